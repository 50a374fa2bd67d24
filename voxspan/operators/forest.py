"""Random forests over leaf features: training, tables of trees, inference, and their measures."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.geometry import d
from .features import FEATURE_COLUMNS, NOT_INPUTS

FOREST_SCHEMA = "forest string, tree int, node int, left int, right int, feature int, threshold float, values array<float>"
INPUTS = [c for c in FEATURE_COLUMNS if c not in NOT_INPUTS]
CLASSES = 3
#: Slices of a class in split_rows(), in bits of the hash.
SLICE_BITS = 12


# --- training rows --------------------------------------------------------------------------------------------------


def training_rows(rows: DataFrame, inputs: list[str], label: str = "label", probability: str = "obstacle_probability") -> DataFrame:
    """Rows as training takes them: text or numbers to doubles, labels cut to whole numbers, probabilities clamped; `valid` says whether a row counts."""
    numbers = [F.expr(f"try_cast(`{c}` as double)").alias(c) for c in inputs]
    y, p = F.expr(f"try_cast(`{label}` as double)"), F.expr(f"try_cast(`{probability}` as double)")
    rest = [c for c in rows.columns if c not in (*inputs, label, probability)]
    out = rows.select(*rest, *numbers, y.alias("_y"), p.alias("_p"))
    fine = F.lit(True)
    for c in (*inputs, "_y", "_p"):
        fine = fine & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    whole = F.when(fine, F.signum("_y") * F.floor(F.abs(F.col("_y")))).cast("int")
    out = out.withColumn(label, whole).withColumn("valid", F.coalesce(fine & whole.isin(0, 1, 2), F.lit(False)))
    return out.withColumn(probability, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_p")))).drop("_y", "_p")


def label_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def check_training(rows: DataFrame, least: int = 1, least_per_class: int = 2) -> None:
    """Raises ValueError if there are too few rows, or too few of a class that occurs."""
    counts = {r[0]: r[1] for r in label_counts(rows).collect()}  # a number for each class
    if sum(counts.values()) < least:
        raise ValueError(f"{sum(counts.values())} training rows; at least {least} are needed")
    if few := {k: v for k, v in counts.items() if v < least_per_class}:
        raise ValueError(f"too few rows of classes {few}")


def split_rows(rows: DataFrame, share: float, keys: list[str], label: str = "label", seed: int = 42) -> DataFrame:
    """Adds `test`: of all rows ceil(n * share), dealt to the classes by their size (the largest remainders round up, the
    smaller label first), and of each class those with the smallest hashes of the keys; rows with equal keys in any order.

    Rows are ranked within slices of the hash, and the sizes of a class's slices before are added, so no class is sorted in one task.
    """
    if not 0 < share < 0.5:
        raise ValueError("the share of test rows is between 0 and 0.5")
    h = F.xxhash64(F.lit(seed), label, *keys)
    sliced = rows.withColumn("_h", h).withColumn("_slice", F.shiftright("_h", 64 - SLICE_BITS))
    sizes = sliced.groupBy(label, "_slice").agg(F.count(F.lit(1)).alias("_n"))  # 2 ** SLICE_BITS rows for a class
    by_class = sizes.groupBy(label).agg(F.sum("_n").alias("_of"))  # a row for each class
    every = by_class.withColumn("_all", F.sum("_of").over(Window.partitionBy()))
    every = every.withColumn("_test", F.ceil(F.col("_all") * F.lit(share))).withColumn("_exact", F.col("_of") * F.col("_test") / F.col("_all"))
    left = F.col("_test") - F.sum(F.floor("_exact")).over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(F.col("_exact") - F.floor("_exact")), label))
    quota = every.withColumn("_quota", F.floor("_exact") + (place <= left).cast("long")).select(label, "_quota")
    before = F.sum("_n").over(Window.partitionBy(label).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(label, "_slice", F.coalesce(before, F.lit(0)).alias("_before")).join(F.broadcast(quota), label)
    rank = F.row_number().over(Window.partitionBy(label, "_slice").orderBy("_h")) - 1
    return sliced.withColumn("_rank", rank).join(sizes, [label, "_slice"]).withColumn("test", F.col("_rank") + F.col("_before") < F.col("_quota")).drop("_h", "_slice", "_rank", "_before", "_quota")


# --- training and tables of trees -----------------------------------------------------------------------------------


@dataclass
class Forests:
    classifier: object
    regressor: object
    inputs: list[str]


def train(rows: DataFrame, inputs: list[str], trees: int = 300, least: int = 2, depth: int = 12, seed: int = 42) -> Forests:
    """A classifier of the label, with classes weighed alike, and a regressor of the probability.

    Spark grows trees level by level to a depth of 30 at most; `depth` may be set that far.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    counts = label_counts(rows).select("label", (F.lit(1.0) / F.col("rows")).alias("_inverse"))
    total = rows.count() / max(1, counts.count())
    weighed = rows.join(F.broadcast(counts), "label").withColumn("_weight", F.col("_inverse") * total)  # a row for each class
    x = VectorAssembler(inputCols=inputs, outputCol="_x").transform(weighed).withColumn("_label", d("label")).select("_x", "_label", "_weight", "obstacle_probability")
    own = dict(featuresCol="_x", numTrees=trees, minInstancesPerNode=least, maxDepth=depth, seed=seed)
    classifier = RandomForestClassifier(labelCol="_label", weightCol="_weight", **own).fit(x)
    regressor = RandomForestRegressor(labelCol="obstacle_probability", **own).fit(x)
    return Forests(classifier, regressor, inputs)


def importances(model: Forests, spark: SparkSession, most: int = 15) -> DataFrame:
    """The most important inputs of both forests."""
    rows = [(forest, name, float(v)) for forest, m in (("classifier", model.classifier), ("regressor", model.regressor)) for name, v in zip(model.inputs, m.featureImportances.toArray(), strict=True)]
    return top_inputs(spark.createDataFrame(rows, "forest string, feature string, importance double"), most)


def top_inputs(rows: DataFrame, most: int = 15) -> DataFrame:
    """The `most` rows (forest, feature, importance) of each forest with the highest importance, by name on ties."""
    order = Window.partitionBy("forest").orderBy(F.desc("importance"), "feature")
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")


def facts(table: DataFrame) -> DataFrame:
    """What a table of trees (FOREST_SCHEMA) holds: trees, nodes, leaves and the highest input of each forest."""
    leaf = F.col("left") < 0
    return table.groupBy("forest").agg(F.countDistinct("tree").alias("trees"), F.count(F.lit(1)).alias("nodes"), F.count_if(leaf).alias("leaves"), F.coalesce(F.max(F.when(~leaf, F.col("feature"))), F.lit(-1)).alias("highest_feature"))


def forest_table(model: Forests, spark: SparkSession) -> DataFrame:
    """Both forests as rows of nodes. Only splits on continuous features are written, as leaf features are."""
    rows = []
    for forest, m in (("classifier", model.classifier), ("regressor", model.regressor)):
        for t, tree in enumerate(m._call_java("trees")):
            todo, made = [(tree.rootNode(), None, "")], 0
            nodes: list[list] = []
            while todo:
                node, parent, side = todo.pop()
                own, made = made, made + 1
                if parent is not None:
                    nodes[parent][3 if side == "left" else 4] = own
                kind = node.getClass().getSimpleName()
                if kind == "InternalNode":
                    nodes.append([forest, t, own, -1, -1, int(node.split().featureIndex()), float(node.split().threshold()), []])
                    todo += [(node.rightChild(), own, "right"), (node.leftChild(), own, "left")]
                else:
                    stats = list(node.impurityStats().stats())
                    total = sum(stats) or 1.0
                    values = [float(stats[i]) / total if i < len(stats) else 0.0 for i in range(CLASSES)] if forest == "classifier" else [float(node.prediction())]
                    nodes.append([forest, t, own, -1, -1, -1, 0.0, values])
            rows += nodes
    return spark.createDataFrame(rows, FOREST_SCHEMA)


def write_text(nodes: list[dict], inputs: list[str]) -> str:
    """The text form of two forests (rows of FOREST_SCHEMA)."""
    out = ["RFVOXEL_TEXT 1", f"FEATURE_COUNT {len(inputs)}", *(f"FEATURE {i} {name}" for i, name in enumerate(inputs)), "CLASS_COUNT 3", "CLASSES 0 1 2"]
    for forest in ("classifier", "regressor"):
        own = [n for n in nodes if n["forest"] == forest]
        trees = sorted({n["tree"] for n in own})
        out.append(f"{forest.upper()}_TREES {len(trees)}")
        for t in trees:
            rows = sorted((n for n in own if n["tree"] == t), key=lambda n: n["node"])
            out.append(f"TREE {t} {len(rows)}")
            out += [" ".join(["NODE", *map(str, (n["node"], n["left"], n["right"], n["feature"])), f"{n['threshold']:.17g}", *(f"{v:.17g}" for v in n["values"] or [0.0] * (CLASSES if forest == "classifier" else 1))]) for n in rows]
    return "\n".join([*out, "END"]) + "\n"


def read_text(text: str) -> tuple[list[str], list[tuple]]:
    """Inputs and rows of FOREST_SCHEMA from the text form. Raises ValueError if anything is out of place."""
    lines = iter([x.split() for x in text.splitlines() if x.strip()])

    def take(word: str) -> list[str]:
        got = next(lines, [])
        if not got or got[0] != word:
            raise ValueError(f"expected {word}, found {' '.join(got) or 'the end'}")
        return got[1:]

    if take("RFVOXEL_TEXT") != ["1"]:
        raise ValueError("unknown version")
    inputs = []
    for i in range(int(take("FEATURE_COUNT")[0])):
        at, name = take("FEATURE")
        if int(at) != i:
            raise ValueError("features are out of order")
        inputs.append(name)
    if take("CLASS_COUNT") != ["3"] or take("CLASSES") != ["0", "1", "2"]:
        raise ValueError("classes must be 0 1 2")
    rows = []
    for forest, width in (("classifier", CLASSES), ("regressor", 1)):
        for t in range(int(take(f"{forest.upper()}_TREES")[0])):
            at, n = map(int, take("TREE"))
            if at != t:
                raise ValueError("trees are out of order")
            for k in range(n):
                got = take("NODE")
                if len(got) != 5 + width or int(got[0]) != k:
                    raise ValueError(f"bad node {k} of tree {t}")
                left, right, feature = map(int, got[1:4])
                rows.append((forest, t, k, left, right, feature, float(np.float32(got[4])), [] if left >= 0 else [float(np.float32(v)) for v in got[5:]]))
    take("END")
    return inputs, rows


# --- inference ------------------------------------------------------------------------------------------------------


def predictor(nodes: list[tuple], inputs: list[str]) -> Column:
    """A column of struct<label, probability> from feature columns: x <= threshold goes left; class values are added up and
    ties go to the lower class; the probability is the mean over trees. A tree with a broken link is left out."""
    trees: dict[tuple[str, int], list[tuple]] = {}
    for row in nodes:
        trees.setdefault((row[0], row[1]), []).append(row)
    if not trees:
        raise ValueError("the forest has no trees")
    packed = []
    for (forest, _), rows in sorted(trees.items()):
        rows = sorted(rows, key=lambda r: r[2])
        links = np.array([r[3:6] for r in rows])
        if ((links[:, :2] >= len(rows)) | ((links[:, 2] >= len(inputs))[:, None])).any():
            continue
        values = np.array([list(r[7]) or [0.0] * (CLASSES if forest == "classifier" else 1) for r in rows], np.float32)
        packed.append((forest, links, np.array([r[6] for r in rows], np.float32), values))

    @pandas_udf("label int, probability double")
    def predict(*columns: pd.Series) -> pd.DataFrame:
        x = np.stack([c.to_numpy(np.float32) for c in columns], 1)
        votes, p, n = np.zeros((len(x), CLASSES)), np.zeros(len(x)), 0
        for forest, links, threshold, values in packed:
            at = np.zeros(len(x), np.int64)
            live = np.flatnonzero(links[at, 0] >= 0)
            while len(live):
                i = at[live]
                left = x[live, links[i, 2]] <= threshold[i]
                at[live] = np.where(left, links[i, 0], links[i, 1])
                live = live[links[at[live], 0] >= 0]
            if forest == "classifier":
                votes += values[at]
            else:
                p += values[at, 0]
                n += 1
        return pd.DataFrame({"label": votes.argmax(1).astype(np.int32), "probability": np.clip(p / max(n, 1), 0, 1)})

    return predict(*[F.col(c) for c in inputs])


def predict_rows(rows: DataFrame, nodes: list[tuple], inputs: list[str]) -> DataFrame:
    """Rows with predicted_label and predicted_obstacle_probability (six decimals); rows with an input that is no number stay, with nulls."""
    missing = [c for c in inputs if c not in rows.columns]
    if missing:
        raise ValueError(f"missing inputs: {missing}")
    numbers = rows.select("*", *[F.expr(f"try_cast(`{c}` as double)").alias(f"_{c}") for c in inputs])
    fine = F.lit(True)
    for c in inputs:
        fine = fine & F.col(f"_{c}").isNotNull()
    filled = numbers.withColumn("_fine", fine)
    p = predictor(nodes, [f"_{c}" for c in inputs])
    out = filled.withColumn("_p", p)
    return out.select(*rows.columns, F.when(F.col("_fine"), F.col("_p.label")).alias("predicted_label"), F.when(F.col("_fine"), F.round("_p.probability", 6)).alias("predicted_obstacle_probability"))


# --- measures -------------------------------------------------------------------------------------------------------


def confusion_matrix(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("rows"))


def class_metrics(rows: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of each class that occurs, and their macro and weighted means; 0 where a divisor is zero."""
    pairs = confusion_matrix(rows, truth, predicted)
    sides = pairs.select(F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("s"), "rows").select("s.*", "rows")
    by = sides.groupBy("c").agg(*[F.sum(F.col(k) * F.col("rows")).alias(k) for k in ("t", "p", "hit")])

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    by = by.withColumn("precision", ratio(F.col("hit"), F.col("p"))).withColumn("recall", ratio(F.col("hit"), F.col("t")))
    by = by.withColumn("f1", ratio(F.col("precision") * F.col("recall") * 2.0, F.col("precision") + F.col("recall")))
    one = by.select(F.col("c").cast("string").alias("class"), "precision", "recall", "f1", F.col("t").alias("support"))
    measures = ("precision", "recall", "f1")
    macro = one.agg(F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support"))
    weighted = one.agg(F.lit("weighted avg").alias("class"), *[ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures], F.sum("support").alias("support"))
    hit = by.agg(F.lit("accuracy").alias("class"), *[ratio(F.sum("hit"), F.sum("t")).alias(m) for m in measures], F.sum("t").alias("support"))
    return one.unionByName(macro).unionByName(weighted).unionByName(hit)


def probability_errors(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean absolute error, root mean square error and R squared."""
    e = d(truth) - d(predicted)
    out = rows.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("_rest"), (F.var_pop(d(truth)) * F.count(F.lit(1))).alias("_all"))
    return out.select("rows", "mae", "rmse", (F.lit(1.0) - F.try_divide(F.col("_rest"), F.col("_all"))).alias("r2"))
