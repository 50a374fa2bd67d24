"""The corpus pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspan.llm.common import release_driver, release_executors, scratch, staged, table, unstage


def _like(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in docs.schema])


def _rest(spark: SparkSession) -> None:
    """Between stages: what the one before left in memory goes."""
    release_driver(spark)
    release_executors(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go. The model is fitted on labelled rows outside the held-out third."""
    from voxspan.llm.toxicity import THRESHOLD, held_out, score, train

    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return _like(score(docs, model, keep=True).where(F.col("toxicity_score") < THRESHOLD), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more that occur earlier, up to two edits, go; a document that loses all its lines goes too."""
    from voxspan.llm.linededup import dedup_lines

    _rest(spark)
    out = dedup_lines(docs)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    # documents that lose nothing keep their count as it is
    return _like(out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 of 100 five-word shingles, directly or by others, one row stays: that with the smallest doc_id."""
    from voxspan.llm.minhash import first_of_each

    _rest(spark)
    return _like(first_of_each(docs, k=5, percent=80), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    from voxspan.llm.packing import pack, token_pieces
    from voxspan.llm.queries import vocabulary

    _rest(spark)
    return pack(token_pieces(docs, vocabulary()))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("MinHash near-dedup", drop_near_duplicates), ("best-fit packing", pack_sequences)]

#: The stages cannot be expressed in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as keep:  # what a stage writes on its way goes when its result is there
            docs = keep(staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}"))
        unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
