"""Invariants of the point-cloud operators, on small clouds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxspan.config import OctreeConfig, PlannerConfig, parse_point
from voxspan.operators import features, forest, graph, ingest, neighbors, octree
from voxspan.sources import files, packed, shapes
from voxspan.sources.adapters import with_defaults
from voxspan.streaming import state

SCHEMA = "frame_id int, x float, y float, z float, entity_id long, room_id int, label int, probability float, has_semantics boolean, is_cross_floor boolean"


def cloud(spark, points, label=0, p=0.0, semantic=False, room=0):
    return spark.createDataFrame([(0, float(x), float(y), float(z), 0, room, label, p, semantic, label == 2) for x, y, z in points], SCHEMA)


def test_grid_splits_and_counts_add_up(spark):
    c = cloud(spark, [(i * 0.5, j * 0.5, 1.0) for i in range(14) for j in range(14)])
    tree = octree.nodes(c, octree.root_bounds(c), OctreeConfig()).collect()
    leaves = [n for n in tree if n.leaf]
    assert len(tree) > len(leaves) > 1
    assert sum(n.n for n in leaves) == 196
    assert sorted(n.node_index for n in tree) == list(range(len(tree)))
    assert len({(n.depth, n.path) for n in tree}) == len(tree)


def test_level_by_level_build_gives_the_same_leaves(spark):
    rng = np.random.default_rng(1)
    points = rng.uniform(0, 6, (400, 3)).astype(np.float32)
    c, cfg = cloud(spark, points.tolist()), OctreeConfig(max_depth=5)
    r = octree.root_bounds(c).first()
    lo, hi = (np.array([r[f"root_{s}_{a}"] for a in "xyz"], np.float32) for s in ("min", "max"))
    found = {}

    def build(own, lo, hi, depth, path):
        size = (hi.astype(float) - lo).max()
        n = len(own)
        split = depth < cfg.max_depth and n >= 6 and size > np.float32(0.2) and (size > 0.5 or n / np.prod(hi.astype(float) - lo) > 220 or n > 36)
        if not split:
            found[depth, path] = n
            return
        mid = np.float32(0.5) * (lo + hi)
        octant = ((own >= mid) * [1, 2, 4]).sum(1)
        for k in range(8):
            up = np.array([k & 1, k >> 1 & 1, k >> 2], bool)
            if (octant == k).any():
                build(own[octant == k], np.where(up, mid, lo), np.where(up, hi, mid), depth + 1, path * 8 + k)

    build(points, lo, hi, 0, 0)
    assert {(x.depth, x.path): x.n for x in octree.leaves(c, cfg).collect()} == found


def test_stair_votes(spark):
    c = cloud(spark, [(0.05 * i, 0, 0.5) for i in range(24)], label=2, p=0.15, semantic=True, room=3)
    for leaf in octree.leaves(c, OctreeConfig()).collect():
        assert leaf.label == 2 and leaf.is_cross_floor and leaf.room_id == 3


def test_empty_cloud_has_no_leaves(spark):
    c = cloud(spark, [(0, 0, 0)]).where("false")
    assert octree.leaves(c, OctreeConfig()).count() == 0


def test_plane_pca(spark):
    c = cloud(spark, [(0, 0, 1), (1, 0, 1), (0, 1, 1), (1, 1, 1), (0.5, 0.5, 1)])
    row = octree.pca(c, ["frame_id"]).first()
    assert row.normal_z > 0.9 and row.flatness > 0.8 and row.curvature < 0.05
    two = octree.pca(c.limit(2), ["frame_id"]).first()
    assert two.normal_z == 0 and two.linearity == 0


def test_points_are_in_the_leaf_that_holds_them(spark):
    c = cloud(spark, np.random.default_rng(2).uniform(0, 4, (200, 3)).tolist())
    roots, cfg = octree.root_bounds(c), OctreeConfig()
    own = octree.leaves(c, cfg, roots)
    got = octree.locate(c.select("frame_id", "x", "y", "z").withColumn("id", F.monotonically_increasing_id()), own, roots, cfg, ["min_x", "max_x", "n"]).collect()
    assert len(got) == 200 and all(r.leaf_min_x <= r.x <= r.leaf_max_x for r in got)
    far = spark.createDataFrame([(0, 99.0, 0.0, 0.0)], "frame_id int, x float, y float, z float")
    assert octree.locate(far, own, roots, cfg).first().leaf_path is None


def test_rooms_close_links(spark):
    a = [(x * 0.3, 0.0, 1.0) for x in range(12)]
    c = cloud(spark, a, semantic=True, room=1).union(cloud(spark, [(x + 3.6, y, z) for x, y, z in a], semantic=True, room=2))
    roots, cfg = octree.root_bounds(c), OctreeConfig(min_points_to_split=1, max_depth=5)
    links = neighbors.face_neighbors(octree.leaves(c, cfg, roots), roots, cfg).collect()
    assert links and all(e.src_room_id == e.dst_room_id for e in links)


def test_obstacles_cost_more(spark):
    rows = spark.createDataFrame([(0, 0.1, False, False, 3), (1, 0.1, False, False, 3), (0, 0.96, False, False, 3), (2, 0.1, True, False, 3)], "label int, probability float, is_cross_floor boolean, dynamic boolean, depth int")
    cost = [r[0] for r in rows.select(neighbors.traversal_cost(OctreeConfig())).collect()]
    assert cost[1] == cost[2] == 1e6 and cost[0] < cost[3] < 1e6


def _corridor(spark):
    c = cloud(spark, [(0.25 * i, 0, 1) for i in range(33)])
    cfg = OctreeConfig(max_depth=5, corridor_max_voxel=0.5, min_points_to_split=1)
    roots = octree.root_bounds(c)
    return graph.with_leaf_id(octree.leaves(c, cfg, roots), cfg), roots, cfg


def _walk(spark, leaves, roots, cfg, plan):
    asked = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0), (2, 0, 8.0, 0.0, 1.0)], "query_id long, frame_id int, x float, y float, z float")
    ends = {r.query_id: r.leaf_id for r in graph.endpoint_snap(asked, leaves, roots, cfg, plan).collect()}
    costs = graph.edge_costs(graph.graph_edges(leaves, neighbors.face_neighbors(leaves, roots, cfg), plan), leaves, cfg, plan)
    q = spark.createDataFrame([(0, 1, ends[1], ends[2])], "frame_id int, query_id long, start_leaf long, goal_leaf long")
    return graph.find_paths(leaves, costs, q, plan).first()


def test_paths_and_risk(spark):
    leaves, roots, cfg = _corridor(spark)
    plan = PlannerConfig(max_non_stair_vertical_step=1.0)
    plain = _walk(spark, leaves, roots, cfg, plan)
    assert plain.success and plain.leaf_ids[0] == plain.start_leaf and plain.leaf_ids[-1] == plain.goal_leaf and plain.total_cost > 0
    assert len(plain.waypoints) <= len(plain.leaf_ids)
    risky = leaves.withColumn("probability", F.when(F.abs(F.col("cx") - 4) < 0.5, 0.6).otherwise(F.col("probability")).cast("float"))
    assert _walk(spark, risky, roots, cfg, plan).total_cost > plain.total_cost


def test_smoothing_keeps_ends_and_breaks():
    def w(i, x, z=0.0, label=0):
        return {"leaf_id": i, "x": x, "y": 0.0, "z": z, "label": label, "probability": 0.0, "is_cross_floor": False, "room_id": 0}

    line = [w(i, float(i)) for i in range(6)]
    assert [p["leaf_id"] for p in graph.smooth(line)] == [0, 5]
    assert 3 in [p["leaf_id"] for p in graph.smooth([*line[:3], w(3, 3.0, 0.3), *line[4:]])]
    assert graph.smooth(line[:2]) == line[:2]


def test_packed_frames_round_trip(spark):
    rows = [(1, i, float(i), 0.5, float("nan") if i == 3 else 1.0, i % 5, 1.5 if i == 4 else 0.25, i) for i in range(51)]
    samples = spark.createDataFrame(rows, "frame_id long, seq long, x float, y float, z float, label int, probability float, entity_id long")
    frames = packed.encode_packed(samples)
    got = packed.decode_packed(frames, 100).orderBy("seq").collect()
    assert len(got) == 50 and got[1].label == 1 and got[2].is_cross_floor and got[3].probability == 1.0 and got[0].source_points == 51
    assert [r.seq for r in packed.decode_packed(frames, 50).orderBy("seq").collect()] == list(range(0, 51, 2))
    short = frames.withColumn("data", F.expr("substring(data, 1, 10)"))
    with pytest.raises(Exception, match="shorter"):
        packed.decode_packed(short).collect()


def test_stride_keeps_every_second_of_51(spark):
    assert ingest.stride_sample(spark.range(51).withColumnRenamed("id", "seq"), 50).count() == 26


def test_numbered_without_partition(spark):
    got = ingest.numbered(spark.range(1000).withColumn("v", 999 - F.col("id")), ["v"]).orderBy("v").collect()
    assert [r.seq for r in got] == list(range(1000))


def test_mesh_triangles(spark):
    v = spark.createDataFrame([(1, i, float(i % 2), float(i // 2), 0.0) for i in range(4)] + [(2, i, float(i), 0.0, float(i * i)) for i in range(3)], "mesh int, vertex long, x double, y double, z double")
    i = spark.createDataFrame([(1, k, n) for k, n in enumerate((0, 1, 2, 1, 2, 3))], "mesh int, at long, vertex long")
    got = shapes.mesh_triangles(v, i, ["mesh"])
    assert {r[0]: r[1] for r in got.groupBy("mesh").count().collect()} == {1: 2, 2: 1}
    assert shapes.sample_triangles(got, 0.5, ["mesh"]).count() > 10


def test_forest_text_round_trip(spark):
    from voxspan.plans.reports import SMALL_FOREST

    nodes = [dict(zip(("forest", "tree", "node", "left", "right", "feature", "threshold", "values"), r, strict=True)) for r in SMALL_FOREST]
    text = forest.write_text(nodes, ["a", "b"])
    inputs, rows = forest.read_text(text)
    assert inputs == ["a", "b"] and [r[:6] for r in rows] == [r[:6] for r in SMALL_FOREST]
    for bad in (text.replace("RFVOXEL_TEXT 1", "RFVOXEL_TEXT 2"), text.replace("END", ""), text.replace("CLASS_COUNT 3", "CLASS_COUNT 4")):
        with pytest.raises(ValueError):
            forest.read_text(bad)


def test_predictions_keep_bad_rows(spark):
    from voxspan.plans.reports import SMALL_FOREST

    rows = spark.createDataFrame([("1", "2"), ("x", "2")], "a string, b string")
    got = forest.predict_rows(rows, SMALL_FOREST, ["a", "b"]).orderBy("a").collect()
    assert got[0].predicted_label == 0 and got[1].predicted_label is None
    with pytest.raises(ValueError):
        forest.predict_rows(rows, SMALL_FOREST, ["c"])


def test_feature_columns_and_names():
    assert len(features.FEATURE_COLUMNS) == 50 and features.FEATURE_COLUMNS[0] == "node_index" and features.FEATURE_COLUMNS[-1] == "obstacle_probability"
    assert files.output_path("data/leaf.csv", 7, True) == "data/train_leaf_frame000007.csv"
    assert files.prediction_files(["b.csv", "train_a.csv", "predicted_b.csv", "a.csv"], []) == ["a.csv", "b.csv"]
    assert parse_point("1,2,3") == (1.0, 2.0, 3.0) and parse_point("1,,3") is None


def test_throttle_stream_is_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", "ts", "event_id")
    events.write.parquet(str(tmp_path / "in"))
    want = {r.event_id for r in state.throttle(events, "event_type", 7200).collect()}
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = state.throttle_stream(stream, "event_type", 7200).writeStream.format("memory").queryName("through").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id for r in spark.table("through").collect()} == want


def test_frames_job(spark, tmp_path):
    from voxspan.streaming import jobs

    rows = [(f, i, float(i % 5), float(i // 5), 1.0, i % 3, 0.2, 1) for f in (1, 2) for i in range(30)]
    samples = spark.createDataFrame(rows, "frame_id long, seq long, x float, y float, z float, label int, probability float, entity_id long")
    packed.encode_packed(samples).write.parquet(str(tmp_path / "frames"))
    seen = []
    q = jobs.run_frames(jobs.frame_stream(spark, str(tmp_path / "frames")), lambda df, b: seen.append(jobs.leaf_features_of(df).groupBy("frame_id").agg(F.sum("num_points").alias("n")).collect()), str(tmp_path / "c"), once=True)
    q.awaitTermination(180)
    assert {r.frame_id: r.n for rows in seen for r in rows} == {1: 30, 2: 30}


def test_updates_decay(spark):
    start = spark.createDataFrame([(1, 5, 0, 0, 0.9, False)], "leaf long, n long, label int, room_id int, probability double, is_cross_floor boolean")
    hits = spark.createDataFrame([(1, s, s == 1, 2, 7, 1.0) for s in range(1, 4)], "leaf long, seq long, has_semantics boolean, label int, room_id int, probability double")
    row = state.update_leaves(start, hits).first()
    assert row.n == 8 and row.label == 2 and row.room_id == 7 and row.dynamic and abs(row.probability - 0.64) < 1e-9


def test_defaults_have_no_semantics(spark):
    row = with_defaults(spark.createDataFrame([(1.0, 2.0, 3.0)], "x float, y float, z float")).first()
    assert not row.has_semantics and row.label == 0


def test_pace_drops_what_comes_early_or_while_it_runs():
    from voxspan.streaming.jobs import Pace

    now, ran = [0.0], []

    def each(df, batch):
        ran.append(batch)
        if batch == 4:
            now[0] += 10
            pace(None, 99)  # comes while batch 4 runs

    pace = Pace(each, 2.0, clock=lambda: now[0])
    for batch, t in enumerate([0.0, 0.5, 1.9, 2.0, 5.0, 15.5]):
        now[0] = t
        pace(None, batch)
    assert ran == [0, 3, 4, 5] and pace.ran == 4 and pace.dropped == 3  # 1, 2, and 99 while 4 ran


def test_later_feature_files_need_the_columns_of_the_first(spark, tmp_path):
    for name, text in (("a.csv", "depth,label\n1,0\n"), ("b.csv", "label,more,depth\n2,x,7\n"), ("c.csv", "label\n1\n")):
        (tmp_path / name).write_text(text)
    both = files.read_features(spark, [f"{tmp_path}/b.csv", f"{tmp_path}/a.csv"]).select("depth", "label").collect()
    assert sorted((r.depth, r.label) for r in both) == [("1", "0"), ("7", "2")]
    with pytest.raises(ValueError, match="depth"):
        files.read_features(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/c.csv"])


def test_what_a_search_says(spark, monkeypatch):
    monkeypatch.setattr(graph, "QUERIES_AT_ONCE", 2)
    rows = [(0, i, 1 if i == 4 else 0, 0.1, False, 0, float(i), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0) for i in range(6)]
    leaves = spark.createDataFrame(rows, "frame_id int, leaf_id long, label int, probability float, is_cross_floor boolean, room_id int, cx double, cy double, cz double, min_x float, min_y float, min_z float, max_x float, max_y float, max_z float")
    costs = spark.createDataFrame([(0, i, i + 1, 1.0, 0) for i in (0, 1)], "frame_id int, src_leaf_id long, dst_leaf_id long, cost double, ord int")
    asked = [(0, 1, 0, 2, None, 0.5), (0, 2, None, 2, None, None), (0, 3, 0, None, None, None), (0, 4, 0, 77, None, None), (0, 5, 4, 0, None, None), (0, 6, 0, 4, None, None), (0, 7, 0, 5, None, None), (0, 8, 3, 3, 0.25, 0.125)]
    q = spark.createDataFrame(asked, "frame_id int, query_id long, start_leaf long, goal_leaf long, start_snap double, goal_snap double")
    got = {r.query_id: r for r in graph.find_paths(leaves, costs, q, PlannerConfig()).collect()}
    assert [got[i].message for i in range(1, 9)] == [
        "Path found (goal snapped 0.500000m)", graph.NO_START, graph.NO_GOAL, graph.OUT_OF_RANGE, graph.START_BLOCKED, graph.GOAL_BLOCKED, graph.NO_PATH, "Path found (start snapped 0.250000m, goal snapped 0.125000m)",
    ]
    assert got[1].expanded == 3 and got[1].total_cost == 2.0 and got[7].expanded == 3 and got[8].expanded == 0
    capped = graph.find_paths(leaves, costs, q.where("query_id = 1"), PlannerConfig(max_expansions=2)).first()
    assert capped.message == graph.CAPPED and capped.expanded == 2


def test_numbers_over_ordered_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    got = ingest.numbered(df, ["k"]).collect()
    assert all(r.k == r.seq for r in got) and len(got) == 1000


def test_forests_are_saved_whole(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 3).cast("int").alias("label"), (F.col("id") % 3 * 1.0).alias("a"), (F.col("id") % 5 * 1.0).alias("b"), (F.col("id") % 3 / 2.0).alias("obstacle_probability"))
    model = forest.train(rows, ["a", "b"], trees=3, depth=3)
    files.save_forests(model, f"{tmp_path}/m")
    back = files.load_forests(spark, f"{tmp_path}/m")
    tables = [sorted(map(tuple, forest.forest_table(m, spark).select("forest", "tree", "node", "left", "right", "feature", "threshold").collect())) for m in (model, back)]
    assert tables[0] == tables[1] and back.inputs == ["a", "b"]


def test_memory_is_told():
    from voxspan.operators import view

    told = view.memory_kb()
    assert 0 < told["rss_kb_after"] <= told["peak_rss_kb"] * 1.1


def test_a_point_on_a_cut_finer_than_a_leaf(spark):
    # the coarse leaf ends at x = 4; the fine one begins there and ends at y = 2, a cut inside the coarse one
    leaves = spark.createDataFrame([(0, 1, 0, 4.0, 4.0, 4.0), (0, 2, 8, 6.0, 2.0, 2.0)], "frame_id int, depth int, path long, max_x float, max_y float, max_z float")
    roots = spark.createDataFrame([(0, *[0.0] * 3, *[8.0] * 3)], "frame_id int, " + ", ".join(f"root_{s}_{a} float" for s in ("min", "max") for a in "xyz"))
    points = spark.createDataFrame([(0, 4.0, 2.0, 1.5), (0, 4.0, 3.5, 1.5), (0, 4.0, 5.0, 1.5)], "frame_id int, x float, y float, z float")
    got = octree.locate(points, leaves, roots, OctreeConfig(max_depth=3)).collect()
    assert {r.y: (r.leaf_depth, r.leaf_path) for r in got} == {2.0: (2, 8), 3.5: (1, 0), 5.0: (None, None)}


def test_lines_past_blocked_leaves(spark):
    rng = np.random.default_rng(3)
    at, half = rng.normal(0, 1.2, (400, 3)), rng.choice([0.02, 0.05, 0.1, 0.9], 400, p=[0.5, 0.3, 0.19, 0.01])
    rows = [(0, i, 1 if i % 2 else 0, 0.1, *[float(v) for v in at[i]], *[float(v) for v in at[i] - half[i]], *[float(v) for v in at[i] + half[i]]) for i in range(400)]
    leaves = spark.createDataFrame(rows, "frame_id int, leaf_id long, label int, probability float, cx double, cy double, cz double, min_x float, min_y float, min_z float, max_x float, max_y float, max_z float")
    pairs = [(i, j) for i in range(0, 400, 3) for j in range(0, 400, 8) if i != j]
    edges = spark.createDataFrame([(0, i, j, *[float(v) for v in (*at[i], *at[j])]) for i, j in pairs], "frame_id int, src_leaf_id long, dst_leaf_id long, src_cx double, src_cy double, src_cz double, dst_cx double, dst_cy double, dst_cz double")
    cfg = PlannerConfig()
    box = {r.leaf_id: r for r in graph.obstacles(leaves, cfg).collect()}
    widest = max(r.planar_radius for r in box.values())

    def hit(i, j):
        s, t = at[i], at[j]
        for o, r in box.items():
            low, high = (np.floor((f(s, t)[:2] + w) / cfg.obstacle_cell) for f, w in ((np.minimum, -widest), (np.maximum, widest)))
            if o in (i, j) or (np.array([r.cell_x, r.cell_y]) < low).any() or (np.array([r.cell_x, r.cell_y]) > high).any():
                continue
            u = min(1.0, max(0.0, (at[o] - s) @ (t - s) / ((t - s) @ (t - s))))
            if np.linalg.norm(at[o] - s - u * (t - s)) <= r.radius + cfg.edge_obstacle_clearance_radius:
                return True
        return False

    short = [p for p in pairs if np.linalg.norm(at[p[0]] - at[p[1]]) < 1.25][:300]
    far = [p for p in pairs if np.linalg.norm(at[p[0]] - at[p[1]]) >= 1.25][:300]
    for some, longest in ((short, 1.25), (short + far, None)):
        asked = edges.join(spark.createDataFrame(some, "src_leaf_id long, dst_leaf_id long"), ["src_leaf_id", "dst_leaf_id"])
        got = {(r.src_leaf_id, r.dst_leaf_id) for r in graph.blocked_segments(asked, leaves, cfg, longest).collect()}
        assert got == {p for p in some if hit(*p)} and 0 < len(got) < len(some)


def test_a_listing_is_numbered_without_the_driver(spark):
    names = [f"data/{('', 'train_', 'predicted_')[i % 3]}leaves{i % 50:03d}{('.csv', '.txt')[i % 4 == 0]}" for i in range(700)]
    df = spark.createDataFrame([(n,) for n in [*names, None]], "name string")
    training = df.where(F.col("name").endswith("3.csv"))
    want = files.prediction_files(names, [n for n in names if n.endswith("3.csv")])
    got = files.prediction_listing(df, training).collect()
    assert sorted((r.at, r.name) for r in got) == list(enumerate(want)) and len(want) > len(set(want))


def test_stair_edges_are_judged_where_they_are_found(spark):
    rng = np.random.default_rng(5)
    kinds = "frame_id int, leaf_id long, label int, probability float, is_cross_floor boolean, room_id int, entity_id long, dynamic boolean, depth int, " + ", ".join(f"{s}_{a} float" for s in ("min", "max") for a in "xyz") + ", cx double, cy double, cz double"
    at = rng.uniform(0, 2.5, (250, 3))
    rows = [(0, i, (0, 2, 0, 1)[i % 4], 0.1, i % 4 == 1, 0, i % 3, False, 3, *[float(v) - 0.1 for v in at[i]], *[float(v) + 0.1 for v in at[i]], *[float(v) for v in at[i]]) for i in range(250)]
    leaves, plan = spark.createDataFrame(rows, kinds), PlannerConfig(stair_direction_dot_min=0.1)
    components = graph.stair_components(leaves, plan)
    by_leaf = graph.staircases(components, graph.component_stats(leaves, components, plan))
    want = graph.with_staircase(graph.stair_edges(leaves, plan), by_leaf).where(graph.allowed_transition(plan))
    got, want = ({(r.src_leaf_id, r.dst_leaf_id): (r.src_label, r.dst_label) for r in df.collect()} for df in (graph.walkable_stair_edges(leaves, by_leaf, plan), want))
    assert got == want and {(0, 2), (2, 0), (2, 2)} == set(got.values())


def _random_graph():
    rng = np.random.default_rng(2)
    return {a: [(int(b), float(c)) for b, c in zip(rng.integers(0, 60, 3), rng.uniform(0.1, 2, 3), strict=True)] for a in range(50)}


def test_one_search_without_estimate_serves_all_goals(monkeypatch):
    out, calls, search = _random_graph(), [], graph._search
    for most in (200_000, 20):
        want = {(s, g): search(s, g, out, lambda _: 0.0, most) for s in (0, 55) for g in range(62)}
        monkeypatch.setattr(graph, "_search", lambda *a: calls.append(a[:2]) or search(*a))
        searches = graph._Searches(out, PlannerConfig(heuristic_weight=0.0, max_expansions=most))
        assert {k: searches.path(*k, lambda _: 0.0) for k in want} == want
        monkeypatch.setattr(graph, "_search", search)
    assert len(calls) == 2 * 4  # for each start, once for all goals and once for itself


def test_queries_with_the_same_ends_share_a_search(monkeypatch):
    out, calls, search = _random_graph(), [], graph._search
    monkeypatch.setattr(graph, "_search", lambda *a: calls.append(a[:2]) or search(*a))
    searches = graph._Searches(out, PlannerConfig())
    assert len({str(searches.path(3, 3, lambda _: 0.0)) for _ in range(50)}) == 1 and calls == [(3, 3)]


def test_a_start_that_reaches_too_little_is_searched_once(monkeypatch):
    out, calls, search = {0: [(1, 1.0)], 1: [(2, 1.0)], 2: [(0, 1.0)]}, [], graph._search
    want = {g: search(0, g, out, lambda _: 0.5, 200_000) for g in (2, 7, 8, 9, 1)}
    monkeypatch.setattr(graph, "_search", lambda *a: calls.append(a[:2]) or search(*a))
    searches = graph._Searches(out, PlannerConfig())
    assert {g: searches.path(0, g, lambda _: 0.5) for g in want} == want
    assert calls == [(0, 2), (0, 7), (0, 1)]


def test_dealt_cells_are_not_gathered_in_the_driver(spark):
    sides = [spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0)], f"frame_id int, {e}_leaf_id long, " + ", ".join(f"{e}_c{k} double" for k in "xyz")) for e in ("src", "dst")]
    plan = graph.within_radius(*sides, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_points_meet_leaves_in_blocks(spark):
    # the cells of a random tree, some of them without a leaf, some wider than a block, and points on their cuts
    rng = np.random.default_rng(9)
    cfg, tree = OctreeConfig(max_depth=6), []

    def grow(depth, path):
        if depth < 6 and rng.random() < (1.0 if depth < 2 else 0.3):
            for octant in range(8):
                grow(depth + 1, path * 8 + octant)
        elif rng.random() < 0.9:
            low = [sum((path >> 3 * level + axis & 1) << level for level in range(depth)) * 64 / 2**depth for axis in range(3)]
            tree.append((depth, path, *[float(x + 64 / 2**depth) for x in low]))

    grow(0, 0)
    frames = [1, 2]
    leaves = spark.createDataFrame([(f, *r) for f in frames for r in tree if f == 1 or r[0] > 2], "frame_id int, depth int, path long, max_x float, max_y float, max_z float")
    roots = spark.createDataFrame([(f, *[0.0] * 3, *[64.0] * 3) for f in frames], "frame_id int, " + ", ".join(f"root_{s}_{a} float" for s in ("min", "max") for a in "xyz"))
    spots = [*rng.integers(0, 65, (300, 3)).astype(float).tolist(), *rng.uniform(0, 64, (300, 3)).astype(np.float32).astype(float).tolist()]
    points = spark.createDataFrame([(f, i, *p) for f in frames for i, p in enumerate(spots)], "frame_id int, id long, x float, y float, z float")
    want = {}
    for f in frames:
        for i, p in enumerate(spots):
            held = []
            for depth, path, *top in tree:
                wide = 64 / 2**depth
                if (f == 1 or depth > 2) and all(t - wide <= x <= t for x, t in zip(p, top, strict=True)):
                    octant = sum((x < t) << k for k, (x, t) in enumerate(zip(p, top, strict=True)))
                    held.append((-1 if octant == 7 else octant, 8**depth | path))
            if held:
                want[f, i] = min(held)[1]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in ("37", was):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            assert {(r.frame_id, r.id): r._place for r in octree.holding(points, leaves, roots, cfg, ["frame_id", "id"]).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    # a row for a point that is on no cut, eight at most; a leaf above the blocks lies in those below it
    sent = octree.dealt(points, leaves, roots, cfg, ["frame_id", "id"])
    times = {(r.frame_id, r.id): r.n for r in sent.where("_kind = 1").groupBy("frame_id", "id").agg(F.count("id").alias("n")).collect()}
    assert max(times.values()) == 8 and all(times[f, i] == 1 for f in frames for i in range(300, 600))
    assert sent.where("_kind = 0 and frame_id = 1").count() == sum(8 ** max(0, octree.HELD_DEPTH - r[0]) for r in tree)


def test_tables_that_grow_are_not_gathered_in_the_driver(spark, monkeypatch):
    from voxspan.functions import components

    plans, write = [], components.written

    def seen(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    c = cloud(spark, np.random.default_rng(3).uniform(0, 4, (300, 3)).tolist(), label=2, p=0.2, semantic=True)
    roots, cfg = write(octree.root_bounds(c), "roots"), OctreeConfig()
    tree = write(graph.with_leaf_id(octree.leaves(c, cfg, roots), cfg), "tree")
    faces = write(neighbors.face_links(tree, roots, cfg), "faces")
    monkeypatch.setattr(components, "written", seen)
    monkeypatch.setattr(graph, "written", seen)
    edges = graph.graph_edges(tree, faces, PlannerConfig())
    plans.append(edges._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4 and not any("BroadcastHashJoin" in p for p in plans)


def test_writing_a_table_lets_the_driver_collect(spark, monkeypatch):
    from voxspan.functions import components

    calls = []
    monkeypatch.setattr(components, "release_driver", calls.append)
    assert components.written(spark.range(3), "three").count() == 3 and calls == [spark]
