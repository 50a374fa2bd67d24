"""Packed point frames: decoding from bytes and encoding to them, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The types a packed field may have, by name, and the layout that is written.
TYPES = {"FLOAT32": "<f4", "UINT32": "<u4"}
LAYOUT = [("x", 0, "FLOAT32"), ("y", 4, "FLOAT32"), ("z", 8, "FLOAT32"), ("label", 12, "UINT32"), ("obstacle_probability", 16, "FLOAT32"), ("entity_id", 20, "UINT32")]
POINT_STEP = 24
FRAME_SCHEMA = "frame_id long, width int, height int, point_step int, fields array<struct<name:string,offset:int,datatype:string>>, data binary"
SAMPLE_SCHEMA = "frame_id long, seq long, source_points long, x float, y float, z float, entity_id long, room_id int, label int, probability float, has_semantics boolean, is_cross_floor boolean"


def field_offsets(fields: list[dict]) -> dict[str, int]:
    """Offsets of the fields that are known by name and type; `xyz` stands for three floats in a row."""
    wanted = {"x": "FLOAT32", "y": "FLOAT32", "z": "FLOAT32", "xyz": "FLOAT32", "obstacle_probability": "FLOAT32", "label": "UINT32", "entity_id": "UINT32"}
    found = {f["name"]: f["offset"] for f in fields if wanted.get(f["name"]) == f["datatype"]}
    if "xyz" in found:
        at = found.pop("xyz")
        found |= {"x": at, "y": at + 4, "z": at + 8}
    return found


def decode_frame(frame: dict, max_points: int, finite_first: bool = False) -> dict[str, np.ndarray] | None:
    """Samples of one frame, every ceil(n / max_points)th point; with finite_first, points that are not finite go before that."""
    n, step = frame["width"] * frame["height"], frame["point_step"]
    if n == 0 or step == 0:
        return None
    at = field_offsets(frame["fields"])
    if not {"x", "y", "z"} <= at.keys():
        raise ValueError(f"frame {frame['frame_id']}: no float fields x, y, z or xyz")
    if len(frame["data"]) < n * step:
        raise ValueError(f"frame {frame['frame_id']}: data is shorter than width * height * point_step")
    kinds = {k: TYPES["UINT32" if k in ("label", "entity_id") else "FLOAT32"] for k in at}
    dtype = np.dtype({"names": list(at), "formats": [kinds[k] for k in at], "offsets": list(at.values()), "itemsize": step})
    rows = np.frombuffer(frame["data"], dtype, n)
    seq = np.arange(n)
    finite = np.isfinite(rows["x"]) & np.isfinite(rows["y"]) & np.isfinite(rows["z"])
    if finite_first:
        rows, seq, finite = rows[finite], seq[finite], finite[finite]
    stride = max(1, -(-len(rows) // max_points))
    keep = np.arange(len(rows)) % stride == 0
    keep &= finite
    rows, seq = rows[keep], seq[keep]
    semantic = {"label", "obstacle_probability"} <= at.keys()
    label = rows["label"].astype(np.int32) if semantic else np.zeros(len(rows), np.int32)
    label = np.where(np.isin(label, (1, 2)), label, 0).astype(np.int32)
    p = rows["obstacle_probability"] if semantic else np.zeros(len(rows), np.float32)
    p = np.clip(np.where(np.isfinite(p), p, 0), 0, 1).astype(np.float32)
    entity = rows["entity_id"].astype(np.int64) if semantic and "entity_id" in at else np.zeros(len(rows), np.int64)
    return {
        "frame_id": np.full(len(rows), frame["frame_id"], np.int64), "seq": seq, "source_points": np.full(len(rows), n, np.int64),
        "x": rows["x"].astype(np.float32), "y": rows["y"].astype(np.float32), "z": rows["z"].astype(np.float32), "entity_id": entity,
        "room_id": np.zeros(len(rows), np.int32), "label": label, "probability": p,
        "has_semantics": np.full(len(rows), semantic), "is_cross_floor": label == 2,
    }


def decode_packed(frames: DataFrame, max_points: int = 50_000, finite_first: bool = False) -> DataFrame:
    """Samples of packed frames (FRAME_SCHEMA)."""

    def run(batches):
        for batch in batches:
            for frame in batch.to_pylist():
                got = decode_frame(frame, max_points, finite_first)
                if got is not None and len(got["x"]):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in got.values()], names=list(got))

    return frames.select("frame_id", "width", "height", "point_step", "fields", "data").mapInArrow(run, SAMPLE_SCHEMA)


def encode_packed(samples: DataFrame) -> DataFrame:
    """One packed frame for each frame_id of samples (x, y, z, label, probability, entity_id, seq)."""
    dtype = np.dtype({"names": [f[0] for f in LAYOUT], "formats": [TYPES[f[2]] for f in LAYOUT], "offsets": [f[1] for f in LAYOUT], "itemsize": POINT_STEP})

    def run(key, group):
        group = group.sort_values("seq")
        rows = np.zeros(len(group), dtype)
        for name, column in (("x", "x"), ("y", "y"), ("z", "z"), ("label", "label"), ("obstacle_probability", "probability"), ("entity_id", "entity_id")):
            rows[name] = group[column].to_numpy()
        import pandas as pd

        fields = [{"name": n, "offset": o, "datatype": t} for n, o, t in LAYOUT]
        return pd.DataFrame([{"frame_id": key[0], "width": len(group), "height": 1, "point_step": POINT_STEP, "fields": fields, "data": rows.tobytes()}])

    return samples.groupBy("frame_id").applyInPandas(run, FRAME_SCHEMA)
