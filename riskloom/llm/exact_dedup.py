"""Exact dedup by a Golomb-coded exchange of fingerprints.

Texts are equal when identical after deleting the ASCII white space characters.
Blocks of rows send the sorted 48-bit fingerprints of their normalised texts to
owners and get bitmaps of those that occur more than once. Only these suspects
are compared byte by byte: they are grouped by the normalised text itself, with a
partial aggregation, so one text that a third of the rows share travels once per
task. Rows meet their group by its SHA-256 digest.

Null texts count as empty; empty texts are equal to each other. Of equal texts the
row with the most code points in the original text stays, then the smallest
doc_id (null last), then the earliest row: repeated rows with one doc_id keep one.
Extra columns pass through; columns with the names made here are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as C
from .exchange import blocks, contains, flagged, recurring, unpack
from .tables import written

MADE = ["keep_id", "group_size", "kept", "text_sha256", "n_points", "row_id", "normal"]


def normalised(batch: pa.RecordBatch, text_col: str) -> tuple[list[bytes], np.ndarray]:
    """Texts without white space, and the code points of the original ones."""
    data, offsets = C.string_bytes(batch.column(text_col))
    keep = C.NON_SPACE[data]
    bounds = np.append(0, np.cumsum(keep))[offsets].tolist()
    flat = data[keep].tobytes()
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    return [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], np.diff(points)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """48 bits, as the high bits of 64."""
    return np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64) >> np.uint64(16) << np.uint64(16)


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row with keep_id, group_size, kept and text_sha256; `carry` names the input columns to return (all)."""
    fields = [f for f in df.schema if f.name not in MADE and (carry is None or f.name in [*carry, id_col])]
    names = [f.name for f in fields]
    table = blocks(df, text_col, "blocks")
    total = table.agg(F.sum("n_rows")).first()[0] or 0

    def prints_of(row: dict) -> np.ndarray:
        return fingerprints(normalised(unpack(row["payload"]), text_col)[0])

    answers, owners = recurring(table, prints_of, total, "prints")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                row = {n: rows.column(n)[i].as_py() for n in rows.schema.names}
                batch = unpack(row["payload"])
                texts, points = normalised(batch, text_col)
                prints = fingerprints(texts)
                suspect = contains(flagged(prints, row["bitmaps"], owners), prints)
                made = [
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    pa.array(points),
                    pa.array((row["block_id"] << 16) + np.arange(len(texts))),
                    pa.array([t if s else None for t, s in zip(texts, suspect, strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + made, names=[*names, "text_sha256", "n_points", "row_id", "normal"])

    schema = T.StructType(fields + [T.StructField("text_sha256", T.StringType()), T.StructField("n_points", T.LongType()), T.StructField("row_id", T.LongType()), T.StructField("normal", T.BinaryType())])
    marked = written(table.join(answers, "block_id", "left").mapInArrow(mark, schema), "marked")
    best = F.max(F.struct(F.col("n_points"), (-F.col(id_col)).alias("minus_id"), (-F.col("row_id")).alias("minus_row"), F.col(id_col).alias("id")))
    groups = marked.where("normal is not null").groupBy("text_sha256", "normal").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    groups = groups.select("text_sha256", "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.minus_row")).alias("keep_row"))
    single = marked.where("normal is null").select(*names, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    several = marked.where("normal is not null").drop("normal").join(groups, "text_sha256")
    several = several.select(*names, "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256")
    return single.unionAll(several)
