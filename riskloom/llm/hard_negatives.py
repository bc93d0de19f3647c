"""Hard negatives by exact integer inner products, several of them in one multiplication.

Components become integers floor(scale * x). A block's candidate components are
biased to be non-negative and put side by side into the fields of one wide
integer (Kronecker packing): each field is wide enough for the largest inner
product of the block, so one multiplication by an anchor's biased component adds
to the scores of all packed candidates at once, and shifts and masks unpack them.
An integer of up to 53 bits is held in a double, whose products and sums are then
exact whatever their order. Blocks whose products need more, or whose scores reach
2**48, are multiplied as Python's integers of any width.

Candidates are dealt into shards and anchors into parts of bounded size; each pair of
a shard and a part is one group, so no task holds all of either. A first pass
finds each anchor's positives, a second one the negatives in the score band
of each positive. Every group returns its best few, merged by partial top-k.

Rows with a null id, label or vector, or a component that is null, not finite, or
not finite when scaled, take no part. An anchor is compared with vectors of its own
length only; vectors without components score 0. Repeated rows are rows of their
own: a copy of an anchor is another anchor, and one of its positives. Ties go to
the smaller id; rows of one id are alike then. Scores beyond 64 bits count as the
nearest long. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import pack, unpack
from .tables import written

#: Rows of a shard of candidates and of a part of the anchors, and anchors multiplied at a time.
SHARD, PART, AT_ONCE = 16384, 16384, 128
#: Bits that a double holds exactly, and of the scores that a row number may follow in 63 bits.
EXACT, SCORE = 53, 48
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python's where they are too large."""
    floors = np.floor(values.astype(np.float64) * scale)
    if np.abs(floors).max(initial=0) < 1 << EXACT:
        return floors.astype(np.int64)
    return np.array([[int(x) for x in row] for row in floors], object).reshape(floors.shape)


def inner_products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact scores, anchors x candidates, by products of packed candidates."""
    m, k, size = len(anchors), len(candidates), anchors.shape[1]
    if not size or not m or not k:
        return np.zeros((m, k), np.int64)
    low_a, low_c = int(anchors.min()), int(candidates.min())
    high_a, high_c = int(anchors.max()), int(candidates.max())
    bits = max(1, (size * (high_a - low_a) * (high_c - low_c)).bit_length())
    small = size * max(abs(low_a), abs(high_a), 1) * max(abs(low_c), abs(high_c), 1) < 1 << SCORE and bits <= EXACT
    kind = np.int64 if small else object
    fields = EXACT // bits if small else 8
    a, c = anchors.astype(kind) - low_a, candidates.astype(kind) - low_c
    spare = -k % fields
    lanes = np.concatenate([c, np.zeros((spare, size), kind)]).reshape(-1, fields, size)
    shifts = [j * bits for j in range(fields)]
    words = sum(lanes[:, j] * (1 << s) for j, s in enumerate(shifts))
    if small:
        products = (a.astype(np.float64) @ words.T.astype(np.float64)).astype(np.int64)
    else:
        products = a.dot(words.T)
    mask = (1 << bits) - 1
    out = np.empty((m, lanes.shape[0], fields), kind)
    for j, s in enumerate(shifts):
        out[:, :, j] = (products >> s) & mask
    out = out.reshape(m, -1)[:, :k]
    # what the biases took away
    out = out + low_c * a.sum(axis=1)[:, None] + low_a * c.sum(axis=1)[None, :] + size * low_a * low_c
    return out if small else np.minimum(np.maximum(out, LEAST), MOST)


def best(scores: np.ndarray, allowed: np.ndarray, n: int) -> list[np.ndarray]:
    """For each anchor the columns of its n highest allowed scores, in no order; ties go to smaller columns."""
    m, k = scores.shape
    if scores.dtype == object:
        return [np.array(sorted(np.flatnonzero(ok), key=lambda j: (-row[j], j))[:n], np.int64) for row, ok in zip(scores, allowed, strict=True)]
    key = np.where(allowed, (scores << 14) - np.arange(k), LEAST)
    if k > n:
        top = np.argpartition(key, k - n, axis=1)[:, k - n :]
    else:
        top = np.broadcast_to(np.arange(k), (m, k))
    fits = np.take_along_axis(allowed, top, axis=1)
    return [t[ok] for t, ok in zip(top, fits, strict=True)]


def _valid(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def _packed(df: DataFrame, key: str, rows: int, n: int) -> tuple[DataFrame, int]:
    """Rows (size, `key`, `key`_rows): the rows in about n / rows packed blocks for each length of vector, and their number."""
    blocks = max(1, -(-n // rows))
    dealt = df.withColumn(key, F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        size, block = table.column("size")[0].as_py(), table.column(key)[0].as_py()
        # a block's rows in the order of ids, as ties go; more rows than a row number has bits make several blocks
        table = table.drop_columns(["size", key]).sort_by([("id", "ascending"), ("uid", "ascending")]).combine_chunks()
        parts = [pack(b) for b in table.to_batches(max_chunksize=1 << 14)]
        return pa.table({"size": pa.array([size] * len(parts), pa.int32()), key: pa.array([block] * len(parts), pa.int32()), f"{key}_rows": pa.array(parts, pa.binary())})

    return written(dealt.groupBy("size", key).applyInArrow(run, f"size int, {key} int, {key}_rows binary"), key), blocks


def mine(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor: str = "id % 100 = 0", scale: int = 256, n_positives: int = 5, n_negatives: int = 5, low: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all rows that `anchor` (SQL on id) selects.

    An anchor's positives are the n_positives best other rows of its label. Negatives have another label and
    low * positive_score <= 100 * negative_score <= 100 * positive_score; of each positive the n_negatives best are returned.
    """
    usable = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector"))
    usable = usable.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _valid("vector"))
    usable = usable.where(F.forall("vector", lambda x: F.abs(x.cast("double") * scale) < float("inf")))
    rows = written(usable.select(F.monotonically_increasing_id().alias("uid"), "*", F.size("vector").alias("size")), "vectors")
    anchors = rows.where(anchor)
    shards, n_shards = _packed(rows, "shard", SHARD, rows.count())
    found = _pass(anchors.withColumn("wanted", F.lit(None).cast("array<struct<id:long,score:long,place:int>>")), shards, n_shards, scale, n_positives, low)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "other", "other_uid")
    positives = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_positives)
    wanted = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(F.col("other").alias("id"), "score", "place"))).alias("wanted"))
    wanted = written(wanted.withColumnRenamed("anchor", "uid"), "positives")
    found = _pass(anchors.join(wanted, "uid"), shards, n_shards, scale, n_negatives, low)
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "other", "other_uid")
    negatives = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return negatives.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


FOUND = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("other", pa.int64()), ("other_uid", pa.int64()), ("score", pa.int64())])


def _pass(anchors: DataFrame, shards: DataFrame, n_shards: int, scale: int, n: int, low: int) -> DataFrame:
    """The best n of each shard for each anchor: of its label, or for each of its `wanted` positives of other labels in the band."""
    parts, n_parts = _packed(anchors, "part", PART, anchors.count())
    left = parts.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    right = shards.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    key = ["size", "part", "shard"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        blocks = [unpack(x) for x in right.column("shard_rows").to_pylist()]
        sides = [(b.column("uid").to_numpy(), b.column("id").to_numpy(), b.column("label").to_numpy(), _matrix(b, scale)) for b in blocks]
        for packed in left.column("part_rows").to_pylist():
            whole = unpack(packed)
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                uid, ids, label = (batch.column(c).to_numpy() for c in ("uid", "id", "label"))
                vectors, wanted = _matrix(batch, scale), batch.column("wanted").to_pylist()
                for side in sides:
                    out.extend(_best_of_block(uid, ids, label, vectors, wanted, side, n, low))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FOUND, strict=True)] if out else FOUND.empty_table().columns, schema=FOUND)

    schema = "anchor long, anchor_id long, place int, positive_id long, positive_score long, other long, other_uid long, score long"
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


def _matrix(batch: pa.RecordBatch, scale: int) -> np.ndarray:
    return integers(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), scale) if batch.num_rows else np.zeros((0, 0), np.int64)


def _best_of_block(uid, ids, label, vectors, wanted, side, n, low):
    other_uid, other_id, other_label, other = side
    scores = inner_products(vectors, other)
    same = label[:, None] == other_label[None, :]
    if wanted[0] is None:
        for i, chosen in enumerate(best(scores, same & (uid[:, None] != other_uid[None, :]), n)):
            for j in chosen:
                yield int(uid[i]), int(ids[i]), None, None, None, int(other_id[j]), int(other_uid[j]), int(scores[i, j])
        return
    for p in range(max(len(w) for w in wanted)):
        # anchors with fewer positives have an empty band here
        bound = np.array([w[p]["score"] if p < len(w) else -1 for w in wanted], scores.dtype)[:, None]
        band = ~same & (scores <= bound) & (100 * scores >= low * bound)
        for i, chosen in enumerate(best(scores, band, n)):
            for j in chosen:
                w = wanted[i][p]
                yield int(uid[i]), int(ids[i]), w["place"], w["id"], w["score"], int(other_id[j]), int(other_uid[j]), int(scores[i, j])

