"""Blocks of rows, and a fingerprint exchange that tells each block which of its hashes occur anywhere else.

A block holds some rows as one compressed Arrow batch under a unique id. It sends
its sorted distinct hashes, Golomb coded, to the owners of their ranges. An owner
answers each message with a bitmap: bit i is set if hash i occurs more than once
in the corpus. A hash that a third of all rows share costs one entry per block,
so there is no hot owner, and an answer is smaller than its message.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written
from .textcore import slices

BLOCK_BYTES = 2 << 20
#: Hashes that one owner holds, on average: its memory is bounded by this number, whatever the corpus.
OWNED = 1_000_000


def pack(batch: pa.RecordBatch, level: int | None = None) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.py_buffer(payload.as_py() if isinstance(payload, pa.Scalar) else payload)).read_next_batch()


def blocks(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """Rows (block_id, n_rows, payload), written to the shared folder so that ids and contents hold for good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, text_col, BLOCK_BYTES):
                yield pa.RecordBatch.from_pydict({"block_id": pa.array([at], pa.int64()), "n_rows": pa.array([batch.num_rows], pa.int64()), "payload": pa.array([pack(batch)], pa.binary())})
                at += 1

    return written(df.mapInArrow(run, "block_id long, n_rows long, payload binary"), name)


def golomb_encode(values: np.ndarray) -> bytes:
    """Ascending distinct unsigned integers: gaps as quotients in unary and remainders of k bits, in two streams.

    Low bits that are zero in all of them aren't sent.
    """
    n = len(values)
    used = int(np.bitwise_or.reduce(values)) if n else 0
    zeros = (used & -used).bit_length() - 1 if used else 0
    values = values >> np.uint64(zeros)
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = int(values[-1]) // n if n else 0
    k = max(0, int(mean * 0.69).bit_length() - 1)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + n, np.uint8)
    unary[np.cumsum(quotient) + np.arange(n)] = 1
    rest = np.empty((n, k), np.uint8)
    for bit in range(k):
        rest[:, bit] = (gaps >> np.uint64(bit)) & np.uint64(1)
    head = np.packbits(unary).tobytes()
    return bytes([k, zeros]) + n.to_bytes(4, "little") + len(head).to_bytes(4, "little") + head + np.packbits(rest).tobytes()


def golomb_decode(code: bytes) -> np.ndarray:
    k, zeros, n, size = code[0], code[1], int.from_bytes(code[2:6], "little"), int.from_bytes(code[6:10], "little")
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, size, 10)))[:n]
    gaps = (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    rest = np.unpackbits(np.frombuffer(code, np.uint8, offset=10 + size), count=n * k).reshape(n, k)
    for bit in range(k):
        gaps |= rest[:, bit].astype(np.uint64) << np.uint64(bit)
    return np.cumsum(gaps, dtype=np.uint64) << np.uint64(zeros)


def owner_of(hashes: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold consecutive ranges of the 64-bit hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _messages(block_id: int, hashes: np.ndarray, owners: int) -> Iterator[tuple]:
    distinct, counts = np.unique(hashes, return_counts=True)
    bounds = np.searchsorted(owner_of(distinct, owners), np.arange(owners + 1))
    for owner in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[owner], bounds[owner + 1]
        base = distinct[a] >> np.uint64(40) << np.uint64(40)
        yield block_id, int(owner), int(base), golomb_encode(distinct[a:b] - base), np.packbits(counts[a:b] > 1).tobytes()


SENT = pa.schema([("block_id", pa.int64()), ("owner", pa.int64()), ("base", pa.uint64()), ("codes", pa.binary()), ("multi", pa.binary())])


def _answer(table: pa.Table) -> pa.Table:
    """One owner: a bitmap for each message, set where a hash is in several messages or repeated within one."""
    bases = table.column("base").to_numpy().view(np.uint64)
    lists = [golomb_decode(c) + b for c, b in zip(table.column("codes").to_pylist(), bases, strict=True)]
    sizes = np.array([len(x) for x in lists])
    hashes = np.concatenate(lists)
    multi = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(table.column("multi").to_pylist(), sizes, strict=True)])
    order = np.argsort(hashes, kind="stable")
    same = np.zeros(len(hashes) + 1, bool)
    same[1:-1] = hashes[order[1:]] == hashes[order[:-1]]
    found = np.empty(len(hashes), bool)
    found[order] = same[1:] | same[:-1]
    found |= multi.astype(bool)
    ends = np.cumsum(sizes)
    maps = [np.packbits(found[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
    return pa.table({"block_id": table.column("block_id"), "owner": table.column("owner"), "bitmap": pa.array(maps, pa.binary())})


def recurring(block_rows: DataFrame, hashes_of: Callable[[dict], np.ndarray], total: int, name: str) -> tuple[DataFrame, int]:
    """Exchange of the 64-bit hashes that `hashes_of` takes from each block row.

    `total` is about their number and sets the number of owners. Returns
    (block_id, bitmaps) as a table in the shared folder, and the number of owners.
    """
    owners = max(1, -(-total // OWNED))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                rows = list(_messages(one["block_id"], hashes_of(one), owners))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SENT, strict=True)], schema=SENT).set_column(2, "base", pa.array([r[2] for r in rows], pa.uint64()).view(pa.int64()))

    sent = block_rows.mapInArrow(send, "block_id long, owner long, base long, codes binary, multi binary")
    answers = sent.groupBy("owner").applyInArrow(_answer, "block_id long, owner long, bitmap binary")
    gathered = answers.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("owner", "bitmap"))).alias("bitmaps"))
    return written(gathered, name), owners


def flagged(hashes: np.ndarray, bitmaps: list[dict] | None, owners: int) -> np.ndarray:
    """The sorted distinct hashes of a block that its answers mark as recurring."""
    distinct = np.unique(hashes)
    if not len(distinct):
        return distinct
    sizes = np.bincount(owner_of(distinct, owners), minlength=owners)
    sizes = sizes[sizes > 0]
    bits = [np.unpackbits(np.frombuffer(x["bitmap"], np.uint8), count=n) for x, n in zip(bitmaps, sizes, strict=True)]
    return distinct[np.concatenate(bits).astype(bool)]


def contains(ordered: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash is in a sorted array."""
    if not len(ordered):
        return np.zeros(len(hashes), bool)
    return ordered[np.minimum(np.searchsorted(ordered, hashes), len(ordered) - 1)] == hashes
