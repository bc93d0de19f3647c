"""Jaccard self-join of n-gram sets by token-combination prefixes.

A document's set holds its distinct word n-grams, the tokens. Sets of n tokens
whose similarity is `percent` or more have at least ceil(n * percent / 100) tokens in common.

1. A fingerprint exchange tells which tokens are in one set of the corpus only. A set
   with fewer other tokens than that has no partner, and goes no further.
2. Equal sets become one node. Tokens are counted over the nodes and put in
   the order of their counts; in that order similar sets share one token within their
   first n - ceil(n * percent / 100) + 1.
3. Index. Of the rare tokens (RARE nodes at most) of this prefix each is a key. Where the
   prefix reaches frequent tokens it is extended by m; similar sets then share m + 1
   tokens, and if none is rare, two of them in one of m classes of frequent tokens (by hash). So
   the pairs of frequent tokens of one class are keys. m follows from a level of set sizes;
   a set is at its own level and the next, and similar sets have a level in common.
4. Verification on the full sets: of each key's sets with the one that has the largest
   share of common tokens. Union-find makes groups of the linked sets.
5. Keys whose sets are in several groups. Where they are many, each set first goes to one task with
   others of its largest key; the task's own union-find takes a pair only while its sets are in different
   groups, so it returns fewer links than it has sets, however many of them are similar to each other. Then sets of
   different groups that are close enough by their sizes and by their parity bitmaps (an exact bound of
   how many tokens differ) are verified too, in blocks of bounded size. Only sets outside a key's largest
   group are compared with the others, so groups aren't expanded into pairs, and no link is lost.

Null and empty texts, and texts without words, have an empty set and are linked with
nothing. Texts with fewer words than an n-gram have one token, the whole sequence. Rows
are told apart by themselves: rows of one id with different texts are documents of
their own, and a component's id is the smallest id in it, null only if all are. Sets are
compared as 64-bit hashes of their tokens. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as C
from .components import components
from .exchange import blocks, contains, flagged, recurring, unpack
from .tables import written
from .textcore import shingle_sets

#: Nodes that a rare token is in, at most; sets of a key that are joined row by row, at most.
RARE, FEW = 16, 32
#: Of a key with more sets, those outside its largest group and all of them that meet in one task, and bits of their bitmaps for each token.
OUTSIDE, ALL, BITS = 512, 2048, 2
#: Common tokens of the sets that are gathered in one task, about, and turns of gathering before what is left is compared.
TOKENS, TURNS = 4_000_000, 3
#: Bits of a token in the exchange beyond those that number all tokens: one in 2**SPARE is taken for common by chance.
SPARE = 10


def token_sets(batch: pa.RecordBatch, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Tokens of each row in ascending order, n + 1 bounds, and a digest of each set."""
    hashes, bounds = shingle_sets(batch.column(text_col), width)
    digests = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds, bounds[1:], strict=False)]
    return hashes, bounds, digests


def least_common(n, percent: int):
    """Tokens that a set of n tokens shares with a similar one, at least."""
    return -(-n * percent // 100)


def levels(percent: int, most: int = 1 << 40) -> np.ndarray:
    """First set size of each level; similar sets are at the same level or at neighbouring ones."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


def index_keys(ordered: np.ndarray, counts: np.ndarray, n: int, percent: int, starts: np.ndarray) -> np.ndarray:
    """Keys of a set of n tokens; `ordered` has those of several sets, rarest first, with their counts."""
    first = n - least_common(n, percent) + 1 - (n - len(ordered))
    if first <= 0:
        return np.zeros(0, np.uint64)
    n_rare = int(np.searchsorted(counts, RARE, "right"))
    out = [ordered[: min(first, n_rare)]]
    if first > n_rare:
        own = int(np.searchsorted(starts, n, "right")) - 1
        for level in (own, own + 1):
            m = int(starts[max(level - 1, 0)]) // 8
            frequent = ordered[n_rare : first + m]
            salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
            if not m:
                out.append(C.mix(frequent + salt))
                continue
            kind = (C.mix(frequent ^ salt) >> np.uint64(32)) % np.uint64(m)
            order = np.lexsort((frequent, kind))
            kind, frequent = kind[order], frequent[order]
            # each token with all later ones of its class
            later = np.searchsorted(kind, kind, "right") - np.arange(len(kind)) - 1
            a = np.repeat(np.arange(len(kind)), later)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
            out.append(C.mix(C.mix(frequent[a] + salt) * np.uint64(31) + frequent[b]))
    return np.unique(np.concatenate(out))


def parity(tokens: np.ndarray, n: int) -> bytes:
    """Bitmap of BITS bits a token (a power of 2, for the size of the full set) with the parity of the tokens at each."""
    width = max(6, int(BITS * n - 1).bit_length())
    odd = np.bincount((tokens >> np.uint64(64 - width)).astype(np.int64), minlength=1 << width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def halved(bitmap: np.ndarray) -> np.ndarray:
    """The bitmaps (rows of bytes) with half as many bits: neighbouring parities become one."""
    odd = np.unpackbits(bitmap, axis=1)
    return np.packbits(odd[:, 0::2] ^ odd[:, 1::2], axis=1)


def close_pairs(bitmaps: list[np.ndarray], n: np.ndarray, known: np.ndarray, component: np.ndarray, first: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the `first` rows those after them, of another component, that its similarity with isn't ruled out."""
    sizes = np.array([len(x) for x in bitmaps])
    stacks: dict[int, np.ndarray] = {}
    for size in np.unique(sizes):
        for k, x in ((int(size), 0), (int(size) // 2, 1)):
            rows = np.flatnonzero(sizes == size)
            part = np.stack([bitmaps[i] for i in rows])
            part = halved(part) if x and size > 8 else part
            table = stacks.setdefault(part.shape[1], np.zeros((len(sizes), part.shape[1]), np.uint8))
            table[rows] = part
    later = np.arange(len(sizes)) >= first
    for i in range(first):
        total = n + n[i]
        fits = later & (component != component[i])
        fits &= 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
        fits &= np.minimum(known, known[i]) * (100 + percent) >= percent * total
        at = np.flatnonzero(fits)
        if not len(at):
            continue
        for size in np.unique(np.minimum(sizes[at], sizes[i])):
            some = at[np.minimum(sizes[at], sizes[i]) == size]
            # tokens of single sets are not in the bitmaps
            apart = np.bitwise_count(stacks[int(size)][some] ^ stacks[int(size)][i]).sum(axis=1).astype(np.int64) + (total[some] - known[some] - known[i])
            some = some[(total[some] - apart) * (100 + percent) >= 2 * percent * total[some]]
            if len(some):
                yield i, some


def _candidates(df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, n, digest, tokens) of every row; tokens (those of several sets) only where a partner with another set is possible.

    Equal sets of a block send their tokens once; they find each other by their digest.
    """
    table = blocks(df.select(id_col, text_col), text_col, "blocks")
    total = max(1, (df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // 5)
    spare = np.uint64(max(0, 64 - total.bit_length() - SPARE))

    def sent(hashes: np.ndarray, bounds: np.ndarray, digests: list[bytes]) -> np.ndarray:
        seen: set[bytes] = set()
        first = [d not in seen and not seen.add(d) for d in digests]
        return hashes[np.repeat(first, np.diff(bounds))] >> spare << spare

    def hashes_of(row: dict) -> np.ndarray:
        return sent(*token_sets(unpack(row["payload"]), text_col, width))

    answers, owners = recurring(table, hashes_of, total, "answers")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                row = {n: rows.column(n)[i].as_py() for n in rows.schema.names}
                batch = unpack(row["payload"])
                hashes, bounds, digests = token_sets(batch, text_col, width)
                short = hashes >> spare << spare
                common = contains(flagged(sent(hashes, bounds, digests), row["bitmaps"] or [], owners), short)
                found = np.add.reduceat(np.append(common, False), bounds[:-1]) * (np.diff(bounds) > 0) if len(bounds) > 1 else np.zeros(0, int)
                n = np.diff(bounds)
                open_ = (n > 0) & (found >= least_common(n, percent))
                tokens = [hashes[a:b][common[a:b]].tobytes() if o else None for a, b, o in zip(bounds, bounds[1:], open_, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(id_col).cast(pa.int64()), pa.array(n), pa.array(digests, pa.binary()), pa.array(tokens, pa.binary())], names=["id", "n", "digest", "tokens"])

    return written(table.join(answers, "block_id", "left").mapInArrow(mark, "id long, n long, digest binary, tokens binary"), "candidates")


def indexed(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, n, known, tokens, bitmap, keys) of distinct sets (node, n, tokens), as a table.

    `tokens` of the input are those that may be in other sets, of the output those that several nodes
    have; known is their number. Sets with too few of them for a partner are left out.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.slices(whole, "tokens", 1 << 20):
                data, offsets = C.string_bytes(batch.column("tokens"))
                sizes = np.diff(offsets) // 8
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data.tobytes(), np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), sizes)), pa.array(np.repeat(batch.column("n").to_numpy(), sizes))], names=["token", "node", "n"])

    rows = nodes.select("node", "n", "tokens").mapInArrow(spread, "token long, node long, n long")
    often = rows.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("often")).where("often > 1")
    ordered = rows.join(often, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("t"))
    ordered = ordered.where((F.size("t") * 100 >= percent * F.col("n"))).select("node", "n", "t.token", "t.often")
    starts = levels(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, n, token, often in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("token"), batch.column("often"), strict=True):
                tokens = token.values.to_numpy().view(np.uint64)
                keys = index_keys(tokens, often.values.to_numpy(), n, percent, starts)
                out.append((node, n, len(tokens), np.sort(tokens).tobytes(), parity(tokens, n), keys.view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["node", "n", "known", "tokens", "bitmap", "keys"])

    return written(ordered.mapInArrow(run, "node long, n long, known long, tokens binary, bitmap binary, keys array<long>"), "ready")


def similar(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, percent: int) -> bool:
    """Whether sets of n_a and n_b tokens are similar, by those (sorted) that others have too."""
    both = int(contains(b, a).sum())
    return 100 * both >= percent * (n_a + n_b - both)


def verified(pairs: DataFrame, ready: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are similar by their full sets."""
    left = ready.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("tokens_a"))
    right = ready.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("tokens_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure = []
            for x, y, n_x, n_y in zip(batch.column("tokens_a"), batch.column("tokens_b"), batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), strict=True):
                a, b = (np.frombuffer(t.as_buffer(), np.uint64) for t in (x, y))
                sure.append(similar(a, b, n_x, n_y, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(sure, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b").mapInArrow(run, "a long, b long")


def _possible(percent: int, *names: str) -> str:
    """SQL: whether two sets can be similar by their sizes and numbers of common tokens."""
    n, known, m, other = names
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and least({known}, {other}) * {100 + percent} >= {percent} * ({n} + {m})"


def across(index: DataFrame, ready: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components with a key in common; `index` has (key, n_sets, node, n, known, component)."""
    few = index.where(F.col("n_sets") <= FEW)
    other = few.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("known").alias("known_b"), F.col("component").alias("of_b"))
    near = F.expr(f"node < b and component <> of_b and {_possible(percent, 'n', 'known', 'm', 'known_b')}")
    pairs = few.alias("x").join(other.alias("y"), (F.col("x.key") == F.col("y.key")) & near).select(F.col("node").alias("a"), "b")
    # of a large key the sets outside its largest group meet all of them, in blocks
    many = index.where(F.col("n_sets") > FEW)
    home = many.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n_home")).groupBy("key").agg(F.max(F.struct("n_home", "component")).alias("home"))
    many = many.join(home, "key").join(ready.select("node", "bitmap"), "node").withColumn("out", F.col("component") != F.col("home.component"))
    many = many.withColumn("outs", F.expr(f"cast(ceil((n_sets - home.n_home) / {OUTSIDE}) as long)")).withColumn("alls", F.expr(f"cast(ceil(n_sets / {ALL}) as long)"))
    own = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts))
    each = lambda parts: F.explode(F.expr(f"sequence(0L, {parts} - 1L)"))
    columns = ["key", "node", "n", "known", "component", "bitmap", "out", "outs", "alls"]
    few_outside = many.where("out").select(*columns, own("outs").alias("low")).withColumn("high", each("alls"))
    all_of_key = many.select(*columns, own("alls").alias("high")).withColumn("low", each("outs")).withColumn("out", F.lit(False))
    met = few_outside.select(*columns, "low", "high").unionAll(all_of_key.select(*columns, "low", "high"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("out", "descending")])
        node, n, known, component = (table.column(c).to_numpy() for c in ("node", "n", "known", "component"))
        bitmaps = [np.frombuffer(x, np.uint8) for x in table.column("bitmap").to_pylist()]
        first = sum(table.column("out").to_pylist())
        out = [(node[i], node[j]) for i, some in close_pairs(bitmaps, n, known, component, first, percent) for j in some]
        return pa.table([pa.array([min(x) for x in out], pa.int64()), pa.array([max(x) for x in out], pa.int64())], names=["a", "b"])

    found = met.select("key", "low", "high", "out", "node", "n", "known", "component", "bitmap").groupBy("key", "low", "high").applyInArrow(run, "a long, b long")
    return pairs.unionAll(found).distinct()


def _spread(index: DataFrame) -> DataFrame:
    """The rows of keys whose sets are in several components."""
    ends = index.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return written(index.join(ends.where("low < high").select("key"), "key"), "spread")


def gathered(index: DataFrame, ready: DataFrame, percent: int, turn: int) -> DataFrame:
    """Links (a, b) of nodes of different components (of_a, of_b) that meet in a block of the largest key that each node has.

    A block's links are a forest over its components: fewer than its nodes. Turns deal the nodes to other blocks.
    """
    many = index.where(F.col("n_sets") > FEW)
    own = many.groupBy("node").agg(F.max(F.struct("n_sets", "key")).alias("at"), *[F.first(c).alias(c) for c in ("n", "known", "component")])
    own = own.select("node", F.col("at.key").alias("key"), "n", "known", "component")
    parts = own.groupBy("key").agg(F.expr(f"cast(ceil(greatest(count(1) / {ALL}, sum(known) / {TOKENS})) as long)").alias("parts"))
    dealt = own.join(parts, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit(turn)), "parts"))

    def run(table: pa.Table) -> pa.Table:
        node, n, known, component = (table.column(c).to_numpy() for c in ("node", "n", "known", "component"))
        tokens = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        bitmaps = [np.frombuffer(x, np.uint8) for x in table.column("bitmap").to_pylist()]
        size, out = len(node), []
        now = np.tile(component, 2)  # as united so far, of the nodes and of those that they are compared with
        for i, some in close_pairs(bitmaps * 2, np.tile(n, 2), np.tile(known, 2), now, size, percent):
            for j in (some - size).tolist():
                if now[i] != now[j] and similar(tokens[i], tokens[j], int(n[i]), int(n[j]), percent):
                    now[now == now[j]] = now[i]
                    out.append((i, j))
        a, b = (np.array([x[k] for x in out], np.int64) for k in (0, 1))
        return pa.table([pa.array(c[k]) for c in (node, component) for k in (a, b)], names=["a", "b", "of_a", "of_b"])

    met = dealt.join(ready.select("node", "tokens", "bitmap"), "node").select("key", "block", "node", "n", "known", "component", "tokens", "bitmap")
    return met.groupBy("key", "block").applyInArrow(run, "a long, b long, of_a long, of_b long")


def between(index: DataFrame, ready: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of nodes of different components with a key in common: all that it takes to join the components.

    `index` has (key, n_sets, node, n, known, component).
    """
    spread, found = _spread(index), []
    for turn in range(TURNS):
        near = written(gathered(spread, ready, percent, turn), "gathered")
        if not near.limit(1).count():
            break
        found.append(near.select("a", "b"))
        united = components(near.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("united"))
        spread = _spread(spread.join(united, "component", "left").withColumn("component", F.coalesce("united", "component")).drop("united"))
    links = written(verified(written(across(spread, ready, percent), "rest"), ready, percent), "more")
    for near in found:
        links = links.unionAll(near)
    return links


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row (id, n_shingles, component_id) per document: the smallest id reachable over links of similarity >= percent / 100."""
    candidates = _candidates(df, id_col, text_col, width, percent)
    grouped = candidates.where("tokens is not null").groupBy("digest").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    nodes = written(grouped.select(F.monotonically_increasing_id().alias("node"), "digest", "n", "tokens"), "nodes")
    digests, ready = nodes.select("digest", "node"), indexed(nodes, percent)
    index = ready.select("node", "n", "known", F.explode("keys").alias("key"))
    best = F.max(F.struct((F.col("known") / F.col("n")).alias("share"), (-F.col("node")).alias("minus"), "n", "known")).alias("best")
    pivots = index.groupBy("key").agg(best, F.count(F.lit(1)).alias("n_sets")).where("n_sets > 1")
    pivots = pivots.select("key", "n_sets", (-F.col("best.minus")).alias("pivot"), F.col("best.n").alias("m"), F.col("best.known").alias("known_b"))
    index = written(index.join(pivots, "key"), "index")
    stars = index.where("node <> pivot").where(_possible(percent, "n", "known", "m", "known_b")).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    links = written(verified(stars, ready, percent), "links")
    trees = components(links)
    placed = index.select("key", "n_sets", "node", "n", "known").join(trees, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = written(placed, "placed")
    trees = components(written(links.unionAll(between(placed, ready, percent)), "all"))
    # the smallest id of each set, and of each group of sets
    lowest = candidates.where("n > 0").groupBy("digest").agg(F.min("id").alias("low"))
    linked = written(digests.join(trees, "node").join(lowest, "digest").select("digest", "component", "low"), "linked")
    named = linked.join(linked.groupBy("component").agg(F.min("low").alias("component_low")), "component").select("digest", "component_low")
    named = lowest.join(named, "digest", "left").select("digest", F.coalesce("component_low", "low").alias("component_id"))
    full = candidates.where("n > 0").select("id", F.col("n").alias("n_shingles"), "digest").join(named, "digest").select("id", "n_shingles", "component_id")
    return full.unionAll(candidates.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
