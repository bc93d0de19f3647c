import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from riskloom.llm import hard_negatives, ngram_join, spelling_variants
from riskloom.llm.queries import QUERIES

from .conftest import SF
from .test_dedup import NAMES, groups


def joined(make, rows, width=4, percent=85, extra="extra"):
    return {r.id: (r.n_shingles, r.component_id) for r in ngram_join.groups(make(rows, extra=extra), width=width, percent=percent).collect()}


def family(rng, n_words, n, edits, first):
    """Variants of one text, with some words replaced, some by words that other variants have too."""
    base = list(rng.choice(NAMES, n_words))
    out = []
    for i in range(n):
        w = list(base)
        for k in rng.choice(n_words, rng.integers(0, edits + 1), replace=False):
            w[k] = f"x{rng.integers(0, 30)}"
        out.append((first + i, " ".join(w)))
    return out


@pytest.mark.parametrize(("rare", "few", "outside", "whole"), [(16, 32, 512, 2048), (2, 2, 3, 7)])
def test_ngram_join_against_brute_force(make, monkeypatch, rare, few, outside, whole):
    for name, value in (("RARE", rare), ("FEW", few), ("OUTSIDE", outside), ("ALL", whole)):
        monkeypatch.setattr(ngram_join, name, value)  # most keys are of frequent tokens, most groups in several blocks
    rng = np.random.default_rng(11)
    rows, base = [], list(rng.choice(NAMES, 160))
    for i in range(40):  # a chain: each differs a little from the one before, the ends differ much
        base[4 * i] = f"n{i}"
        rows.append((100 + i, " ".join(base)))
    rows += family(rng, 90, 60, 6, 200) + family(rng, 400, 40, 30, 300) + family(rng, 30, 40, 2, 400)
    rows += [(1, "one"), (2, "ONE"), (3, "one two"), (4, ""), (5, None), (6, "  "), (7, "a b c d e f"), (8, "a  b c d e F"), (9, "a b c d"), (10, "a b\nc d")]
    rows += [(500 + i, " ".join(rng.choice(NAMES, 50))) for i in range(20)]
    for width, percent in ((4, 85), (5, 80)):
        assert joined(make, rows, width, percent) == groups(rows, width, percent)


def test_ngram_join_on_documents(make, documents):
    assert joined(make, documents) == groups(documents, 4, 85)


def test_ngram_join_ids(make):
    same = " ".join(NAMES[:40])
    other = " ".join([*NAMES[:39], "z"])
    rows = [(5, same), (5, " ".join(NAMES[50:90])), (6, f"{same} z"), (7, other), (None, same), (None, " ".join(NAMES[100:140])), (9, same), (9, same)]
    got = Counter((r.id, r.component_id) for r in ngram_join.groups(make(rows, extra="component_id"), width=4, percent=85).collect())
    assert got == Counter([(5, 5), (5, 5), (6, 5), (7, 5), (None, 5), (None, None), (9, 5), (9, 5)])
    assert ngram_join.groups(make([])).count() == 0
    assert joined(make, [(1, "word " * 60000), (2, "Word " * 60001), (3, "")]) == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(60, 95), st.data())
def test_similar_sets_share_a_key(n, percent, data):
    """Two sets of similarity `percent` or more, whatever the counts of their tokens."""
    starts = ngram_join.levels(percent)
    lost = data.draw(st.integers(0, n * (100 - percent) // 100))
    more = data.draw(st.integers(0, n // 4))
    if 100 * (n - lost) < percent * (n + more):
        more = 0
    rng = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    tokens = rng.integers(0, 2**64, n + more, dtype=np.uint64)
    counts = rng.choice([2, 5, 16, 17, 40, 1000], n + more)

    def keys(part):
        order = np.lexsort((tokens[part], counts[part]))
        return set(ngram_join.index_keys(tokens[part][order], counts[part][order], len(part), percent, starts).tolist())

    x, y = np.arange(n), np.arange(lost, n + more)
    common = n - lost
    if 100 * common >= percent * (len(x) + len(y) - common):
        assert keys(x) & keys(y)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6))
def test_bitmaps_rule_out_no_similar_pair(seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2**64, 300, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 290), replace=False)) for _ in range(12)]
    sets += [np.unique(np.append(s[: len(s) - len(s) // 20], pool[:2])) for s in sets]
    n = np.array([len(s) + rng.integers(0, 3) for s in sets])  # some tokens are in one set only
    known = np.array([len(s) for s in sets])
    bitmaps = [np.frombuffer(ngram_join.parity(s, k), np.uint8) for s, k in zip(sets, n, strict=True)]
    twice = [np.concatenate([x, x]) for x in (n, known, np.arange(len(sets)))]
    found = {(i, int(j) - len(sets)) for i, some in ngram_join.close_pairs(bitmaps * 2, *twice, len(sets), 80) for j in some}
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 80 * (n[i] + n[j] - both):
                assert (i, j) in found


# ---------------------------------------------------------------- spelling variants
def counted(rows, every):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def variants(rows, every=199, ratio=5):
    n = counted(rows, every)
    out, form = {}, {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = (n[w], len(near), n[best] if form[w] else None)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w])
    return out


def as_rows(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("every", [199, 3])
def test_spelling_variants_on_documents(make, documents, every):
    rows = documents[:120] if every == 3 else documents
    assert as_rows(spelling_variants.variants(make(rows, extra="word"), every=every)) == variants(rows, every)


def test_spelling_variants_by_hand(make):
    words = {"letter": 700, "lettre": 130, "leter": 9, "lettér": 6, "letters": 130, "lettters": 25, "letterss": 5, "LETTER": 4, "abcdef": 5, "abcdeg": 25, "abcdeh": 25, "xbcdef": 4, "aaaaaa": 40, "aaaaaaa": 8}
    text = " ".join(f"{w}" for w, n in words.items() for _ in range(n))
    rows = [(1, text), (2, None), (3, ""), (None, "letter1letter"), (4, "letter " * 3), (4, "letter " * 3)]
    got = as_rows(spelling_variants.variants(make(rows, extra="n"), every=10**9))
    assert got == variants(rows, 10**9)
    assert got["letterss"][:2] == ("letters", "letter") and got["abcdef"][0] == "abcdeg" and got["aaaaaaa"][0] == "aaaaaa"
    assert spelling_variants.variants(make([])).count() == 0


def test_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(spelling_variants, "PIECE", 10)
    text = "abcdefghijklmnop qrstuvw xyzabc " * 5
    parts = list(spelling_variants.pieces(text))
    assert "".join(parts) == text and len(parts) > 5
    assert [w for p in parts for w in spelling_variants.RUN.findall(p)] == spelling_variants.RUN.findall(text)


# ---------------------------------------------------------------- hard negatives
def mined(rows, anchor_every=100, low=80):
    rows = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for k, (i, lab, v) in enumerate(rows):
        if i % anchor_every:
            continue
        others = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for m, (j, other, w) in enumerate(rows) if m != k and len(w) == len(v)]
        for s, p, _ in sorted((x for x in others if x[2] == lab), key=lambda x: x[:2])[:5]:
            band = sorted((x for x in others if x[2] != lab and low * -s <= 100 * -x[0] <= 100 * -s), key=lambda x: x[:2])[:5]
            out.update((i, p, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(band))
    return out


SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("score", T.StringType())])


def mine(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame([(*r, "x") for r in rows], schema).repartition(3)
    return Counter(tuple(r) for r in hard_negatives.mine(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(rng, n, size=8, labels=3):
    return [(i, [float(np.float32(x)) for x in rng.normal(0, 0.4, size)], int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize(("shard", "part", "at_once"), [(16384, 16384, 128), (50, 3, 2)])
def test_hard_negatives_against_brute_force(spark, make, monkeypatch, shard, part, at_once):
    for name, value in (("SHARD", shard), ("PART", part), ("AT_ONCE", at_once)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(np.random.default_rng(2), 600)
    rows += [(601, [0.5] * 8, 1), (700, None, 1), (702, [0.1] * 8, None), (703, [0.1, None] + [0.2] * 6, 1), (704, [float("nan")] * 8, 0), (705, [float("inf")] * 8, 0), (None, [0.9] * 8, 0)]
    rows += [(-100, [0.3] * 8, 0), (1000, [0.25, 0.5], 0), (1001, [0.5, 0.25], 0), (1002, [0.5, 0.26], 1), (1100, [], 1), (1101, [], 1), (1102, [], 2)]
    rows += [(2000 + k, rows[100][1], k % 3) for k in range(20)] + [rows[100]] * 2  # ties, and repeated rows
    got = mine(spark, rows)
    assert got == mined(rows) and len(got) > 60


def test_hard_negatives_of_wide_integers(spark, make):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1e5 if i % 2 else 1, 6)], i % 2 + i % 3) for i in range(300)]
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert mine(spark, rows) == mined(rows)


def test_hard_negatives_empty(spark, make):
    assert not mine(spark, []) and not mine(spark, [(1, [0.5], 1)]) and not mine(spark, [(100, [0.5], 1)])


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 40, 3000, 10**6, 10**11]))
def test_packed_products_are_exact(seed, spread):
    rng = np.random.default_rng(seed)
    a = rng.integers(-spread, spread + 1, (4, 7)) + int(rng.integers(-spread, spread + 1))
    c = rng.integers(-spread, spread + 1, (11, 7)) - int(rng.integers(0, 2 * spread + 1))
    exact = a.astype(object).dot(c.T.astype(object))
    limit = np.vectorize(lambda x: min(max(x, -(2**63)), 2**63 - 1), otypes=[object])
    assert (hard_negatives.inner_products(a, c).astype(object) == limit(exact)).all()


def test_queries_on_the_given_tables(spark, make):
    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = Counter(tuple(r) for r in QUERIES["op13_hard_negatives"](spark, SF).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == mined(rows)


@pytest.mark.parametrize("whole", [2048, 50])
def test_dense_groups_return_few_pairs(spark, monkeypatch, whole):
    """Sets that are nearly all similar, each a group of its own: their links grow with the sets, not with the pairs."""
    monkeypatch.setattr(ngram_join, "ALL", whole)
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 63, 100, dtype=np.uint64)
    sets = []
    for _ in range(150):
        own = base.copy()
        own[rng.choice(100, rng.integers(0, 10), replace=False)] += np.uint64(rng.integers(1, 9))
        sets.append(np.unique(own))
    nodes = spark.createDataFrame([(i, len(x), bytearray(x.tobytes())) for i, x in enumerate(sets)], "node long, n long, tokens binary")
    ready = ngram_join.indexed(nodes, 80)
    index = ready.selectExpr("1L key", "150L n_sets", "node", "n", "known", "node component")
    compared, across = [], ngram_join.across

    def counted(*args):
        compared.append(across(*args))
        return compared[-1]

    monkeypatch.setattr(ngram_join, "across", counted)
    links = [(r.a, r.b) for r in ngram_join.between(index, ready, 80).collect()]
    similar = {(a, b) for a in range(150) for b in range(a) if 100 * len(both := set(sets[a].tolist()) & set(sets[b].tolist())) >= 80 * (len(sets[a]) + len(sets[b]) - len(both))}
    assert len(similar) > 2000 and {(max(x), min(x)) for x in links} <= similar

    def grouped(pairs):
        of = list(range(150))
        for a, b in pairs:
            of = [of[a] if x == of[b] else x for x in of]
        return {frozenset(i for i in range(150) if of[i] == x) for x in of}

    assert grouped(links) == grouped(similar)
    n_pairs = sum(x.count() for x in compared)
    assert n_pairs < 150 and len(links) < 150 * ngram_join.TURNS
