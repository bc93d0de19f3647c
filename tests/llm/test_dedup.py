import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import components as components_module
from riskloom.llm import exact_dedup, exchange, minhash, substring_dedup
from riskloom.llm.components import components

from .conftest import lower, words

NAMES = [f"w{i}" for i in range(400)]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=200))
def test_golomb_round_trip(values):
    ordered = np.array(sorted(values), np.uint64)
    assert (exchange.golomb_decode(exchange.golomb_encode(ordered)) == ordered).all()


def removed(rows, width=35):
    seen, by = Counter(), {}
    for key, (_, text) in enumerate(rows):
        w = by[key] = words(text)
        for k in range(len(w) - width + 1):
            seen[tuple(w[k : k + width])] += 1
    out = Counter()
    for key, (i, _) in enumerate(rows):
        w, gone = by[key], [False] * len(by[key])
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i, len(w), sum(gone), kept] += 1
    return out


def test_substring_dedup_against_brute_force(make):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(rng.choice(NAMES, n))
    shared, short = text(60), text(34)
    rows = [(1, f"{text(20)} {shared} {text(30)}"), (2, f"{shared}\n{text(5)}"), (3, " ".join(shared.split()[10:50])), (4, short), (5, f"{short} {text(3)}")]
    rows += [(6, "Te " * 40), (7, "Te " * 34), (8, None), (9, ""), (10, text(35)), (10, None), (None, f"{text(2)} {shared}"), (12, f"{shared}é")]
    rows += [(13, rows[9][1])] * 2  # repeated rows
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(make(rows, extra="n_words")).collect())
    assert got == removed(rows)


def test_substring_dedup_spans(make):
    rows = [(1, "a " + "b " * 36), (2, "x y")]
    got = {r.doc_id: r.removed_spans for r in substring_dedup.remove_repeats(make(rows)).collect()}
    assert [(s.first_word, s.n) for s in got[1]] == [(1, 36)] and got[2] == []


def test_substring_dedup_on_documents(make, documents):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(make(documents)).collect())
    assert got == removed(documents)


def test_substring_dedup_joins_alike_at_every_size(make):
    found = substring_dedup.remove_repeats(make([(i, " ".join(NAMES[:60])) for i in range(4)]))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.n_removed for r in found.collect()} == {60}


def test_substring_dedup_empty(make):
    assert substring_dedup.remove_repeats(make([])).count() == 0


def test_exact_dedup(make):
    rows = [(5, "a b\n"), (2, "ab"), (3, " a\tb"), (4, None), (6, ""), (7, " \n"), (8, "A B"), (9, "ab"), (9, "ab"), (None, "a b\n"), (11, "long " * 9000)]
    got = exact_dedup.classes(make(rows, extra="kept")).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    same = by[hashlib.sha256(b"ab").hexdigest()]
    assert len(same) == 6 and {r.group_size for r in same} == {6}
    assert {r.keep_id for r in same} == {3} and [r.doc_id for r in same if r.kept] == [3]  # the longest, then the smallest id; null last
    assert [r.doc_id for r in by[hashlib.sha256(b"").hexdigest()] if r.kept] == [7]
    assert all(sum(r.kept for r in g) == 1 for g in by.values())


def test_exact_dedup_repeated_rows_keep_one(make):
    got = exact_dedup.classes(make([(1, "x"), (1, "x"), (1, "x")])).collect()
    assert sum(r.kept for r in got) == 1 and {r.group_size for r in got} == {3}
    assert exact_dedup.classes(make([])).count() == 0


def groups(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_dedup_against_brute_force(make):
    rng = np.random.default_rng(5)
    rows, base = [], list(rng.choice(NAMES, 120))
    for i in range(40):  # a chain: each differs a little from the one before, the ends differ much
        base[3 * i] = f"n{i}"
        rows.append((100 + i, " ".join(base)))
    rows += [(1, "one"), (2, "ONE"), (3, "one two"), (4, ""), (5, None), (6, "  "), (7, "one two three four five six"), (8, "one  two three four five SIX")]
    rows += [(200 + i, " ".join(rng.choice(NAMES, 50))) for i in range(30)]
    spread = list(rng.choice(NAMES, 100))
    for i in range(60):  # variants of one text, similar and not
        w = list(spread)
        for k in rng.choice(100, rng.integers(0, 7), replace=False):
            w[k] = f"x{rng.integers(0, 20)}"
        rows.append((300 + i, " ".join(w)))
    for width, percent in ((3, 85), (5, 80)):
        got = {r.id: (r.n_shingles, r.component_id) for r in minhash.groups(make(rows), width=width, percent=percent).collect()}
        assert got == groups(rows, width, percent)


def test_near_dedup_on_documents(make, documents):
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash.groups(make(documents), width=3, percent=85).collect()}
    assert got == groups(documents, 3, 85)


def test_near_dedup_empty_and_repeated(make):
    assert minhash.groups(make([])).count() == 0
    got = minhash.groups(make([(3, "a b c d e f"), (3, "a b c d e f")])).collect()
    assert {r.component_id for r in got} == {3}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:340], rng.integers(0, 2**63, 60, dtype=np.uint64)])
    s = minhash.super_minhash(np.concatenate([a, b]), np.array([0, 400, 800]), 255)
    assert abs((s[0] == s[1]).mean() - 340 / 460) < 0.1
    few = minhash.super_minhash(a[:2], np.array([0, 0, 2]), 100)  # empty, and smaller than the signature
    assert (few[0] == 1 << 63).all() and (few[1] < 1 << 63).all()


@pytest.mark.parametrize("held", [200_000, 5])
def test_components(spark, make, held, monkeypatch):
    monkeypatch.setattr(components_module, "HELD", held)  # in few and in many tasks
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 101), (7, 7)]
    links = spark.createDataFrame(chain, "a long, b long").repartition(4)
    got = {r.node: r.component for r in components(links).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[103] == 100 and got[100] == 100


def test_near_dedup_null_and_repeated_ids(make):
    a, z = " ".join(NAMES[:30]), " ".join(NAMES[200:230])
    rows = [(5, a), (5, z), (6, f"{a} q"), (7, f"{z} q"), (None, a), (None, " ".join(NAMES[300:330])), (9, a), (9, a)]
    got = Counter((r.id, r.component_id) for r in minhash.groups(make(rows, extra="row"), width=3, percent=85).collect())
    assert got == Counter([(5, 5), (5, 5), (6, 5), (7, 5), (None, 5), (None, None), (9, 5), (9, 5)])
