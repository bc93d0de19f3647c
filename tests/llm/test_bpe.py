import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = bpe.Vocabulary(bpe.read_ranks(PATH))
ENCODING = tiktoken.Encoding(
    "own",
    pat_str=public_tokenizers.PATTERN,
    mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))},  # noqa: SIM115
    special_tokens={},
)
PIECES = st.sampled_from(["a", "s", "'", "'s", "'ll", "'re", " '", "t", " ", "  ", "\n", "\t", "1", "²", "!", "é", "中", "　", "\x85", "\x1c", "😀", "the", "ing"])


def encode(texts):
    starts = np.cumsum([0] + [len(t) for t in texts])
    ids, first = VOCABULARY.encode("".join(texts), starts)
    return [ids[a:b].tolist() for a, b in zip(first, first[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.lists(PIECES, max_size=20).map("".join)), min_size=1, max_size=5))
def test_ids_equal_the_reference_library(texts):
    assert encode(texts) == [ENCODING.encode_ordinary(t) for t in texts]


def test_long_runs():
    texts = ["a" * 5000, "=" * 3000 + " " * 3000, "é" * 2000, ""]
    assert encode(texts) == [ENCODING.encode_ordinary(t) for t in texts]


def test_cache_may_be_cleared():
    VOCABULARY.clear()
    assert encode(["hello world"]) == [ENCODING.encode_ordinary("hello world")]


def test_round_trip_and_edge_rows(make):
    rows = [(1, "It's 42 — naïve\n"), (2, None), (3, ""), (3, ""), (None, "x" * 3000)]
    df = make(rows, extra="token_ids")  # a clashing name is replaced
    got = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert len(got) == 5
    key = lambda r: (str(r.doc_id), bytes(r.token_ids), bytes(r.token_starts), bytes(r.decoded))
    assert sorted(map(key, got)) == sorted(map(key, bpe.encode(df, PATH, and_decode=True).collect()))
    for r in got:
        ids = np.frombuffer(bytes(r.token_ids), "<u4").tolist()
        assert ids == ENCODING.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
        starts = np.frombuffer(bytes(r.token_starts), "<u4")
        assert len(starts) == len(ids) and (len(starts) == 0 or starts[0] == 0)


def test_empty_table(make):
    assert bpe.decode(bpe.encode(make([]), PATH), PATH).count() == 0


def test_query(spark, make):
    from riskloom.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op1_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect():
        ids = ENCODING.encode_ordinary(r.text)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
