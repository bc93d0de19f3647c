import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from riskloom.llm import stages

from .conftest import words
from .test_dedup import groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_pipeline_against_brute_force(spark, make, tmp_path):
    """Each stage's decision on its own input, on documents of every kind."""
    rng = np.random.default_rng(2)
    english, german = (["the", "and", "of"] + [f"{p}{i}" for i in "abcdefgh" for p in ("thing", "owl", "were")] for _ in range(2))
    german = ["der", "und", "nicht"] + [f"{p}{i}" for i in "äöüßk" for p in ("schl", "ungz", "keit")]
    texts = [" ".join(rng.choice(english if i % 2 else german, 60)) for i in range(40)]
    item = " ".join(rng.choice(english, 12)) + " " + " ".join(f"benchword{i}" for i in range(20))
    near = texts[5].split()
    near[59] = "changed"
    rows = [(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)]
    rows += [(100, texts[3] + "  ", "en"), (101, texts[3].replace(" ", "\n"), "en"), (102, " ".join(near), "en"), (103, f"{texts[7]} {item} {texts[9]}", "en")]
    rows += [(104, None, None), (105, "", "en"), (106, "123 456 !!", "en"), (None, texts[11] + " the last owl", None), (107, "und der " + texts[0], "de"), (107, "und der " + texts[0], "de")]
    rows = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    folder = str(tmp_path)
    table(spark, folder, "documents", rows, SCHEMA)
    table(spark, folder, "benchmark", [(1, item)], "item_id long, text string")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stages.written(stage(spark, docs, folder), name)
        after = [(r.doc_id, r.text) for r in docs.collect()]
        if name != "bpe":
            assert docs.dtypes == [tuple(x.split()[:2]) if x.split()[1] != "long" else (x.split()[0], "bigint") for x in SCHEMA.split(", ")]
        if name == "language_id":
            assert sorted(map(str, set(before) - set(after))) == sorted(map(str, [(104, None), (105, ""), (106, "123 456 !!")])) and len(after) == len(before) - 3
        elif name == "exact_dedup":
            best = {}
            for i, t in before:
                key = "".join(words(t))
                best[key] = min(best.get(key, (0, float("inf"), "")), (-len(t), float("inf") if i is None else i, t))
            assert sorted(t for _, t in after) == sorted(t for _, _, t in best.values())
        elif name == "near_dedup":
            keys = dict(enumerate(before))
            members = {}
            for k, (_, root) in groups([(k, t) for k, (_, t) in keys.items()], 5, 80).items():
                members.setdefault(root, []).append(keys[k])
            assert sorted(map(str, after)) == sorted(str(min(g, key=lambda x: (x[0] is None, x[0]))) for g in members.values())
        elif name == "decontaminate":
            assert set(before) - set(after) == {(103, f"{texts[7]} {item} {texts[9]}")}
        else:
            assert sorted(map(str, after)) == sorted(map(str, before))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}  # noqa: SIM115
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in docs.collect():
        assert r.round_trip and np.frombuffer(bytes(r.token_ids), "<u4").tolist() == encoding.encode_ordinary(r.text) and r.n_tokens == len(r.token_ids) // 4
    assert sorted(map(str, corpus_pipeline.run(spark, folder).select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, make, tmp_path, name):
    table(spark, str(tmp_path), "benchmark", [], "item_id long, text string")
    empty = spark.createDataFrame([], SCHEMA)
    assert dict(corpus_pipeline.STAGES)[name](spark, empty, str(tmp_path)).count() == 0
