"""Registered queries of this subpackage: op1 to op13 and the pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, hard_negatives, html_extract, language_id, licenses, minhash, ngram_join, pii, spelling_variants, substring_dedup, toxicity
from .tables import read, written

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Key of the registered query's surrogates; users of the operator pass their own.
SURROGATE_KEY = "surrogates of the test tables"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes they decode to, as digests."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, RANKS, and_decode=True).select(
        "doc_id",
        F.expr("octet_length(token_ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that no repeated 35-word window covers."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 3-word shingle sets of similarity 0.85 or more."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = minhash.groups(docs, width=3, percent=85).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages in them: one row for each document and item."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, read(spark, sf_dir, "benchmark")).select("doc_id", F.explode("matches").alias("m"))
    return found.select("doc_id", "m.item_id", "m.first_word", "m.cosine", "m.lcs", "m.answer")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of those with equal texts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.classes(docs, carry=["doc_id"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", "n_chars", "n_boilerplate")


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data; fails if two entities share one."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    replaced = written(pii.surrogates(docs, SURROGATE_KEY), "surrogates")
    if clash := pii.collisions(replaced).head(1):
        raise ValueError(f"surrogates don't tell entities apart: {clash[0].kind}")
    return replaced.select("doc_id", "text", "n_entities", F.col("entities.kind").alias("kinds"), F.col("entities.position").alias("positions"), F.col("entities.surrogate").alias("surrogates"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from three quarters of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    model = language_id.fit(docs.where("not held_out"))
    return language_id.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from four fifths of the labelled ones."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", language_id.held_out(modulus=5, remainder=0))
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.where("not held_out").join(labels, "doc_id"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases, tags and expressions of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).drop("text")


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 4-word shingle sets of similarity 0.85 or more."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.groups(docs, width=4, percent=85).withColumnRenamed("id", "doc_id")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every frequent word of the documents, with planted misspellings."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_variants.variants(docs, every=199)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", label))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_html_extract": op6_html_extract,
    "op7_language_id": op7_language_id,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan,
    "op11_ngram_jaccard": op11_ngram_jaccard,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL: dict[str, str] = {
    "op5_exact_dedup": r"""
        with d as (select doc_id, coalesce(text, '') as t from documents),
        n as (select doc_id, length(t) as points, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') as normal from d),
        g as (select *, count(*) over (partition by normal) as group_size,
                     first_value(doc_id) over (partition by normal order by points desc, doc_id) as keep_id from n)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(normal) as text_sha256 from g
    """,
    "op11_ngram_jaccard": r"""
        with recursive d as (
            select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
            from documents),
        s as (
            select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                                when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as token from d),
        n as (select doc_id, count(*) as n from s group by doc_id),
        links as (
            select a.doc_id as x, b.doc_id as y from s a join s b using (token) join n p on p.doc_id = a.doc_id join n q on q.doc_id = b.doc_id
            where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, p.n, q.n having 100 * count(*) >= 85 * (p.n + q.n - count(*))),
        reach as (select doc_id as x, doc_id as y from documents union select r.x, l.y from reach r join links l on l.x = r.y)
        select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, (select min(y) from reach where reach.x = d.doc_id) as component_id
        from documents d left join n using (doc_id)
    """,
    "op13_hard_negatives": r"""
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as c
            from embeddings
            where vec_id is not null and label is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
        s as (
            select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_dot_product(a.c, b.c)::bigint as score
            from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
        p as (select anchor_id, other as positive_id, score as positive_score from s where same
              qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
        select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, other)::int as rank,
               other as negative_id, positive_score, score as negative_score
        from p join s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * score and score <= positive_score
        qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, other) <= 5
    """,
}
