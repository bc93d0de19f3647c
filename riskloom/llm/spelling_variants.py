"""Grouping of spelling variants by asymmetric q-chunks.

Words are counted over all documents, with a partial count in every task. Of two
words that differ by one edit, the longer one (of equal ones the first in
code-point order) contributes two disjoint chunks of half its length, the other
its positional grams of that size. One edit leaves a chunk whole and moves it by
one place at most, so words meet in an equi-join on the chunk, its number and the
longer word's length; grams that no chunk can reach within that shift aren't
sent. The join's condition verifies the distance, so it returns true pairs only.

A word's form is its near word with the largest count (ties: the smallest in
code-point order), if that count is `ratio` times the word's or more. Counts grow along
forms, so there are no cycles, and a chain has at most log(largest count) / log(ratio)
words; roots come from pointer doubling, each round a table in the shared folder.

Null and empty texts have no words; a null id counts as empty text. Repeated rows
count as often as they are there. Very long texts are read in pieces that end
between runs. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Least code points and occurrences of a word.
LENGTH, SEEN = 6, 5
RUN = re.compile(rf"[A-Za-zÀ-ÿ]{{{LENGTH},}}")
_NO_RUN = re.compile(r"[^A-Za-zÀ-ÿ]")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Code points of a text read at a time, and words that a task holds before it sends their counts.
PIECE, HELD = 1 << 20, 200_000


def pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        cut = _NO_RUN.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def misspelt(run: str, place: bytes, every: int) -> str:
    """The run without one code point where `every` divides the checksum of its place, else as it is."""
    h = zlib.crc32(place + run.encode())
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199) -> DataFrame:
    """(word, n) of the words with at least LENGTH code points and SEEN occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                place = f"{'' if doc is None else doc}:".encode()
                for piece in pieces(text.as_py() or ""):
                    for found, n in Counter(RUN.findall(piece)).items():
                        word = misspelt(found.lower() if found.isascii() else found.translate(_LOWER), place, every)
                        if len(word) >= LENGTH:
                            counts[word] += n
                    if len(counts) >= HELD:
                        yield flush()
        yield flush()

    counted = df.select(id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= SEEN)


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, a_n, b, b_n) of words that one inserted, deleted or replaced code point turns into each other, each pair once."""
    words = words.withColumn("size", F.length("word"))
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), "size", F.explode(F.expr("array(struct(0 as slot, substring(word, 1, size div 2) as gram), struct(1 as slot, substring(word, size div 2 + 1, size div 2) as gram))")).alias("c"))
    # grams where a chunk of a word as long lies, and of a word longer by one: its second chunk here or one place before
    grams = words.select(
        F.col("word").alias("b"),
        F.col("n").alias("b_n"),
        F.explode(
            F.expr("""array(
                struct(size, 0 as slot, substring(word, 1, size div 2) as gram),
                struct(size, 1 as slot, substring(word, size div 2 + 1, size div 2) as gram),
                struct(size + 1 as size, 0 as slot, substring(word, 1, (size + 1) div 2) as gram),
                struct(size + 1 as size, 1 as slot, substring(word, (size + 1) div 2, (size + 1) div 2) as gram),
                struct(size + 1 as size, 1 as slot, substring(word, (size + 1) div 2 + 1, (size + 1) div 2) as gram))""")
        ).alias("g"),
    )
    chunks = chunks.select("a", "a_n", "size", "c.slot", "c.gram")
    grams = grams.select("b", "b_n", "g.size", "g.slot", "g.gram").distinct()
    verified = F.expr("a <> b and (length(b) < length(a) or a < b) and levenshtein(a, b, 1) = 1")
    keyed = chunks.alias("c").join(grams.alias("g"), (F.col("c.size") == F.col("g.size")) & (F.col("c.slot") == F.col("g.slot")) & (F.col("c.gram") == F.col("g.gram")) & verified)
    return keyed.select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word in `forms` (word, form): the last form of its chain."""
    known = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = written(known.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        known = jumped.select("word", "root")
        if not jumped.where("moved").limit(1).count():
            return known


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, ratio: int = 5) -> DataFrame:
    """One row (word, form, root, n, n_near, form_n) for every word of `count_words`."""
    words = written(count_words(df, id_col, text_col, every), "words")
    pairs = written(near_pairs(words), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    both = both.unionAll(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    chosen = words.join(best, "word", "left").withColumn("form_n", F.expr(f"case when -best.minus >= {ratio} * n then -best.minus end"))
    chosen = written(chosen.select("word", F.expr("case when form_n is not null then best.other end").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"), "forms")
    last = roots(chosen.where("form is not null"))
    return chosen.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
