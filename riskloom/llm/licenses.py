"""License scans: Aho-Corasick for identifier tags and notice phrases, a shunting-yard parser for expressions.

Phrases are found in the normalised words of a text (A-Z in lower case, runs of
digits, a-z and characters beyond ASCII), at word boundaries, overlapping places
included. Identifier tags are found in the text itself; the expression after a tag
is parsed to postfix order and evaluated: its licences give labels, and it is
permissive if its `or` parts have a permissive choice and its `and` parts are all
permissive (`with` keeps what its licence is).

Null and empty texts have no words, no places, and empty labels. An expression that
can't be parsed gives no labels. Extra columns pass through; columns with the
names made here are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textcore as C
from .substring_dedup import kept_bytes

#: Base phrases and their labels, fixed by the task.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases of this method.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license version 2 0": "apache-2",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0-1.0",
    "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
PERMISSIVE = {"mit", "mit-0", "apache-2", "apache-2.0", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0", "0bsd", "bsl-1.0"}
#: How tightly the operators of an expression bind.
BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*(\(|\)|[a-z0-9][a-z0-9.+:\-]*)")


def tokens(expression: str) -> list[str]:
    """Tokens up to the first text that isn't one; two licence names in a row end the expression."""
    out, at, depth, operand = [], 0, 0, False
    while m := _TOKEN.match(expression, at):
        t = m.group(1)
        if t == "(":
            if operand:
                break
            depth += 1
        elif t == ")":
            if not operand or not depth:
                break
            depth -= 1
        elif t in BINDS:
            if not operand:
                break
            operand = False
        else:
            if operand:
                break
            operand = True
        out.append(t)
        at = m.end()
    while out and out[-1] in BINDS:
        out.pop()
    return out


def postfix(infix: list[str]) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order, None if brackets don't match."""
    out, waiting = [], []
    for t in infix:
        if t == "(":
            waiting.append(t)
        elif t == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif t in BINDS:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[t]:
                out.append(waiting.pop())
            waiting.append(t)
        else:
            out.append(t)
    while waiting:
        if (t := waiting.pop()) == "(":
            return None
        out.append(t)
    return out


def evaluate(order: list[str] | None) -> tuple[bool, set[str]] | None:
    """Whether the expression can be met with permissive licences only, and the licences in it."""
    stack: list[tuple[bool, set[str]]] = []
    for t in order or []:
        if t not in BINDS:
            stack.append((t in PERMISSIVE, {t}))
            continue
        if len(stack) < 2:
            return None
        (right, more), (left, names) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((left, names))
        else:
            stack.append(((left and right) if t == "and" else (left or right), names | more))
    return stack[0] if len(stack) == 1 else None


@cache
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for p in {**BASE, **NOTICES}:
        phrases.add_word(p, p)
    for t in TAGS:
        tags.add_word(t, len(t))
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("expressions", T.ArrayType(T.StringType())),
    T.StructField("permissive", T.BooleanType()),
]


def _scan(column: pa.Array) -> list[pa.Array]:
    phrases, tags = _automata()
    data, offsets = C.string_bytes(column)
    low = C.folded(data)
    n = len(offsets) - 1
    words = C.Words(low, offsets, C.ALNUM_LOWER, hashed=False)
    flat, bounds = kept_bytes(words, np.ones(len(words), bool))
    # a line break after each text, so that no phrase spans two
    lines = np.insert(flat, bounds[1:], 0x0A)
    begins = bounds[:-1] + np.arange(n)
    sizes = words.ends - words.starts
    word_at = np.cumsum(sizes + 1) - sizes - 1
    empty = np.flatnonzero(words.counts() == 0)  # an empty text still has its line break
    word_at = word_at + np.searchsorted(empty, np.repeat(np.arange(n), words.counts()))
    text = lines.tobytes().decode("latin-1")
    places: dict[int, list[tuple[int, str]]] = {}
    for end, phrase in phrases.iter(text):
        a = end + 1 - len(phrase)
        if (a == 0 or text[a - 1] in " \n") and text[end + 1] in " \n":
            i = int(np.searchsorted(begins, a, "right")) - 1
            places.setdefault(i, []).append((int(np.searchsorted(word_at, a)) - int(words.first[i]), phrase))
    parsed: dict[int, list[tuple[str, tuple[bool, set[str]] | None]]] = {}
    raw = low.tobytes().decode("latin-1")
    for end, _ in tags.iter(raw):
        i = int(np.searchsorted(offsets, end, "right")) - 1
        line = raw[end + 1 : int(offsets[i + 1])].split("\n", 1)[0]
        infix = tokens(line)
        if infix:
            parsed.setdefault(i, []).append((" ".join(infix), evaluate(postfix(infix))))
    out: list[list] = [[] for _ in ADDED]
    for i, count in enumerate(words.counts().tolist()):
        here, found = places.get(i, []), parsed.get(i, [])
        base = [(w, p) for w, p in here if p in BASE]
        labels = {BASE.get(p) or NOTICES[p] for _, p in here}
        names = set().union(*(e[1] for _, e in found if e))
        verdicts = [e[0] for _, e in found if e] + [label in PERMISSIVE for label in labels]
        evidence = len({p for _, p in here}) + 2 * sum(e is not None for _, e in found)
        row = (
            count,
            len(base),
            min((w for w, _ in base), default=None),
            max((w for w, _ in base), default=None),
            ",".join(sorted({BASE[p] for _, p in base})),
            ",".join(sorted(labels | names)),
            1.0 - 0.5**evidence,
            [x for x, _ in found],
            all(verdicts) if verdicts else None,
        )
        for values, v in zip(out, row, strict=True):
            values.append(v)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.bool_()]
    return [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the columns of ADDED to every row."""
    names = [a.name for a in ADDED]
    fields = [f for f in df.schema if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in C.slices(whole, text_col, 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in fields] + _scan(batch.column(text_col)), names=[f.name for f in fields] + names)

    return df.mapInArrow(run, T.StructType(fields + ADDED))
