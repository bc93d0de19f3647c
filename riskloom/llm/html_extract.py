"""Main text of web pages, with a suffix array over the pages of each host.

Markup is split into blocks. Blocks in elements that say what they are (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments, scripts,
styles) go. Of a page's declared main part (article, main) a whole block goes if
`SHARE` of the host's different main parts, and `LEAST` of them, hold it; nothing
within a block does, since an article may quote a line that other pages of its host
quote too. For everything outside a declared main part the token streams of a host's
pages decide: runs of `RUN` tokens, grouped by host and hash, that two pages with
different streams hold are boilerplate, and the tokens that no such run covers stay.
The streams hold the disowned blocks too, so what one page marks as its footer goes
from a page that doesn't mark it. Runs are grouped by host and key, so a host with a
third of all pages is spread over all tasks. Every repeated substring of RUN tokens or
more consists of repeated runs; no suffix array is built.

Null and empty pages have an empty text. Repeated rows are separate pages, but
pages of one host with equal token streams count as one page, so copies don't make
each other boilerplate. Extra columns pass through; columns with the names made
here are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as C
from .exchange import pack, unpack
from .tables import bucketed, written

#: Tokens of a run that makes boilerplate if it is on distinct pages of a host.
RUN = 8
#: Pages of different main parts, and their share of the host's, that make a whole block of main parts boilerplate.
LEAST, SHARE = 3, 0.5
#: Parts that a host's number of pages is joined in.
SALT = 32
#: Elements without article text.
DROPPED = {"nav", "header", "footer", "aside", "form", "noscript", "template", "iframe", "object", "svg", "math", "button", "select", "datalist", "dialog", "menu", "head", "title", "canvas", "audio", "video", "map"}
#: Elements whose content isn't markup.
RAW = ("script", "style", "textarea", "xmp")
#: Elements that make no block of their own.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MAIN = {"article", "main"}
#: Words in class, id or role that mark an element as something else than the article.
MARKED = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "complementary", "consent", "contentinfo", "cookie", "cookies", "dialog", "disclaimer", "disqus", "footer", "gdpr", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pagination", "paywall", "popup", "promo", "promoted", "promotion",
    "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Words in a name that say nothing of the element's role, and words that make a name say what the element has or lacks.
NEUTRAL = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "group", "icon", "icons", "inner", "item", "items", "left", "link",
    "links", "list", "module", "outer", "panel", "placeholder", "posts", "right", "section", "slot", "text", "top", "unit", "wrap", "wrapper", "zone",
}
MODIFIERS = {"has", "with", "no", "without", "not", "hide", "show", "is"}
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WHITE = re.compile(r"\s+")


def _says_role(name: str) -> bool:
    """Whether a class, id or role names an element that isn't the article: by its last word that isn't neutral."""
    words = [w for w in re.split(r"[^a-z0-9]+", name.split("--")[0]) if w]
    if MODIFIERS.intersection(words):
        return False
    while len(words) > 1 and (words[-1] in NEUTRAL or words[-1].isdigit()):
        words.pop()
    return bool(words) and (words[-1] in MARKED or words[-1].rstrip("0123456789") in MARKED)


def _mark(attributes: str) -> int:
    """2 for a hidden element, 1 for one that a name marks, else 0."""
    marked = 0
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return 2
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                return 2
        elif any(map(_says_role, value.split())):
            marked = 1
    return marked


def parse(source: str) -> tuple[list[str], list[str], list[str], bool]:
    """Blocks of the declared main part, other blocks, blocks that an element disowns, and whether there is a main part.

    A main part in an element that only a name marks counts if the page has none outside such elements.
    """
    inside: list[str] = []
    outside: list[str] = []
    disowned: list[str] = []
    wrapped: list[tuple[int, str]] = []  # of main parts in marked elements, with their places among the disowned
    open_tags: list[tuple[str, int, bool, int]] = []  # name, dropped (2: whatever it holds), main part, marked elements around a main part
    dropped, marked, main, around, has_main, has_wrapped = 0, 0, 0, 0, False, False
    parts: list[str] = []

    def end_block() -> None:
        if parts:
            text = _WHITE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if not text:
                return
            if not dropped and not marked and around:
                wrapped.append((len(disowned), text))
            (disowned if dropped or marked or around else inside if main else outside).append(text)

    def close(upto: int) -> None:
        nonlocal dropped, marked, main, around
        while len(open_tags) > upto:
            _, off, was_main, lifted = open_tags.pop()
            dropped -= off == 2
            marked += lifted - (off == 1)
            around -= lifted
            main -= was_main

    at, size = 0, len(source)
    while at < size:
        m = _MARKUP.search(source, at)
        if m is None:
            parts.append(source[at:])
            break
        if m.start() > at:
            parts.append(source[at : m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):  # end tag
            if name not in INLINE:
                end_block()
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == name:
                    if open_tags[i][1] or open_tags[i][2]:
                        end_block()
                    close(i)
                    break
            continue
        if name in RAW:
            finish = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            at = finish.end() if finish else size
            continue
        attributes = m.group(3)
        off = 2 if name in DROPPED else _mark(attributes) if attributes and name not in MAIN and name not in ("html", "body") else 0
        if name not in INLINE or off:
            end_block()
        if name in VOID or attributes.rstrip().endswith("/") and name in INLINE:
            continue
        is_main = not off and not dropped and (name in MAIN or 'role="main"' in attributes)
        lifted = marked if is_main else 0
        marked -= lifted
        around += lifted
        has_wrapped |= is_main and around > 0
        has_main |= is_main and not around
        open_tags.append((name, off, is_main, lifted))
        dropped += off == 2
        marked += off == 1
        main += is_main
    end_block()
    if has_wrapped and not has_main:
        for i, _ in reversed(wrapped):
            del disowned[i]
        return [t for _, t in wrapped], outside, disowned, True
    return inside, outside, disowned, has_main


#: What a block of pages holds of each after its other columns; bytes of html that make a block, and zstd's level for it.
PARSED = [("host", pa.int64()), ("main", pa.list_(pa.string())), ("rest", pa.list_(pa.string())), ("disowned", pa.list_(pa.string()))]
BLOCK_BYTES, LEVEL = 4 << 20, 6


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.\-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", url or "")
    return m.group(1).lower() if m else ""


def _parsed(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(block_id, payload): blocks of pages, packed, in buckets of their ids, so that they stay where they are when they meet their marks."""
    names = [f.name for f in pages.schema if f.name != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in C.slices(whole, html_col, BLOCK_BYTES):
                found = [parse(x or "") for x in batch.column(html_col).to_pylist()]
                hosts = [xxhash.xxh3_64_intdigest(host_of(u)) >> 1 for u in batch.column(url_col).to_pylist()]
                made = [hosts, [a if has else None for a, _, _, has in found], [b for _, b, _, _ in found], [c for _, _, c, _ in found]]
                columns = [batch.column(c) for c in names] + [pa.array(x, kind) for x, (_, kind) in zip(made, PARSED, strict=True)]
                payload = pack(pa.RecordBatch.from_arrays(columns, names=[*names, *(n for n, _ in PARSED)]), LEVEL)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([payload], pa.binary())], names=["block_id", "payload"])
                at += 1

    return bucketed(pages.select(*names, html_col).mapInArrow(run, "block_id long, payload binary"), "parsed", "block_id")


def _unpacked(payload: pa.Scalar) -> tuple[list[pa.Array], list[list]]:
    """The pages' own columns, and what PARSED names."""
    columns = unpack(payload).columns
    return columns[: -len(PARSED)], [c.to_pylist() for c in columns[-len(PARSED) :]]


def _runs(rest: list[str] | None) -> tuple[C.Words, np.ndarray]:
    """The token stream of a page, and the key of the run of RUN tokens at each token."""
    blocks = [b.encode() + b"\n" for b in rest or []]
    words = C.Words(np.frombuffer(b"".join(blocks), np.uint8), np.cumsum([0] + [len(b) for b in blocks]), C.NON_SPACE)
    return words, C.grams(words.hashes, RUN, 11)


def _keys(runs: list[np.ndarray], main: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a page's runs, and of the blocks of its main part."""
    blocks = np.unique(np.array([_block_key(b) for b in main or []], np.uint64))
    return np.unique(np.concatenate(runs)).view(np.int64), blocks.view(np.int64)


def _by_row(marked: pa.Scalar, n: int) -> list[np.ndarray]:
    """Which of their keys are repeated, for each of a block's n pages."""
    places = np.sort(np.array(marked.values if marked.is_valid else [], np.int64))
    return np.split(places & 0xFFFFFFFF, np.searchsorted(places >> 32, np.arange(1, n)))


def _covered(words: C.Words, runs: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Tokens in repeated runs; where a run only reaches into a block that has more, its few tokens there don't count."""
    hit = np.flatnonzero(np.isin(runs, repeated.view(np.uint64)))
    change = np.zeros(len(words) + 1, np.int64)
    change[hit] += 1
    change[hit + RUN] -= 1
    covered = np.cumsum(change[:-1]) > 0
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        part = covered[a:b]
        if part.any() and not part.all():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], part.astype(np.int8), [0]])))
            for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if y - x < RUN:
                    part[x:y] = False
    return covered


def _block_key(block: str) -> int:
    return xxhash.xxh3_64_intdigest(f"main {block}".encode())


def _suffixes(parsed: DataFrame) -> DataFrame:
    """(host, key, block_id, place, page, main): the runs of each page's stream outside main parts, and the blocks of its main part.

    A place is the page's row in its block and the key's index among the page's (:func:`_keys`).

    Equal streams, or equal main parts, have one page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block_id").to_pylist(), batch.column("payload"), strict=True):
                for row, (host, main, *lists) in enumerate(zip(*_unpacked(payload)[1], strict=True)):
                    streams = [_runs(x) for x in lists]
                    keys, blocks = _keys([k for _, k in streams], main)
                    if len(keys):
                        page = xxhash.xxh3_64_intdigest(b"".join(w.hashes.tobytes() + b"|" for w, _ in streams)) >> 1
                        yield made(host, keys, block, row << 32, page, False)
                    if len(blocks):
                        yield made(host, blocks, block, row << 32 | len(keys), xxhash.xxh3_64_intdigest("\n".join(main).encode()) >> 1, True)

    def made(host: int, keys: np.ndarray, block: int, place: int, page: int, main: bool) -> pa.RecordBatch:
        n = len(keys)
        columns = [pa.array(np.full(n, host)), pa.array(keys), pa.array(np.full(n, block)), pa.array(place + np.arange(n)), pa.array(np.full(n, page, np.int64)), pa.array(np.full(n, main))]
        return pa.RecordBatch.from_arrays(columns, names=["host", "key", "block_id", "place", "page", "main"])

    return parsed.mapInArrow(run, "host long, key long, block_id long, place long, page long, main boolean")


def _repeated_blocks(suffixes: DataFrame) -> DataFrame:
    """(host, key) of blocks that a large share of a host's different main parts hold."""
    blocks = suffixes.where("main")
    held = blocks.groupBy("host", "key").agg(F.countDistinct("page").alias("n")).where(F.col("n") >= LEAST).withColumn("salt", F.pmod("key", F.lit(SALT)))
    pages = blocks.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    pages = pages.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALT)])))
    return held.join(pages, ["host", "salt"]).where(F.col("n") >= SHARE * F.col("pages")).select("host", "key")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages with text, n_chars, and n_boilerplate (tokens that distinct pages of the host share: runs outside main parts, blocks in them)."""
    keep = [f for f in pages.schema if f.name not in (html_col, "text", "n_chars", "n_boilerplate")]
    parsed = _parsed(pages.select(*[f.name for f in keep], html_col), url_col, html_col)
    suffixes = written(_suffixes(parsed), "suffixes")
    repeated = suffixes.where("not main").groupBy("host", "key").agg(F.min("page").alias("low"), F.max("page").alias("high")).where("low < high").select("host", "key")
    repeated = repeated.unionByName(_repeated_blocks(suffixes))
    marks = suffixes.join(repeated, ["host", "key"]).groupBy("block_id").agg(F.collect_list("place").alias("marks"))
    names = [f.name for f in keep]
    schema = T.StructType(keep + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_boilerplate", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, marked in zip(batch.column("payload"), batch.column("marks"), strict=True):
                columns, (_, mains, rests, disowned_lists) = _unpacked(payload)
                texts, shared = [], []
                for main, rest, disowned, which in zip(mains, rests, disowned_lists, _by_row(marked, len(mains)), strict=True):
                    (words, runs), apart = _runs(rest), _runs(disowned)
                    keys = np.concatenate(_keys([runs, apart[1]], main))[which]
                    covered = _covered(words, runs, keys)
                    common = 0
                    if main is not None:
                        held = set(keys.tolist())
                        gone = [bool(held) and int(np.uint64(_block_key(b)).view(np.int64)) in held for b in main]
                        common = sum(len(b.split()) for b, g in zip(main, gone, strict=True) if g)
                        main = " ".join(b for b, g in zip(main, gone, strict=True) if not g)
                    else:
                        raw = words.data.tobytes()
                        main = " ".join(raw[a:b].decode() for a, b, c in zip(words.starts.tolist(), words.ends.tolist(), covered.tolist(), strict=True) if not c)
                    texts.append(main)
                    shared.append(common + int(covered.sum() + _covered(*apart, keys).sum()))
                made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(shared, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + made, names=[*names, "text", "n_chars", "n_boilerplate"])

    return parsed.join(marks.hint("shuffle_merge"), "block_id", "left").select("payload", "marks").mapInArrow(run, schema)
