"""Surrogates for personal data and secrets.

Detected entities are replaced by keyed surrogates of the same type and format:
each is a permutation, under the key, of the values of its format (a Feistel
network over the digits or letters that may vary, walked until the result is valid
again). So equal entities have equal surrogates everywhere (coreference), and two
different entities of a type never share one (distinctness), without a table of
what has been replaced. Card numbers keep their network digit and a right or wrong
check digit, addresses their private or public range, telephone numbers their
country code and a 555 exchange, keys their prefix, e-mail addresses their shape
and reserved domains. Names are found after a title, which stays and
tells the gender; listed first names become names of the same gender; other parts
keep their script and case: vowels stay vowels and consonants consonants.

Null texts stay null, empty texts empty. Everything else in a text stays as it is.
Extra columns pass through; columns with the names made here are replaced.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as C

ROUNDS = 8
#: First names by gender.
FEMALE = ["Alice", "Anna", "Carmen", "Claire", "Elena", "Emma", "Eva", "Grace", "Helen", "Ingrid", "Julia", "Laura", "Lucia", "Maria", "Marie", "Nina", "Olga", "Petra", "Rosa", "Sarah", "Sophie", "Ursula"]
MALE = ["Adam", "Anton", "Carlos", "Daniel", "David", "Felix", "George", "Hans", "Henri", "Ivan", "James", "John", "Jorge", "Karl", "Louis", "Marc", "Michael", "Oscar", "Paul", "Peter", "Robert", "Thomas"]
#: Alphabets whose letters are exchanged among themselves: vowels and consonants by script.
ALPHABETS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "àáâäèéêëìíîïòóôöùúûü", "çñß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
RESERVED = re.compile(r"(?:.*\.)?example(?:\.(?:com|net|org))?|.*\.(?:test|invalid|localhost)")

_TITLE = "Mrs|Mr|Ms|Miss|Dr|Prof|Herr|Frau|Señora|Señor|Sra|Sr|Madame|Mademoiselle|Mme|Monsieur"
PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----",
    "email": r"(?<![\w.+\-])[A-Za-z0-9][\w.+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}(?![\w\-])",
    "access_key": r"(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])",
    "token": r"(?<![A-Za-z0-9])(?:(?:api|access|secret|private|auth)[_\-]?)?(?:key|token|secret|password|passwd|pwd)\s*[=:]\s*(?:[\"'][^\"'\s]{6,}(?=[\"'])|(?=[^\s\"',;]*[0-9])[^\s\"',;]{8,})|(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9\-]{10,})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])",
    "phone": r"(?<![\w+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}(?![\w])|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![\w])|(?<![\w.\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![\w\-])",
    "card": r"(?<![\w\-])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3})(?![\w\-])",
    "name": rf"(?<!\w)(?:{_TITLE})\.? [^\W\d_a-zа-я][^\W\d_]+(?:[ \-][^\W\d_a-zа-я][^\W\d_]+){{0,2}}",
}
_FIND = re.compile("|".join(f"(?P<{k}>{'(?i:' + p + ')' if k == 'token' else p})" for k, p in PATTERNS.items()))
#: What a text has to hold, in lower case, for an entity without a digit or an at sign; or one of the titles.
_SIGNS = ("token", "secret", "passw", "pwd", "key", "akia", "asia", "sk-", "xox")
_TITLED = re.compile(rf"(?<!\w)(?:{_TITLE})\.? [^\W\d_]")
_DIGIT_OR_AT = re.compile("[0-9@]")


def may_hold(text: str) -> bool:
    """Whether there can be an entity at all; most texts end here."""
    if _DIGIT_OR_AT.search(text):
        return True
    low = text.lower()
    return any(x in low for x in _SIGNS) or bool(_TITLED.search(text))


class Keyed:
    """Permutations under a key."""

    def __init__(self, key: bytes):
        self.key = key

    def draw(self, tweak: str, number: int, value: int, size: int) -> int:
        text = f"{tweak}|{number}|{value}".encode()
        return int.from_bytes(blake2b(text, key=self.key[:64], digest_size=8 + (size.bit_length() + 7) // 8).digest(), "big") % size

    def permute(self, value: int, base: int, length: int, tweak: str) -> int:
        """A permutation of the numbers of `length` digits to `base`."""
        left, right = base ** (length // 2), base ** (length - length // 2)
        if left == 1:  # one digit: a shift that moves every value
            return (value + 1 + self.draw(tweak, 0, 0, right - 1)) % right if right > 1 else value
        a, b = divmod(value, right)
        for i in range(0, ROUNDS, 2):
            a = (a + self.draw(tweak, i, b, left)) % left
            b = (b + self.draw(tweak, i + 1, a, right)) % right
        return a * right + b

    def walk(self, value: int, base: int, length: int, tweak: str, valid: Callable[[int], bool]) -> int:
        """The permutation, repeated until the result is valid: a permutation of the valid values."""
        while not valid(value := self.permute(value, base, length, tweak)):
            pass
        return value

    def letters(self, text: str, tweak: str, alphabets: list[str]) -> str:
        """Characters of each alphabet exchanged among themselves, as one number to its size; others stay."""
        out = list(text)
        shape = "".join(next((str(i) for i, a in enumerate(alphabets) if c in a), c) for c in text)
        for i, alphabet in enumerate(alphabets):
            at = [k for k, c in enumerate(text) if c in alphabet]
            if at:
                number = 0
                for k in at:
                    number = number * len(alphabet) + alphabet.index(text[k])
                number = self.permute(number, len(alphabet), len(at), f"{tweak}|{shape}|{i}")
                for k in reversed(at):
                    number, digit = divmod(number, len(alphabet))
                    out[k] = alphabet[digit]
        return "".join(out)


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def luhn(number: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(number)))
    return total % 10 == 0


def _refill(shape: str, digits: str) -> str:
    """`shape` with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c in DIGITS else c for c in shape)


def _card(k: Keyed, text: str) -> str:
    digits = "".join(c for c in text if c in DIGITS)
    n, right = len(digits) - 1, luhn(digits)
    value = k.walk(int(digits[1:]), 10, n, f"card{digits[0]}{n}", lambda v: luhn(f"{digits[0]}{v:0{n}d}") == right)
    return _refill(text, f"{digits[0]}{value:0{n}d}")


#: Networks with a meaning of their own; addresses stay within theirs, all others outside of all.
NETWORKS = [ipaddress.IPv4Network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "240.0.0.0/4")]
_RANGES = [(int(n.network_address), int(n.broadcast_address), 32 - n.prefixlen) for n in NETWORKS]


def _ip(k: Keyed, text: str) -> str:
    value = int(ipaddress.IPv4Address(".".join(str(int(p)) for p in text.split("."))))
    for low, high, bits in _RANGES:
        if low <= value <= high:
            return str(ipaddress.IPv4Address(low + k.permute(value - low, 2, bits, f"ip{low}")))
    return str(ipaddress.IPv4Address(k.walk(value, 2, 32, "ip", lambda v: not any(a <= v <= b for a, b, _ in _RANGES))))


def _phone(k: Keyed, text: str) -> str:
    lead = re.match(r"\+[0-9]{1,3}(?=[ .\-(])|\+[0-9]{1,2}", text)
    head, rest = (lead.group(), text[lead.end() :]) if lead else ("", text)
    digits = "".join(c for c in rest if c in DIGITS)
    fixed = len(digits) == 10 and digits[3:6] == "555"
    free = digits[:3] + digits[6:] if fixed else digits
    n = len(free)
    low = free[0] in "01"
    value = k.walk(int(free), 10, n, f"phone{head}{n}{fixed}", lambda v: (f"{v:0{n}d}"[0] in "01") == low)
    free = f"{value:0{n}d}"
    return head + _refill(rest, free[:3] + "555" + free[3:] if fixed else free)


def _email(k: Keyed, text: str) -> str:
    local, domain = text.lower().split("@")
    local = k.letters(local, f"email@{domain if RESERVED.fullmatch(domain) else ''}", [LOWER, DIGITS])
    if not RESERVED.fullmatch(domain):
        labels, end = domain.rsplit(".", 1)
        domain = f"{k.letters(labels, 'domain', [LOWER, DIGITS])}.{end}"
    return f"{local}@{domain}"


def _prefixed(k: Keyed, text: str) -> str:
    prefix = text[:4]
    return prefix + k.letters(text[4:], f"access{prefix}", [UPPER + DIGITS])


def _token(k: Keyed, text: str) -> str:
    m = re.match(r"[\w\-]+\s*[=:]\s*[\"']?|gh[pousr]_|sk-|xox[abp]-", text)
    head, secret = text[: m.end()], text[m.end() :]
    if re.fullmatch("[0-9a-f]+", secret):
        return head + k.letters(secret, "hex", [DIGITS + "abcdef"])
    return head + k.letters(secret, "token", [LOWER, UPPER, DIGITS])


def _iban(k: Keyed, text: str) -> str:
    flat = text.replace(" ", "")
    country, body = flat[:2], k.letters(flat[4:], f"iban{flat[:2]}", [DIGITS, UPPER])
    check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
    new = iter(f"{country}{check:02d}{body}")
    return "".join(" " if c == " " else next(new) for c in text)


def _ssn(k: Keyed, text: str) -> str:
    return _refill(text, f"{k.permute(int(text.replace('-', '')), 10, 9, 'ssn'):09d}")


def _recase(shape: str, text: str) -> str:
    return "".join(c.upper() if s.isupper() else c for s, c in zip(shape, text, strict=True))


def _name(k: Keyed, text: str) -> str:
    title, rest = text.split(" ", 1)
    words = re.split(r"([ \-])", rest)
    out = [title + " "]  # the title stays and tells the gender
    for i, w in enumerate(words):
        listed = FEMALE if w in FEMALE else MALE if w in MALE else None
        if i == 0 and len(words) > 1 and listed:
            out.append(listed[k.permute(listed.index(w), len(listed), 1, "first name")])
        elif w in (" ", "-"):
            out.append(w)
        else:
            out.append(_recase(w, k.letters(w.lower(), "name", ALPHABETS)))
    return "".join(out)


def _private_key(k: Keyed, text: str) -> str:
    head, body, tail = re.fullmatch(r"(-----BEGIN [^\-]*-----)(.*)(-----END [^\-]*-----)", text, re.S).groups()
    return head + k.letters(body, "private key", [LOWER, UPPER, DIGITS]) + tail


MAKERS = {"card": _card, "ip": _ip, "phone": _phone, "email": _email, "access_key": _prefixed, "token": _token, "iban": _iban, "ssn": _ssn, "name": _name, "private_key": _private_key}


def replace(text: str, keyed: Keyed) -> tuple[str, list[tuple[str, int, str, str]]]:
    """The text with surrogates, and (kind, position, entity, surrogate) of each entity, positions in the given text."""
    if not may_hold(text):
        return text, []
    out, found, at = [], [], 0
    for m in _FIND.finditer(text):
        kind, entity = m.lastgroup, m.group()
        new = MAKERS[kind](keyed, entity)
        out += [text[at : m.start()], new]
        found.append((kind, m.start(), entity, new))
        at = m.end()
    return "".join([*out, text[at:]]), found


ENTITY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("position", T.LongType()), T.StructField("surrogate", T.StringType()), T.StructField("entity_hash", T.BinaryType())])


def surrogates(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The rows with surrogates in `text_col`, n_entities, and entities: kind, position, surrogate, and a keyed hash of what was there."""
    fields = [f for f in df.schema if f.name not in ("n_entities", "entities")]
    names = [f.name for f in fields]
    schema = T.StructType(fields + [T.StructField("n_entities", T.LongType()), T.StructField("entities", T.ArrayType(ENTITY))])
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Keyed(secret)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("position", pa.int64()), ("surrogate", pa.string()), ("entity_hash", pa.binary())]))
        for whole in batches:
            for batch in C.slices(whole, text_col, 1 << 20):
                texts, found = [], []
                for text in batch.column(text_col).to_pylist():
                    new, entities = replace(text, keyed) if text else (text, [])
                    texts.append(new)
                    found.append([{"kind": k, "position": p, "surrogate": s, "entity_hash": blake2b(canonical(k, e).encode(), key=secret[:64], digest_size=16).digest()} for k, p, e, s in entities])
                columns = {n: batch.column(n) for n in names} | {text_col: pa.array(texts, pa.string())}
                yield pa.RecordBatch.from_arrays([columns[n] for n in names] + [pa.array([len(x) for x in found], pa.int64()), pa.array(found, kind)], names=[*names, "n_entities", "entities"])

    return df.mapInArrow(run, schema)


def canonical(kind: str, entity: str) -> str:
    """What two mentions of one entity have in common."""
    if kind == "email":
        return entity.lower()
    if kind == "name":
        return entity
    if kind in ("card", "iban"):
        return re.sub(r"[ \-]", "", entity)
    if kind == "ip":
        return ".".join(str(int(p)) for p in entity.split("."))
    return entity


def collisions(replaced: DataFrame) -> DataFrame:
    """(kind, surrogate) that stand for more than one entity, or entities with more than one surrogate; none are expected."""
    pairs = replaced.select(F.explode("entities").alias("e")).select("e.kind", F.when(F.col("e.kind").isin("card", "iban"), F.regexp_replace("e.surrogate", "[ -]", "")).otherwise(F.col("e.surrogate")).alias("surrogate"), "e.entity_hash").distinct()
    shared = pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    split = pairs.groupBy("kind", "entity_hash").agg(F.count(F.lit(1)).alias("n"), F.min("surrogate").alias("surrogate")).where("n > 1")
    return shared.unionByName(split.select("kind", "surrogate", "n"))
