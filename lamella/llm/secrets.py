"""Secrets in texts: fixed patterns, and strings that compress badly where a secret is expected."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

#: Fixed patterns and least lengths.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAMED = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words near which a string counts as sensitive, and the string.
_NEAR = ("passwd", "password", "passphrase", "secret", "token", "credential", "private", "apikey", "api_key", "api-key", "access_key", "accesskey", "auth", "bearer", "signature")
_SENSITIVE = re.compile(f"(?i:{'|'.join(map(re.escape, _NEAR))})", re.A)
_STRING = re.compile(r"[A-Za-z0-9+/_=~-](?:[A-Za-z0-9+/_=.~-]{10,}[A-Za-z0-9+/_=~-])", re.A)
#: Characters on either side of a sensitive word in which a string is a candidate, and those it is measured against.
REACH, AROUND = 160, 256
#: A string's least share of the bytes that its own characters take there in a drawn order, in which nothing but their
#: frequencies is left to save; the least share of its length these must be; and the least surprise, in bits, of its pairs of characters to one who knows the corpus's words.
NEW, DENSE, SURPRISE = 0.8, 0.4, 5.0
#: Identifiers and phrases of code that a candidate is measured against.
IDENTIFIERS = (
    "import from return class def function const let var public private static void string int bool null none true false self this "
    "username password secret token api_key access_key client_id client_secret authorization bearer basic content-type application/json "
    "https://www.example.com/index.html localhost config settings environment variable default required optional description "
    "production development connection database server account session request response header parameter argument exception message "
    "the and for with that this from have which their would there about other these into time could your than then them only some"
).encode()


def corpus_words(docs: DataFrame, text: str = "text", most: int = 2000, least: int = 10) -> list[str]:
    """The ``most`` words of 5 to 24 letters that the most documents have, ``least`` or more, counted over all of them, the rarest first."""
    each = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(r"(?<![\p{L}\p{N}_])[\p{L}_]{5,24}(?![\p{L}\p{N}_])"), F.lit(0)))).alias("word"))
    top = each.groupBy("word").count().where(F.col("count") >= least).orderBy(F.desc("count"), "word").limit(most).collect()
    return [r["word"] for r in reversed(top)]


class Novelty:
    """How new a string is: the bytes it adds to the compressed form of what surrounds it, with identifiers as the dictionary."""

    def __init__(self, words: list[str], level: int = 9):
        shared = zstandard.ZstdCompressionDict(" ".join(words).encode() + b" " + IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=level)
        self.compressor = zstandard.ZstdCompressor(dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False)
        self.pairs: Counter = Counter()
        for word in [*words, *IDENTIFIERS.decode().split()]:
            self.pairs.update(zip(word, word[1:], strict=False))
        self.firsts: Counter = Counter()
        for (a, _), n in self.pairs.items():
            self.firsts[a] += n

    def of(self, candidate: str, around: str) -> int:
        """Marginal compressed bytes of ``candidate``."""
        base = around.encode()
        return len(self.compressor.compress(base + candidate.encode())) - len(self.compressor.compress(base))

    def surprise(self, candidate: str) -> float:
        pairs = list(zip(candidate, candidate[1:], strict=False))
        return sum(-log2((self.pairs[p] + 0.5) / (self.firsts[p[0]] + 32)) for p in pairs) / len(pairs)

    def reports(self, candidate: str, around: str) -> bool:
        if not any(c.isalpha() for c in candidate) or self.surprise(candidate) < SURPRISE:
            return False
        drawn = self.of("".join(random.Random(len(candidate)).sample(candidate, len(candidate))), around)
        return drawn >= DENSE * len(candidate) and self.of(candidate, around) >= NEW * drawn


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, each kind leftmost and without overlap."""
    low = text.lower()
    found = [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    if any(name in low for name in _NAMED):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def surroundings(text: str, start: int, end: int) -> str:
    """The ``AROUND`` characters on either side of a string, without other copies of it, whole or cut by the window's ends."""
    own, low, high = text[start:end], max(0, start - AROUND), min(len(text), end + AROUND)
    at = text.find(own, max(0, low - len(own) + 1), low + len(own) - 1)
    low = at + len(own) if at >= 0 and at < low else low
    at = text.find(own, max(end, high - len(own) + 1), high + len(own) - 1)
    high = at if at >= 0 and at < high < at + len(own) else high
    return (text[min(low, start) : start] + text[end : max(high, end)]).replace(own, " ")


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, str]]:
    """Strings near a sensitive word, or in the line after one that is reported, which are new where they stand."""
    low = text.lower()
    if not any(name in low for name in _NEAR):
        return []
    near: list[list[int]] = []
    for m in _SENSITIVE.finditer(text):
        start, end = m.start() - REACH, m.end() + REACH
        if near and start <= near[-1][1]:
            near[-1][1] = end
        else:
            near.append([start, end])
    ends, taken = [e for _, e in near], []
    for start, end, _ in base:
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    taken_ends = [e for _, e in taken]
    found: list[tuple[int, int, str]] = []
    for m in _STRING.finditer(text):
        start, end = m.span()
        at = bisect_left(ends, start)
        follows = bool(found) and text[found[-1][1] : start].strip(" \t\r") == "\n"
        if not follows and (at == len(near) or near[at][0] > end):
            continue
        at = bisect_left(taken_ends, start + 1)
        if at < len(taken) and taken[at][0] < end:
            continue
        if novelty.reports(m[0], surroundings(text, start, end)):
            found.append((start, end, "novel"))
    return found


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def _scan(words: Broadcast):
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words.value)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(text or "")
                extra = novel_spans(text or "", base, novelty)
                every = sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))
                count = [sum(k == kind for _, _, k in every) for kind in KINDS]
                out.append((doc_id, *count[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), count[3]))
            kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.int64(),)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

    return run


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts by kind, all spans in code points, and a digest of the fixed patterns' spans.

    A ``novel`` span is a string of 12 or more characters, a letter among them (numbers and addresses are none), within ``REACH`` characters of a sensitive word,
    before or after it, in its line or another (or in the line after such a span), which is new where it stands:
    beside its surroundings, other copies of it left out, and a dictionary of identifiers and of the corpus's commonest words it costs at least
    four fifths of the compressed bytes that its own characters cost there in a drawn order, whatever its length, and its
    pairs of characters are not those of the corpus's words. It never overlaps a span of the fixed patterns.

    One reading counts words, of which the driver gets the commonest 2000; in the second each document is read on
    its own, where it lies. Null and empty texts have no spans: counts 0, the digest of nothing. Repeated rows give
    repeated rows. Null ids stay null. Other columns are not read. No rows give none.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    words = docs.sparkSession.sparkContext.broadcast(corpus_words(rows))
    return rows.mapInArrow(_scan(words), SCHEMA)
