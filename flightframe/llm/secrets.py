"""Secrets in release files: a keyword automaton first, patterns only where it hits, check sums last."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from flightframe.llm.store import column, type_of

KINDS = ("assign", "access", "hex", "sealed")
# The words that open a secret, lower case, by the kind of pattern tried there.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "sealed": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
}
PATTERNS = {
    "assign": re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "sealed": re.compile(rb"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
}
HEX = re.compile(rb"[0-9a-f]{24,}")
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


@cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def sealed(token: bytes) -> bool:
    """Whether the last six characters of such a token are the CRC-32 of the thirty before, in base 62."""
    body, seal = token[-36:-6], 0
    for digit in token[-6:]:
        seal = seal * 62 + DIGITS.index(digit)
    return seal == zlib.crc32(body)


def _good(kind: str, match: re.Match[bytes]) -> bool:
    if kind == "assign":
        return len(match[2]) >= 6
    return len(match[0]) >= 20 if kind == "access" else sealed(match[0])


def secret_spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """Spans (kind, start, end, base) in code points, by start, then kind as in KINDS.

    Leftmost matches of a kind do not overlap; a match that fails its test still uses up its characters.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    # One character per byte, so places in the automaton's text are places in the bytes.
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in _automaton().iter(raw.lower().decode("latin-1")))
    upto = dict.fromkeys(KINDS, 0)
    spans = [(m.start(), m.end(), "hex") for m in HEX.finditer(raw)]
    for start, kind in hits:
        if start >= upto[kind] and (match := PATTERNS[kind].match(raw, start)):
            upto[kind] = match.end()
            if _good(kind, match):
                spans.append((start, match.end(), kind))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    if len(raw) != len(text or ""):
        edges = sorted({x for s in spans for x in s[:2]})
        at, chars, place = 0, 0, {}
        for edge in edges:
            chars += len(raw[at:edge].decode("utf-8", "surrogatepass"))
            at, place[edge] = edge, chars
        spans = [(place[a], place[b], kind) for a, b, kind in spans]
    return [(kind, a, b, kind != "sealed") for a, b, kind in spans]


def _scanned(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[dict(zip(("kind", "start", "end", "base"), s)) for s in secret_spans(text)] for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["path", "spans"])


def scan_secrets(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path`` and ``spans`` (kind, start, end in code points, base) of every release file.

    Kinds: ``assign`` (a word like password or token, a sign, a value of six characters or more), ``access`` (access key ids),
    ``hex`` (24 hexadecimal digits or more) and, beside these base kinds, ``sealed``: tokens that carry a check sum, which must hold.

    A null text counts as empty and has no span. Each row is scanned alone, so ties, repeated rows and null
    paths change nothing; other columns are ignored. An empty table gives an empty result.
    """
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    source = files.select(column(path).alias("path"), column(text).cast("string").alias("text"))
    return source.mapInArrow(lambda batches: _scanned(batches, arrow), f"path {type_of(files, path)}, spans {SPANS}")
