"""How two tokenizers cut the same frame payloads: byte-level BPE (A) against pieces with byte fallback (B).

Each distinct payload is tokenised and aligned once and counts as often as it occurs. Tokens of A and B whose
byte ranges end together are linked; the places where both end cut the payload into groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightframe.llm.lexicon import Lexicon, ragged, spread
from flightframe.llm.store import column, written
from flightframe.llm.words import pieces, text_bytes

_JOINED = 1000
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Part(NamedTuple):
    """A stretch of text that both tokenizers cut on its own."""

    n_a: int
    n_b: int
    links: bytes
    groups: str


class Aligner:
    """Both tokenizers, the bytes of their tokens, and all pairs of tokens that can be linked.

    Linked tokens end together, so one's bytes end with the other's: pairs are listed by looking up each
    token's endings in the other vocabulary. Their number is at most that of all endings (times two, as a
    single byte can be two pieces of B), a bound on what is counted and broadcast.
    """

    def __init__(self, byte_tokenizer: str, piece_tokenizer: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_tokenizer)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_tokenizer)
        code = _byte_of()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()
        as_byte = lambda i, p: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [as_byte(i, p) for i, p in enumerate(names)]
        # A piece that goes on behind a word's end would reach over the cuts made between words.
        self.whole = any("▁" in p.lstrip("▁") for p in names)
        self.pairs = self._pairs()
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.digits = np.array([len(n) for n in self.names], np.int64)
        self.lexicon = Lexicon(self._aligned)

    def _pairs(self) -> np.ndarray:
        by_bytes = lambda table: {t: [i for i, _ in g] for t, g in _grouped(table)}
        a_of, b_of = by_bytes(self.a_bytes), by_bytes(self.b_bytes)
        keys = []
        for token, own in a_of.items():
            for k in range(len(token)):
                keys += [a * len(self.b_bytes) + b for b in b_of.get(token[k:], ()) for a in own]
        for token, own in b_of.items():
            for k in range(1, len(token)):
                keys += [a * len(self.b_bytes) + b for a in a_of.get(token[k:], ()) for b in own]
        return np.sort(np.array(keys, np.int64))

    def _aligned(self, parts: list[str]) -> list[Part | None]:
        """Parts begin with the space that A gets; B adds its own. None where bytes differ. Parts without white
        space at their ends are worked on many at a time, as both cut between them."""
        out: list[Part | None] = [None] * len(parts)
        words = [i for i, p in enumerate(parts) if len(p) > 1 and not p[1].isspace() and not p[-1].isspace() and "▁" not in p]
        groups = [words[low : low + _JOINED] for low in range(0, len(words), _JOINED)]
        groups += [[i] for i in set(range(len(parts))) - set(words)]
        while groups:
            own = groups.pop()
            found = self._together([parts[i] for i in own])
            if found is None and len(own) > 1:
                # One of them does not come back: halves, down to that one.
                groups += [own[: len(own) // 2], own[len(own) // 2 :]]
                continue
            for i, part in zip(own, found or [None]):
                out[i] = part
        return out

    def _together(self, parts: list[str]) -> list[Part] | None:
        """The parts of one text, cut behind each; None where a tokenizer does not give back the text or cuts elsewhere."""
        text = "".join(parts)
        data = text.encode()
        a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.b.encode(text[1:], num_threads=1), np.int64)
        if b"".join([self.a_bytes[i] for i in a.tolist()]) != data or b"".join([self.b_bytes[i] for i in b.tolist()]) != data:
            return None
        a_end, b_end = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        common, last_a, last_b = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
        part_end = np.cumsum([len(p.encode()) for p in parts])
        last = np.searchsorted(common, part_end)
        if (common[last] != part_end).any():
            return None
        links = np.searchsorted(self.pairs, a[last_a] * len(self.b_bytes) + b[last_b]).astype(np.uint32).tobytes()
        # Tokens by group, A before B; the last A of a group is followed by a bar, its last B by a semicolon.
        order = np.argsort(np.concatenate([np.searchsorted(common, a_end) * 2, np.searchsorted(common, b_end) * 2 + 1]), kind="stable")
        marks = np.zeros(len(order), np.int64)
        marks[last_a], marks[len(a) + last_b] = 1, 2
        ids = np.concatenate([a, b])[order]
        said = "".join([self.names[i] + ",|;"[m] for i, m in zip(ids.tolist(), marks[order].tolist())])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(self.digits[ids] + 1)
        ends = place[len(a) + last_b[last]]
        n_a, n_b = (np.diff(np.searchsorted(end, part_end, "right"), prepend=0) for end in (a_end, b_end))
        bounds, cuts = [0, *((last + 1) * 4).tolist()], [0, *ends.tolist()]
        return [Part(x, y, links[i:j], said[k : m - 1]) for x, y, i, j, k, m in zip(n_a.tolist(), n_b.tolist(), bounds, bounds[1:], cuts, cuts[1:])]


def _grouped(table: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, bytes]]]]:
    groups: dict[bytes, list[tuple[int, bytes]]] = {}
    for i, token in enumerate(table):
        if token:
            groups.setdefault(token, []).append((i, token))
    return iter(groups.items())


@lru_cache(maxsize=2)
def aligner(byte_tokenizer: str, piece_tokenizer: str) -> Aligner:
    return Aligner(byte_tokenizer, piece_tokenizer)


def parts_of(texts: pa.Array, whole: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Texts, a space before each, cut before single spaces between words, and where each text's parts begin.

    Both tokenizers begin a token at such a space whatever stands before, so parts are independent. Next to
    white space, control characters and characters whose first byte may belong to Unicode white space
    nothing is cut.
    """
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
    data, bounds = text_bytes(spaced)
    begins = np.zeros(len(data) + 1, bool)
    if not whole and len(data) > 2:
        plain = (data > 0x20) & (data != 0x7F)
        unclear = (data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)
        before = plain.copy()
        before[1:] &= ~(unclear[:-1] & (data[:-1] == 0xC2))
        before[2:] &= ~(unclear[:-2] & (data[:-2] != 0xC2))
        after = plain & ~unclear
        begins[1:-2] = (data[1:-1] == 0x20) & before[:-2] & after[2:]
    begins[bounds] = True
    cuts = np.flatnonzero(begins)
    first = np.searchsorted(cuts, bounds)
    buffers = [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, buffers), first


def _measured(batches: Iterator[pa.RecordBatch], byte_tokenizer: str, piece_tokenizer: str) -> Iterator[pa.RecordBatch]:
    both = aligner(byte_tokenizer, piece_tokenizer)
    for batch in pieces(batches, 0):
        parts, first = parts_of(batch.column(0), both.whole)
        which, found = both.lexicon(parts)
        number = lambda f, kind=np.int64: np.fromiter((f(p) if p else 0 for p in found), kind, len(found))[which]
        starts = np.minimum(first[:-1], max(len(which) - 1, 0))
        add = lambda x: np.add.reduceat(x, starts) if len(batch) else np.zeros(0, np.int64)
        good = add(number(lambda p: 1)) == np.diff(first)
        sizes = np.fromiter((len(p.links) // 4 if p else 0 for p in found), np.int64, len(found))
        flat = np.frombuffer(b"".join(p.links for p in found if p), np.uint32)
        kept = sizes[which] * np.repeat(good, np.diff(first))
        links = flat[spread((np.cumsum(sizes) - sizes)[which], kept)]
        bounds = np.concatenate([[0], np.cumsum(kept)])[first]
        said = [p.groups if p else "" for p in found]
        digests = [hashlib.sha256(";".join([said[i] for i in which[a:b]]).encode()).hexdigest() if g else "" for a, b, g in zip(first[:-1], first[1:], good)]
        n_a, n_b, n_groups = (add(number(f)) * good for f in (lambda p: p.n_a, lambda p: p.n_b, lambda p: len(p.links) // 4))
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()), pa.array(digests), ragged(links, bounds)],
            ["print", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "links"])


def _counted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for batch in batches:
        for copies, links in zip(batch.column(0).to_pylist(), batch.column(1)):
            own, n = np.unique(np.frombuffer(links.as_buffer(), np.uint32), return_counts=True)
            total[own] += n * copies
    pair = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(total[pair], pa.int64())], ["pair", "n"])


def _weighed(batches: Iterator[pa.RecordBatch], counts: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of = batch.column("links")
        rows = [np.frombuffer(x.as_buffer(), np.uint32) for x in of]
        weighed = [(int(best[r].sum()), int(counts[r].sum())) for r in rows]
        kept = [batch.column(c) for c in ("print", "n_a", "n_b", "n_groups", "groups_sha256")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array([w[0] for w in weighed], pa.int64()), pa.array([w[1] for w in weighed], pa.int64())],
            ["print", "n_a", "n_b", "n_groups", "groups_sha256", "n_best", "count_sum"])


def aligned_payloads(payloads: DataFrame, byte_tokenizer: str, piece_tokenizer: str, url: str = "url", payload: str = "payload") -> DataFrame:
    """How the tokenizers' cuts of every payload agree: ``url``, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``,
    ``n_best`` (links whose pair is the most frequent of its B token, over all payloads), ``count_sum`` (of the links'
    pair counts) and ``groups_sha256`` (of ``a1,a2|b1;a3|b2``, decimal ids).

    A gets the payload with a space before it, special tokens' strings as plain text; B adds that space itself.
    Payloads are brought together by their full text, so each is worked on once; pair counts take it as often as
    it occurs; its measures go back to the urls by its SHA-256. No token is empty, so a place where both end is
    one link. Tokenizer paths must exist on all machines.

    Null and empty payloads, and those whose tokens do not give back the payload's bytes, have zeros and
    an empty digest. Rows with one url, null urls and repeated rows are reported each. Other columns are
    ignored. An empty table gives an empty result.
    """
    source = payloads.select(column(url).alias("url"), F.coalesce(column(payload).cast("string"), F.lit("")).alias("payload"))
    distinct = source.where("payload != ''").groupBy("payload").agg(F.count(F.lit(1)).alias("copies"))
    aligned = written(distinct.select("payload", F.unhex(F.sha2(F.encode("payload", "UTF-8"), 256)).alias("print"), "copies").mapInArrow(
        lambda b: _measured(b, byte_tokenizer, piece_tokenizer),
        "print binary, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"))
    both = aligner(byte_tokenizer, piece_tokenizer)
    size = len(both.pairs)
    counts = np.zeros(size, np.int64)
    for row in aligned.select("copies", "links").mapInArrow(lambda b: _counted(b, size), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[row.pair] = row.n
    highest = np.zeros(len(both.b_bytes), np.int64)
    later = both.pairs % len(both.b_bytes)
    np.maximum.at(highest, later, counts)
    shared = payloads.sparkSession.sparkContext.broadcast((counts, counts == highest[later]))
    measures = aligned.drop("copies").mapInArrow(
        lambda b: _weighed(b, *shared.value), "print binary, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long")
    own = source.select("url", F.when(F.col("payload") != "", F.unhex(F.sha2(F.encode("payload", "UTF-8"), 256))).alias("print"))
    joined = own.join(measures.withColumn("n_links", F.col("n_groups")), "print", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select("url", *[zero(c) for c in MEASURES], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
