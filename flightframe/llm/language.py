"""A bigram language model of frame payloads: interpolated modified Kneser-Ney.

Counting is spread by Spark: tasks count the tokens and token pairs of their texts, cut the counts into
shards by hash, and one task per shard adds up and writes its sorted arrays into the shared
folder. Scoring tasks map these files into memory, so a model takes the room of its pages in the
file cache, whatever its size and the number of tasks, and look tokens up by binary search.

Tokens are words (A-Z lower-cased) and one end per text. A token's number is its rank by hash; a pair's key
is made of two numbers, so only single words are told apart by hash.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightframe.llm.store import column, shared_folder, type_of
from flightframe.llm.words import U, mixed, pieces, words_of

END = mixed(np.array([0x0E2D], U))[0]
_MERGE = 2_000_000


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a hash; shards are ranges, so shards in order hold hashes in order."""
    return ((h >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Whole files only: a task that runs again puts an equal file in the place of the first."""
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        np.save(out, array)
    os.replace(part, f"{folder}/{name}.npy")


def _smallest(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    joined, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(joined, kind="stable")
    joined, n = joined[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], joined[1:] != joined[:-1]])) if len(joined) else np.zeros(0, int)
    return joined[first], np.add.reduceat(n, first) if len(first) else n


@dataclass(frozen=True)
class Model:
    """Where a model's shards lie: ``bounds[s]:bounds[s + 1]`` are the numbers of the tokens of shard s; the last number marks a text's begin."""

    folder: str
    bounds: tuple[int, ...]
    pair_discounts: tuple[float, ...] = ()
    word_discounts: tuple[float, ...] = ()
    word_counts: tuple[int, ...] = ()
    tokens: int = 0
    pairs: int = 0

    @property
    def shards(self) -> int:
        return len(self.bounds) - 1

    @property
    def vocabulary(self) -> int:
        return self.bounds[-1]

    def _open(self, name: str, s: int) -> np.ndarray:
        return np.load(f"{self.folder}/{name}-{s}.npy", mmap_mode="r")

    @cached_property
    def hashes(self) -> list[np.ndarray]:
        return [self._open("hash", s) for s in range(self.shards)]

    @cached_property
    def pair_files(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(self._open("pair", s), self._open("pairs", s)) for s in range(self.shards)]

    def files(self, name: str) -> list[np.ndarray]:
        return [self._open(name, s) for s in range(self.shards)]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Token numbers, -1 for unknown ones."""
        asked, back = np.unique(hashes, return_inverse=True)
        edges = np.searchsorted(_shard(asked, self.shards), np.arange(self.shards + 1))
        out = np.full(len(asked), -1, np.int64)
        for s in np.flatnonzero(np.diff(edges)):
            own, known = asked[edges[s] : edges[s + 1]], self.hashes[s]
            if len(known):
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                out[edges[s] : edges[s + 1]] = np.where(known[at] == own, at + self.bounds[s], -1)
        return out[back]

    def keys(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return before.astype(U) * U(self.vocabulary + 1) + after.astype(U)

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """How often pairs occur, 0 for unseen ones."""
        asked, back = np.unique(keys, return_inverse=True)
        shard = _shard(mixed(asked), self.shards)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.shards + 1))
        out = np.zeros(len(asked), np.int64)
        for s in np.flatnonzero(np.diff(edges)):
            rows = order[edges[s] : edges[s + 1]]
            known, counts = self.pair_files[s]
            if len(known):
                at = np.minimum(np.searchsorted(known, asked[rows]), len(known) - 1)
                out[rows] = np.where(known[at] == asked[rows], counts[at], 0)
        return out[back]

    def of_tokens(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """Rows of a per-token file, zeros for unknown tokens."""
        files = self.files(name)
        out = np.zeros((len(numbers), *files[0].shape[1:]), np.int64)
        shard = np.searchsorted(np.array(self.bounds[1:-1], np.int64), numbers, "right")
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edges)):
            rows = order[edges[s] : edges[s + 1]]
            rows = rows[numbers[rows] >= 0]
            out[rows] = files[s][numbers[rows] - self.bounds[s]]
        return out


def _tokens(column_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end behind each, and where texts begin."""
    words = words_of(column_, lower=True)
    counts = np.diff(words.first)
    first = words.first + np.arange(len(words.first))
    out = np.full(first[-1], END, U)
    out[np.arange(len(words.hash)) + np.repeat(np.arange(len(counts)), counts)] = words.hash
    return out, first


def _cut(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted counts as one row per shard."""
    order = np.argsort(shard, kind="stable")
    places, edges = np.unique(shard[order], return_index=True)
    edges = np.append(edges, len(order))
    rows = [(int(s), keys[order[a:b]].tobytes(), counts[order[a:b]].astype(np.uint32).tobytes()) for s, a, b in zip(places, edges, edges[1:])]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["shard", "keys", "counts"])


def _counted(batches: Iterator[pa.RecordBatch], of, place, most: int = _MERGE) -> Iterator[pa.RecordBatch]:
    """Counts of what ``of`` finds in texts, added up in the task as long as they stay below ``most``."""
    keys, counts, held = [], [], 0
    for batch in pieces(batches, 0):
        found, n = np.unique(of(batch.column(0)), return_counts=True)
        keys.append(found)
        counts.append(n)
        held += len(found)
        if held > most:
            merged = _merged(keys, counts)
            if len(merged[0]) > most // 2:
                yield from _cut(*merged, place(merged[0]))
                keys, counts, held = [], [], 0
            else:
                keys, counts, held = [merged[0]], [merged[1]], len(merged[0])
    if keys:
        merged = _merged(keys, counts)
        yield from _cut(*merged, place(merged[0]))


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    keys, counts = {}, {}
    for batch in batches:
        for s, k, n in zip(*[c.to_pylist() for c in batch.columns]):
            keys.setdefault(s, []).append(np.frombuffer(k, U))
            counts.setdefault(s, []).append(np.frombuffer(n, np.uint32))
    for s in sorted(keys):
        yield s, *_merged(keys.pop(s), counts.pop(s))


def _write_tokens(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    rows = []
    for s, keys, counts in _by_shard(batches):
        _save(folder, f"hash-{s}", keys)
        _save(folder, f"count-{s}", counts)
        rows.append((s, len(keys), int(counts.sum())))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["shard", "size", "total"])


def _pairs_of(column_: pa.Array, model: Model) -> np.ndarray:
    tokens, first = _tokens(column_)
    after = model.numbers(tokens)
    before = np.concatenate([[model.vocabulary], after[:-1]])
    before[first[:-1]] = model.vocabulary
    return model.keys(before, after)


def _write_pairs(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Writes pair shards; hands on, by token shard, what pairs say of their first and second tokens, and the counts of counts."""
    ends = np.array(model.bounds[1:-1], np.int64)
    for s, keys, counts in _by_shard(batches):
        _save(model.folder, f"pair-{s}", keys)
        _save(model.folder, f"pairs-{s}", _smallest(counts))
        before, after = (keys // U(model.vocabulary + 1)).astype(np.int64), (keys % U(model.vocabulary + 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(before, prepend=-1))
        add = lambda x: np.add.reduceat(x.astype(np.int64), first)
        facts = np.stack([add(counts), add(counts == 1), add(counts == 2), add(counts > 2)], 1)
        own = before[first]
        later, many = np.unique(after, return_counts=True)
        of_own, of_later = np.searchsorted(ends, own, "right"), np.searchsorted(ends, later, "right")
        rows = []
        for p in np.unique(np.concatenate([of_own, of_later])):
            mine, theirs = of_own == p, of_later == p
            rows.append((int(p), own[mine].tobytes(), facts[mine].tobytes(), later[theirs].tobytes(), many[theirs].tobytes()))
        for a in range(1, 5):
            rows.append((-a, b"", np.array([(counts == a).sum()], np.int64).tobytes(), b"", np.array([len(keys) if a == 1 else 0], np.int64).tobytes()))
        kinds = (pa.int64(), *[pa.binary()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["shard", "own", "facts", "later", "many"])


def _write_facts(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Per token: occurrences before others (total, once, twice, more) and the number of different tokens before it."""
    arrays, sums = {}, {}
    ints = lambda b: np.frombuffer(b, np.int64)
    for batch in batches:
        for s, own, facts, later, many in zip(*[c.to_pylist() for c in batch.columns]):
            if s < 0:
                a = sums.setdefault(s, [0, 0])
                a[0] += int(ints(facts)[0])
                a[1] += int(ints(many)[0])
                continue
            low = model.bounds[s]
            if s not in arrays:
                arrays[s] = np.zeros((model.bounds[s + 1] - low + (s == model.shards - 1), 5), np.int64)
            arrays[s][ints(own) - low, :4] += ints(facts).reshape(-1, 4)
            arrays[s][ints(later) - low, 4] += ints(many)
    rows = [("pair", -s, n, m) for s, (n, m) in sums.items()]
    for s, facts in arrays.items():
        _save(model.folder, f"facts-{s}", facts.astype(np.min_scalar_type(int(facts.max()) if facts.size else 0)))
        rows += [("word", a, int((facts[:, 4] == a).sum()), 0) for a in range(1, 5)] + [("word", 5, int((facts[:, 4] > 2).sum()), 0)]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["of", "times", "n", "pairs"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken off counts of one, two, and three or more. Where so few counts occur that the estimate
    is undefined or out of range, half a count is taken off."""
    out = []
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = i - (i + 1) * y * b / a if a else 0.5
        out.append(d if 0 < d <= i else 0.5)
    return tuple(out)


def train(payloads: DataFrame, payload: str = "payload", shard_chars: int = 400_000_000) -> Model:
    """A model of all texts of ``payloads``, its files in a new folder below ``spark.checkpoint.dir``.

    That folder must be mounted on every machine, as memory can only be mapped from there. There is a shard per
    ``shard_chars`` characters of text, and no fewer than shuffle partitions, so what a task adds up does not grow
    with the corpus. A null payload counts as empty, its end as its only token; repeated rows count repeatedly, other
    columns are ignored. An empty table gives a model without tokens, by which every token has the chance 1.
    """
    spark = payloads.sparkSession
    where = urlparse(shared_folder(spark))
    if where.scheme not in ("", "file"):
        raise ValueError("spark.checkpoint.dir must be a folder that is mounted on all machines")
    folder = unquote(where.path)
    os.makedirs(folder, exist_ok=True)
    texts = payloads.select(column(payload).cast("string").alias("payload"))
    chars = texts.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // shard_chars))
    blobs = "shard long, keys binary, counts binary"

    tokens = texts.mapInArrow(lambda b: _counted(b, lambda c: _tokens(c)[0], lambda k: _shard(k, shards)), blobs)
    sizes = tokens.repartition(shards, "shard").mapInArrow(lambda b: _write_tokens(b, folder), "shard long, size long, total long").collect()
    known = {r.shard: r for r in sizes}
    for s in set(range(shards)) - set(known):
        _save(folder, f"hash-{s}", np.zeros(0, U))
        _save(folder, f"count-{s}", np.zeros(0, np.int64))
    bounds = (0, *np.cumsum([known[s].size if s in known else 0 for s in range(shards)]).tolist())
    if bounds[-1] >= 1 << 32:
        raise ValueError("more different tokens than pair keys can number")
    model = Model(folder, bounds, tokens=sum(r.total for r in sizes))

    pairs = texts.mapInArrow(lambda b: _counted(b, lambda c: _pairs_of(c, model), lambda k: _shard(mixed(k), shards)), blobs)
    facts = pairs.repartition(shards, "shard").mapInArrow(
        lambda b: _write_pairs(b, model), "shard long, own binary, facts binary, later binary, many binary")
    rows = facts.repartition(shards, "shard").mapInArrow(lambda b: _write_facts(b, model), "of string, times long, n long, pairs long").collect()
    for s in range(shards):
        for name, empty in (("pair", np.zeros(0, U)), ("pairs", np.zeros(0, np.uint8)), ("facts", np.zeros((bounds[s + 1] - bounds[s] + (s == shards - 1), 5), np.uint8))):
            if not os.path.exists(f"{folder}/{name}-{s}.npy"):
                _save(folder, f"{name}-{s}", empty)
    total = lambda of, times: sum(r.n for r in rows if r.of == of and r.times == times)
    return Model(
        folder, bounds, discounts(*[total("pair", i) for i in range(1, 5)]), discounts(*[total("word", i) for i in range(1, 5)]),
        (total("word", 1), total("word", 2), total("word", 5)), model.tokens, sum(r.pairs for r in rows))


def _taken(counts: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    spare = sum(d * n for d, n in zip(model.word_discounts, model.word_counts))
    for batch in pieces(batches):
        tokens, first = _tokens(batch.column(1))
        numbers = model.numbers(tokens)
        asked, back = np.unique(numbers, return_inverse=True)
        count, facts = model.of_tokens("count", asked), model.of_tokens("facts", asked)
        seen = facts[:, 4]
        even = 1.0 / (model.vocabulary + 1)
        word = (seen - _taken(seen, model.word_discounts) + spare * even) / model.pairs if model.pairs else np.full(len(asked), even)
        weight = facts[:, 1:4] @ np.array(model.pair_discounts)

        begin = model.of_tokens("facts", np.array([model.vocabulary]))[0]
        place = np.concatenate([[0], back[:-1]])
        total, mass = facts[place, 0].astype(float), weight[place]
        total[first[:-1]], mass[first[:-1]] = begin[0], begin[1:4] @ np.array(model.pair_discounts)
        before = np.concatenate([[0], numbers[:-1]])
        before[first[:-1]] = model.vocabulary
        both = (before >= 0) & (numbers >= 0)
        pair = np.zeros(len(tokens), np.int64)
        pair[both] = model.pair_counts(model.keys(before[both], numbers[both]))
        lower = word[back]
        with np.errstate(divide="ignore", invalid="ignore"):
            higher = (pair - _taken(pair, model.pair_discounts) + mass * lower) / total
        chance = np.where(total > 0, higher, lower)
        plain = np.log10((count[back] + 1) / (model.tokens + model.vocabulary + 1))
        add = lambda x: np.add.reduceat(x, first[:-1]) if len(batch) else np.zeros(0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(first), pa.int64()), pa.array(add((count[back] > 0).astype(np.int64)), pa.int64()),
             pa.array(add(plain), pa.float64()), pa.array(add(np.log10(chance)), pa.float64())],
            ["url", "n_tokens", "n_known", "base_score", "score"])


def score_payloads(payloads: DataFrame, model: Model, url: str = "url", payload: str = "payload") -> DataFrame:
    """Log10 probability of every payload: ``url``, ``n_tokens``, ``n_known`` (tokens seen in training), ``base_score``
    (single tokens, each count and an unknown token raised by one), ``score`` (the model's), ``perplexity``.

    A null payload counts as empty: its only token is the end. Without any training text every token has the
    chance 1. Rows are scored alone, so repeated rows and null urls change nothing; other columns are
    ignored. An empty table gives an empty result.
    """
    source = payloads.select(column(url).alias("url"), column(payload).cast("string").alias("payload"))
    scored = source.mapInArrow(lambda batches: _scored(batches, model), f"url {type_of(payloads, url)}, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
