"""Footage that repeats across recordings: substring deduplication over frame fingerprints.

A recording is the sequence of its frames' fingerprints. A stretch of ``window`` consecutive frames is
removed where the same stretch also starts in a recording with a smaller name.

Suffixes are grouped by prefixes of variable length, and a suffix tree is built per group, in memory.
Only suffixes at seeds are taken: the seed of a stretch is the smallest hash among its runs of
``seed`` frames, so equal stretches have equal seeds at equal places, and all stretches with one seed
form one record, of which equal ones are counted once. Records are grouped by the seed's frames. A
group of up to ``group`` different records becomes two sorted lists with common-prefix lengths,
that is the trees of what follows the seed and of what precedes it; stretches share a node of depth
``window - l`` in the one and of depth ``l`` in the other, and the least recording below both is
theirs. Groups beyond take the longest prefix, the whole stretch: such a group is one deep node, of
which only the least recording counts, so a combined minimum stands for it whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightframe.llm.store import column, type_of, written
from flightframe.llm.words import U, mixed, pieces, runs, words_of


@dataclass(frozen=True)
class RepeatPolicy:
    window: int = 50
    seed: int = 8
    group: int = 2_000
    bucket: int = 20_000

    def __post_init__(self) -> None:
        if not 0 < self.seed <= self.window or self.group < 1 or self.bucket < self.group:
            raise ValueError("settings out of range")

    @property
    def most(self) -> int:
        """Runs of the seed's length in a stretch, so the most stretches a record can hold."""
        return self.window - self.seed + 1


REPEATS = RepeatPolicy()


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of each ``width`` neighbours."""
    n = len(values) - width + 1
    best, place, size = values, np.arange(len(values)), 1

    def pick(shift: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        right = best[shift : shift + upto] < best[:upto]
        return np.where(right, best[shift : shift + upto], best[:upto]), np.where(right, place[shift : shift + upto], place[:upto])

    while size * 2 <= width:
        best, place = pick(size, len(best) - size)
        size *= 2
    return pick(width - size, n)[1] if width > size else place[:n]


def _records(batches: Iterator[pa.RecordBatch], policy: RepeatPolicy) -> Iterator[pa.RecordBatch]:
    """(session, print, key, content, place, lead, stretches): runs of stretches with one seed."""
    names = ["session", "print", "key", "content", "place", "lead", "stretches"]
    for batch in pieces(batches, 2):
        words = words_of(batch.column(2))
        n = len(words.hash) - policy.window + 1
        if n <= 0:
            continue
        seeds = runs(words.hash, policy.seed)
        whole = runs(words.hash, policy.window)
        at = least_places(seeds, policy.most)
        owner = words.owner
        inside = owner[:n] == owner[policy.window - 1 :]
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1]) | (owner[1:n] != owner[: n - 1]) | ~inside[:-1]
        start = np.flatnonzero(new & inside)
        # A record ends before the next one begins, or with its text.
        stop = np.minimum(np.append(start[1:], n), words.first[owner[start] + 1] - policy.window + 1)
        count, lead = stop - start, at[start] - start
        content = mixed(mixed(whole[start] * U(3) + whole[stop - 1]) + (lead * 64 + count).astype(U))
        take = lambda i: batch.column(i).take(pa.array(owner[start]))
        yield pa.RecordBatch.from_arrays([
            take(0), take(1), pa.array(seeds[at[start]].view(np.int64)), pa.array(content.view(np.int64)),
            pa.array(start - words.first[owner[start]]), pa.array(lead.astype(np.int32)), pa.array(count.astype(np.int32))], names)


def _contents(batches: Iterator[pa.RecordBatch], policy: RepeatPolicy) -> Iterator[pa.RecordBatch]:
    """The frames of asked records (session, fingerprints, asked), as hashes."""
    for batch in pieces(batches):
        words = words_of(batch.column(1))
        asked = batch.column(2)
        rows = np.repeat(np.arange(len(batch)), np.diff(asked.offsets.to_numpy()))
        flat = asked.flatten()
        place, lead, count = (flat.field(i).to_numpy() for i in (2, 3, 4))
        begin = words.first[rows] + place
        frames = [words.hash[a : a + c + policy.window - 1].tobytes() for a, c in zip(begin, count)]
        yield pa.RecordBatch.from_arrays(
            [flat.field(0), flat.field(1), batch.column(0).take(pa.array(rows)), pa.array(lead), pa.array(count), pa.array(frames, pa.binary())],
            ["key", "content", "low", "lead", "stretches", "frames"])


def _padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), U)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _tree(key: np.ndarray, sequences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A suffix tree of ``sequences`` per key as sorted order and common-prefix lengths with the row before (-1 at a new key)."""
    order = np.lexsort((*sequences.T[::-1], key))
    same = sequences[order[1:]] == sequences[order[:-1]]
    common = np.where(same.all(1), sequences.shape[1], same.argmin(1))
    return order, np.concatenate([[-1], np.where(key[order[1:]] == key[order[:-1]], common, -1)])


def _nodes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Number of the node of ``depth`` above each row."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def _stretches_seen(table: pa.Table, policy: RepeatPolicy) -> pa.Table:
    """Runs of stretches, by record, that also occur in a record of a smaller recording, from the trees of a bucket of groups."""
    key, low = table["key"].to_numpy(), pc.rank(table["low"].combine_chunks(), tiebreaker="dense").to_numpy()
    lead, count = table["lead"].to_numpy(), table["stretches"].to_numpy()
    frames = [np.frombuffer(f, U) for f in table["frames"].to_pylist()]
    after = _tree(key, _padded([f[a:] for f, a in zip(frames, lead)], policy.window))
    before = _tree(key, _padded([f[:a][::-1] for f, a in zip(frames, lead)], policy.most - 1 or 1))
    seen = np.zeros((len(key), policy.most + 1), bool)
    for left in range(policy.most):
        rows = np.flatnonzero((left <= lead) & (left > lead - count))
        if len(rows) < 2:
            continue
        nodes = _nodes(*after, policy.window - left)[rows] * (len(key) + 1) + _nodes(*before, left)[rows]
        _, node = np.unique(nodes, return_inverse=True)
        least = np.full(node.max() + 1, len(key) + 1)
        np.minimum.at(least, node, low[rows])
        hit = rows[least[node] < low[rows]]
        seen[hit, lead[hit] - left] = True
    edge = np.diff(np.concatenate([np.zeros((len(key), 1), bool), seen], axis=1).astype(np.int8), axis=1)
    row, begin = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    take = lambda name: table[name].combine_chunks().take(pa.array(row))
    return pa.table({"key": take("key"), "content": take("content"), "begin": pa.array(begin.astype(np.int32)), "stop": pa.array(stop.astype(np.int32))})


def _spread(batches: Iterator[pa.RecordBatch], policy: RepeatPolicy) -> Iterator[pa.RecordBatch]:
    """Every stretch of the records of a very large group, by its whole prefix."""
    for batch in batches:
        frames = [np.frombuffer(f, U) for f in batch.column(5).to_pylist()]
        hashes = [runs(f, policy.window) for f in frames]
        rows = np.repeat(np.arange(len(frames)), [len(h) for h in hashes])
        begin = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, int)
        whole = np.concatenate(hashes) if hashes else np.zeros(0, U)
        take = lambda i: batch.column(i).take(pa.array(rows))
        yield pa.RecordBatch.from_arrays(
            [take(0), take(1), take(2), pa.array(whole.view(np.int64)), pa.array(begin.astype(np.int32))], ["key", "content", "low", "whole", "begin"])


def _cleaned(batches: Iterator[pa.RecordBatch], policy: RepeatPolicy) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals, removed, kept = [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            frames = (text or "").encode("utf-8", "surrogatepass").split()  # splits at the six ASCII spaces only
            upto, parts, gone = 0, [], 0
            for a, b in sorted((s["begin"], s["stop"]) for s in spans or ()):
                parts += frames[upto:a] if a > upto else []
                gone += max(0, b - max(a, upto))
                upto = max(upto, b)
            parts = parts + frames[upto:] if spans else frames
            totals.append(len(frames))
            removed.append(gone)
            kept.append(b" ".join(parts).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            ["session", "n_frames", "n_removed", "kept"])


def without_repeated_footage(
    recordings: DataFrame, session: str = "session", fingerprints: str = "fingerprints", policy: RepeatPolicy = REPEATS,
) -> DataFrame:
    """Recordings without stretches that a recording with a smaller name also has.

    ``fingerprints`` holds a recording's frame fingerprints in order, parted by white space. Returns ``session``,
    ``n_frames``, ``n_removed`` (frames in removed stretches) and ``kept`` (the others, one space between). Stretches are
    judged on the input, not on what is left, and compared by hashes of 64 bits per frame.

    Null, empty and short recordings lose nothing. Rows with a null session neither lose frames nor take
    them from others; rows with the same session are compared with other sessions only. Other columns are
    ignored. An empty table gives an empty result.
    """
    kind = type_of(recordings, session)
    source = recordings.select(column(session).alias("session"), column(fingerprints).cast("string").alias("fingerprints"))
    source = source.select("session", F.xxhash64("fingerprints").alias("print"), "fingerprints")
    records = written(source.where("session is not null and fingerprints is not null").mapInArrow(
        lambda batches: _records(batches, policy),
        f"session {kind}, print long, key long, content long, place long, lead int, stretches int"))
    contents = records.groupBy("key", "content").agg(
        F.min("session").alias("low"), F.max("session").alias("high"),
        F.min(F.struct("session", "print", "place", "lead", "stretches")).alias("one"))
    groups = contents.groupBy("key").agg(
        F.min("low").alias("a"), F.max("high").alias("b"), F.min("low").alias("c"), F.max("low").alias("d"), F.count(F.lit(1)).alias("rows")).where("a < b")
    known = written(contents.join(groups.select("key", "rows", (F.col("c") < F.col("d")).alias("differ")), "key"))

    # One record per different content, with its frames, from the recording that has it first.
    asked = known.where("differ").select(
        F.col("one.session").alias("session"), F.col("one.print").alias("print"),
        F.struct("key", "content", F.col("one.place").alias("place"), F.col("one.lead").alias("lead"), F.col("one.stretches").alias("stretches")).alias("r"),
    ).groupBy("session", "print").agg(F.collect_list("r").alias("asked"))
    contents_of = source.join(asked, ["session", "print"]).select("session", "fingerprints", "asked").mapInArrow(
        lambda batches: _contents(batches, policy), f"key long, content long, low {kind}, lead int, stretches int, frames binary")
    filled = written(contents_of.join(groups.where("c < d").select("key", "rows"), "key"))

    small = filled.where(F.col("rows") <= policy.group)
    buckets = small.count() // policy.bucket + 1
    in_trees = small.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(buckets))).groupBy("bucket").applyInArrow(
        lambda table: _stretches_seen(table, policy), "key long, content long, begin int, stop int")
    spread = filled.where(F.col("rows") > policy.group).drop("rows").mapInArrow(
        lambda batches: _spread(batches, policy), f"key long, content long, low {kind}, whole long, begin int")
    least = spread.groupBy("whole").agg(F.min("low").alias("m"))
    in_large = spread.join(least, "whole").where("m < low").select("key", "content", "begin", (F.col("begin") + 1).alias("stop"))
    seen = in_trees.union(in_large).distinct()

    held = records.join(known.select("key", "content", "low"), ["key", "content"])
    later = held.where("session > low").select("session", "print", F.col("place").alias("begin"), (F.col("place") + F.col("stretches") + policy.window - 1).alias("stop"))
    first = held.where("session = low").join(seen, ["key", "content"]).select(
        "session", "print", (F.col("place") + F.col("begin")).alias("begin"), (F.col("place") + F.col("stop") + policy.window - 1).alias("stop"))
    spans = later.union(first).groupBy("session", "print").agg(F.collect_set(F.struct("begin", "stop")).alias("spans"))
    return source.join(spans, ["session", "print"], "left").select("session", "fingerprints", "spans").mapInArrow(
        lambda batches: _cleaned(batches, policy), f"session {kind}, n_frames long, n_removed long, kept string")
