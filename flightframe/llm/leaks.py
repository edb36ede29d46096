"""Held-out evaluation annotations that leaked into training annotations: containment search.

An item is contained in a file if the file has at least ``percent`` of the item's distinct shingles of
five words (A-Z lower-cased); an item of fewer words if the file has its words in a row. Items are partitioned by their number of shingles, in powers of two. An
item's MinHash sketch is its ``size - least + 1`` smallest shingle hashes, where ``least`` is the
number of shingles to be shared: a file that has ``least`` of them cannot miss the whole sketch, so the search
loses nothing. A file is matched with a partition only if it has as many shingles as the
partition's smallest item asks for, and only by its hashes below the partition's largest sketch value.
Candidates are verified by counting shared shingles in full.

The items lie in the shared folder, in portions of bounded size. A task reads them one after the other for each
stretch of its files, so files are scanned once, and neither the driver nor a task holds all items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightframe.llm.store import column, filesystem, shared_folder, type_of, written
from flightframe.llm.words import U, pieces, runs, sets_of, shingles_of, words_of

_STRETCH = 8 << 20


@dataclass(frozen=True)
class LeakPolicy:
    """A portion of items, all that a task holds of them, has about ``index_shingles`` shingles."""

    shingle: int = 5
    percent: int = 75
    index_shingles: int = 2_000_000

    def __post_init__(self) -> None:
        if not 0 < self.percent <= 100 or self.index_shingles < 1:
            raise ValueError("settings out of range")


LEAKS = LeakPolicy()


class Partition(NamedTuple):
    least: int
    highest: int
    hashes: np.ndarray
    items: np.ndarray


class Index(NamedTuple):
    """Items by number: their shingles, what must be shared, the sketches by size partition, and the short items
    (hashes and numbers, sorted) by their number of words."""

    ids: pa.Array
    sets: list[np.ndarray]
    least: np.ndarray
    partitions: list[Partition]
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def indexed(ids: pa.Array, sets: list[np.ndarray], words: np.ndarray, policy: LeakPolicy) -> Index:
    sizes = np.array([len(s) for s in sets], int)
    least = -(-sizes * policy.percent // 100)
    partitions, short = [], {}
    for k in np.unique(words[words < policy.shingle]):
        own = np.flatnonzero(words == k)
        hashes = np.concatenate([sets[i] for i in own])
        order = np.argsort(hashes, kind="stable")
        short[int(k)] = hashes[order], own[order]
    long = (sizes > 0) & (words >= policy.shingle)
    for power in np.unique(np.log2(sizes[long]).astype(int)):
        own = [i for i, n in enumerate(sizes) if long[i] and int(np.log2(n)) == power]
        hashes = [sets[i][: sizes[i] - least[i] + 1] for i in own]
        order = np.argsort(np.concatenate(hashes), kind="stable")
        joined = np.concatenate(hashes)[order]
        items = np.concatenate([np.full(len(h), i) for i, h in zip(own, hashes)])[order]
        partitions.append(Partition(int(least[own].min()), int(joined[-1]), joined, items))
    return Index(ids, sets, least, partitions, short)


def contained(own: np.ndarray, index: Index) -> Iterator[tuple[int, int]]:
    """Items (number, shared shingles) that a file with the sorted shingles ``own`` contains."""
    for part in index.partitions:
        if len(own) < part.least:
            continue
        asked = own[: np.searchsorted(own, U(part.highest), "right")]
        low, high = np.searchsorted(part.hashes, asked, "left"), np.searchsorted(part.hashes, asked, "right")
        met = np.flatnonzero(high > low)
        if not len(met):
            continue
        for item in np.unique(np.concatenate([part.items[a:b] for a, b in zip(low[met], high[met])])):
            other = index.sets[item]
            at = np.minimum(np.searchsorted(own, other), len(own) - 1)
            shared = int((own[at] == other).sum())
            if shared >= index.least[item]:
                yield int(item), shared


def _short_ones(words: np.ndarray, index: Index) -> Iterator[int]:
    """Short items whose words stand in a row in a file with the word hashes ``words``."""
    for k, (hashes, items) in index.short.items():
        own = np.unique(runs(words, k))
        low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
        for at in np.flatnonzero(high > low):
            yield from items[low[at] : high[at]].tolist()


@lru_cache(maxsize=1)
def _portion(folder: str, number: int, policy: LeakPolicy) -> Index | None:
    store, place = filesystem(folder)
    name = f"{place}/{number}.arrow"
    if store.get_file_info(name).is_file:
        with store.open_input_file(name) as source:
            table = pa.ipc.open_file(source).read_all().combine_chunks()
        ids = table["item"].combine_chunks() if table.num_rows else pa.array([], table.schema.field("item").type)
        sets = [np.frombuffer(s, U) for s in table["shingles"].to_pylist()]
        return indexed(ids, sets, table["words"].to_numpy(), policy)
    return None


def _kept(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes the portions of a task, each as one file; a task that runs again puts an equal file in its place."""
    store, place = filesystem(folder)
    held: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        for number in np.unique(batch["portion"].to_numpy()):
            mine = batch.filter(pa.array(batch["portion"].to_numpy() == number))
            held.setdefault(int(number), []).append(mine.select(["item", "shingles", "words"]))
    store.create_dir(place)
    for number, parts in held.items():
        part = f"{place}/.{number}-{uuid4().hex}"
        with store.open_output_stream(part) as out, pa.ipc.new_file(out, parts[0].schema) as writer:
            for own in parts:
                writer.write_batch(own)
        store.move(part, f"{place}/{number}.arrow")
    yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], ["n"])


def _stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Pieces of batches, put together up to ``most`` bytes."""
    held, size = [], 0
    for batch in pieces(batches):
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _searched(batches: Iterator[pa.RecordBatch], folder: str, portions: int, policy: LeakPolicy) -> Iterator[pa.RecordBatch]:
    # With one portion there is nothing to save by putting pieces together.
    for stretch in _stretches(batches, _STRETCH if portions > 1 else 0):
        told = [words_of(batch.column(1), lower=True) for batch in stretch]
        sets = [sets_of(shingles_of(words, policy.shingle)) for words in told]
        for number in range(portions):
            index = _portion(folder, number, policy)
            if index is None:
                continue
            for batch, words, own in zip(stretch, told, sets):
                rows, items, counts = [], [], []
                for d in range(len(batch)):
                    found = list(contained(own.hash[own.first[d] : own.first[d + 1]], index))
                    if index.short:
                        found += [(item, 1) for item in _short_ones(words.hash[words.first[d] : words.first[d + 1]], index)]
                    for item, shared in found:
                        rows.append(d)
                        items.append(item)
                        counts.append(shared)
                take = lambda values, at: values.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [take(batch.column(0), rows), take(index.ids, items), pa.array(counts, pa.int64()),
                     pa.array([len(index.sets[i]) for i in items], pa.int64())], ["path", "item", "shared", "item_shingles"])


def _sets(batches: Iterator[pa.RecordBatch], policy: LeakPolicy) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        words = words_of(batch.column(1), lower=True)
        sets = sets_of(shingles_of(words, policy.shingle))
        cells = [sets.hash[a:b].tobytes() for a, b in zip(sets.first[:-1], sets.first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary()), pa.array(np.diff(words.first), pa.int64())], ["item", "shingles", "words"])


def leaked_items(
    files: DataFrame, held_out: DataFrame, path: str = "path", xml: str = "xml", item: str = "item", item_xml: str = "xml", policy: LeakPolicy = LEAKS,
) -> DataFrame:
    """Held-out annotations inside training files: ``path``, ``item``, ``shared``, ``item_shingles``.

    Null, empty and blank texts contain nothing and are contained in nothing; an item of fewer than five words has
    its whole sequence as only shingle, and is found wherever these words stand in a row. Repeated rows
    report repeatedly, equal items each; null paths and null items stay null. Other columns are ignored.
    An empty side gives an empty result.
    """
    kind, item_kind = type_of(files, path), type_of(held_out, item)
    sets = held_out.select(column(item).alias("item"), column(item_xml).cast("string").alias("xml")).mapInArrow(
        lambda batches: _sets(batches, policy), f"item {item_kind}, shingles binary, words long").where(F.octet_length("shingles") > 0)
    items = written(sets.withColumn("at", F.monotonically_increasing_id()))
    total = items.agg(F.sum(F.octet_length("shingles") / 8)).first()[0] or 0
    portions, folder = int(total // policy.index_shingles) + 1, shared_folder(files.sparkSession)
    # Rows are dealt by their number, so that equal items share portions like others.
    dealt = items.withColumn("portion", F.pmod(F.xxhash64("at"), F.lit(portions))).repartition(portions, "portion")
    dealt.select("item", "shingles", "words", "portion").mapInArrow(lambda b: _kept(b, folder), "n long").write.format("noop").mode("overwrite").save()
    source = files.select(column(path).alias("path"), column(xml).cast("string").alias("xml"))
    return source.mapInArrow(lambda b: _searched(b, folder, portions, policy), f"path {kind}, item {item_kind}, shared long, item_shingles long")
