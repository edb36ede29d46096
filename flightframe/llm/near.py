"""Near-duplicate annotation files: b-bit MinHash signatures joined by a multi-index search.

Annotations of neighbouring frames differ in a few numbers only. A file's set is its distinct
shingles of five words (A-Z lower-cased); two files are linked when 100 * shared >= 75 * union.

A signature is a row of 16-bit minima. The first ``chunks * chunk`` of them are split into chunks;
two files whose signatures differ in at most ``2 * chunks - 1`` places have, by the pigeonhole
principle, a chunk with at most one error. Each chunk is therefore entered once for every place
that may be in error, keyed by the other places, and an equality join on these keys meets every
such pair: none is missed by the search. At a similarity of 0.75 a place differs with
probability 0.25, so a link is beyond the 23 errors of the default 36 places in fewer than
one of a million cases. All ``places`` minima then thin out candidates before the exact check,
and so does a parity sketch: each shingle flips one of ``sketch`` bits, hence two sets differ in at
least as many shingles as their sketches in bits, which rules out pairs without losing a link.

Within a key no pairs are listed: files meet a few pivots of the key first. Only where a key still
holds several components are its other pairs compared, in blocks, and only pairs of different
components come out. So copies cost their number, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightframe.llm.components import components
from flightframe.llm.store import column, type_of, written
from flightframe.llm.words import U, mixed, pieces, sets_of, shingles_of, words_of


@dataclass(frozen=True)
class NearPolicy:
    shingle: int = 5
    percent: int = 75
    chunks: int = 12
    chunk: int = 3
    places: int = 128
    most_differing: int = 58
    sketch: int = 1024
    pivots: int = 3
    turns: int = 2
    block: int = 512

    def __post_init__(self) -> None:
        if self.chunk < 2 or self.chunks * self.chunk > self.places:
            raise ValueError("chunks do not fit into the signature")
        if self.sketch % 8:
            raise ValueError("a sketch takes whole bytes")

    @property
    def errors(self) -> int:
        """Differences in the searched places within which every pair is found."""
        return 2 * self.chunks - 1


NEAR = NearPolicy()
_SEEDS = mixed(np.arange(1, 1025, dtype=U) * U(0xD1342543DE82EF95)) | U(1)


def _signed(batches: Iterator[pa.RecordBatch], policy: NearPolicy) -> Iterator[pa.RecordBatch]:
    """Per file: size of its set, fingerprint of the set, signature and parity sketch (null without words)."""
    for batch in pieces(batches):
        sets = sets_of(shingles_of(words_of(batch.column(1), lower=True), policy.shingle))
        sizes = np.diff(sets.first)
        some = np.flatnonzero(sizes)
        marks = np.zeros((len(some), policy.places), np.uint16)
        prints = np.zeros((len(some), 2), U)
        flips = np.zeros((len(some), policy.sketch), bool)
        if len(some):
            starts = sets.first[:-1][some]
            for k in range(policy.places):
                least = np.minimum.reduceat(sets.hash * _SEEDS[k] + _SEEDS[k + 512], starts)
                marks[:, k] = (mixed(least) >> U(48)).astype(np.uint16)
            prints[:, 0] = mixed(np.add.reduceat(mixed(sets.hash), starts))
            prints[:, 1] = mixed(np.add.reduceat(mixed(sets.hash ^ _SEEDS[0]), starts))
            bits = (mixed(sets.hash ^ _SEEDS[1]) % U(policy.sketch)).astype(np.int64)
            for row, d in enumerate(some):
                flips[row] = np.bincount(bits[sets.first[d] : sets.first[d + 1]], minlength=policy.sketch) & 1
        rank = {int(d): i for i, d in enumerate(some)}
        cells = lambda rows: pa.array([rows[rank[d]].tobytes() if d in rank else None for d in range(len(sizes))], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), cells(prints), cells(marks), cells(np.packbits(flips, axis=1)), batch.column(2)],
            ["path", "n_shingles", "print", "signature", "sketch", "mark"])


def _keys(marks: np.ndarray, policy: NearPolicy) -> np.ndarray:
    """Per signature, chunk and place in error the key made of the chunk's other places."""
    own = marks[:, : policy.chunks * policy.chunk].reshape(-1, policy.chunks, policy.chunk).astype(U)
    keys = np.empty(own.shape, np.int64)
    for wrong in range(policy.chunk):
        acc = np.broadcast_to(_SEEDS[: policy.chunks] + U(wrong), own.shape[:2]).copy()
        for place in range(policy.chunk):
            if place != wrong:
                acc = mixed(acc * U(65537) + own[:, :, place])
        keys[:, :, wrong] = acc.view(np.int64)
    return keys


def _keyed(batches: Iterator[pa.RecordBatch], policy: NearPolicy) -> Iterator[pa.RecordBatch]:
    """One row for each chunk and place that may be in error."""
    for batch in batches:
        if len(batch):
            keys = _keys(_marks(batch.column(1), policy.places), policy)
            rows = np.repeat(np.arange(len(batch)), policy.chunks * policy.chunk)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), batch.column(0).take(pa.array(rows))], ["key", "path"])


def _marks(column_: pa.Array, places: int) -> np.ndarray:
    return np.frombuffer(b"".join(column_.to_pylist()), np.uint16).reshape(-1, places)


def _far(a: np.ndarray, b: np.ndarray, policy: NearPolicy) -> np.ndarray:
    """Whether two signatures differ in too many places, broadcasting over leading axes."""
    return (a != b).sum(-1) > policy.most_differing


def _bits(column_: pa.Array, policy: NearPolicy) -> np.ndarray:
    return np.frombuffer(b"".join(column_.to_pylist()), np.uint8).reshape(-1, policy.sketch // 8)


def _apart(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, policy: NearPolicy) -> np.ndarray:
    """Whether two sketches differ in more bits than linked sets of these sizes together can in shingles."""
    return (100 + policy.percent) * np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) > (100 - policy.percent) * sizes


def _close(batches: Iterator[pa.RecordBatch], policy: NearPolicy) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs (a, b, sizes, common shingles, signatures, sketches) that may reach the similarity."""
    for batch in batches:
        if len(batch):
            na, nb, ca, cb = (batch.column(i).to_numpy() for i in range(2, 6))
            enough = (100 + policy.percent) * np.minimum(ca, cb) >= policy.percent * (na + nb)
            keep = enough & ~_far(_marks(batch.column(6), policy.places), _marks(batch.column(7), policy.places), policy)
            keep &= ~_apart(_bits(batch.column(8), policy), _bits(batch.column(9), policy), na + nb, policy)
            yield batch.select([0, 1]).filter(pa.array(keep))


def _compared(tables: pa.Table, policy: NearPolicy) -> pa.Table:
    """Pairs of one block of a key: rows (side, path, component, n, common, signature, sketch), sides 1 and 2, or 3 for both.

    A pair comes out under its first common key only. Of two files, at most the shingles that each
    has in common with any other file can be shared, which rules out pairs before their sets are met.
    """
    key = tables["key"][0].as_py()
    side, size, common = tables["side"].to_numpy(), tables["n"].to_numpy(), tables["common"].to_numpy()
    paths, component = tables["path"].combine_chunks(), tables["component"].combine_chunks()
    code = component.dictionary_encode().indices.to_numpy()
    marks, bits = _marks(tables["signature"], policy.places), _bits(tables["sketch"], policy)
    chunks = marks[:, : policy.chunks * policy.chunk].reshape(-1, policy.chunks, policy.chunk)
    keys = _keys(marks, policy)
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    found_a, found_b = [np.zeros(0, int)], [np.zeros(0, int)]
    for i in left:
        enough = (100 + policy.percent) * np.minimum(common[right], common[i]) >= policy.percent * (size[right] + size[i])
        other = right[(code[right] != code[i]) & enough]
        other = other[~_apart(bits[other], bits[i], size[other] + size[i], policy)]
        other = other[~_far(marks[other], marks[i], policy)]
        equal = chunks[other] == chunks[i]
        chunk = (equal.sum(2) >= policy.chunk - 1).argmax(1)
        wrong = equal[np.arange(len(other)), chunk].argmin(1)
        other = other[keys[i, chunk, wrong] == key]
        found_a.append(np.full(len(other), i))
        found_b.append(other)
    take = lambda rows: paths.take(pa.array(np.concatenate(rows), pa.int64()))
    return pa.table({"a": take(found_a), "b": take(found_b)})


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of sets, one row each."""
    for batch in batches:
        cells = [np.frombuffer(s, np.int64) for s in batch.column(1).to_pylist()]
        rows = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows)), pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int64))], ["path", "shingle"])


def _sets(batches: Iterator[pa.RecordBatch], policy: NearPolicy) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        sets = sets_of(shingles_of(words_of(batch.column(1), lower=True), policy.shingle))
        cells = [sets.hash[a:b].tobytes() for a, b in zip(sets.first[:-1], sets.first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], ["path", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch], policy: NearPolicy) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            p, q = np.frombuffer(x, U), np.frombuffer(y, U)
            shared = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * shared >= policy.percent * (len(p) + len(q) - shared))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


def _sets_of(wanted: DataFrame, files: DataFrame, policy: NearPolicy) -> DataFrame:
    """The full sets (``path``, ``shingles``) of the models in ``wanted`` (``model``, and ``path`` and ``mark`` of its text)."""
    # The texts move by path at every size; a broadcast here would only hide what a large run shuffles.
    texts = files.join(wanted.hint("merge"), ["path", "mark"]).select(F.col("model").alias("path"), "xml")
    return written(texts.mapInArrow(lambda batches: _sets(batches, policy), "path long, shingles binary"))


def _confirmed(pairs: DataFrame, sets: DataFrame, policy: NearPolicy) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    both = (
        pairs.join(sets.select(F.col("path").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("path").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    )
    return both.mapInArrow(lambda batches: _linked(batches, policy), "a long, b long").distinct()


def _pivot_pairs(known: DataFrame, facts: DataFrame, turn: int, policy: NearPolicy) -> DataFrame:
    """Files (``key``, ``path``, ``component``) with the pivots of their keys from other components: the file with
    the smallest share of shingles of its own, and others drawn by a hash."""
    who = ("path", "component", "n", "common")
    rows = known.select("key", "path", "component").join(facts.select("path", "n", "common"), "path")
    central = F.min(F.struct((F.lit(1) - F.col("common") / F.col("n")).alias("s"), *who)).alias("p0")
    drawn = [F.min(F.struct(F.xxhash64(F.lit(turn * 100 + r), "path").alias("s"), *who)).alias(f"p{r}") for r in range(1, policy.pivots)]
    pivots = rows.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), central, *drawn).where("low != high").drop("low", "high")
    each = F.explode(F.array(*[F.struct(*[F.col(f"p{r}")[c].alias(c) for c in who]) for r in range(policy.pivots)]))
    # No more can be shared than each has in common with any other file.
    enough = (100 + policy.percent) * F.least("common", "p.common") >= policy.percent * (F.col("n") + F.col("p.n"))
    return rows.join(pivots, "key").select(*who, each.alias("p")).where((F.col("component") != F.col("p.component")) & enough).select(
        F.col("path").alias("a"), F.col("p.path").alias("b"))


def _both_facts(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    side = lambda x: facts.select(F.col("path").alias(x), F.col("n").alias(f"n{x}"), F.col("common").alias(f"c{x}"), F.col("signature").alias(f"s{x}"), F.col("sketch").alias(f"k{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ca", "cb", "sa", "sb", "ka", "kb")


def near_duplicate_files(files: DataFrame, path: str = "path", xml: str = "xml", policy: NearPolicy = NEAR) -> DataFrame:
    """Groups of near-duplicate annotation files.

    Returns ``path``, ``n_shingles`` (size of the file's set), ``component`` (smallest path that
    links reach, the own one included) and ``kept`` (the file is its component's smallest).

    Null, empty or blank texts have no set: they are linked with nothing and kept. A text of
    fewer than five words has its whole sequence as only shingle. Rows with the same path count as
    one file that has all their texts, each row coming back; rows with a null path are linked with
    nothing and kept. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    kind = type_of(files, path)
    files = files.select(column(path).alias("path"), column(xml).cast("string").alias("xml")).withColumn("mark", F.xxhash64("xml"))
    signed = written(files.mapInArrow(
        lambda batches: _signed(batches, policy), f"path {kind}, n_shingles long, print binary, signature binary, sketch binary, mark long"))
    named = signed.where("path is not null and print is not null")
    # One text, the class's model, stands for all with an equal set. Models have numbers, as a file of several texts may have
    # several; such a file ties its classes together in the end.
    classes = written(named.groupBy("print").agg(
        F.min(F.struct("path", "n_shingles", "signature", "sketch", "mark")).alias("r")).select(
            "print", "r.*", F.monotonically_increasing_id().alias("model")))
    members = named.select("path", "print").join(classes.select("print", "model", F.col("path").alias("least")), "print").select("path", "model", "least")
    # From here on the model's number takes the place of the path.
    models = classes.select(F.col("model").alias("path"), "n_shingles", "signature", "sketch")

    keyed = written(models.select("path", "signature").mapInArrow(
        lambda batches: _keyed(batches, policy), "key long, path long").repartition("key"))
    several_rows = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = written(keyed.join(several_rows, "key").select("key", "rows", "path"))
    met = shared.select(F.col("path").alias("model")).distinct()
    sets = _sets_of(classes.select("model", "path", "mark").join(met, "model", "left_semi"), files, policy)
    lone = sets.mapInArrow(_single, "path long, shingle long").groupBy("shingle").agg(
        F.min("path").alias("path"), F.max("path").alias("last")).where("path = last").groupBy("path").agg(F.count(F.lit(1)).alias("lone"))
    facts = written(models.join(met.withColumnRenamed("model", "path"), "path", "left_semi").join(lone, "path", "left").select(
        "path", F.col("n_shingles").alias("n"), (F.col("n_shingles") - F.coalesce("lone", F.lit(0))).alias("common"), "signature", "sketch"))

    # A file that has too little in common with all others together is similar enough to none.
    facts = facts.where(100 * F.col("common") >= policy.percent * F.col("n"))
    shared = written(shared.join(facts.select("path"), "path", "left_semi"))
    # Files meet the pivots of their keys; what is then connected is not compared again.
    known, found, links, tested = shared.withColumn("component", F.col("path")), None, None, None
    for turn in range(policy.turns):
        pairs = _ordered(_pivot_pairs(known, facts, turn, policy))
        pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(_both_facts(pairs, facts).mapInArrow(lambda batches: _close(batches, policy), "a long, b long"))
        tested = pairs if tested is None else tested.union(pairs)
        linked = written(_confirmed(pairs, sets, policy))
        links = linked if links is None else links.union(linked)
        found = written(components(links))
        known = shared.join(found, F.col("path") == F.col("node"), "left").select(
            "key", "rows", "path", F.coalesce("component", "path").alias("component"))

    # Keys that still hold several components: their other pairs, block by block.
    mixed_keys = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    blocks = F.ceil(F.col("rows") / policy.block).cast("int")
    placed = known.join(mixed_keys, "key", "left_semi").join(facts, "path").withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("path", F.lit(7)), F.col("blocks")).cast("int"))
    meets = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int").alias("side"),
        "path", "component", "n", "common", "signature", "sketch")
    second = meets.groupBy("key", "i", "j").applyInArrow(lambda table: _compared(table, policy), "a long, b long")
    second = written(_ordered(second).join(tested, ["a", "b"], "left_anti"))
    links = links.union(_confirmed(second, sets, policy)) if not second.isEmpty() else links

    several = members.groupBy("path").agg(F.min("model").alias("b"), F.max("model").alias("a")).where("a != b")
    if not several.isEmpty():
        links = links.union(members.join(several.select("path", "b"), "path").select(F.col("model").alias("a"), "b"))
    groups = components(links) if not second.isEmpty() or not several.isEmpty() else found
    named_groups = groups.join(classes.select(F.col("model").alias("node"), "path"), "node")
    least = named_groups.groupBy("component").agg(F.min("path").alias("first"))
    labels = members.join(named_groups.join(least, "component").select("node", "first"), F.col("model") == F.col("node"), "left").groupBy("path").agg(
        F.min(F.coalesce("first", "least")).alias("component"))
    return signed.join(labels, "path", "left").select(
        "path", "n_shingles", F.coalesce("component", "path").alias("component")).withColumn(
        "kept", F.col("path").eqNullSafe(F.col("component")))
