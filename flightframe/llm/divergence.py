"""How the videos of a camera modality differ in the terms of their annotations.

A term's price between two videos depends only on how often each has it, its level in each. Terms are rows of
a matrix with one indicator column per (video, level); the matrix times its transpose, taken in blocks of rows and
columns, counts the terms at every two levels of every two videos: the joint tables. Prices are then
worked out once per cell, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightframe.llm.store import column, written
from flightframe.llm.words import LOWER, pieces, words_of

#: Bytes between terms: all of ASCII but its letters.
BETWEEN = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
SCALE = 1_000_000_000
_SMALL = 50_000
#: Rows of counts handed on at once.
OUT = 1 << 16


@dataclass(frozen=True)
class DivergencePolicy:
    """Terms in fewer than ``files`` annotations of their modality are left out; ``top`` terms are named per video. A block
    has about ``rows`` terms, a product ``columns`` indicator columns a side; beyond ``videos`` videos a modality's columns are
    dealt out to several tasks."""

    files: int = 3
    top: int = 200
    rows: int = 2048
    columns: int = 1024
    videos: int = 256

    def __post_init__(self) -> None:
        if min(self.files, self.top, self.columns, self.videos) < 1 or not 1 <= self.rows <= 1 << 20:
            raise ValueError("settings out of range")


DIVERGENCE = DivergencePolicy()


def _occurring(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of the texts of a column; per (text, term) that occurs its key, text * distinct terms + term, and
    occurrences. Keys are sorted in place and arrays over all words given up once they are used, as a task holds them all."""
    words = words_of(column, True, BETWEEN)
    if not len(words.hash):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(words.hash, kind="stable").astype(np.int32)
    ordered = words.hash[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    del ordered
    at = order[fresh]
    data = LOWER[words.data]
    said = pa.array([data[a:b].tobytes() for a, b in zip(words.start[at].tolist(), words.end[at].tolist())], pa.binary()).cast(pa.string())
    keys = np.empty(len(order), np.int64)
    keys[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    each = np.diff(words.first)
    del words, data, order, fresh
    keys += np.repeat(np.arange(len(each)) * len(at), each)
    keys.sort()
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    return said, keys[edges[:-1]], np.diff(edges)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch, the terms of every (modality, video): occurrences and annotations with it."""
    for batch in pieces(batches, 2, 16 << 20):
        said, in_file, n = _occurring(batch.column(2))
        if not len(said):
            continue
        groups = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["modality", "video"])
        names, group = {}, np.empty(len(batch), np.int64)
        for i, g in enumerate(zip(*[c.to_pylist() for c in groups.flatten()])):
            group[i] = names.setdefault(g, len(names))
        cell, back = np.unique(group[in_file // len(said)] * len(said) + in_file % len(said), return_inverse=True)
        total, files = (np.bincount(back, x, len(cell)).astype(np.int64) for x in (n, None))
        del in_file, n, back
        named = [pa.array([g[i] for g in names], pa.string()) for i in range(2)]
        for low in range(0, len(cell), OUT):
            part = slice(low, low + OUT)
            of = pa.array(cell[part] // len(said))
            yield pa.RecordBatch.from_arrays(
                [named[0].take(of), named[1].take(of), said.take(pa.array(cell[part] % len(said))), pa.array(total[part]), pa.array(files[part])],
                ["modality", "video", "term", "n", "files"])
        del said, cell, total, files
        pa.default_memory_pool().release_unused()


def _products(table: pa.Table, columns: int) -> pa.Table:
    """Cells of the product of one block of terms with itself: levels of two videos (the first by name first) and the
    number of terms there. With two tiles of videos only cells of one with the other."""
    row = table["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    names, video = np.unique(table["video"].to_numpy(zero_copy_only=False), return_inverse=True)
    levels, level = np.unique(table["n"].to_numpy(), return_inverse=True)
    keys, col = np.unique(video * len(levels) + level, return_inverse=True)
    tile = np.zeros(len(names), np.int64)
    tile[video] = table["tile"].to_numpy()
    across = table["low"][0].as_py() != table["high"][0].as_py()
    own_tile = tile[keys // len(levels)]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    edges = np.searchsorted(col, np.arange(0, len(keys) + columns, columns))
    height, parts = int(row.max()) + 1, []

    def indicator(k: int) -> np.ndarray:
        out = np.zeros((height, min(columns, len(keys) - k * columns)), np.float32)
        mine = slice(edges[k], edges[k + 1])
        out[row[mine], col[mine] - k * columns] = 1
        return out

    tiles = range(-(-len(keys) // columns))
    for i in tiles:
        left = indicator(i)
        for j in tiles[i:]:
            # Sums of at most ``rows`` ones are exact in single precision.
            product = left.T @ (left if i == j else indicator(j))
            a, b = np.nonzero(product)
            n = product[a, b].astype(np.int64)
            a, b = a + i * columns, b + j * columns
            wanted = (a <= b) & ((own_tile[a] != own_tile[b]) if across else True)
            parts.append((a[wanted], b[wanted], n[wanted]))
    a, b, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
    modality = pa.array([table["modality"][0].as_py()] * len(n), pa.string())
    video_of = lambda c: pa.array(names[keys[c] // len(levels)], pa.string())
    level_of = lambda c: pa.array(levels[keys[c] % len(levels)], pa.int64())
    return pa.table([modality, video_of(a), level_of(a), video_of(b), level_of(b), pa.array(n, pa.int64())], names=["modality", "a", "a_level", "b", "b_level", "n"])


def chance(level: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (level + 1) / (total + terms)) in whole numbers."""
    raised = F.lit(SCALE).cast("decimal(20,0)") * (level + 1).cast("decimal(17,0)")
    return F.call_function("div", raised, (total + terms).cast("decimal(20,0)")) + 1


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class Counted:
    """Tables all results come from. ``videos``: every (modality, video) with ``total`` occurrences of kept terms, and
    of its modality ``terms`` kept and ``modality_total``; ``rows``: occurrences of kept terms by video."""

    def __init__(self, frames: DataFrame, modality: str, video: str, xml: str, policy: DivergencePolicy) -> None:
        text = lambda c: F.coalesce(column(c).cast("string"), F.lit(""))
        source = frames.select(text(modality).alias("modality"), text(video).alias("video"), text(xml).alias("xml"))
        counted = written(source.mapInArrow(_terms, "modality string, video string, term string, n long, files long")
                          .groupBy("modality", "video", "term").agg(F.sum("n").alias("n"), F.sum("files").alias("files")))
        kept = counted.groupBy("modality", "term").agg(F.sum("n").alias("everywhere"), F.sum("files").alias("files")).where(F.col("files") >= policy.files).drop("files")
        self.rows = written(counted.join(kept, ["modality", "term"]).select("modality", "video", "term", "n", "everywhere"))
        totals = self.rows.groupBy("modality", "video").agg(F.sum("n").alias("total"))
        # A kept term is counted with the first video by name that has it.
        once = self.rows.groupBy("modality", "term").agg(F.first("everywhere").alias("everywhere")).groupBy("modality").agg(
            F.count(F.lit(1)).alias("terms"), F.sum("everywhere").alias("modality_total"))
        none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        groups = source.select("modality", "video").distinct().join(totals, ["modality", "video"], "left").join(once, "modality", "left")
        self.videos = written(groups.select("modality", "video", none("total"), none("terms"), none("modality_total")))


def _cells(counted: Counted, policy: DivergencePolicy) -> DataFrame:
    """The products of all blocks, added up: cells of levels above 0, those of a video with itself on the diagonal.

    Terms are blocked with others of like frequency, so a block has few levels."""
    banded = counted.rows.withColumn("band", F.floor(F.log2("everywhere")))
    blocks = banded.groupBy("modality", "band", "term").agg(F.lit(1).alias("one")).groupBy("modality", "band").agg(F.ceil(F.count(F.lit(1)) / policy.rows).alias("blocks"))
    tiles = counted.videos.groupBy("modality").agg(F.ceil(F.count(F.lit(1)) / policy.videos).alias("tiles"))
    # One row per modality and power of two: small unless there are very many modalities.
    blocks = written(blocks.join(tiles, "modality"))
    blocks = F.broadcast(blocks) if blocks.count() <= _SMALL else blocks
    dealt = (
        banded.join(blocks, ["modality", "band"])
        .withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).withColumn("tile", F.pmod(F.xxhash64("video"), F.col("tiles")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        .select("modality", "band", "block", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "video", "term", "n")
    )
    columns = policy.columns
    products = dealt.groupBy("modality", "band", "block", "low", "high").applyInArrow(
        lambda t: _products(t, columns), "modality string, a string, a_level long, b string, b_level long, n long")
    return products.groupBy("modality", "a", "a_level", "b", "b_level").agg(F.sum("n").alias("n"))


def _joint(counted: Counted, policy: DivergencePolicy) -> DataFrame:
    cells = written(_cells(counted, policy))
    zero, k = F.lit(0).cast("long"), F.col("n").cast("decimal(38,0)")
    cell = lambda a, b, n: F.struct(a.alias("a_level"), b.alias("b_level"), n.alias("n"))
    spread = lambda df, *parts: df.select("modality", "a", "b", F.explode(F.array(*parts)).alias("c")).select("modality", "a", "b", "c.*")
    a, b = F.col("a_level"), F.col("b_level")
    margin = cells.where("a = b").select("modality", F.col("a").alias("video"), F.col("a_level").alias("level"), "n")
    left, right = (counted.videos.select("modality", F.col("video").alias(c), "terms") for c in "ab")
    pairs = left.join(right.drop("terms"), "modality").where("a < b")
    of = lambda side: pairs.join(margin.withColumnRenamed("video", side), ["modality", side])
    level = F.col("level")
    # What is not in a cell of two levels above 0 is at level 0 of one video or of both.
    whole = (
        spread(cells.where("a < b"), cell(a, b, k), cell(a, zero, -k), cell(zero, b, -k), cell(zero, zero, k))
        .union(spread(of("a"), cell(level, zero, k), cell(zero, zero, -k)))
        .union(spread(of("b"), cell(zero, level, k), cell(zero, zero, -k)))
        .union(pairs.select("modality", "a", "b", zero, zero, F.col("terms").cast("decimal(38,0)")))
    )
    return whole.groupBy("modality", "a", "b", "a_level", "b_level").agg(F.sum("n").alias("n")).where("n != 0")


def joint_tables(frames: DataFrame, modality: str = "modality", video: str = "video", xml: str = "xml", policy: DivergencePolicy = DIVERGENCE) -> DataFrame:
    """How many kept terms occur ``a_level`` times in video ``a`` and ``b_level`` times in video ``b`` (later by name) of a
    ``modality``, zero included: ``modality``, ``a``, ``b``, ``a_level``, ``b_level``, ``n``. Nulls, ties and empty tables as in ``video_divergence``."""
    return _joint(Counted(frames, modality, video, xml, policy), policy).withColumn("n", F.col("n").cast("long"))


def video_divergence(frames: DataFrame, modality: str = "modality", video: str = "video", xml: str = "xml", policy: DivergencePolicy = DIVERGENCE) -> DataFrame:
    """Which videos of a camera modality are annotated in other terms than others, and by which terms a video stands out.

    Terms are runs of letters (ASCII ones lower-cased) and of characters beyond ASCII. With a term's occurrences
    ``count`` in a video, N all its occurrences of kept terms and V the modality's kept terms, its chance is
    p = 1 + floor(10^9 (count + 1) / (N + V)), and a difference of p from q is priced floor((p - q)^2 / q). Returns
    ``modality``, ``video``, ``part``, ``item``, ``value``, ``rank``: in part ``pair`` the item is each other video of the modality, valued
    by the prices of all kept terms against it; in part ``term`` the item is a term that occurs in the video with a
    higher chance than in the modality, to rank ``top``. Ranks go by value, then item, from 1 in each part.

    A null annotation is empty, a null modality or video the empty one. Each row is an annotation, so repeated
    rows count repeatedly. A video without terms takes part; without kept terms pairs are worth 0. Terms are told
    apart by 64-bit hashes within a batch, by their text beyond. Other columns are ignored. An empty table gives an
    empty result. Only the numbers of pairs of videos of one modality grow faster than the table: they are the result.
    """
    counted = Counted(frames, modality, video, xml, policy)
    side = lambda c: counted.videos.select("modality", F.col("video").alias(c), F.col("total").alias(f"{c}_total"), "terms").drop(*(["terms"] if c == "b" else []))
    priced = _joint(counted, policy).join(side("a"), ["modality", "a"]).join(side("b"), ["modality", "b"]).where("terms > 0")
    chances = priced.withColumn("p", chance(F.col("a_level"), F.col("a_total"), F.col("terms"))).withColumn("q", chance(F.col("b_level"), F.col("b_total"), F.col("terms")))
    summed = lambda p, q: F.sum(F.col("n") * price(F.col(p), F.col(q)).cast("decimal(20,0)")).cast("long")
    values = chances.groupBy("modality", "a", "b").agg(summed("p", "q").alias("ab"), summed("q", "p").alias("ba"))
    both = values.select("modality", F.explode(F.array(
        F.struct(F.col("a").alias("video"), F.col("b").alias("item"), F.col("ab").alias("value")),
        F.struct(F.col("b").alias("video"), F.col("a").alias("item"), F.col("ba").alias("value")))).alias("v")).select("modality", "v.*")
    others = counted.videos.select("modality", "video").join(counted.videos.select("modality", F.col("video").alias("item")), "modality").where("video != item")
    pairs = others.join(both, ["modality", "video", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("long"))
    ranked = Window.partitionBy("modality", "video").orderBy(F.desc("value"), "item")
    p = chance(F.col("n"), F.col("total"), F.col("terms"))
    q = chance(F.col("everywhere"), F.col("modality_total"), F.col("terms"))
    named = (
        counted.rows.join(counted.videos, ["modality", "video"]).withColumn("p", p).withColumn("q", q).where("p > q")
        .select("modality", "video", F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= policy.top)
    )
    out = lambda df, part: df.select("modality", "video", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return out(pairs.withColumn("rank", F.row_number().over(ranked)), "pair").union(out(named, "term"))
