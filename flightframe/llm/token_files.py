"""Token ids of frame payloads in compact binary files.

Ids are written as canonical Huffman codes of at most ``longest`` bits, made from the counts of all
ids. A file (little-endian, bits from the highest on) is

    magic ``FFT1``, rows u4, before u8, ids u8, block u4, blocks u4, key bytes u8, bit bytes u8
    checkpoint u4 per block: the bit at which it begins    ids u4 per row    key bytes i4 per row, -1 for null
    keys (UTF-8)    codes    CRC-32 u4 of all before

Every ``block`` ids begin at a checkpoint, so blocks are decoded independently of each other; a
reader needs the lengths of the codes only; ``before`` are the ids written before by the same task. A folder
holds ``files``, ``manifest`` (per task: the name its files begin with, and how many ids they hold) and
``codes`` (id, count, bits).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightframe.llm.lexicon import Lexicon, ragged, spread
from flightframe.llm.store import column, filesystem, shared_folder, type_of, written
from flightframe.llm.words import pieces

MAGIC = b"FFT1"
HEAD = np.dtype([("magic", "S4"), ("rows", "<u4"), ("before", "<u8"), ("ids", "<u8"), ("block", "<u4"), ("blocks", "<u4"), ("key_bytes", "<u8"), ("bit_bytes", "<u8")])
_SLICE, _JOINED = 1 << 18, 2000
#: Punctuation behind a word's last letter. A token never reaches over that border, so both sides are looked up on
#: their own; apostrophes and the marks of special tokens may belong to both.
_TAIL = r"""(\p{L})([!"#$%&()*+,./:;=?@\[\\\]^_`{}~-]+)([ \t-\r]|$)"""


@dataclass(frozen=True)
class TokenPolicy:
    """``end`` closes each payload; codes have up to ``longest`` bits; a file is closed with the payload that
    brings it to ``file_ids`` ids, so a task holds that many and one payload."""

    end: int = 2
    longest: int = 18
    block: int = 512
    file_ids: int = 4_000_000

    def __post_init__(self) -> None:
        if not 1 <= self.longest <= 24 or min(self.block, self.file_ids) < 1 or self.end < 0:
            raise ValueError("settings out of range")


TOKENS = TokenPolicy()


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Bits per symbol of the shortest prefix code within ``longest`` bits (package-merge); counts are positive."""
    n = len(counts)
    if n > 1 << longest:
        raise ValueError(f"{n} symbols need codes of more than {longest} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    weights, packages, levels = counts[order].astype(np.int64), np.zeros(0, np.int64), []
    for _ in range(longest):
        items = np.concatenate([weights, packages])
        by_weight = np.argsort(items, kind="stable")
        levels.append(by_weight < n)
        items = items[by_weight][: len(items) // 2 * 2]
        packages = items[::2] + items[1::2]
    taken, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for single in reversed(levels):
        singles = int(single[:taken].sum())
        lengths[:singles] += 1
        taken = 2 * (taken - singles)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


@dataclass(frozen=True)
class Codes:
    """Canonical codes: by length, then id; ``bits`` are the lengths of ``ids``."""

    ids: np.ndarray
    bits: np.ndarray

    @property
    def longest(self) -> int:
        return int(self.bits.max()) if len(self.bits) else 1

    def _ordered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids, self.bits))
        room = np.int64(1) << (self.longest - self.bits[order])
        return order, room, np.cumsum(room) - room

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Code, its highest bit in the highest place of 64, and length by id."""
        order, _, first = self._ordered()
        size = int(self.ids.max()) + 1 if len(self.ids) else 0
        code, bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        code[self.ids[order]] = first.astype(np.uint64) << np.uint64(64 - self.longest)
        bits[self.ids] = self.bits
        return code, bits

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length by the next ``longest`` bits."""
        order, room, _ = self._ordered()
        ids, bits = np.zeros(1 << self.longest, np.uint32), np.ones(1 << self.longest, np.int64)
        ids[: room.sum()], bits[: room.sum()] = np.repeat(self.ids[order], room), np.repeat(self.bits[order], room)
        return ids, bits


def packed(ids: np.ndarray, encoder: tuple[np.ndarray, np.ndarray], block: int) -> tuple[np.ndarray, bytes]:
    """Checkpoints and codes of ids, taken in slices of whole blocks."""
    step = block * max(1, _SLICE // block)
    slices = [ids[low : low + step] for low in range(0, len(ids), step)]
    total = sum(int(encoder[1][own].sum()) for own in slices)
    out, checkpoints, upto = np.zeros(total // 64 + 2, np.uint64), [], 0
    for own in slices:
        code, bits = encoder[0][own], encoder[1][own]
        begin = upto + np.cumsum(bits) - bits
        upto = int(begin[-1] + bits[-1])
        checkpoints.append(begin[::block].astype(np.uint32))
        word, inside = begin >> 6, (begin & 63).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] |= np.bitwise_or.reduceat(code >> inside, first)
        over = np.flatnonzero((begin & 63) + bits > 64)
        out[word[over] + 1] |= code[over] << (np.uint64(64) - inside[over])
    return np.concatenate(checkpoints) if checkpoints else np.zeros(0, np.uint32), out.byteswap().tobytes()[: (total + 7) // 8]


def unpacked(data: np.ndarray, checkpoints: np.ndarray, n: int, block: int, codes: Codes, decoder: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The n ids behind the checkpoints; all blocks are decoded side by side, one id of each at a time."""
    data = np.concatenate([data, np.zeros(4, np.uint8)])
    ids, bits = decoder
    at = checkpoints.astype(np.int64)
    out = np.zeros((min(block, n), len(at)), np.uint32)
    mask, last = (1 << codes.longest) - 1, n - (len(at) - 1) * block
    for i in range(len(out)):
        if i == last:
            at = at[:-1]
        byte = at >> 3
        window = (data[byte].astype(np.int64) << 24) | (data[byte + 1].astype(np.int64) << 16) | (data[byte + 2].astype(np.int64) << 8) | data[byte + 3]
        asked = (window >> (32 - codes.longest - (at & 7))) & mask
        out[i, : len(at)] = ids[asked]
        at = at + bits[asked]
    return out.T.reshape(-1)[:n]


def file_bytes(keys: list[str | None], ids: list[np.ndarray], before: int, encoder: tuple[np.ndarray, np.ndarray], block: int) -> bytes:
    whole = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    checkpoints, bits = packed(whole, encoder, block)
    said = [k.encode() if k is not None else b"" for k in keys]
    sizes = np.array([len(s) if k is not None else -1 for k, s in zip(keys, said)], "<i4")
    text = b"".join(said)
    head = np.array([(MAGIC, len(keys), before, len(whole), block, len(checkpoints), len(text), len(bits))], HEAD)
    body = b"".join([head.tobytes(), checkpoints.astype("<u4").tobytes(), np.array([len(i) for i in ids], "<u4").tobytes(), sizes.tobytes(), text, bits])
    return body + np.array([zlib.crc32(body)], "<u4").tobytes()


def file_rows(content: memoryview, codes: Codes, decoder: tuple[np.ndarray, np.ndarray]) -> tuple[list[str | None], int, np.ndarray, np.ndarray]:
    """Keys, ids before the file's, ids per row, and all ids of a file."""
    if bytes(content[:4]) != MAGIC or zlib.crc32(content[:-4]) != int(np.frombuffer(content[-4:], "<u4")[0]):
        raise ValueError("not a whole token file")
    head = np.frombuffer(content, HEAD, 1)[0]
    place = HEAD.itemsize

    def part(kind: str, n: int) -> np.ndarray:
        nonlocal place
        out = np.frombuffer(content, kind, n, place)
        place += out.nbytes
        return out

    checkpoints, sizes, key_sizes = part("<u4", int(head["blocks"])), part("<u4", int(head["rows"])), part("<i4", int(head["rows"]))
    text, bits = part("u1", int(head["key_bytes"])).tobytes(), part("u1", int(head["bit_bytes"]))
    ends = np.cumsum(np.maximum(key_sizes, 0))
    keys = [text[e - n : e].decode() if n >= 0 else None for e, n in zip(ends.tolist(), key_sizes.tolist())]
    return keys, int(head["before"]), sizes.astype(np.int64), unpacked(bits, checkpoints, int(head["ids"]), int(head["block"]), codes, decoder)


@lru_cache(maxsize=2)
def _lexicon(path: str) -> Lexicon:
    """Ids of words; white space never is part of a token here, so words are told apart before they are encoded.

    Words of letters alone are encoded many at a time and cut behind the tokens that end a word, where
    the vocabulary marks these and there are as many as words.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix")
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for t, i in tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True

    def encoded(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def work(words: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        plain = [i for i, w in enumerate(words) if suffix and w.isalpha()]
        single = [i for i, w in enumerate(words) if not (suffix and w.isalpha())]
        for low in range(0, len(plain), _JOINED):
            own = plain[low : low + _JOINED]
            ids = encoded([" ".join([words[i] for i in own])])[0]
            cuts = np.flatnonzero(ends[ids])
            if len(cuts) != len(own):
                single += own
                continue
            said, bounds = ids.tobytes(), [0, *((cuts + 1) * 4).tolist()]
            for i, a, b in zip(own, bounds, bounds[1:]):
                out[i] = said[a:b]
        for low in range(0, len(single), _JOINED):
            own = single[low : low + _JOINED]
            for i, ids in zip(own, encoded([words[i] for i in own])):
                out[i] = ids.tobytes()
        return out

    return Lexicon(work)


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, policy: TokenPolicy, kind: str) -> Iterator[pa.RecordBatch]:
    lexicon = _lexicon(tokenizer)
    for batch in pieces(batches, size=8 << 20):
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(batch.column(1).fill_null(""), _TAIL, r"\1 \2\3"))
        which, found = lexicon(words.flatten())
        flat = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        lengths = sizes[which]
        places = spread((np.cumsum(sizes) - sizes)[which], lengths)
        own = np.concatenate([[0], np.cumsum(lengths)])[words.offsets.to_numpy()]
        bounds = own + np.arange(len(own))
        ids = np.full(bounds[-1], policy.end, np.uint32)
        ids[np.arange(len(places)) + np.repeat(np.arange(len(batch)), np.diff(own))] = flat[places]
        yield pa.RecordBatch.from_arrays([batch.column(0), ragged(ids.astype(kind), bounds)], ["key", "ids"])


def _counted(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for low in range(0, len(batch), 256):
            own = np.bincount(np.frombuffer(b"".join(batch.column(0).slice(low, 256).to_pylist()), kind))
            if len(own) > len(total):
                total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
            total[: len(own)] += own
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])


def _filed(batches: Iterator[pa.RecordBatch], folder: str, codes: Codes, policy: TokenPolicy, kind: str) -> Iterator[pa.RecordBatch]:
    """Writes files of the sorted rows and hands on their common name; a task that runs again takes another."""
    store, place = filesystem(folder)
    store.create_dir(place)
    encoder, partition, before, held, files = codes.encoder(), TaskContext.get().partitionId(), 0, 0, 0
    name = f"part-{partition}-{uuid.uuid4().hex}"
    keys, ids = [], []

    def close() -> None:
        with store.open_output_stream(f"{place}/{name}-{files}.tok") as out:
            out.write(file_bytes(keys, ids, before, encoder, policy.block))

    for batch in batches:
        for key, own in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(np.frombuffer(own.as_buffer(), kind))
            keys.append(key)
            held += len(ids[-1])
            if held >= policy.file_ids:
                close()
                before, held, files, keys, ids = before + held, 0, files + 1, [], []
    if keys:
        close()
    if before + held:
        yield pa.RecordBatch.from_arrays([pa.array([partition]), pa.array([name]), pa.array([before + held])], ["partition", "name", "ids"])


@dataclass(frozen=True)
class TokenFiles:
    """A folder of token files and the type of their keys."""

    folder: str
    key_type: str


def write_token_files(
    payloads: DataFrame, tokenizer: str, url: str = "url", payload: str = "payload", folder: str | None = None, policy: TokenPolicy = TOKENS,
) -> TokenFiles:
    """The token ids of every payload, closed by ``policy.end``, in files in ascending order of ``url``.

    ``tokenizer`` is the path of a ``tokenizers`` file, present on all machines, whose tokens hold no white space;
    ``folder`` a new folder all machines share (one below ``spark.checkpoint.dir`` by default; local, HDFS and
    object stores). Ids are kept once in a table, counted, and written by tasks that hold one range of urls each.

    Null urls come first; rows of one url follow by their ids' hash, then as they came, so a frequent url is
    split over tasks. A null, empty or blank payload is its end alone. Repeated rows are all written. Other
    columns are ignored. An empty table gives a folder without files.
    """
    folder = folder or shared_folder(payloads.sparkSession)
    from tokenizers import Tokenizer

    kind = type_of(payloads, url)
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), policy.end + 1)
    held = "<u2" if size <= 1 << 16 else "<u4"  # ids on their way to the files
    source = payloads.select(column(url).alias("key"), column(payload).cast("string").alias("payload"))
    table = written(source.mapInArrow(lambda b: _encoded(b, tokenizer, policy, held), f"key {kind}, ids binary").withColumn("at", F.monotonically_increasing_id()))
    counts = table.select("ids").mapInArrow(lambda b: _counted(b, held), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted((r.id, r.n) for r in counts.collect())  # one per token of the vocabulary
    ids, n = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    codes = Codes(ids, code_lengths(n, policy.longest))
    spark = payloads.sparkSession
    spark.createDataFrame([(*r, int(b)) for r, b in zip(rows, codes.bits)], "id long, n long, bits long").coalesce(1).write.parquet(f"{folder}/codes")
    order = (F.col("key").asc_nulls_first(), F.xxhash64("ids"), F.col("at"))
    sorted_rows = table.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("key").cast("string").alias("key"), "ids")
    sorted_rows.mapInArrow(lambda b: _filed(b, f"{folder}/files", codes, policy, held), "partition long, name string, ids long").write.parquet(f"{folder}/manifest")
    return TokenFiles(folder, kind)


def _read(batches: Iterator[pa.RecordBatch], codes: Codes, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    decoder = codes.decoder()
    for batch in batches:
        for begin, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            keys, before, sizes, ids = file_rows(memoryview(content.as_buffer()), codes, decoder)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            low = 0
            while low < len(keys):
                high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + most, "right")) - 1)
                own = bounds[low : high + 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[low:high], pa.string()), pa.array(own[:-1] + before + begin, pa.int64()), pa.array(sizes[low:high], pa.int64()),
                     ragged(ids[own[0] : own[-1]].astype("<u4"), own - own[0])], ["url", "start", "n_tokens", "ids"])
                low = high


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """What the files of a folder hold: ``url``, ``start`` (ids before the row's), ``n_tokens``, ``ids`` (little-endian
    unsigned 32-bit integers). Files the manifest does not name, left by tasks that were lost, are not read."""
    # One row per writing task: their number is a setting, so the names may go to all tasks.
    tasks = spark.read.parquet(f"{files.folder}/manifest").sort("partition").collect()
    if not tasks:
        return spark.createDataFrame([], f"url {files.key_type}, start long, n_tokens long, ids binary")
    book = spark.read.parquet(f"{files.folder}/codes").sort("id").collect()  # one row per token of the vocabulary
    codes = Codes(np.array([r.id for r in book], np.int64), np.array([r.bits for r in book], np.int64))
    ends = np.cumsum([t.ids for t in tasks])
    named = spark.createDataFrame([(t.name, int(e - t.ids)) for t, e in zip(tasks, ends)], "name string, begin long")
    name = F.regexp_extract("path", r"(part-[0-9]+-[0-9a-f]+)-[0-9]+\.tok$", 1).alias("name")
    stored = spark.read.format("binaryFile").load(f"{files.folder}/files").select(name, "content")
    rows = stored.join(F.broadcast(named), "name").select("begin", "content").mapInArrow(lambda b: _read(b, codes), "url string, start long, n_tokens long, ids binary")
    return rows.withColumn("url", F.col("url").cast(files.key_type))
