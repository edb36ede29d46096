"""Token files, tokenizers' cuts and divergences against plain restatements, with awkward texts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flightframe.llm.alignment import aligned_payloads, aligner, parts_of
from flightframe.llm.divergence import DivergencePolicy, joint_tables, video_divergence
from flightframe.llm.queries import QUERIES
from flightframe.llm.token_files import Codes, TokenPolicy, code_lengths, packed, read_token_files, unpacked, write_token_files

public = pytest.importorskip("public_tokenizers")
WORD, BYTE, PIECE = (public.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    None, "", " ", "\n \t", "one", "a  b   c", " x y  z", " lead and trail ", "<|endoftext|> and </s><s>", "don't  we'll I'M", "é è́ ça 　 漢字 かな x",
    "tab\there\x00nul \x1c sep", "under▁score ▁", "🛩️ drone 🛩️🛩️", "x" * 5000, "1234 5.6e-7 ٣٤", "a b  c ​ d", "İSTANBUL ǅ ß ﬁ", "[10,10,30,30] <bndbox>",
    "word.%%% don't. l'été, x<|endoftext|>. (a) e\u0301, [b]! ab!'s c.'ll \"d\"; é… e.'", "w " * 700, "\x85 a \x85b", "a \x7f b \x01",
]


def odd_payloads(spark):
    random.seed(7)
    letters = ["a", "b", " ", "  ", "\n", "é", " ", " ", "▁", "漢", "'s", "1", "\U0001f681", ".", "\x00", "́"]
    more = ["".join(random.choices(letters, k=random.randint(1, 40))) for _ in range(150)]
    data = [(i, t) for i, t in enumerate(ODD + more)] + [(3, "one"), (3, "one"), (None, "one"), (None, None)]
    return data, spark.createDataFrame(data, "url long, payload string").withColumns({c: F.lit("z") for c in ("key", "ids", "at", "n", "links", "print", "copies")})


@pytest.mark.parametrize("longest", [4, 9, 18])
def test_codes_are_the_shortest_within_their_bound(longest):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 11, 16):
        counts = np.sort(rng.integers(1, 4000, n)) if n < 11 else np.array([int(1.9**i) + 1 for i in range(n)])
        bits = code_lengths(counts, longest)
        assert bits.max() <= longest and (n == 1 or sum(2.0**-b for b in bits) == 1)
        if longest == 18 and n > 1:  # the bound is out of reach: the cost is Huffman's
            heap, cost = sorted(counts.tolist()), 0
            while len(heap) > 1:
                both = heap.pop(0) + heap.pop(0)
                cost, heap = cost + both, sorted([*heap, both])
            assert (bits * counts).sum() == cost
    with pytest.raises(ValueError):
        code_lengths(np.ones(17, int), 4)


@pytest.mark.parametrize("n, block", [(0, 4), (1, 4), (7, 1), (8, 4), (1000, 7), (4097, 512)])
def test_codes_round_trip(n, block):
    rng = np.random.default_rng(n)
    ids = rng.geometric(0.02, n).astype(np.uint32) * 37
    known, counts = np.unique(ids, return_counts=True)
    codes = Codes(known.astype(np.int64), code_lengths(counts, 12))
    checkpoints, bits = packed(ids, codes.encoder(), block)
    assert len(checkpoints) == -(-n // block)
    if n:
        assert (unpacked(np.frombuffer(bits, np.uint8), checkpoints, n, block, codes, codes.decoder()) == ids).all()
        # A block is read from its checkpoint alone.
        k = len(checkpoints) - 1
        assert (unpacked(np.frombuffer(bits, np.uint8), checkpoints[k:], n - k * block, block, codes, codes.decoder()) == ids[k * block :]).all()


@pytest.mark.parametrize("file_ids", [50, 4_000_000])
def test_token_files(spark, file_ids):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    data, frame = odd_payloads(spark)
    files = write_token_files(frame, WORD, policy=TokenPolicy(file_ids=file_ids, block=16))
    out = sorted(read_token_files(spark, files).collect(), key=lambda r: r.start)
    wanted = [(u, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for u, t in data]
    assert Counter((r.url, bytes(r.ids)) for r in out) == Counter(wanted)
    assert [r.url for r in out] == sorted((u for u, _ in wanted), key=lambda u: (u is not None, u or 0))
    assert [r.start for r in out] == [0, *accumulate(r.n_tokens for r in out)][:-1] and all(r.n_tokens == len(r.ids) // 4 for r in out)
    empty = write_token_files(frame.limit(0), WORD)
    assert read_token_files(spark, empty).collect() == []


def test_token_files_of_texts_as_urls(spark):
    frame = spark.createDataFrame([("b", "two words"), (None, "x"), ("a", "y"), ("a b\n", "y")], "url string, payload string")
    assert [r.url for r in read_token_files(spark, write_token_files(frame, WORD)).sort("start").collect()] == [None, "a", "a b\n", "b"]


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    both = aligner(BYTE, PIECE)  # for the bytes of tokens only
    a_of, b_of = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a_of.encode_special_tokens = True
    cut = {}
    for text in {t for _, t in rows if t}:
        a, b = a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)
        whole = (" " + text).encode()
        if b"".join(both.a_bytes[i] for i in a) != whole or b"".join(both.b_bytes[i] for i in b) != whole:
            continue
        ends = [list(accumulate(len(table[i]) for i in ids)) for table, ids in ((both.a_bytes, a), (both.b_bytes, b))]
        common = sorted(set(ends[0]) & set(ends[1]))
        a_at, b_at = ({e: k for k, e in enumerate(es)} for es in ends)
        groups, i, j = [], 0, 0
        for e in common:
            groups.append(",".join(map(str, a[i : a_at[e] + 1])) + "|" + ",".join(map(str, b[j : b_at[e] + 1])))
            i, j = a_at[e] + 1, b_at[e] + 1
        cut[text] = (a, b, ";".join(groups), [(a[a_at[e]], b[b_at[e]]) for e in common])
    counts = Counter(p for _, t in rows if t in cut for p in cut[t][3])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for url, text in rows:
        if text not in cut:
            yield url, 0, 0, 0, 0, 0, 0, ""
            continue
        a, b, groups, links = cut[text]
        yield (url, len(a), len(b), groups.count(";") + 1, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
               hashlib.sha256(groups.encode()).hexdigest())


FIELDS = ("url", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_of_awkward_payloads(spark):
    data, frame = odd_payloads(spark)
    got = Counter(tuple(r[f] for f in FIELDS) for r in aligned_payloads(frame, BYTE, PIECE).collect())
    wanted = Counter(plain_alignment(data))
    assert got == wanted and sum(w[1] > 0 for w in wanted) > 60 and sum(w[1] == 0 for w in wanted) > 5
    assert aligned_payloads(frame.limit(0), BYTE, PIECE).collect() == []


def test_parts_are_the_texts():
    texts = [t for t in ODD if t]
    parts, first = parts_of(pa.array(texts))
    said = parts.to_pylist()
    assert ["".join(said[a:b]) for a, b in zip(first[:-1], first[1:])] == [" " + t for t in texts]
    assert len(said) > 700


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_alignment_query(spark, sf):
    got = Counter(tuple(r[f] for f in ("doc_id", *FIELDS[1:])) for r in QUERIES["op12_tokenizer_alignment"](spark, sf).collect())
    assert got == Counter(plain_alignment(documents(spark, sf)))


def test_token_file_query(spark, sf):
    from tokenizers import Tokenizer

    tokenizer, start, wanted = Tokenizer.from_file(WORD), 0, {}
    for doc, text in sorted(documents(spark, sf)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        wanted[doc] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op11_token_files"](spark, sf).collect()} == wanted


def plain_divergence(rows, files, top):
    terms = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if ("a" <= c <= "z" or ord(c) > 127) else " " for c in t or "").split(" ")
    count, seen = defaultdict(Counter), defaultdict(Counter)
    for modality, video, text in rows:
        own = [t for t in terms(text) if t]
        count[modality or "", video or ""].update(own)
        seen[modality or ""].update(set(own))
    out = set()
    for (m, v), _ in list(count.items()):
        kept = {t for t, n in seen[m].items() if n >= files}
        videos = sorted(x for y, x in count if y == m)
        whole = sum((count[m, x] for x in videos), Counter())
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        p, modality_p = p_of(count[m, v]), p_of(whole)
        pairs = []
        for x in videos:
            if x != v:
                q = p_of(count[m, x])
                pairs.append((x, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)))
        named = [(t, (p[t] - modality_p[t]) ** 2 // modality_p[t]) for t in kept if count[m, v][t] > 0 and p[t] > modality_p[t]]
        for part, items, most in (("pair", pairs, None), ("term", named, top)):
            for rank, (item, value) in enumerate(sorted(items, key=lambda i: (-i[1], i[0].encode()))[:most], 1):
                out.add((m, v, part, item, value, rank))
    return out


@pytest.mark.parametrize("policy", [DivergencePolicy(), DivergencePolicy(files=1, top=3, rows=4, columns=3, videos=2)])
def test_divergence(spark, policy):
    random.seed(5)
    said = ["moving", "Vehicle", "landing-pad", "ÇARŞI", "üst", "x1y2", "bird", "漢", "gate", "sea", "roof"]
    frames = [("rgb", f"v{random.randint(0, 5)}", " ".join(random.choices(said, range(1, 12), k=random.randint(0, 30)))) for _ in range(60)]
    frames += [("thermal", "v0", "one word"), ("thermal", "v1", None), (None, None, "moving moving"), (None, "v9", ""), ("rgb", "blank", " \n 12 "), frames[0], frames[0]]
    table = spark.createDataFrame(frames, "modality string, video string, xml string").withColumns({c: F.lit("z") for c in ("term", "n", "band", "p", "a")})
    got = [tuple(r) for r in video_divergence(table, policy=policy).collect()]
    assert set(got) == plain_divergence(frames, policy.files, policy.top) and len(got) == len(set(got))
    assert video_divergence(table.limit(0)).collect() == []


def test_joint_tables(spark):
    frames = [("rgb", "a", "x x y"), ("rgb", "b", "x z z"), ("rgb", "c", "w")]
    table = spark.createDataFrame(frames, "modality string, video string, xml string")
    got = {(r.a, r.b, r.a_level, r.b_level): r.n for r in joint_tables(table, policy=DivergencePolicy(files=1)).collect()}
    assert got == {
        ("a", "b", 2, 1): 1, ("a", "b", 1, 0): 1, ("a", "b", 0, 2): 1, ("a", "b", 0, 0): 1, ("a", "c", 2, 0): 1, ("a", "c", 1, 0): 1, ("a", "c", 0, 1): 1,
        ("a", "c", 0, 0): 1, ("b", "c", 1, 0): 1, ("b", "c", 2, 0): 1, ("b", "c", 0, 1): 1, ("b", "c", 0, 0): 1}
