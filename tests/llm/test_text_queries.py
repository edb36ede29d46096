"""The registered queries against their SQL, and against plain Python where SQL cannot state them."""

import hashlib
import re

import compare
import pytest

from flightframe.llm.queries import QUERIES, SQL

WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def engine(sf):
    return compare.engine(sf)


@pytest.fixture(scope="module")
def texts(engine):
    return dict(engine.execute("select doc_id, coalesce(text, '') from documents").fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, engine, name):
    assert compare.differences(QUERIES[name](spark, sf).toPandas(), engine.execute(SQL[name]).df()) is None


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def passes_luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def private_spans(text):
    only = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(only(s)) <= 19 and passes_luhn(only(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(only(s)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, good) in kinds.items() for m in re.finditer(p, text) if good(m[0])]


def secret_spans(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


@pytest.mark.parametrize("name, plain", [("op9_personal_data", private_spans), ("op10_secret_scan", secret_spans)])
def test_base_spans(spark, sf, texts, name, plain):
    """Span by span; the smallest table holds no secret, so those are also planted in test_operators."""
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) == len(texts)
    for row in rows:
        wanted = plain(texts[row.doc_id])
        assert row.base_sha256 == digest(wanted), row.doc_id
        assert {f"{k}:{a}:{b}" for k, a, b in wanted} <= set(row.spans.split(","))
    assert any(row.spans for row in rows) == any(plain(t) for t in texts.values())


def test_licences(spark, sf, texts):
    from flightframe.llm.licenses import TEMPLATES

    bigrams = lambda t: set(zip(w := re.findall(r"[a-z0-9\x80-\U0010FFFF]+", t.translate({i: i + 32 for i in range(65, 91)})), w[1:]))
    known = [(name, bigrams(t)) for name, ts in TEMPLATES.items() for t in ts]
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b))
    wanted = set()
    for doc, text in texts.items():
        for i, line in enumerate(text.split("\n"), 1):
            if own := bigrams(line):
                best = max((dice(own, b), [-ord(c) for c in name], name) for name, b in known)
                if best[0] >= 0.85:
                    wanted.add((doc, i, best[2], round(best[0], 9)))
    rows = QUERIES["op1_license_scan"](spark, sf).where("unit = 'line'").collect()
    assert {(r.doc_id, r.line, r.license, round(r.dice, 9)) for r in rows} == wanted and wanted


def test_language_model_beats_single_tokens(spark, sf, texts):
    rows = QUERIES["op7_language_model"](spark, sf).collect()
    assert len(rows) == len(texts)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.n_tokens == len(WORD.findall(texts[r.doc_id])) + 1 for r in rows)


def test_mix_comes_near_its_targets(spark, sf):
    rows = QUERIES["op5_mixing"](spark, sf).toPandas()
    assert (rows.taken <= 2 * rows["size"]).all()
    assert abs(rows.taken.sum() / rows["size"].sum() - 1.5) < 0.1


def test_pipeline(spark, sf, texts, engine):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quality, near, leaks, private, mixing = [f for _, f in corpus_pipeline.STAGES]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    sql = lambda q, where: {r[0] for r in engine.execute(f"select doc_id from ({SQL[q]}) where {where}").fetchall()}
    assert ids(quality(spark, docs, sf)) == sql("op8_quality_rules", "kept")
    assert ids(near(spark, docs, sf)) == sql("op2_near_duplicates", "kept")
    assert ids(leaks(spark, docs, sf)) == set(texts) - sql("op4_decontamination", "true")
    clean = {r.doc_id: r.text for r in private(spark, docs, sf).collect()}
    assert set(clean) == set(texts) and not any("@mail" in t for t in clean.values())
    assert clean[next(d for d, t in texts.items() if not private_spans(t))] in texts.values()
    out = corpus_pipeline.run(spark, sf)
    assert set(docs.columns) < set(out.columns) and 0 < out.count() < 2 * len(texts)
