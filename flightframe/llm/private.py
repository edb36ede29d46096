"""Personal data in frame payloads by weak supervision.

Patterns propose spans of four kinds: strict ones, cards within longer runs of digits, and what the gazetteer or the
words in front suggest where no strict pattern matches. Labelers vote on each: the strict pattern, a gazetteer of
endings, codes and issuers, the words in front, and the characters around. Expectation-maximisation
estimates per kind how far each labeler can be trusted, the posteriors train a final
classifier of spans (naive Bayes over votes and shape), and spans above even odds are added to
those of the strict patterns. All of it is built-in functions over one scan of the texts; only
counts per vote pattern and the classifier's weights leave the rows, and their number
is bounded by the kinds, votes and shapes below, not by the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightframe.llm.store import column, written

KINDS = ("email", "ip", "card", "phone")
# Leftmost matches; a run is entered at its first character only, and possessive repeats keep long runs linear.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before its matches are looked for.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]",
        "email_own": r"(?i)@|[\[({]\x20?at|\x20at\x20[A-Za-z0-9-]++\x20dot\x20",
        "ip_own": r"(?i):[0-9a-f]{0,4}:|[0-9]\x20?[\[({]\x20?(?:dot|\.)|[0-9]\x20(?:dot|\.)\x20[0-9]",
        "card_own": r"[0-9](?:[./_\u2013][\x20./_\u2013-]?|[\x20-][\x20./_\u2013-])[0-9]",
        "phone_own": r"(?i)(?<![0-9+])00[1-9]|(?:tel|phone|call|mobile|fax|telefon|llame)\W{0,6}[0-9(]"}
#: What of a failing match is proposed nevertheless.
LOOSE = {
    "card": r"^[0-9](?:[\x20-]?[0-9]){12,18}$",
    "phone": r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
}
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|info|io|tr|de|fr|es|uk|eu)$",
    "ip": r"^(?!0)(?!255)[0-9]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[^0-9]",
}
CUES = {
    "email": r"(?i)(?:mail|contact|write|kontakt|correo|courriel)\W{0,6}$",
    "ip": r"(?i)(?:\bip|host|server|address|adresse|addr)\W{0,6}$",
    "card": r"(?i)(?:card|visa|mastercard|karte|carte|tarjeta)\W{0,6}$",
    "phone": r"(?i)(?:tel|phone|call|mobile|fax|telefon|llame)\W{0,6}$",
}
_NAME, _HOST = r"[A-Za-z0-9._%+-]++", r"[A-Za-z0-9-]++"
_AT = r"(?:\x20?[\[({]\x20?(?:at|@)\x20?[\])}]\x20?|\x20@\x20?|@\x20|\x20at\x20(?=[A-Za-z0-9-]++\x20dot\x20))"
_DOT = r"(?:\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20|\.)"
_POINT = r"(?:\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20|\x20\.\x20)"
_OCTETS = rf"(?<![0-9.])[0-9]{{1,3}}{_POINT}[0-9]{{1,3}}{_POINT}[0-9]{{1,3}}{_POINT}[0-9]{{1,3}}(?![0-9])"
_ODD = r"[./_\u2013]"
#: Words in front as a condition.
_AFTER = {k: f"(?<={c[:-1]})" for k, c in CUES.items()}
#: What the gazetteer proposes of its own, then what the words in front do; none of it is a match of the strict pattern.
OWN = {
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])(?={_NAME}(?:@|{_AT}))(?:{_NAME}{_AT}{_HOST}(?:{_DOT}{_HOST})*{_DOT}(?:{GAZETTEER['email'][5:-2]})(?![A-Za-z0-9])"
             rf"|{_AFTER['email']}{_NAME}(?:{_AT}{_HOST}(?:{_DOT}{_HOST})*|@{_HOST}(?!\.[A-Za-z0-9-])))",
    "ip": rf"(?i)(?:{_OCTETS}|(?<![0-9a-z:])(?:2[0-9a-f]{{3}}|fe80|f[cd][0-9a-f]{{2}})(?:(?::[0-9a-f]{{1,4}}){{7}}|(?::[0-9a-f]{{1,4}}){{0,6}}::(?:[0-9a-f]{{1,4}}:){{0,5}}[0-9a-f]{{0,4}})(?![0-9a-z:])"
          rf"|(?<![0-9a-z:])(?=[0-9a-f:]){_AFTER['ip']}(?:[0-9a-f]{{0,4}}:){{2,7}}[0-9a-f]{{0,4}}(?![0-9a-z:]))",
    "card": rf"(?:(?<![0-9])(?={GAZETTEER['card'][1:]})[0-9]{{4}}(?:{_ODD}[0-9]{{4}}{_ODD}[0-9]{{4}}{_ODD}[0-9]{{4}}|{_ODD}[0-9]{{6}}{_ODD}[0-9]{{5}})(?![0-9])"
            rf"|(?<![0-9])(?=[0-9]){_AFTER['card']}(?=[0-9](?:[\x20-]?[0-9])*+[\x20./_\u2013-]{{1,2}}[0-9])[0-9](?:[\x20./_\u2013-]{{0,2}}[0-9]){{12,18}}(?![0-9]))",
    "phone": rf"(?:(?<![0-9+])00{GAZETTEER['phone'][3:-6]}[\x20().-][0-9\x20().-]{{5,18}}[0-9](?![0-9])"
             rf"|(?<![0-9+])(?=[0-9(]){_AFTER['phone']}\(?[0-9][0-9\x20().-]{{5,18}}[0-9](?![0-9]))",
}
#: The plain form of an own proposal, on which strict pattern and gazetteer vote.
PLAIN = {
    "email": ((f"(?i){_AT}", "@"), (f"(?i){_DOT}", ".")),
    "ip": ((f"(?i){_POINT}", "."),),
    "card": ((r"[^0-9]", ""),),
    "phone": ((r"^00", "+"),),
}
VOTES = ("strict", "gazetteer", "cue", "bounds")
_BLOCK = 64
_SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,strict:int,gazetteer:int,cue:int,bounds:int,shape:string>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.length(digits)
    places = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(
        F.substring(digits, i, F.lit(1)).try_cast("int").alias("d"), ((n - i) % 2 == 1).alias("twice")))
    worth = lambda p: F.when(p.twice, p.d * 2 - F.when(p.d > 4, 9).otherwise(0)).otherwise(p.d)
    return F.aggregate(places, F.lit(0), lambda total, p: total + F.coalesce(worth(p), F.lit(0))) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3) & F.forall(
            F.split(match, r"\."), lambda part: F.coalesce(F.substring(F.concat(F.lit("0"), F.ltrim(part, F.lit("0"))), 1, 5).try_cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


#: Searches by name: of the strict patterns and of the own proposals of other labelers.
SEARCHES = {**STRICT, **{f"{k}_own": p for k, p in OWN.items()}}


def _found(text: Column, name: str) -> Column:
    """Matches of a search, the pieces between them, and what each pair of both takes in code points."""
    may = text.contains(HINT[name]) if name == "email" else text.rlike(HINT[name])
    found = F.when(may, F.struct(
        F.regexp_extract_all(text, F.lit(SEARCHES[name]), F.lit(0)).alias("hits"), F.split(text, SEARCHES[name], -1).alias("rest")))
    return F.coalesce(found, F.struct(F.array().cast("array<string>").alias("hits"), F.array(F.lit("")).alias("rest")))


_vote = lambda test: F.when(test, 1).otherwise(0)
_sum = lambda values: F.aggregate(values, F.lit(0), lambda total, x: total + x)


def _let(value: Column, body) -> Column:
    """An array expression over a value that is worked out once."""
    return F.flatten(F.transform(F.array(value), body))


def _span(kind: str, start: Column, length: Column, base: Column, strict: Column, gazetteer: Column, cue: Column, bounds: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), start.cast("bigint").alias("start"), (start + length).cast("bigint").alias("end"), base.alias("base"),
        _vote(strict).alias("strict"), _vote(gazetteer).alias("gazetteer"), _vote(cue).alias("cue"), _vote(bounds).alias("bounds"),
        F.least(F.floor(length / 4), F.lit(9)).cast("string").alias("shape"))


def _windows(hit: Column, start: Column, before: Column, after: Column) -> Column:
    """Cards within a failing run of several groups of digits: windows of 13 to 19 digits in whole groups that pass the check
    sum. At most 19 groups are looked at from each, and places are summed block by block, so long runs stay cheap."""
    def from_group(r: Column, j: Column, base: Column, k: Column) -> Column:
        i = j * _BLOCK + k

        def ends(w: Column) -> Column:
            sized = F.filter(F.sequence(F.lit(1), F.size(w.steps)), lambda n: (_sum(F.slice(w.steps, 1, n)) - n).between(13, 19))
            numbers = F.transform(sized, lambda n: F.struct(n.alias("n"), F.array_join(F.slice(w.groups, 1, n), "").alias("digits")))
            good = F.filter(numbers, lambda x: luhn(x.digits) & ~((w.i == 0) & (x.n == F.size(r.groups))))
            return F.transform(good, lambda x: _span(
                "card", r.start + w.offset, F.length(x.digits) + x.n - 1, F.lit(False), F.length(x.digits) >= 16, x.digits.rlike(GAZETTEER["card"]),
                (w.i == 0) & r.before.rlike(CUES["card"]),
                ((w.i > 0) | r.before.rlike(_OPEN)) & ((w.i + x.n < F.size(r.groups)) | ~r.after.rlike(_GOES_ON))))

        return _let(F.struct(
            i.alias("i"), (base + _sum(F.slice(r.steps, j * _BLOCK + 1, k))).alias("offset"),
            F.slice(r.groups, i + 1, 19).alias("groups"), F.slice(r.steps, i + 1, 19).alias("steps")), ends)

    def blocks(r: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(r.groups) - 1) / _BLOCK).cast("int"))
        return _let(F.transform(numbers, lambda j: _sum(F.slice(r.steps, j * _BLOCK + 1, _BLOCK))), lambda sums: F.flatten(F.transform(
            numbers, lambda j: _let(_sum(F.slice(sums, 1, j)), lambda base: F.flatten(F.transform(
                F.slice(r.groups, j * _BLOCK + 1, _BLOCK), lambda _, k: from_group(r, j, base, k)))))))

    cut = lambda r: _let(F.struct(
        r.start.alias("start"), r.before.alias("before"), r.after.alias("after"), r.groups.alias("groups"),
        F.transform(r.groups, lambda g: F.length(g) + 1).alias("steps")), blocks)
    some = _let(F.struct(start.alias("start"), before.alias("before"), after.alias("after"), F.split(hit, r"[\x20-]").alias("groups")), cut)
    return F.when((F.length(hit) >= 14) & hit.rlike(r"[\x20-]") & ~_passes("card", hit), some).otherwise(F.array().cast(_SPANS))


_OPEN, _GOES_ON = r"(?:^|[^\p{L}\p{N}])$", r"^[\p{L}\p{N}]"


def _spans(kind: str) -> Column:
    """Proposals of a kind; places are running sums, taken block by block so that many matches stay cheap."""
    def placed(name: str, body) -> Column:
        hits, rest, steps, blocks = (F.col(f"_private.{name}.{n}") for n in ("hits", "rest", "steps", "blocks"))

        def at(hit: Column, k: Column) -> Column:
            block = F.floor(k / _BLOCK).cast("int")
            start = _sum(F.slice(blocks, 1, block)) + _sum(F.slice(steps, block * _BLOCK + 1, k - block * _BLOCK)) + F.char_length(F.get(rest, k))
            return body(hit, start, F.right(F.get(rest, k), F.lit(24)), F.left(F.get(rest, k + 1), F.lit(1)))

        return F.transform(hits, at)

    bounds = lambda before, after: before.rlike(_OPEN) & ~after.rlike(_GOES_ON)

    def matched(hit: Column, start: Column, before: Column, after: Column) -> Column:
        good = _passes(kind, hit)
        kept = F.when(good, hit).otherwise(F.regexp_extract(hit, LOOSE[kind], 0) if kind in LOOSE else F.lit(""))
        return _span(kind, start, F.char_length(kept), good, good, kept.rlike(GAZETTEER[kind]), before.rlike(CUES[kind]), bounds(before, after))

    def own(hit: Column, start: Column, before: Column, after: Column) -> Column:
        plain = hit
        for pattern, by in PLAIN[kind]:
            plain = F.regexp_replace(plain, pattern, by)
        known = plain.rlike(GAZETTEER[kind]) | (plain.rlike("(?i)^(?:fe80|f[cd])") if kind == "ip" else F.lit(False))
        strict = plain.rlike(f"^(?:{STRICT[kind]})$") & _passes(kind, plain)
        return _span(kind, start, F.char_length(hit), F.lit(False), strict, known, before.rlike(CUES[kind]), bounds(before, after))

    found = [F.filter(placed(kind, matched), lambda s: s.end > s.start).cast(_SPANS), placed(f"{kind}_own", own).cast(_SPANS)]
    if kind == "card":
        found.append(F.flatten(placed(kind, _windows)).cast(_SPANS))
    return F.array_sort(F.concat(*found))


def proposed(payloads: DataFrame, payload: str) -> DataFrame:
    """``payloads`` with ``proposals``: all spans of all kinds with their votes."""
    once = lambda df, name, value: df.select(*[column(c) for c in df.columns if c != name], F.explode(F.array(value)).alias(name))
    text = F.coalesce(column(payload).cast("string"), F.lit(""))
    staged = once(payloads, "_private", F.struct(*[_found(text, k).alias(k) for k in SEARCHES]))
    lengths = lambda k: F.zip_with(
        F.slice(f"_private.{k}.rest", 1, F.greatest(F.size(f"_private.{k}.hits"), F.lit(0))), F.col(f"_private.{k}.hits"),
        lambda a, b: F.char_length(a) + F.char_length(b))
    staged = once(staged, "_private", F.struct(*[F.struct(
        F.col(f"_private.{k}.hits"), F.col(f"_private.{k}.rest"), lengths(k).alias("steps")).alias(k) for k in SEARCHES]))
    summed = lambda k: F.transform(F.sequence(F.lit(0), F.floor(F.size(f"_private.{k}.steps") / _BLOCK).cast("int")), lambda j: F.aggregate(
        F.slice(f"_private.{k}.steps", j * _BLOCK + 1, _BLOCK), F.lit(0), lambda total, x: total + x))
    staged = once(staged, "_private", F.struct(*[F.struct(
        F.col(f"_private.{k}.hits"), F.col(f"_private.{k}.rest"), F.col(f"_private.{k}.steps"), summed(k).alias("blocks")).alias(k) for k in SEARCHES]))
    return staged.select(*[column(c) for c in payloads.columns], F.concat(*[_spans(k) for k in KINDS]).alias("proposals"))


def _estimated(patterns: DataFrame, rounds: int) -> DataFrame:
    """Expectation-maximisation over the counts of vote patterns: per kind and pattern its count and the
    probability that such a span is personal data. ``trust`` holds each labeler's rate of votes
    on real and on false spans."""
    row = F.struct(F.array(*[F.col(v) for v in VOTES]).alias("v"), F.col("n"))
    kinds = patterns.groupBy("kind").agg(F.collect_list(row).alias("rows"))
    labelers = range(len(VOTES))
    pick = lambda votes, rate, i: F.when(votes[i] == 1, rate[i]).otherwise(1 - rate[i])

    def posterior(state: Column, votes: Column) -> Column:
        true, false = state.share, 1 - state.share
        for i in labelers:
            true, false = true * pick(votes, state.real, i), false * pick(votes, state.false, i)
        return true / (true + false)

    def total(rows: Column, value) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + value(r))

    def step(state: Column, _: Column) -> Column:
        weigh = F.transform("rows", lambda r: F.struct(r.v.alias("v"), r.n.alias("n"), posterior(state, r.v).alias("p")))
        real, false = total(weigh, lambda r: r.n * r.p), total(weigh, lambda r: r.n * (1 - r.p))
        rate = lambda i, value, mass, least, most: F.greatest(F.lit(least), F.least(F.lit(most), (total(weigh, lambda r: value(r) * r.v[i]) + 1) / (mass + 2)))
        return F.struct(
            ((real + 1) / (real + false + 2)).alias("share"),
            F.array(*[rate(i, lambda r: r.n * r.p, real, 0.02, 0.995) for i in labelers]).alias("real"),
            F.array(*[rate(i, lambda r: r.n * (1 - r.p), false, 0.005, 0.98) for i in labelers]).alias("false"))

    start = F.struct(F.lit(0.5).alias("share"), F.array(*[F.lit(x) for x in (0.95, 0.7, 0.3, 0.9)]).alias("real"),
                     F.array(*[F.lit(x) for x in (0.05, 0.3, 0.05, 0.5)]).alias("false"))
    fitted = kinds.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step))
    return fitted.select("kind", F.explode("rows").alias("r"), "state").select(
        "kind", *[F.col("r.v")[i].alias(v) for i, v in enumerate(VOTES)], F.col("r.n").alias("n"), posterior(F.col("state"), F.col("r.v")).alias("p"))


def _features(span) -> Column:
    """Names of a span's features: its kind, its votes, its shape."""
    get = (lambda c: F.col(c)) if span is None else (lambda c: span[c])
    return F.array(get("kind"), *[F.concat_ws(":", get("kind"), F.lit(v), get(v).cast("string")) for v in VOTES],
                   F.concat_ws(":", get("kind"), F.lit("shape"), get("shape")))


def span_weights(proposals: DataFrame, rounds: int = 20) -> dict[str, float]:
    """Log odds per feature, at most |kinds| * (2 * |votes| + 11) of them, from a table with ``proposals``."""
    shapes = written(proposals.select(F.explode("proposals").alias("s")).select("s.*").groupBy("kind", *VOTES, "shape").agg(F.count(F.lit(1)).alias("n")))
    patterns = shapes.groupBy("kind", *VOTES).agg(F.sum("n").alias("n"))
    known = _estimated(patterns, rounds).drop("n")
    soft = shapes.join(known, ["kind", *VOTES])
    sums = soft.select("kind", "n", "p", F.explode(_features(None)).alias("feature")).groupBy("kind", "feature").agg(
        F.sum(F.col("n") * F.col("p")).alias("real"), F.sum(F.col("n") * (1 - F.col("p"))).alias("false"))
    rows = {r.feature: r for r in sums.collect()}
    whole = {k: (rows[k].real, rows[k].false) for k in KINDS if k in rows}
    out = {}
    for name, r in rows.items():
        real, false = whole[r.kind]
        out[name] = math.log((real + 1) / (false + 1)) if name == r.kind else math.log((r.real + 1) / (real + 2)) - math.log((r.false + 1) / (false + 2))
    return out


def with_personal_data(payloads: DataFrame, payload: str = "payload", rounds: int = 20, keep_text: bool = True) -> DataFrame:
    """``payloads`` with ``spans``: array of (``kind``, ``start``, ``end``, ``base``), sorted by kind as in KINDS, then start.

    Places are code points, the end exclusive. ``base`` tells spans of the strict patterns, which always
    stay, from those the classifier adds. ``keep_text=False`` leaves the payload column out.

    A null payload counts as empty and has no span. Rows are judged one by one, so ties, repeated rows
    and null ids change nothing; a column named ``spans`` or ``proposals`` is replaced. An empty table gives
    an empty result.
    """
    kept = [c for c in payloads.columns if c not in ("spans", "proposals") and (keep_text or c != payload)]
    source = payloads.drop("spans", "proposals")
    table = written(proposed(source, payload).select(*[column(c) for c in kept], "proposals"))
    weights = span_weights(table, rounds)
    if not weights:
        chosen = F.col("proposals")
    else:
        odds = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
        score = lambda s: F.aggregate(_features(s), F.lit(0.0), lambda total, f: total + F.coalesce(F.try_element_at(odds, f), F.lit(0.0)))
        chosen = F.filter("proposals", lambda s: s.base | (score(s) > 0))
    spans = F.transform(chosen, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.base.alias("base")))
    return table.select(*[column(c) for c in kept], spans.alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with ``[KIND]`` in place of each span; overlapping spans become one, named by the first."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a.start < b.start, -1).when(a.start > b.start, 1)
                           .when(a.end > b.end, -1).when(a.end < b.end, 1).otherwise(0))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, (state.at + 1).cast("int"), (s.start - state.at).cast("int")), F.lit("["), F.upper(s.kind), F.lit("]"))
        return F.when(s.start >= state.at, F.struct(s.end.alias("at"), F.concat(state.parts, F.array(piece)).alias("parts"))).otherwise(
            F.struct(F.greatest(state.at, s.end).alias("at"), state.parts.alias("parts")))

    done = F.aggregate(ordered, empty, step, lambda s: F.concat(F.array_join(s.parts, ""), F.substring(text, (s.at + 1).cast("int"), F.lit(2147483647))))
    return F.when(F.size(spans) == 0, text).otherwise(done)
