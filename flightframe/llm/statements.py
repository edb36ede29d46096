"""SQL statements of the queries that SQL can express, over the given tables."""

from __future__ import annotations

from flightframe.llm.exchanges import BEGIN, END, REPLY
from flightframe.llm.leaks import LEAKS
from flightframe.llm.mixing import MIX
from flightframe.llm.quality import RULES, STOP_WORDS, SYMBOLS, Rule

WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str) -> str:
    """Distinct shingles of five words per row of a table."""
    return f"""select distinct {key}, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from (select {key}, regexp_extract_all({_LOWER}, {WORD}) as w from {table})"""


NEAR = f"""with recursive sh as ({_shingles('documents', 'doc_id')}),
  n as (select doc_id, count(*) as n from sh group by 1),
  pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
  links as (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
  reach as (select doc_id, doc_id as other from documents union select r.doc_id, l.y from reach r join links l on l.x = r.other),
  comp as (select doc_id, min(other) as component_id from reach group by 1)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join n using (doc_id) join comp using (doc_id)"""

REPEATED = f"""with w as (select doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) as w from documents),
  win as (select doc_id, p, array_to_string(w[p:p + 49], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 48)) as p from w)),
  firsts as (select s, min(doc_id) as m from win group by 1),
  gone as (select distinct doc_id, unnest(range(p, p + 50)) as p from win join firsts using (s) where m < doc_id),
  words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from w),
  kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as t from words anti join gone using (doc_id, p) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)"""

LEAKED = f"""with d as ({_shingles('documents', 'doc_id')}), i as ({_shingles('benchmark', 'item_id')}),
  n as (select item_id, count(*) as n from i group by 1), k as (select item_id, regexp_extract_all({_LOWER}, {WORD}) as w from benchmark),
  c as (select doc_id, item_id, count(*) as c from d join i using (s) join k using (item_id) where len(w) >= 5 group by 1, 2),
  short as (select doc_id, item_id from k join (select doc_id, regexp_extract_all({_LOWER}, {WORD}) as v from documents) t on len(w) between 1 and 4
    where len(list_filter(range(1, len(v) - len(w) + 2), lambda p: v[p:p + len(w) - 1] = w)) > 0)
select doc_id, item_id, cast(c as bigint) as shared, cast(n as bigint) as item_shingles from c join n using (item_id) where 100 * c >= {LEAKS.percent} * n
union all select doc_id, item_id, 1, 1 from short"""

MIXED = f"""with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), {WORD})) as bigint) as size from documents),
  s as (select source, sum(size)::bigint as n, [{', '.join(map(str, MIX.weights))}][(row_number() over (order by source nulls last) - 1) % {len(MIX.weights)} + 1]::bigint as w from d group by 1),
  o as (select *, row_number() over k as place, {MIX.percent} * sum(n) over () - {100 * MIX.most} * coalesce(sum(n) over (order by {MIX.most} * n / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as l,
    100 * sum(w) over (order by {MIX.most} * n / w, source nulls last rows between current row and unbounded following) as h from s window k as (order by {MIX.most} * n / w, source nulls last)),
  f as (select place as fp, l as fl, h as fh from o where w * l <= {MIX.most} * n * h order by place limit 1),
  t as (select source, n, case when place < fp then ({MIX.most} * n)::double else (w * fl)::double / fh::double end as target from o, f),
  r as (select d.*, n, target, case when n > 0 then target / n else 0e0 end as rate,
    cast('0x' || substr(md5('{MIX.seed}:' || coalesce(doc_id::varchar, '')), 1, 13) as bigint)::double / {1 << 52}e0 as u from d join t on d.source is not distinct from t.source)
select doc_id, size, n as source_size, target, (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken from r"""

_ESCAPED = r"regexp_replace(coalesce(text, ''), '([\\<])', '\\\1', 'g')"
CHATS = f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
  p as (select *, length('{BEGIN}' || url_encode(role) || chr(10) || {_ESCAPED} || '{END.strip()}' || chr(10)) as n,
    row_number() over w as k, count(*) over (partition by conv_id) as last from t window w as (partition by conv_id order by turn, role, text)),
  c as (select *, sum(n) over (partition by conv_id order by k) as upto from p)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = '{REPLY}'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = '{REPLY}'), '')) as loss_sha256,
  sum(upto) filter (where role = '{REPLY}' or k = last)::bigint as formatted_chars from c group by 1"""


def _broken(rule: Rule) -> str:
    whole = rule.of or "1"
    tests = [f"{rule.measure} < {whole} * {rule.least}::double"] if rule.least is not None else []
    tests += [f"{rule.measure} > {whole} * {rule.most}::double"] if rule.most is not None else []
    test = " or ".join(tests)
    for names, join in ((rule.only, "and coalesce(lang in ({}), false)"), (rule.never, "and not coalesce(lang in ({}), false)")):
        test = f"({test}) " + join.format(", ".join(f"'{n}'" for n in names)) if names else test
    return f"({test})"


QUALITY = f"""with w as (select doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {WORD}) as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, {WORD})) as lines from documents),
  win as (select doc_id, p, array_to_string(w[p:p + 2], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as p from w)),
  twice as (select doc_id, s from win group by 1, 2 having count(*) > 1),
  rep as (select doc_id, count(distinct q) as c from (select doc_id, unnest([p, p + 1, p + 2]) as q from win join twice using (doc_id, s)) group by 1),
  m as (select doc_id, lang, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::bigint as n_symbols, len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c, 0)::bigint as n_repeat_words,
    len(list_filter(w, lambda x: lower(x) in ({', '.join(f"'{x}'" for x in STOP_WORDS)})))::bigint as n_stop_words from w left join rep using (doc_id)),
  b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not ({' or '.join(_broken(r) for r in RULES)}) as kept from b"""

_P = "1 + 1000000000::hugeint * ({c} + 1) // ({n} + v)"
_F = "cast(({p} - {q}) * ({p} - {q}) // {q} as hugeint)"
DIVERGED = f"""with t as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, {_LOWER} as text from documents),
  g as (select distinct lang, source from t),
  o as (select r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from t),
  k as (select lang, term, count(*) as c from o group by 1, 2 having count(distinct r) >= 3),
  l as (select lang, count(*) as v, sum(c) as n from k group by 1),
  c as (select lang, source, term, count(*) as c from o semi join k using (lang, term) group by 1, 2, 3),
  n as (select lang, source, coalesce(sum(c), 0) as n from g left join c using (lang, source) group by 1, 2),
  p as (select lang, source, term, coalesce(c.c, 0) as c, {_P.format(c='coalesce(c.c, 0)', n='n.n')} as p from n join l using (lang) join k using (lang) left join c using (lang, source, term)),
  a as (select a.lang, a.source, b.source as item, sum({_F.format(p='a.p', q='b.p')}) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
  pairs as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(value, 0)::bigint as value from g join g h on g.lang = h.lang and g.source <> h.source left join a on a.lang = g.lang and a.source = g.source and a.item = h.source),
  q as (select lang, term, {_P.format(c='c', n='n')} as q from k join l using (lang)),
  terms as (select lang, source, 'term' as part, term as item, ({_F.format(p='p', q='q')})::bigint as value from p join q using (lang, term) where c > 0 and p > q)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from (select * from pairs union all select * from terms) qualify part = 'pair' or rank <= 200"""

SQL = {
    "op2_near_duplicates": NEAR, "op3_repeated_passages": REPEATED, "op4_decontamination": LEAKED, "op5_mixing": MIXED,
    "op6_chat_examples": CHATS, "op8_quality_rules": QUALITY, "op13_source_divergence": DIVERGED,
}
