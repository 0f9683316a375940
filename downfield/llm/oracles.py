"""The corpus queries that plain SQL can state, for DuckDB."""

import math

from downfield.llm import decontaminate, linedup, merkle, mixing, quality, search
from downfield.llm.common import LOWER, UPPER

BLANK = r"[\x20\x09-\x0D]"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{BLANK}+'), lambda x: x <> '')"


def _lines(text: str) -> str:
    return f"list_filter(string_split({text}, chr(10)), lambda s: regexp_matches(s, '[^{BLANK[1:-1]}]'))"


def quality_sql() -> str:
    part = quality.RISK / len(quality.RULES)
    values = {"symbols": ("n_symbols", "word_chars"), "capitals": ("n_capitals", "word_chars"),
              "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
    rules = " union all ".join(f"select stratum, good, '{r}' as rule, (1000 * {a}) // greatest({b}, 1) as value from held"
                               for r, (a, b) in values.items())
    above = " or ".join(f"exists (select 1 from best where best.stratum = f.stratum and best.rule = '{r}'"
                        f" and (1000 * f.{a}) // greatest(f.{b}, 1) > best.cut)" for r, (a, b) in values.items())
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce('=' || lang, '') as stratum, coalesce(text, '') as text from documents),
w as (select *, {_words('text')} as ws, {_lines('text')} as ls from d),
win as (select rid, i, list_slice(ws, i, i + 4) as k from (select rid, ws, unnest(range(1, len(ws) - 3)) as i from w)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as c from win) where c > 1),
covered as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 5)) as p from twice) group by rid),
f as (select doc_id, stratum, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) as bigint) as n_capitals, len(ls) as n_lines,
  cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words,
  len(ws) < 10 or 100 * coalesce(n, 0) > 20 * len(ws) as base_failed from w left join covered using (rid)),
known as (select doc_id, min(quality) = 1 as good from labels where doc_id is not null and quality is not null group by doc_id),
held as (select f.*, good from f join known using (doc_id) where not base_failed),
long as ({rules}),
cuts as (select unnest([{', '.join(map(str, quality.CUTOFFS))}]) as cut),
t as (select stratum, rule, cut, count(*) filter (good) as n, count(*) filter (good and value > cut) as k,
  count(*) filter (not good and value > cut) as caught from long, cuts group by all),
passed as (select *, k <= {part!r}e0 * n and list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1)
  - lgamma(n - i + 1) + i * {math.log(part)!r}e0 + (n - i) * {math.log1p(-part)!r}e0)))
  <= {quality.DOUBT!r}e0 / (select count(*) from (select distinct stratum, rule from long)) as ok from t),
certified as (select *, bool_and(ok) over (partition by stratum, rule order by cut desc) as sure, caught - {quality.COST} * k as gain from passed),
best as (select stratum, rule, cut from certified where sure and gain > 0
  qualify row_number() over (partition by stratum, rule order by gain desc, cut desc) = 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({above}) as kept from f"""


def _passes() -> str:
    """From r to o (more, open): the passes of the last reading."""
    out = ["f0 as (select *, false as more, rest as open from (select *, case when source_size > 0 then target - whole * source_size else 0 end as rest from r) r0)"]
    for t in range(mixing.PASSES):
        order, free = "rank" if t < mixing.PASSES - 1 else "size, rank", "not more and open > 0 and size <= open"
        out += [f"g{t} as (select *, {free} and coalesce(sum(size) filter ({free}) over (partition by stream order by {order}"
                f" rows between unbounded preceding and 1 preceding), 0) + size <= open as now from f{t})",
                f"f{t + 1} as (select * exclude (more, open, now), more or now as more,"
                f" open - coalesce(sum(size) filter (now) over (partition by stream), 0) as open from g{t})"]
    return ",\n".join([*out, f"o as (select * from f{mixing.PASSES})"])


def mixing_sql() -> str:
    weights = f"[{', '.join(map(str, mixing.WEIGHTS))}]"
    at = []
    for k, schedule in enumerate(mixing.SCHEDULES):
        total, start, used, whens, last = sum(s * r for s, r in schedule), 0.0, 0.0, [], 1.0
        for span, rate in schedule:
            gained = span * rate / total
            if gained > 0:
                whens.append(f"when demand <= {used + gained!r}e0 then {start!r}e0 + (demand - {used!r}e0) * {span / gained!r}e0")
                last, used = start + span, used + gained
            start += span
        at.append(f"when place % {len(mixing.SCHEDULES)} = {k} then case {' '.join(whens)} else {last!r}e0 end")
    return f"""
with thin as (select doc_id, source, cast(len({_words("coalesce(text, '')")}) as bigint) as size,
  md5(coalesce(cast(doc_id as varchar), '')) as shuffled, coalesce('=' || source, '') as stream from documents),
s as (select source, stream, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as place
  from thin group by source, stream),
p as (select *, {weights}[place % {len(mixing.WEIGHTS)} + 1] as weight, {mixing.LIMIT} * source_size as cap from s),
q as (select *, cast(sum(source_size) over () - coalesce(sum(cap) over filling, 0) as double)
  / cast(sum(weight) over () - coalesce(sum(weight) over filling, 0) as double) as lv from p
  window filling as (order by cast(cap as double) / weight, place rows between unbounded preceding and 1 preceding)),
t as (select *, least(cast(cap as double), max(lv) over () * weight) as target from q),
r as (select thin.*, source_size, target, place, row_number() over own as rank,
  cast(coalesce(sum(size) over (own rows between unbounded preceding and 1 preceding), 0) as bigint) as before,
  case when source_size > 0 then floor(target / source_size) else 1 end as whole from thin join t using (stream)
  window own as (partition by stream order by shuffled, doc_id, size)),
{_passes()},
b as (select stream, rank from o where not more and abs(size - open) < open
  qualify row_number() over (partition by stream order by abs(size - open), rank) = 1),
c as (select o.*, cast(whole as bigint) + case when more or b.rank is not null then 1 else 0 end as copies,
  case when target > 0 then least(1e0, (before + size / 2e0) / target) else 0.5e0 end as demand
  from o left join b on o.stream = b.stream and o.rank = b.rank)
select doc_id, size, source_size, target, cast(copies * size as bigint) as taken, copies,
  case when copies > 0 then case {' '.join(at)} end end as first_position from c"""


def _terms() -> str:
    return (f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
            r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")


def decontamination_sql() -> str:
    words = _terms()
    return f"""
with d as (select row_number() over () as rid, doc_id, {words} as ws from documents),
i as (select item_id, {words} as ws from benchmark),
v as (select item_id, n, list_slice(ws, s, s + n - 1) as win from (select item_id, ws, least({decontaminate.WINDOW}, len(ws)) as n,
  unnest(range(1, len(ws) - least({decontaminate.WINDOW}, len(ws)) + 2)) as s from i where len(ws) > 0)),
lengths as (select distinct n from v),
x as (select rid, n, s, list_slice(ws, s, s + n - 1) as win from (select rid, ws, n, unnest(range(1, len(ws) - n + 2)) as s from d, lengths)),
hits as (select distinct rid, x.n, s, item_id from x join v on x.n = v.n and x.win = v.win),
hit as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(s, s + n)) as p from (select distinct rid, n, s from hits)) group by rid),
items as (select rid, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as listed
  from hits group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 and {decontaminate.SHARE} * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join hit using (rid) left join items using (rid)"""


def line_runs_sql() -> str:
    return f"""
with d as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as al, row_number() over (order by doc_id nulls first) as doc from documents),
l as (select doc, place, line, cast(len({_words('line')}) as bigint) as words from (select doc, unnest(range(1, len(al) + 1)) as place, unnest(al) as line from d)
  where regexp_matches(line, '[^{BLANK[1:-1]}]')),
o as (select *, row_number() over (partition by doc order by place) as i, count(*) over (partition by doc) as n from l),
seq as (select doc, list(line order by i) as ls, list(words order by i) as ws from o group by doc),
win as (select doc, i, m, list_slice(ls, i, i + m - 1) as run, list_sum(list_slice(ws, i, i + m - 1)) as words
  from (select doc, ls, ws, m, unnest(range(1, len(ls) - m + 2)) as i from seq, (select unnest(range(1, {linedup.MIN_LINES} + 1)) as m))),
later as (select doc, i, m from (select *, row_number() over (partition by run order by doc, i) as turn from win)
  where turn > 1 and (m = {linedup.MIN_LINES} or words >= {linedup.MIN_WORDS})),
gone as (select distinct doc, unnest(range(i, i + m)) as i from later),
dropped as (select doc, list(place) as places, count(*) as n_dropped, sum(words) as words_dropped from gone join o using (doc, i) group by doc),
kept as (select doc, string_agg(line, chr(10) order by place) as text from (select d.doc, unnest(range(1, len(al) + 1)) as place, unnest(al) as line from d)
  anti join (select doc, unnest(places) as place from dropped) using (doc, place) group by doc)
select doc_id, coalesce(len(ls), 0) as n_lines, coalesce(n_dropped, 0) as n_dropped, cast(coalesce(words_dropped, 0) as bigint) as words_dropped,
  md5(case when d.text is null then null else coalesce(kept.text, '') end) as text_md5
from d left join seq using (doc) left join dropped using (doc) left join kept using (doc)"""


def captures_sql() -> str:
    """Base32 goes five hexadecimal digits at a time, which are four of its letters."""
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {b}) & 31) + 1, 1)" for b in (15, 10, 5, 0))
    return f"""
with p as (select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as sha from pages),
d as (select *, max(page_id) over (partition by sha) as largest, array_to_string(list_transform(list_transform(range(0, 8),
  lambda i: cast('0x' || substr(sha, cast(5 * i + 1 as integer), 5) as bigint)), lambda v: {letters}), '') as payload_digest from p)
select page_id, payload_bytes, payload_digest, case when page_id is distinct from largest and largest is not null then 'revisit' else 'response' end
  as record_type, case when page_id is distinct from largest then largest end as refers_to from d"""


def search_sql() -> str:
    return f"""
with d as (select row_number() over () as rid, doc_id, {_terms()} as ws from documents),
i as (select row_number() over () as q, item_id, list_distinct({_terms()}) as ws from benchmark),
asked as (select q, unnest(ws) as term from i),
c as (select rid, doc_id, cast(len(ws) as bigint) as n from d),
stats as (select count(*) filter (n > 0) as n_docs, cast(sum(n) as bigint) as n_terms from c),
t as (select rid, term, count(*) as tf from (select rid, unnest(ws) as term from d) where term in (select term from asked) group by rid, term),
w as (select term, cast(floor(1000 * ln(cast(2 * any_value(n_docs) + 2 as double) / (2 * count(*) + 1))) as bigint) as w from t, stats group by term),
s as (select q, rid, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) as bigint) as score
  from asked join t using (term) join w using (term) join c using (rid), stats group by q, rid, doc_id)
select item_id, cast(place as integer) as rank, doc_id, score from (select q, doc_id, score,
  row_number() over (partition by q order by score desc, doc_id nulls first) as place from s where score > 0) join i using (q) where place <= {search.TOP}"""


LEVELS = 40  # of a tree in SQL, enough for any table


def _tree(name: str, leaves: str) -> str:
    """CTEs ``name``_root (g, h) and ``name``_path (g, i, steps) over ``leaves`` (g, i, n, h)."""
    def open_(k: int) -> str:
        return f"(n + {(1 << k) - 1}) // {1 << k} > 1"

    out = [f"{name}0 as (select g, i, n, h from {leaves})"]
    for k in range(LEVELS):
        out.append(f"{name}{k + 1} as (select g, i // 2 as i, n, case when {open_(k)} then sha256(string_agg(h, '' order by i)) else any_value(h) end as h"
                   f" from {name}{k} group by g, i // 2, n)")
    steps = " union all ".join(
        f"select a.g, a.i, {k} as k, case when (a.i >> {k}) % 2 = 1 then b.h || '|' else '|' || coalesce(b.h, '') end as step"
        f" from {name}0 a left join {name}{k} b on a.g = b.g and b.i = xor(a.i >> {k}, 1) where {open_(k).replace('n +', 'a.n +')}" for k in range(LEVELS))
    return ", ".join([*out, f"{name}_root as (select g, h from {name}{LEVELS})",
                      f"{name}_path as (select g, i, list(step order by k) as steps from ({steps}) group by g, i)"])


def merkle_sql() -> str:
    """The tampered rows need CRC-32, here bit by bit over the digits of the id."""
    def leaf(n_chars: str) -> str:
        values = [f"cast({n_chars if f == 'n_chars' else f} as varchar)" for f in merkle.FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    bits = "[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]"
    crc = (f"xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), flatten(list_transform(string_split(cast(doc_id as varchar), ''), "
           f"lambda x: {bits}))), lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end))")
    return f"""
with e as (select doc_id, coalesce('=' || lang, '') as g, {leaf('n_chars')} as h,
  case when {crc} % 7 = 0 then {leaf('cast(n_chars as hugeint) + 1')} end as presented from documents),
rows as (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as i, count(*) over (partition by g) as n from e),
{_tree('t', 'rows')},
groups as (select '' as g, g as lang, row_number() over (order by g) - 1 as i, count(*) over () as n, h from t_root),
{_tree('u', 'groups')},
tops as (select groups.lang as g, groups.h as subroot, u_root.h as root, coalesce(steps, []) as upper from groups cross join u_root
  left join u_path on u_path.i = groups.i),
p as (select doc_id, rows.h as leaf, subroot, root, list_concat(coalesce(steps, []), upper) as steps, coalesce(presented, rows.h) as own
  from rows left join t_path on t_path.g = rows.g and t_path.i = rows.i join tops on tops.g = rows.g),
f as (select *, list_reduce(list_prepend(own, steps), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) as folded_root from p)
select doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) as proof_sha256, folded_root, folded_root = root as verified from f"""
