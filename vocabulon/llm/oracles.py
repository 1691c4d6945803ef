"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = f"""
with rules(rule_host, rule_path, action) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
after as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from after),
best as (
  select host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(action, length(rule_host || rule_path)) as verdict
  from (select distinct host, path from parts) p join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by host, path)
select page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') as verdict from parts left join best on parts.host = best.host and parts.path = best.path
"""

OP4 = f"""
with recursive words as (select doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as s from words, lateral unnest(range(1, len(w) - 48)) as t(i)),
firsts as (select s, min(doc_id) as first_id from windows group by s having min(doc_id) < max(doc_id)),
repeated as (select windows.doc_id, i, md5(s) as h, first_id from windows join firsts using (s)),
doubled(n, doc_id, i, h) as (
  select 50, doc_id, i, h from repeated
  union all
  select 2 * x.n, x.doc_id, x.i, md5(x.h || y.h) from doubled x join doubled y on x.n = y.n and x.doc_id = y.doc_id and y.i = x.i + x.n),
levels as (
  select doc_id, max(n) as level from doubled join (select n, h from doubled group by n, h having min(doc_id) < max(doc_id)) using (n, h) group by doc_id),
gone as (select distinct doc_id, k from repeated, lateral unnest(range(i, i + 50)) as u(k) where first_id < doc_id),
kept as (
  select doc_id, len(w) as n_words, count(k) as n_removed, coalesce(string_agg(word, ' ' order by p) filter (where k is null), '') as text
  from (select words.doc_id, w, p, w[p] as word, gone.k from words left join lateral unnest(range(1, len(w) + 1)) as t(p) on true
        left join gone on gone.doc_id = words.doc_id and gone.k = p) group by doc_id, w)
select doc_id, cast(n_words as bigint) as n_words, cast(n_removed as bigint) as n_removed, sha256(text) as kept_sha256, cast(coalesce(level, 0) as bigint) as level
from kept left join levels using (doc_id)
"""

OP5 = f"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {WORDS}) as w from documents),
shingles as (
  select distinct doc_id, case when len(w) > 1 then w[i] || ' ' || w[i + 1] else w[1] end as s from words, lateral unnest(range(1, greatest(len(w) - 1, 1) + 1)) as t(i) where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
ways as (select x, y from links union all select y, x from links),
reach(node, root) as (select doc_id, doc_id from documents union select ways.y, reach.root from reach join ways on ways.x = reach.node),
roots as (select node as doc_id, min(root) as component_id from reach group by node)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, doc_id = component_id as kept from roots left join sizes using (doc_id)
"""

QUALITY_BASE = f"""
with words as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {WORDS}) as w from documents),
lines as (
  select doc_id, line, count(*) - 1 as later from words, lateral unnest(string_split(text, chr(10))) as t(line) where regexp_matches(line, {WORDS}) group by doc_id, line),
dup as (select doc_id, sum(later) as n from lines group by doc_id),
windows as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as s from words, lateral unnest(range(1, len(w) - 6)) as t(i)),
twice as (select doc_id, s from windows group by doc_id, s having count(*) > 1),
covered as (select doc_id, count(distinct k) as n from windows join twice using (doc_id, s), lateral unnest(range(i, i + 8)) as u(k) group by doc_id),
figures as (
  select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(dup.n, 0) as bigint) as n_dup_lines, cast(coalesce(covered.n, 0) as bigint) as n_repeat_words
  from words left join dup using (doc_id) left join covered using (doc_id))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from figures
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
SECRET_BASE = f"""
with texts as (select doc_id, coalesce(text, '') as text from documents)
select doc_id,
  cast(len(list_filter(regexp_extract_all(text, '({_NAMES})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) as bigint) as n_assign,
  cast(len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) as bigint) as n_access,
  cast(len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 24)) as bigint) as n_hex
from texts
"""

_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_DOUBLED = f"cast({_DIGITS}[length({_DIGITS}) - k] as int) * (1 + k % 2)"
_LUHN = f"list_sum([case when {_DOUBLED} > 9 then {_DOUBLED} - 9 else {_DOUBLED} end for k in range(0, length({_DIGITS}))]) % 10 = 0"
PERSONAL_BASE = f"""
with texts as (select doc_id, coalesce(text, '') as text from documents)
select doc_id,
  cast(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) as bigint) as n_email,
  cast(len(list_filter(regexp_extract_all(text, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'), lambda x: len(list_filter(string_split(x, '.'), lambda p: coalesce(try_cast(p as bigint), 256) > 255)) = 0)) as bigint) as n_ip,
  cast(len(list_filter(regexp_extract_all(text, '[0-9]([\\x20-]?[0-9])+'), lambda x: length({_DIGITS}) between 16 and 19 and {_LUHN})) as bigint) as n_card,
  cast(len(list_filter(regexp_extract_all(text, '\\+[0-9][\\x20().0-9-]+[0-9]'), lambda x: length({_DIGITS}) between 8 and 15)) as bigint) as n_phone
from texts
"""

MIX_TARGETS = f"""
with sized as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), {WORDS})) as bigint) as size from documents),
per as (select source, sum(size) as source_size from sized group by source),
weighed as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from per),
bounds as (select *, 3 * source_size as most, 3 * source_size / weight as bound from weighed),
sums as (
  select *, (select sum(source_size) from per) - coalesce(sum(most) over (order by bound, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(weight) over (order by bound, source nulls last rows between current row and unbounded following) as weights from bounds),
level as (select bound as b, rest as r, weights as w from sums where rest / weights <= bound order by bound, rest, weights limit 1),
goals as (select source, source_size, case when bound < (select b from level) then most else least(weight * (select r from level) / (select w from level), most) end as target from sums)
select doc_id, size, cast(source_size as bigint) as source_size, cast(target as double) as target from sized join goals on sized.source is not distinct from goals.source
"""


WHITENING_BASE = """
with fine as (
  select vec_id, [cast(floor(256 * cast(c as double)) as bigint) for c in embedding] as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
fit as (select distinct x from fine),
sums as (select i, cast(sum(x[i]) as bigint) as s, cast(count(*) as bigint) as n from fit, lateral unnest(range(1, len(x) + 1)) as t(i) group by i)
select vec_id, any_value(n) as n, cast(sum((n * x[i] - s) * (n * x[i] - s)) as bigint) as deviation
from (select vec_id, x, row_number() over () as r from fine), sums group by vec_id, r
"""

OP13 = """
with ends as (select sale_id, min(shipped_at) as shipped from sale_lines group by sale_id),
homes as (select client_id, min(nation_id) as nation_id from clients group by client_id),
sold as (
  select coalesce(h.nation_id, -1) as nation_id, epoch_us(sold_at) // 60000000 * 60 as a, epoch_us(shipped) // 60000000 * 60 + 604800 as b,
    case when total is null or not isfinite(total) then 0 else cast(floor(100 * total + 0.5) as bigint) end as cents
  from sales s left join ends e on e.sale_id = s.sale_id left join homes h on h.client_id = s.client_id where sold_at is not null),
moves as (
  select nation_id, a as t, 1 as n, cents from sold where b is null or b > a
  union all select nation_id, b, -1, -cents from sold where b > a),
steps as (
  select nation_id, t, sum(n) as n, sum(cents) as cents from (select * from moves union all select -2, t, n, cents from moves)
  group by nation_id, t having sum(n) <> 0 or sum(cents) <> 0),
run as (
  select nation_id, t as from_s, lead(t) over (partition by nation_id order by t) as to_s, sum(n) over (partition by nation_id order by t) as n_open,
    sum(cents) over (partition by nation_id order by t) as open_cents from steps)
select cast(nation_id as int) as nation_id, cast(from_s as bigint) as from_s, cast(to_s as bigint) as to_s, cast(n_open as bigint) as n_open, cast(open_cents as bigint) as open_cents,
  cast(max(n_open) over (partition by nation_id order by from_s) as bigint) as high_open, open_cents = max(open_cents) over (partition by nation_id) as is_peak from run
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": OP3, "op4_substring_dedup": OP4, "op5_minhash_near_duplicates": OP5, "quality_base": QUALITY_BASE, "secret_base": SECRET_BASE,
        "personal_base": PERSONAL_BASE, "mix_targets": MIX_TARGETS, "op13_peak_concurrency": OP13, "whitening_base": WHITENING_BASE,
    }
