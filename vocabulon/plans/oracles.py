"""DuckDB SQL for the registered queries, composed of shared parts."""

from __future__ import annotations

from functools import reduce

TOKENS = r"""
tokens as (select doc_id, pos - 1 as pos, w[pos] as word
  from (select doc_id, regexp_extract_all(lower(text), '[^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+') as w from documents), lateral unnest(range(1, len(w) + 1)) as t(pos)),
vocab as (select row_number() over (order by cnt desc, doc, pos) - 1 as id, word, cnt
  from (select word, count(*) as cnt, min(doc_id) as doc, arg_min(pos, doc_id * 4294967296 + pos) as pos from tokens group by word having count(*) >= 5)),
ids as (select doc_id, row_number() over (partition by doc_id order by pos) - 1 as pos, id from tokens join vocab using (word))"""
LENGTHS = "lengths as (select doc_id, count(*) as n from ids group by doc_id)"
PROBS = "kept as (select id, word, cnt, least(1.0, sqrt(r) + r) as keep_prob from (select *, 1e-5 / (cnt / (select cast(sum(cnt) as bigint) from vocab)) as r from vocab))"
NEG = """
shares as (select id, sum(p) over (order by id rows between unbounded preceding and current row) as c
  from (select id, pow(cast(cnt as double), 0.75) / (select sum(pow(cast(cnt as double), 0.75)) from vocab) as p from vocab)),
ends as (select id, max(least(cast(round_even(c * 10000000, 0) as bigint), 10000000)) over (order by id) as hi from shares),
neg as (select id, coalesce(lag(hi) over (order by id), 0) as lo, case when id = (select max(id) from ends) then 10000000 else hi end as hi from ends)"""


def _u(*parts: str) -> str:
    return "(cast('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8) as bigint) / 4294967296.0)"


def _ahead(window: int, source: str = "ids", more: str = "") -> str:
    leads = ", ".join(f"lead(id, {k}) over w as n{k}" for k in range(1, window + 1))
    rows = " union all ".join(f"select doc_id, pos, id as l, n{k} as r, {k} as dist{more} from looked where n{k} is not null" for k in range(1, window + 1))
    return f"looked as (select doc_id, pos, id{more}, {leads} from {source} window w as (partition by doc_id order by pos)), ahead as ({rows})"


BOTH = "both_ways as (select l as center, r as context, dist from {0} union all select r, l, dist from {0})"
COOC = "half as (select least(l, r) as i, greatest(l, r) as j, cast(sum(2520 // dist) as bigint) as w from ahead {0} group by 1, 2), cells as (select i, j, case when i = j then 2 * w else w end / 2520.0 as value from half union all select j, i, w / 2520.0 from half where i <> j)"
SPPMI = "sums as (select i, ln(greatest(sum(value), 1e-10)) as l from cells group by i), scored as (select c.i, c.j, ln(value) + ln((select sum(value) from cells)) - a.l - b.l - ln(15.0) as value from cells c join sums a on a.i = c.i join sums b on b.i = c.j)"


def _model(name: str, expression: str) -> str:
    unit = f"[x / (sqrt(list_inner_product(v, v)) + 1e-8) for x in v]"
    return f"{name}_raw as (select vec_id as id, {expression} as v from embeddings), {name} as (select id, {unit} as v from {name}_raw)"


BASE = "cast(embedding as double[])"
OTHER = "list_reverse(cast(embedding as double[]))"
WEAKER = "[case when i <= 48 then cast(embedding[i] as double) else 0.0 end for i in range(1, len(embedding) + 1)]"
FOURS = """
fours as (select 'label_' || label as category, p // 4 + 1 as qno, max(case when p % 4 = 0 then vec_id end) as a, max(case when p % 4 = 1 then vec_id end) as b,
    max(case when p % 4 = 2 then vec_id end) as c, max(case when p % 4 = 3 then vec_id end) as d
  from (select vec_id, label, row_number() over (partition by label order by vec_id) - 1 as p from embeddings) group by 1, 2),
plain as (select * from fours where d is not null)"""


def _answers(m: str, k: int, source: str = "questions", model: str | None = None) -> str:
    """Ranked answers of a model to ``source``, as tables named after ``m``."""
    e = model or m
    return f"""
{m}_t as (select category, qno, a, b, c, d, [y.v[i] - x.v[i] + z.v[i] for i in range(1, len(x.v) + 1)] as t
  from {source} join {e} x on x.id = a join {e} y on y.id = b join {e} z on z.id = c),
{m}_q as (select *, [x / (sqrt(list_inner_product(t, t)) + 1e-8) for x in t] as u from {m}_t),
{m}_s as (select category, qno, a, b, c, d, e.id as answer, list_inner_product(u, e.v) as score from {m}_q join {e} e on e.id not in (a, b, c)),
{m}_r as (select *, row_number() over (partition by category, qno order by score desc, answer) as rank from {m}_s qualify rank <= {k})"""


#: Needs the model named base.
QUESTIONS = f"""{FOURS}, {_answers('seed', 1, 'plain', 'base')},
questions as (select q.category, q.qno, q.a, q.b, q.c, case when q.qno % 5 = 0 then -1 when q.qno % 2 = 0 then r.answer else q.d end as d
  from plain q left join seed_r r on r.category = q.category and r.qno = q.qno)"""


def _judged(m: str) -> str:
    return f"{m}_j as (select q.*, q.d >= 0 as answerable, coalesce(q.d >= 0 and r.answer = q.d, false) as correct, r.answer from questions q left join {m}_r r on r.category = q.category and r.qno = q.qno and r.rank = 1)"


_COUNTS = "count(*) filter (where correct) as correct, count(*) filter (where answerable) as total, count(*) filter (where not answerable) as skipped, round(case when count(*) filter (where answerable) > 0 then count(*) filter (where correct) / count(*) filter (where answerable) else 0.0 end, {0}) as {1}"
COUNTS = _COUNTS.format(6, "accuracy")
SEM = "category in ('label_0', 'label_1', 'label_2', 'label_3', 'label_4')"
BATCH = """
n_rows as (select count(*) as n from embeddings),
batch as (select vec_id as row, vec_id // 2 as center, (vec_id * 7 + 1) % n as pos, [(vec_id * 11 + 3) % n, (vec_id * 13 + 5) % n, ((vec_id * 17 + 9) % n) // 3] as negs, {0} as w from embeddings, n_rows),
slots as (select row, center, w, 0 as slot, pos as target from batch union all select row, center, w, k, negs[k] from batch, lateral unnest(range(1, 4)) as t(k)),
w_in as (select vec_id as id, cast(embedding as double[]) as v from embeddings), w_out as (select vec_id as id, list_reverse(cast(embedding as double[])) as v from embeddings),
found as (select row, slot, center, target, w, a.v as vc, b.v as vt, greatest(-10.0, least(10.0, list_inner_product(a.v, b.v))) as x from slots join w_in a on a.id = center join w_out b on b.id = target),
coef as (select *, w * (1 / (1 + exp(-x)) - case when slot = 0 then 1.0 else 0.0 end) as c from found),
parts as (select 'in' as side, 0 as s, row, center as id, dim - 1 as dim, vt[dim] * c as g from coef, lateral unnest(range(1, 65)) as t(dim)
  union all select 'out', slot, row, target, dim - 1, vc[dim] * c from coef, lateral unnest(range(1, 65)) as t(dim)),
grads as (select side, id, dim, sum(g) as grad from parts group by 1, 2, 3)"""
STEP = "select o.side, o.id, o.dim, round(o.v - 0.025 * coalesce(g.grad, 0.0), 6) as value from (select 'in' as side, id, dim - 1 as dim, v[dim] as v from w_in, lateral unnest(range(1, 65)) as t(dim) union all select 'out', id, dim - 1, v[dim] from w_out, lateral unnest(range(1, 65)) as t(dim)) o left join grads g using (side, id, dim)"


_LOSS = "w * (greatest({0}, 0.0) + ln(1 + exp(-abs({0}))))"
_MOVED = "greatest(-10.0, least(10.0, raw {0} 1e-5 * other)) * case when slot = 0 then -1 else 1 end"
DIFFERENCES = f"""
entries as (select 'in' as side, center as id, dim - 1 as dim, w, slot, list_inner_product(vc, vt) as raw, vt[dim] as other from found, lateral unnest(range(1, 65)) as t(dim)
  union all select 'out', target, dim - 1, w, slot, list_inner_product(vc, vt), vc[dim] from found, lateral unnest(range(1, 65)) as t(dim)),
differences as (select side, id, dim, sum({_LOSS.format('(' + _MOVED.format('+') + ')')} - {_LOSS.format('(' + _MOVED.format('-') + ')')}) / 2e-5 as numeric from entries group by 1, 2, 3)
select {{0}} as weighted, side, count(*) as parameters, round(max(abs(grad - numeric) / greatest(abs(grad), abs(numeric), 1e-4)), 5) as error,
  max(abs(grad - numeric) / greatest(abs(grad), abs(numeric), 1e-4)) < 1e-5 as ok from grads join differences using (side, id, dim) group by side"""


def _long(source: str, column: str = "v") -> str:
    return f"select id, dim - 1 as dim, round({column}[dim], 6) as value from {source}, lateral unnest(range(1, 65)) as t(dim)"


def _squared(name: str, cells: str) -> str:
    """``name``: the unit vector of the strongest direction of a symmetric table (r, c, x), which 20 squarings leave alone."""
    return f"""
{name}_p(k, r, c, x) as (
  select 0, r, c, x / sqrt(sum(x * x) over ()) from {cells}
  union all
  select k, r, c, x / sqrt(sum(x * x) over ()) from (
    select a.k + 1 as k, a.r, b.c, sum(a.x * b.x) as x from {name}_p a join {name}_p b on a.c = b.r and a.k = b.k where a.k < 20 group by 1, 2, 3)),
{name}_t as (select r as dim, x / sqrt((select max(x) from {name}_p where k = 20 and r = c)) as x from {name}_p
  where k = 20 and c = (select r from {name}_p where k = 20 and r = c order by x desc, r limit 1)),
{name} as (select dim, x / sqrt((select sum(x * x) from {name}_t)) as x from {name}_t)"""


def _processed(m: str) -> str:
    """``m``_pp_raw (id, v) and ``m``_pp: the unit rows of ``m`` less their mean and two strongest directions, as they are and of unit length."""
    return f"""
{m}_ppl as (select id, dim, v[dim] as x from {m}, lateral unnest(range(1, 65)) as t(dim)),
{m}_ppm as (select dim, avg(x) as m from {m}_ppl group by dim),
{m}_ppz as (select id, dim, x - m as x from {m}_ppl join {m}_ppm using (dim)),
{m}_ppc as (select a.dim as r, b.dim as c, avg(a.x * b.x) as x from {m}_ppz a join {m}_ppz b using (id) group by 1, 2),
{_squared(f'{m}_ppe', f'{m}_ppc')},
{m}_pps as (select sum(a.x * c.x * b.x) as s from {m}_ppc c join {m}_ppe a on a.dim = c.r join {m}_ppe b on b.dim = c.c),
{m}_ppd as (select r, c, c.x - s * a.x * b.x as x from {m}_ppc c join {m}_ppe a on a.dim = c.r join {m}_ppe b on b.dim = c.c, {m}_pps),
{_squared(f'{m}_ppf', f'{m}_ppd')},
{m}_ppy as (select id, sum(z.x * e.x) as p, sum(z.x * f.x) as q from {m}_ppz z join {m}_ppe e using (dim) join {m}_ppf f using (dim) group by id),
{m}_ppw as (select z.id, dim, z.x - p * e.x - q * f.x as x from {m}_ppz z join {m}_ppy using (id) join {m}_ppe e using (dim) join {m}_ppf f using (dim)),
{m}_pp_raw as (select id, list(x order by dim) as v from {m}_ppw group by id),
{m}_pp as (select id, [x / (sqrt(list_inner_product(v, v)) + 1e-8) for x in v] as v from {m}_pp_raw)"""


def _scores(m: str) -> str:
    acc = "round(case when count(*) filter (where answerable and {0}) > 0 then count(*) filter (where correct and {0}) / count(*) filter (where answerable and {0}) else 0.0 end, 6) as {1}"
    return f"(select {acc.format(SEM, 'sem')}, {acc.format('not ' + SEM, 'syn')}, {acc.format('true', 'overall')} from {m}_j)"


def oracle_sql() -> dict[str, str]:
    t = f"with {TOKENS}"
    digest = "select center, cast(dist as bigint) as dist, count(*) as n, cast(sum(context) as bigint) as contexts from both_ways group by 1, 2"
    coin = f"coined as (select * from ahead where {_u('1', chr(39) + 'pair' + chr(39), '0', 'doc_id', 'pos', 'dist')} < (10 - dist + 1) / 10.0)"
    expected = reduce(lambda a, b: f"{a} + {b}", [f"2.0 * greatest(n - {d}, 0) * {10 - d + 1} / 10" for d in range(1, 11)])
    cells = f"{t}, {_ahead(10)}, {COOC.format('')}"
    base, other, weaker = _model("base", BASE), _model("other", OTHER), _model("weaker", WEAKER)
    judged = f"with {base}, {QUESTIONS}, {_answers('base', 1)}, {_judged('base')}"
    rolled = f"select coalesce(part, 'overall') as part, {COUNTS} from (select *, case when {SEM} then 'semantic' else 'syntactic' end as part from base_j) group by rollup (part)"
    plain, weighted = BATCH.format("1.0"), BATCH.format("1.0 / (1 + vec_id % 5)")
    report_rows = f"""select case when is_sem then 0 else 2 end as place, category as label, correct, total, skipped, percent from (select category, {SEM} as is_sem, {_COUNTS.format(9, 'acc')}, round(acc * 100, 1) as percent from base_j group by category)
      union all select case part when 'semantic' then 1 when 'syntactic' then 3 else 4 end, case part when 'semantic' then 'SEMANTIC TOTAL' when 'syntactic' then 'SYNTACTIC TOTAL' else 'OVERALL' end, correct, total, skipped, round(accuracy * 100, 1)
      from ({rolled.replace('6) as accuracy', '9) as accuracy')})"""
    select = " union all ".join(
        f"select cast({no} as bigint) as config_no, '{m}' as name, (select round(case when count(*) filter (where answerable) > 0 then count(*) filter (where correct) / count(*) filter (where answerable) else 0.0 end, 6) from {m}_j where {SEM}) as score"
        for no, m in enumerate(("base", "other", "weaker"))
    )
    every = ", ".join([base, other, weaker, QUESTIONS, *[f"{_answers(m, 1)}, {_judged(m)}" for m in ("base", "other", "weaker")]])
    models = ("base", "base_pp", "weaker", "weaker_pp")
    processed = f"with recursive {base}, {weaker}, {_processed('base')}, {_processed('weaker')}, {QUESTIONS}, " + ", ".join(f"{_answers(m, 1)}, {_judged(m)}" for m in models)
    compared = " union all ".join(
        f"select cast({no} as bigint) as config_no, '{m}' as config, r.sem as sem_raw, p.sem as sem_pp, r.syn as syn_raw, p.syn as syn_pp, p.overall as all_pp from {_scores(m)} r, {_scores(m + '_pp')} p"
        for no, m in enumerate(("base", "weaker"))
    )
    sql = {
        "postprocess": f"with recursive {base}, {_processed('base')} select id, dim - 1 as dim, round(v[dim], 5) + 0.0 as value from base_pp_raw, lateral unnest(range(1, 65)) as t(dim)",
        "experiment_scores": f"{processed}, compared as ({compared}) select *, row_number() over (order by sem_pp desc, config_no) = 1 as chosen from compared",
        "tokenize": f"{t} select doc_id, pos, word from tokens",
        "build_vocab": f"{t} select id, word, cnt from vocab",
        "encode_ids": f"{t} select doc_id, pos, id from ids",
        "corpus_stats": f"{t} select count(*) as n_words, cast(sum(cnt) as bigint) as n_tokens, max(cnt) as top from vocab",
        "subsample_probs": f"{t}, {PROBS} select id, word, cnt, round(keep_prob, 9) as keep_prob from kept",
        "subsample_tokens": f"{t}, {PROBS} select doc_id, row_number() over (partition by doc_id order by pos) - 1 as pos, id from ids join kept using (id) where {_u('1', chr(39) + 'sub' + chr(39), '0', 'doc_id', 'pos')} < keep_prob",
        "neg_table": f"{t}, {NEG} select id, cast(lo as bigint) as lo, cast(hi as bigint) as hi from neg",
        "neg_sample": f"{t}, {NEG}, draws as (select cast(floor({_u('1', chr(39) + 'neg' + chr(39), '0', 'doc_id', 'pos', 'k')} * 10000000) as bigint) as r from ids, lateral unnest(range(0, 5)) as t(k)) select id, count(*) as draws, cast(sum(r) as bigint) as slots from draws asof join (select * from neg where hi > lo) n on draws.r >= n.lo group by id",
        "chunk_ids": f"{t} select chunk_id, count(*) as n from (select (row_number() over (order by doc_id, pos) - 1) // 50000 as chunk_id from ids) group by 1",
        "pairs_window": f"{t}, {_ahead(10)}, {BOTH.format('ahead')} {digest}",
        "pairs_sampled": f"{t}, {_ahead(10)}, {coin}, {BOTH.format('coined')} select center, count(*) as n, cast(sum(context) as bigint) as contexts from both_ways group by 1",
        "pairs_weighted": f"{t}, {_ahead(10)}, {coin}, {BOTH.format('coined')} select center, cast(dist as bigint) as dist, count(*) as n, round(count(*) * pow(cast(dist as double), -1.0), 6) as weight from both_ways group by 1, 2, both_ways.dist",
        "pairs_afws": f"{t}, wide as (select doc_id, pos, id, 3 + 12 * pow(greatest(0.0, least(1.0, 1.0 - cnt / (select max(cnt) from vocab))), 0.5) as width from ids join vocab using (id)), {_ahead(15, 'wide', ', width')}, coined as (select * from ahead where dist <= width and {_u('1', chr(39) + 'pair' + chr(39), '0', 'doc_id', 'pos', 'dist')} < (width - dist + 1) / width), {BOTH.format('coined')} {digest}",
        "expected_pairs": f"{t}, {LENGTHS} select round(sum({expected}), 3) as expected_pairs, cast(sum(n) as bigint) as tokens from lengths",
        "cooc": f"{cells} select i, j, round(value, 6) as value from cells",
        "cooc_marginals": f"{cells} select i, round(sum(value), 4) as total, count(*) as n_cells from cells group by i",
        "sppmi": f"{cells}, {SPPMI} select i, j, round(value, 5) as value from scored where value > 0",
        "cooc_topn": f"{t}, {_ahead(10)}, {COOC.format('where l < 30000 and r < 30000')} select i, count(*) as n_cells, round(sum(value), 4) as total from cells group by i",
        "cooc_stream": f"{t}, stream as (select g // 200000 as doc_id, g % 200000 as pos, id from (select id, row_number() over (order by doc_id, pos) - 1 as g from ids)), {_ahead(10, 'stream')}, {COOC.format('')} select i, count(*) as n_cells, round(sum(value), 4) as total from cells group by i",
        "sppmi_top": f"{cells}, {SPPMI}, ranked as (select *, row_number() over (partition by i order by round(value, 5) desc, j) as rank from scored where value > 0 qualify rank <= 5) select a.word, rank, b.word as associate, round(value, 5) as value from ranked join vocab a on a.id = i join vocab b on b.id = j",
        "lr_schedule": "with e as (select l_orderkey as batch, count(*) as n from lineitem group by 1), p as (select batch, coalesce(sum(n) over (order by batch rows between unbounded preceding and 1 preceding), 0) as before from e) select batch, cast(before as bigint) as processed, round(greatest(0.025 * (1 - least(before / 50000.0, 1.0)), 0.0001), 9) as lr from p",
        "l2_normalize": f"with {base} {_long('base')}",
        "nearest_neighbors": f"with {base}, s as (select q.id as q, e.id as e, list_inner_product(q.v, e.v) as score from base q join base e on q.id <> e.id), r as (select *, row_number() over (partition by q order by score desc, e) as rank from s qualify rank <= 10) select 'w' || q as query, rank, 'w' || e as word, round(score, 6) as score from r union all select 'w-1', 1, 'OOV', 0.0",
        "analogy_topk": f"with {base}, {QUESTIONS}, asked as (select category, qno, a, case when qno % 7 = 0 then -1 else b end as b, c, d from questions), {_answers('base', 5, 'asked')} select category, qno, rank, 'w' || answer as answer, round(score, 6) as score from base_r union all select category, qno, 1, 'OOV', 0.0 from asked where b < 0",
        "gradient_check": " union all ".join(f"select * from (with {batch}, {DIFFERENCES.format(weighted)})" for batch, weighted in ((plain, "false"), (weighted, "true"))),
        "analogy_eval": f"{judged} select category, {COUNTS}, {SEM} as is_semantic from base_j group by category",
        "analogy_rollup": f"{judged} {rolled}",
        "analogy_report": f"{judged} select row_number() over (order by place, label) as line, label, correct, total, skipped, percent from ({report_rows})",
        "failure_analysis": f"with {base}, {weaker}, {QUESTIONS}, {_answers('base', 1)}, {_judged('base')}, {_answers('weaker', 1)}, {_judged('weaker')}, diff as (select case when x.correct then 'improved' else 'regressed' end as change, x.category, x.qno, 'w' || x.a as a, 'w' || x.b as b, 'w' || x.c as c, 'w' || x.d as d, 'w' || case when x.correct then y.answer else x.answer end as wrong from base_j x join weaker_j y on x.category = y.category and x.qno = y.qno where x.answerable and x.correct <> y.correct), numbered as (select change, row_number() over (partition by change order by category, qno) as n, category, qno, a, b, c, d, wrong, count(*) over (partition by change) as change_total from diff) select * from numbered where n <= 10",
        "model_select": f"with {every}, scores as ({select}) select *, row_number() over (order by score desc, config_no) = 1 as chosen from scores",
        "combine": f"with {base}, {other}, m as (select x.id, [x.v[i] + y.v[i] for i in range(1, len(x.v) + 1)] as v from base_raw x join other_raw y using (id)) {_long('m')}",
        "blend": f"with {base}, {other}, m as (select x.id, [0.7 * x.v[i] + (1 - 0.7) * y.v[i] for i in range(1, len(x.v) + 1)] as v from base x join other y using (id)) {_long('m')}",
        "extend_svd": f"with {base}, {other}, avg_norm as (select avg(sqrt(list_inner_product(v, v)) + 1e-8) as m from other_raw where id % 3 = 0), m as (select x.id, case when x.id % 3 = 0 then y.v else [e * m for e in x.v] end as v from base x join other_raw y using (id), avg_norm) {_long('m')}",
        "mean_center": f"with {base} select dim - 1 as dim, round(avg(v[dim]), 6) as mean from base, lateral unnest(range(1, 65)) as t(dim) group by dim",
        "covariance": f"with {base}, x as (select id, dim - 1 as dim, v[dim] as x from base, lateral unnest(range(1, 65)) as t(dim)), m as (select dim, avg(x) as m from x group by dim), c as (select id, dim, x - m as x from x join m using (dim)) select a.dim as r, b.dim as c, round(avg(a.x * b.x), 6) + 0.0 as value from c a join c b using (id) group by 1, 2",
        "sgns_loss": f"with {plain} select round(sum(w * (greatest(case when slot = 0 then -x else x end, 0.0) + ln(1 + exp(-abs(x))))) / count(distinct row), 6) as loss, count(distinct row) as samples from found",
        "sgns_grad": f"with {plain} select side, id, dim, round(grad, 6) as grad from grads",
        "sgns_grad_last": f"with {plain} select side, id, dim, round(sum(g), 6) as grad from (select * from parts qualify row = max(row) over (partition by side, id, dim, s)) group by 1, 2, 3",
        "sgns_step": f"with {plain} {STEP}",
        "sgns_step_weighted": f"with {weighted} {STEP}",
        "loss_history": "select win, round(loss, 6) as loss from (select event_id // 2000 as win, avg(value) as loss, count(*) as n from events group by 1) where n = 2000",
        "smooth_loss": "with w as (select greatest(1, count(*) // 80) as width from events), s as (select event_id as batch, value as loss, row_number() over (order by event_id) as k, sum(value) over (order by event_id) as c from events), f as (select a.batch, a.loss, (b.c - a.c + a.loss) / width as smooth from s a, w, s b where b.k = a.k + width - 1) select batch, round(loss, 6) as loss, round(smooth, 6) as smooth from f",
        "parse_questions": f"with {base}, {QUESTIONS} select category, row_number() over (partition by category order by qno) as qno, 'w' || a as a, 'w' || b as b, 'w' || c as c, 'w' || d as d from questions",
    }
    return sql
