"""DuckDB equivalents that take more than a line or two."""

from __future__ import annotations

from pairloom.plans import inputs as I
from pairloom.schema import Window


def hist_ctes(w: Window) -> str:
    """CTEs up to h (name1, name2, distance, value): every label with every label, every distance."""
    both = "select n1, n2, d from p" if w.directional else "select n1, n2, d from p union all select n2, n1, d from p"
    return f"""with {I.ITEMS}, l as (select distinct name from s), f as (select a.name as name1, b.name as name2 from l a cross join l b),
{I.pairs_sql(w, clamp=False)}, k as (select n1, n2, d, count(*) as n from ({both}) group by 1, 2, 3),
g as (select unnest(range({w.min_dist}, {w.max_dist} + 1)) as d),
h as (select name1, name2, g.d::int as distance, coalesce(n, 0)::double as value from f cross join g left join k on k.n1 = name1 and k.n2 = name2 and k.d = g.d)"""


def hist_sql(w: Window, tail: str = "select name1, name2, distance, value from h") -> str:
    return f"{hist_ctes(w)} {tail}"


def percentage_sql(w: Window, counted: Window, bins: int) -> str:
    """Shares of the longer site instead of distances, for the rules of another window."""
    return f"""with {I.SITES}, {I.rules_sql(counted)}, {I.pairs_sql(w, clamp=False, out='q')},
x as (select n1, n2, (case when d < 0 then greatest(aen - ast, ben - bst) + d else d end) * {bins} / nullif(greatest(aen - ast, ben - bst), 0)::double as v from q),
y as (select n1, n2, (case when v >= 0 then floor(v) else ceil(v) end)::int as d from x where v is not null),
z as (select n1, n2, d, count(*) as n from (select * from y union all select n2, n1, d from y) where d between 0 and {bins} group by 1, 2, 3),
f as (select distinct name1, name2 from r), g as (select unnest(range(0, {bins} + 1)) as d)
select name1, name2, g.d::int as distance, coalesce(n, 0)::double as value from f cross join g left join z on z.n1 = name1 and z.n2 = name2 and z.d = g.d"""


def peaks_ctes(w: Window, threshold: float) -> str:
    """CTEs up to sm (the scaled signal, smoothed over three places) and pk (its peaks, with counts at and around them)."""
    pair = "partition by name1, name2"
    lo, hi = w.min_dist + 1, w.max_dist - 1
    return f"""{hist_ctes(w)},
sc as (select name1, name2, distance, coalesce((value - min(value) over ({pair})) / nullif(max(value) over ({pair}) - min(value) over ({pair}), 0), 0) as v from h),
sw as (select name1, name2, distance, (lag(v) over ({pair} order by distance) + v + lead(v) over ({pair} order by distance)) / 3 as v from sc),
sm as (select * from sw where distance between {lo} and {hi}),
tot as (select name1, name2, sum(value) as total from h where distance between {lo} and {hi} group by 1, 2 having sum(value) >= 1),
zs as (select name1, name2, distance as pos, coalesce((v - avg(v) over ({pair})) / nullif(stddev_pop(v) over ({pair}), 0), 0) as x from sm semi join tot using (name1, name2)),
xs as (select * from zs union all select name1, name2, e, 0.0 from tot cross join (select unnest([{lo - 1}, {hi + 1}]) as e)),
ch as (select *, case when x = lag(x) over ({pair} order by pos) then 0 else 1 end as c from xs),
rn as (select *, sum(c) over ({pair} order by pos) as run from ch),
rs as (select name1, name2, run, min(x) as x, min(pos) as i, max(pos) as j from rn group by 1, 2, 3),
nb as (select *, lag(x) over ({pair} order by run) as before, lead(x) over ({pair} order by run) as after from rs),
tops as (select name1, name2, (i + j) // 2 as top_at, x as top from nb where before < x and after < x and x >= {threshold}),
higher as (select t.name1, t.name2, t.top_at, any_value(top) as top, max(case when pos < top_at and x > top then pos end) as hl, min(case when pos > top_at and x > top then pos end) as hr from tops t join xs using (name1, name2) group by 1, 2, 3),
valleys as (select t.name1, t.name2, t.top_at, any_value(top) as top, min(case when pos <= top_at and pos > coalesce(hl, -1000000) then x end) as vl, min(case when pos >= top_at and pos < coalesce(hr, 1000000) then x end) as vr from higher t join xs using (name1, name2) group by 1, 2, 3),
pk0 as (select name1, name2, top_at::int as distance, top as height, top - greatest(vl, vr) as prominence, greatest(top_at - 1, {lo}) as lo, least(top_at + 1, {hi}) as hi from valleys where top - greatest(vl, vr) >= {threshold}),
pk as (select name1, name2, a.distance, height, prominence, any_value(total) as total, sum(h.value) as near, any_value(a.lo) as lo, any_value(a.hi) as hi
  from pk0 a join tot using (name1, name2) join h using (name1, name2) where h.distance between a.lo and a.hi group by name1, name2, a.distance, height, prominence)"""


def peaks_sql(w: Window, threshold: float) -> str:
    return f"""{peaks_ctes(w, threshold)}
select name1, name2, distance, round(height, 6) as height, round(prominence, 6) as prominence, {threshold}::double as threshold, total, near, round(near / total * 100, 6) as percent, '[' || lo || ';' || hi || ']' as "window" from pk"""


def noise_sql(w: Window, threshold: float, share: float = 0.75) -> str:
    """The median of what is left of the smoothed signal when the peaks are cut out."""
    last = w.max_dist - 1
    return f"""{peaks_ctes(w, threshold)},
pv as (select pk.name1, pk.name2, pk.distance as p, v as pval from pk join sm using (name1, name2, distance)),
cut as (select pv.name1, pv.name2, p, coalesce(max(case when distance < p and v <= {share} * pval then distance end) + 1, {w.min_dist + 1}) as a,
  coalesce(min(case when distance > p and v < {share} * pval then distance end) - 1, {last}) as b from pv join sm using (name1, name2) group by 1, 2, 3),
rest as (select name1, name2, v, exists (select 1 from cut c where c.name1 = sm.name1 and c.name2 = sm.name2 and sm.distance >= a and sm.distance < b) as gone from sm semi join pv using (name1, name2))
select name1, name2, round(coalesce(median(v) filter (where not gone), 'nan'::double), 6) as noisiness from rest group by 1, 2"""


def autocorrelation_ctes(w: Window) -> str:
    """CTEs up to ac (name1, name2, lag, a), a null where the signal is constant."""
    return f"""{hist_ctes(w)}, y as (select name1, name2, distance, value - avg(value) over (partition by name1, name2) as y from h),
sq as (select name1, name2, sum(y * y) as q from y group by 1, 2),
cr as (select a.name1, a.name2, b.distance - a.distance as lag, sum(a.y * b.y) as c from y a join y b on a.name1 = b.name1 and a.name2 = b.name2 and a.distance < b.distance group by 1, 2, 3),
ac as (select name1, name2, lag, c / nullif(q, 0) as a from cr join sq using (name1, name2))"""


def autocorrelation_sql(w: Window) -> str:
    return f"{autocorrelation_ctes(w)} select name1, name2, lag::int as lag, case when round(a, 6) = 0 then 0 else coalesce(round(a, 6), 'nan'::double) end as value from ac"


def periodicity_sql(w: Window) -> str:
    n = w.max_dist - w.min_dist
    return f"""{autocorrelation_ctes(w)}, fr as (select unnest(range(0, {n // 2} + 1)) as k),
sp as (select name1, name2, k, sum(a * cos(2 * pi() * (lag - 1) * k / {n})) as re, sum(a * sin(2 * pi() * (lag - 1) * k / {n})) as im from ac cross join fr group by 1, 2, 3),
best as (select name1, name2, arg_max(k, re) as k, arg_max(sqrt(re * re + im * im), re) as size from sp group by 1, 2)
select name1, name2, case when size is null then 'nan'::double when k = 0 then 'infinity'::double else round_even({n} / k::double, 2) end as period, coalesce(round(size, 3), 'nan'::double) as amplitude from best"""


def windows_ctes(w: Window, flank: int) -> str:
    """CTEs up to fr: the windows around click and view, as the operator lays them around the middle of the gap."""
    return f"""with {I.SITES}, {I.pairs_sql(w, clamp=False)},
c as (select *, n1 = 'click' as flip, floor(d / 2)::bigint as half from p where (n1, n2) in (('click', 'view'), ('view', 'click'))),
m as (select *, case when flip then bst - half else aen + half end as mid from c),
fr as (select i, j, contig, flip, mid - {flank} as ws, mid + {flank} as we, case when flip then mid + {flank} - ben else ast - mid + {flank} end as r1, case when flip then mid + {flank} - aen else bst - mid + {flank} end as r2 from m)"""


def track_sql(w: Window, flank: int) -> str:
    """The mean logarithmic signal over these windows."""
    return f"""{windows_ctes(w, flank)}, sg as (select contig, st, max(en) as en, max(score) as v from s group by 1, 2),
pl as (select i, j, contig, flip, ws, we, unnest(range(0, {2 * flank})) as position from fr),
va as (select i, j, position, coalesce(max(v), 0) as v from pl left join sg on sg.contig = pl.contig and sg.st <= case when flip then we - 1 - position else ws + position end and sg.en > case when flip then we - 1 - position else ws + position end group by 1, 2, 3)
select position, round(avg(sign(v) * ln(1 + abs(v))), 6) as value from va group by position"""


_OWNED = """own as (select distinct l_suppkey::varchar as gene, p_brand as term, 'brand' as aspect from lineitem join part on l_partkey = p_partkey union select distinct l_suppkey::varchar, p_type, 'type' from lineitem join part on l_partkey = p_partkey),
fl as (select *, gene::bigint % 3 = 0 as study from own),
sz as (select aspect, count(distinct gene) as total, count(distinct gene) filter (where study) as drawn from fl group by 1),
per as (select aspect, term, count(*) as good, count(*) filter (where study) as k from fl group by 1, 2),
tb as (select * from per join sz using (aspect)),
ks as (select aspect, term, k, unnest(range(greatest(0, drawn + good - total), least(drawn, good) + 1)) as i, drawn, good, total from tb),
lp as (select *, lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + lgamma(total - good + 1) - lgamma(drawn - i + 1) - lgamma(total - good - drawn + i + 1) - lgamma(total + 1) + lgamma(drawn + 1) + lgamma(total - drawn + 1) as l from ks),
ob as (select aspect, term, l as own from lp where i = k),
pv as (select aspect, term, least(1.0, sum(exp(l)) filter (where l <= own + 1e-7)) as p from lp join ob using (aspect, term) group by 1, 2),
rk as (select *, row_number() over (partition by aspect order by round(p, 12), term) as r, count(*) over (partition by aspect) as m from pv),
bh as (select aspect, term, p, least(1.0, min(p * m / r) over (partition by aspect order by r desc rows between unbounded preceding and current row)) as fdr from rk),
en as (select aspect, term, good, k as count, total, drawn, p, fdr, case when k * total > good * drawn then 'increased' else 'decreased' end as direction from bh join tb using (aspect, term))"""


def enrichment_sql() -> str:
    """Fisher's exact test by sums of hypergeometric terms, and Benjamini-Hochberg's correction."""
    return f"with {_OWNED} select aspect, term, good, count, total, drawn, round(p, 6) as p, round(fdr, 6) as fdr, direction from en"


def term_bubble_sql(n: int = 20) -> str:
    return f"with {_OWNED} select term, count, 0.0 - round(ln(greatest(fdr, 1e-300)), 5) as minus_log_fdr from (select * from en where aspect = 'brand' order by round(fdr, 9), count desc, term limit {n})"


def matched_sql() -> str:
    """The genes that the table of ids knows, by the id that it names."""
    return "select (s_suppkey + 7000)::varchar as gene from supplier where s_suppkey % 3 = 0"
