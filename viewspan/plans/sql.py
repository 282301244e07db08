"""SQL of the derived study and of what hangs on it, as named common table expressions."""

from __future__ import annotations

from ..operators.study import DECK, PLANTED, STATEMENTS, grid_values

_GRID = "[" + ", ".join(str(v) for v, q in zip(grid_values(len(DECK)), DECK, strict=True) for _ in range(q)) + "]"
Z05 = "1.959963984540054"


def corr(x: str, y: str) -> str:
    """Pearson r from sums, null where either side is constant."""
    n, sx, sy = "count(*)::double", f"sum({x})", f"sum({y})"
    vx, vy = f"({n} * sum({x} * {x}) - {sx} * {sx})", f"({n} * sum({y} * {y}) - {sy} * {sy})"
    return f"case when {vx} > 0 and {vy} > 0 then ({n} * sum({x} * {y}) - {sx} * {sy}) / sqrt({vx} * {vy}) end"


def mid(value: str, by: str) -> str:
    return f"(rank() over (partition by {by} order by {value}) + (count(*) over (partition by {by}, {value}) - 1) / 2.0)"


def ties(value: str, by: str) -> str:
    t = f"(count(*) over (partition by {by}, {value}))::double"
    return f"({t} * {t} - 1)"


STUDY = "'supplier_brand'"
#: Each expression may use those before it.
PARTS = {
    "cells": "select l_suppkey as s, p_brand as b, floor(sum(l_quantity)::double * 100 / count(*)) as q from lineitem join part on l_partkey = p_partkey group by 1, 2",
    "numbered": "select s, q, row_number() over (partition by s order by b) as j from cells",
    "scored": f"select s, j, q + {PLANTED} * ((j * (2 * n_regionkey + 3)) % {STATEMENTS}) as score from numbered join supplier on s = s_suppkey join nation on s_nationkey = n_nationkey",
    "sorts": f"select {STUDY} as study_id, s::varchar as participant, s::int as p_idx, j::int as stmt_num, ({_GRID})[row_number() over (partition by s order by score, j)]::double as value from scored",
    "attrs": f"""select {STUDY} as study_id, s_suppkey::varchar as participant, r_name as region, n_regionkey as region_key, s_acctbal::double as acctbal,
        case when s_acctbal < 2000 then '1 low' when s_acctbal < 6000 then '2 middle' else '3 high' end as band, case when n_regionkey <= 1 then 'first' else 'rest' end as pair
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    # priorities
    "groups_all": "select study_id, participant, 'region' as attribute, region as level from attrs union all select study_id, participant, 'band', band from attrs union all select study_id, participant, 'pair', pair from attrs",
    "groups_counted": "select *, count(*) over (partition by attribute, level) as level_n from groups_all",
    "groups_min": "select * from groups_counted where level_n >= 5",
    "groups": "select * from (select *, min(level) over (partition by attribute) as lo, max(level) over (partition by attribute) as hi from groups_min) where lo <> hi",
    "grouped": "select g.attribute, g.level, s.* from sorts s join groups g using (study_id, participant)",
    "granked": f"select *, {mid('value', 'attribute, stmt_num')} as r, {ties('value', 'attribute, stmt_num')} as t from grouped",
    "means": "select study_id, stmt_num, avg(value) as mean, stddev_samp(value) as sd, median(value) as median, count(*) filter (value > 0) as n_above, count(*) filter (value = 0) as n_at, count(*) filter (value < 0) as n_below, count(value) as n from sorts group by all",
    "ranked": "select *, rank() over (order by round(mean, 12) desc) as rank, count(*) over (partition by round(mean, 12)) > 1 as tied from means",
    # correlation
    "pairs": "select a.study_id, a.p_idx as p_i, b.p_idx as p_j, a.stmt_num, a.value as x, b.value as y from sorts a join sorts b on a.stmt_num = b.stmt_num and a.p_idx < b.p_idx",
    "pearson": f"select study_id, p_i, p_j, {corr('x', 'y')} as r, count(*) as n_pair from pairs group by all",
    # viewpoints
    "factors": "select unnest([1, 2, 3]) as factor",
    "prefs": f"select factor, j, (j * (2 * (factor - 1) + 3)) % {STATEMENTS} as pref from factors, (select unnest(range(1, {STATEMENTS + 1})) as j)",
    "loadings": f"select study_id, participant, p_idx, factor, {corr('value', 'pref')} as loading from sorts join prefs on stmt_num = j group by study_id, participant, p_idx, factor",
    "flags": f"select *, abs(loading) > {Z05} / sqrt({STATEMENTS}) and loading * loading > sum(loading * loading) over (partition by participant) - loading * loading as flagged from loadings",
    "weights": "select study_id, participant, factor, a / (1 - a * a) as weight from (select *, sign(loading) * least(0.9999, greatest(0.0001, abs(loading))) as a from flags where flagged)",
    "wsums": "select study_id, factor, stmt_num, sum(value * weight) as wsum from sorts join weights using (study_id, participant) group by all",
    "zs": "select study_id, factor, stmt_num, case when sd > 0 then (wsum - m) / sd else 0.0 end as zscore from (select *, stddev_samp(wsum) over (partition by factor) as sd, avg(wsum) over (partition by factor) as m from wsums)",
    "zmid": f"select *, rank() over (partition by factor order by zscore desc) as rank, {mid('zscore', 'factor')} as mid from zs",
    "scores": f"select study_id, factor, stmt_num, zscore, rank, case when mid = floor(mid) then ({_GRID})[floor(mid)::int] else min(({_GRID})[floor(mid)::int]) over (partition by factor, zscore) end as score from zmid",
    "chars": """select study_id, factor, n_flagged, eigenvalue, 100 * eigenvalue / n as variance_pct, sum(100 * eigenvalue / n) over (order by factor) as cumulative_var_pct, rel as composite_reliability, avg_loading, sqrt(1 - rel) as se_factor
        from (select *, case when n_flagged > 0 then 0.8 * n_flagged / (1 + (n_flagged - 1) * 0.8) end as rel
        from (select study_id, factor, count(*) filter (flagged) as n_flagged, sum(loading * loading) as eigenvalue, count(*) as n, avg(abs(loading)) filter (flagged) as avg_loading from flags group by all))""",
    "sed": "select a.study_id, a.factor as f, b.factor as g, case when a.factor <> b.factor then sqrt(a.se_factor * a.se_factor + b.se_factor * b.se_factor) end as sed from chars a, chars b",
    "fpairs": """select study_id, stmt_num, f, g, diff, sed, case when abs(diff) > sed * 3.29 then 3 when abs(diff) > sed * 2.58 then 2 when abs(diff) > sed * 1.96 then 1 else 0 end as level
        from (select a.study_id, a.stmt_num, a.factor as f, b.factor as g, a.zscore - b.zscore as diff from scores a join scores b on a.stmt_num = b.stmt_num and a.factor < b.factor) join sed using (study_id, f, g)""",
    "twoway": "select study_id, stmt_num, f as factor, g as other, level from fpairs union all select study_id, stmt_num, g, f, level from fpairs",
    "per": "select study_id, stmt_num, factor, min(level) as least, max(level) as most, count(*) as n_other, count(*) filter (level > 0) as n_diff from twoway group by all",
    "totals": "select study_id, stmt_num, count(*) as n_pairs, count(*) filter (level > 0) as sig, max(level) as top from fpairs group by all",
    "alone": "select stmt_num, min(factor) as alone from per join totals using (study_id, stmt_num) where n_diff = n_other and sig = n_diff group by 1",
    "class": """select s.study_id, s.stmt_num, case when n_pairs is null then 'Consensus' when sig = n_pairs then 'Distinguishes all' when alone is not null then 'Distinguishes F' || alone || '*' when sig = 0 then 'Consensus' else '' end as category,
        case when coalesce(top, 0) = 0 then 'strict' when top = 1 then 'broad' else '' end as consensus_level, ranking_variance, z_min, z_max
        from (select study_id, stmt_num, var_samp(zscore) as ranking_variance, min(zscore) as z_min, max(zscore) as z_max from scores group by all) s left join totals using (study_id, stmt_num) left join alone using (stmt_num)""",
}


def with_parts(final: str, *needed: str) -> str:
    """``final`` after the parts it needs, and theirs."""
    import re

    wanted: set[str] = set()

    def add(text: str) -> None:
        for name in PARTS:
            if name not in wanted and re.search(rf"(?<![\w.]){name}(?!\w*\()\b", text):
                wanted.add(name)
                add(PARTS[name])

    add(final)
    for n in needed:
        wanted.add(n)
        add(PARTS[n])
    ctes = [f"{n} as materialized ({t})" for n, t in PARTS.items() if n in wanted]
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + final
