"""All registered queries of the Q-methodology operators, on the study derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import with_bh
from ..operators import attributes as A
from ..operators import correlation as C
from ..operators import factors as V
from ..operators import plotdata as G
from ..operators import priorities as R
from ..operators.study import DECK, STATEMENTS, deck_frame, deck_neutral, default_deck, inferred_deck, long_to_wide, preference, supplier_attributes, supplier_brand_study, wide_to_long
from .registry import Query
from .sql import Z05, corr, mid, ties, with_parts

SORT_COLUMNS = [f"s{k}" for k in range(1, STATEMENTS + 1)]
LOWER, UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- what several queries start from ----------------------------------------------------------------


def sorts(spark: SparkSession, d: str) -> DataFrame:
    return supplier_brand_study(spark, d)


def tied_sorts(spark, d):
    """Values in coarse steps, so that ties are everywhere."""
    return sorts(spark, d).withColumn("value", F.floor(F.col("value") / 2).cast("double"))


def holed_sorts(spark, d):
    """About 2 % of cells missing."""
    return sorts(spark, d).withColumn("value", F.when((F.col("p_idx") * 31 + F.col("stmt_num") * 17) % 50 != 0, F.col("value")))


def doubled_sorts(spark, d):
    """The first participant a second time, under a new id."""
    s = sorts(spark, d)
    return s.union(s.where("p_idx = 1").select("study_id", F.lit("copy").alias("participant"), F.lit(1000000).alias("p_idx"), "stmt_num", "value"))


def groups(spark, d):
    a = supplier_attributes(spark, d)
    return a.unpivot(["study_id", "participant"], ["region", "band", "pair"], "attribute", "level")


def usable(spark, d):
    return R.usable_levels(groups(spark, d))


def only(df, attribute):
    return df.where(F.col("attribute") == attribute)


def numbers(spark, d):
    return supplier_attributes(spark, d).select("study_id", "participant", F.lit("acctbal").alias("attribute"), F.col("acctbal").alias("num"))


def viewpoints(spark, d, k: int = 3):
    """Loadings on the planted viewpoints of the first ``k`` regions: r of a sort with each viewpoint."""
    s = sorts(spark, d).withColumn("factor", F.explode(F.sequence(F.lit(1), F.lit(k))))
    s = s.withColumn("pref", preference(F.col("stmt_num"), F.col("factor") - 1).cast("double"))
    return s.groupBy("study_id", "participant", "p_idx", "factor").agg(R._corr("value", "pref").alias("loading"))


def flags(spark, d):
    return V.flag_auto(viewpoints(spark, d), STATEMENTS)


def scores(spark, d):
    return V.factor_scores(sorts(spark, d), flags(spark, d), DECK)


def sed(spark, d):
    return V.sed_matrix(V.characteristics(flags(spark, d)))


def pairs(spark, d):
    return V.pairwise(scores(spark, d), sed(spark, d))


def region_levels(spark, d):
    return supplier_attributes(spark, d).select("study_id", "participant", F.col("region").alias("level"))


def customer_attributes(spark, d):
    """A made attribute file: keys of customers in two columns and some facts, long."""
    c = spark.read.parquet(f"{d}/supplier.parquet")
    row = F.col("s_suppkey").cast("int")
    cols = {"record": F.concat(F.lit("Q0"), row.cast("string")), "nation": F.col("s_nationkey").cast("string"), "age": F.when(row % 3 == 0, "18-30").when(row % 3 == 1, "31-40").otherwise("71+"), "name": F.col("s_name")}
    wide = c.where(row % 7 != 0).select(F.lit("supplier_brand").alias("study_id"), row.alias("row"), *[v.alias(k) for k, v in cols.items()])
    return wide.unpivot(["study_id", "row"], list(cols), "attribute", "raw")


CUSTOM_ATTRS = """(select 'supplier_brand' as study_id, s_suppkey::int as row, unnest(['record', 'nation', 'age', 'name']) as attribute,
  unnest(['Q0' || s_suppkey, s_nationkey::varchar, case when s_suppkey % 3 = 0 then '18-30' when s_suppkey % 3 = 1 then '31-40' else '71+' end, s_name]) as raw from supplier where s_suppkey % 7 <> 0)"""

QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None, needed: tuple[str, ...] = ()):
    def put(build):
        QUERIES[name] = Query(columns, build, with_parts(sql, *needed) if sql else None)
        return build

    return put


# --- priorities -------------------------------------------------------------------------------------

query("priorities_ranked", "study_id:s stmt_num:i mean:d sd:d median:d n_above:i n_at:i n_below:i n:i rank:i tied:b", "select * from ranked")(lambda s, d: R.ranked_table(sorts(s, d), DECK))

_NEUTRAL = f"""select study_id, stmt_num, count(*) filter (v <> 0) as n_nonzero, sum(case when v > 0 then r else 0.0 end) as t_plus, sum(case when v < 0 then r else 0.0 end) as t_minus, sum(case when v <> 0 then r * r else 0.0 end) as squares
from (select *, {mid("a", "stmt_num")} as r from (select *, value as v, abs(value) as a from sorts)) group by all"""
query("neutral_rank_biserial", "study_id:s stmt_num:i n_nonzero:i t_plus:d t_minus:d z:d rank_biserial:d", f"select *, case when squares > 0 then (t_plus - (t_plus + t_minus) / 2) / sqrt(squares / 4) end as z, case when t_plus + t_minus > 0 then (t_plus - t_minus) / (t_plus + t_minus) end as rank_biserial from ({_NEUTRAL})")(lambda s, d: R.neutral_statistics(sorts(s, d), DECK))


def _w(frame: str, by: str) -> str:
    b = f"{by}, " if by else ""
    person = f"{b}participant"
    return f"""select {b}case when m >= 2 and den > 0 then 12 * s / den end as w, m * (j - 1) * case when m >= 2 and den > 0 then 12 * s / den end as chi2, j - 1 as df, m,
      case when 12 * s / den < 0.1 then 'very weak' when 12 * s / den < 0.3 then 'weak' when 12 * s / den < 0.5 then 'moderate' else 'strong' end as band from
      (select *, m * m * (j * j * j - j) - m * t as den from (select {b}sum(rj * rj) - sum(rj) * sum(rj) / count(*) as s, max(m) as m, count(*)::double as j, sum(t) as t from
      (select {b}stmt_num, sum(r) as rj, count(*)::double as m, sum(t) as t from (select *, {mid("value", person)} as r, {ties("value", person)} as t from {frame}) group by {b}stmt_num) group by {by or "()"}))"""


query("kendall_w", "study_id:s w:d chi2:d df:i m:i band:s", f"select 'supplier_brand' as study_id, * from ({_w('sorts', '')})")(lambda s, d: R.kendall_w(sorts(s, d)))
query("kendall_w_by_level", "attribute:s level:s w:d chi2:d df:i m:i band:s", _w("grouped", "attribute, level"))(lambda s, d: R.kendall_w(sorts(s, d).join(usable(s, d), ["study_id", "participant"]), ["study_id", "attribute", "level"]))
query("permanova_f", "study_id:s attribute:s f:d r2:d n:i levels:i", """select study_id, attribute, ((sst - ssw) / (k - 1)) / (ssw / (n - k)) as f, 1 - ssw / sst as r2, n, k as levels from
  (select study_id, attribute, sum(w) as ssw, sum(t) as sst, max(n) as n, max(k) as k from
  (select study_id, attribute, stmt_num, sum(ss - s * s / n) as w, sum(ss) - sum(s) * sum(s) / sum(n) as t, sum(n) as n, count(*) as k from
  (select study_id, attribute, level, stmt_num, sum(value) as s, sum(value * value) as ss, count(*)::double as n from grouped group by all) group by all) group by all)""")(lambda s, d: R.permanova(sorts(s, d), usable(s, d)))
query("mann_whitney_ps", "attribute:s stmt_num:i level_a:s level_b:s z:d ps:d winner:s", """select *, case when ps > 0.5 then level_a when ps < 0.5 then level_b end as winner from (select *, (w - n1 * (n1 + 1) / 2) / (n1 * n2) as ps, case when v > 1e-12 then (w - n1 * (n + 1) / 2) / sqrt(v) end as z from
  (select *, n1 * n2 / n * (rr - n * (n + 1) / 2 * (n + 1) / 2) / (n - 1) as v from
  (select attribute, stmt_num, min(level) as level_a, max(level) as level_b, (count(*) filter (level = 'first'))::double as n1, (count(*) filter (level = 'rest'))::double as n2, count(*)::double as n, sum(case when level = 'first' then r else 0.0 end) as w, sum(r * r) as rr from granked where attribute = 'pair' group by all)))""")(lambda s, d: R.mann_whitney(sorts(s, d), only(usable(s, d), "pair")))
query("kruskal_wallis_h", "attribute:s stmt_num:i h:d df:i eps2:d", """select *, h / (n - 1) as eps2 from (select *, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)) as h from
  (select attribute, stmt_num, sum(sr * sr / k) as s, sum(k) as n, sum(t) as t, count(*) - 1 as df from (select attribute, stmt_num, level, sum(r) as sr, count(*)::double as k, sum(t) as t from granked where attribute = 'region' group by all) group by all))""")(lambda s, d: R.kruskal_wallis(sorts(s, d), only(usable(s, d), "region")))
_DUNN = """(with g as (select attribute, stmt_num, level, avg(r) as m, count(*)::double as k, sum(t) as t from granked where attribute = 'region' group by all),
  h as (select *, sum(k) over (partition by attribute, stmt_num) as n, sum(t) over (partition by attribute, stmt_num) as tt from g)
  select a.attribute, a.stmt_num, a.level as level_a, b.level as level_b, (a.m - b.m) / sqrt((a.n * (a.n + 1) / 12 - a.tt / (12 * (a.n - 1))) * (1 / a.k + 1 / b.k)) as z from h a join h b on a.stmt_num = b.stmt_num and a.level < b.level)"""
query("dunn_contrasts", "attribute:s stmt_num:i level_a:s level_b:s z:d", f"select * from {_DUNN}", ("granked",))(lambda s, d: R.dunn(sorts(s, d), only(usable(s, d), "region")))
query("linear_by_linear_z", "attribute:s stmt_num:i r:d z:d direction:s", f"select *, r * sqrt(n - 1) as z, case when r > 0 then 'rises' when r < 0 then 'falls' end as direction from (select attribute, stmt_num, {corr('i', 'value')} as r, count(*) as n from (select *, (dense_rank() over (partition by attribute order by level))::double as i from grouped where attribute = 'band') group by all)")(lambda s, d: R.linear_by_linear(sorts(s, d), only(usable(s, d), "band")))
query("spearman_attribute", "attribute:s stmt_num:i rho:d n:i", f"select 'acctbal' as attribute, stmt_num, {corr('rx', 'ry')} as rho, count(*) as n from (select *, {mid('acctbal', 'stmt_num')} as rx, {mid('value', 'stmt_num')} as ry from sorts join attrs using (study_id, participant)) group by stmt_num")(lambda s, d: R.spearman_numeric(sorts(s, d), numbers(s, d)))
_TOP = "(select *, row_number() over (partition by attribute, level order by round(mean, 12) {0}, stmt_num) as place, count(*) over (partition by attribute, level, round(mean, 12)) > 1 as tied from (select g.attribute, g.level, stmt_num, avg(value) as mean from sorts join groups_all g using (study_id, participant) group by all)) where place <= 5"
query("top_n_by_level", "attribute:s level:s place:i stmt_num:i mean:d tied:b", "select * from " + _TOP.format("desc"))(lambda s, d: R.top_n(sorts(s, d), groups(s, d)))
query("bottom_n_by_level", "attribute:s level:s place:i stmt_num:i mean:d tied:b", "select * from " + _TOP.format("asc"))(lambda s, d: R.top_n(sorts(s, d), groups(s, d), bottom=True))
_RANKINGS = "(select attribute, level, stmt_num, rank() over (partition by attribute, level order by round(m, 12) desc) as level_rank from (select attribute, level, stmt_num, avg(value) as m from grouped group by all))"
query("group_vs_overall_rank", "attribute:s level:s stmt_num:i level_rank:i overall_rank:i shift:i", f"select g.*, r.rank as overall_rank, g.level_rank - r.rank as shift from {_RANKINGS} g join ranked r using (stmt_num)")(lambda s, d: R.group_rankings(sorts(s, d), usable(s, d), DECK))
query("rank_flow", "level_key:s level_rank:i stmt_num:i", f"select case when many then attribute || ': ' || level else level end as level_key, level_rank, stmt_num from {_RANKINGS} join (select level, count(distinct attribute) > 1 as many from grouped group by level) using (level)")(lambda s, d: R.rank_flow(R.group_rankings(sorts(s, d), usable(s, d), DECK)))
query("level_notes", "attribute:s level:s n:i note:s", "select attribute, level, count(*) as n, 'level ''' || level || ''' not compared, n = ' || count(*) as note from groups_all group by attribute, level having count(*) < 15")(lambda s, d: R.level_notes(groups(s, d), 15))
query("bh_adjusted", "stmt_num:i p:d p_adj:d", f"""select stmt_num, p, least(1.0, min(p * m / rn) over (order by rn desc rows unbounded preceding)) as p_adj from (select *, count(*) over () as m, row_number() over (order by p, stmt_num) as rn from
  (select stmt_num, (stmt_num * 7 % {STATEMENTS + 1}) / {STATEMENTS + 1}.0 / 4 as p from ranked))""")(lambda s, d: with_bh(R.ranked_table(sorts(s, d), DECK).withColumn("p", (F.col("stmt_num") * 7 % (STATEMENTS + 1)) / F.lit(STATEMENTS + 1) / 4), "p", ["study_id"]))

# --- correlation and quality --------------------------------------------------------------------------

query("corr_pearson", "p_i:i p_j:i r:d n_pair:i", "select * from pearson")(lambda s, d: C.pearson(sorts(s, d)))
_HOLED = "(select * replace (case when (p_idx * 31 + stmt_num * 17) % 50 <> 0 then value end as value) from sorts)"
_HPAIRS = f"(select a.p_idx as p_i, b.p_idx as p_j, a.stmt_num, a.value as x, b.value as y from {_HOLED} a join {_HOLED} b on a.stmt_num = b.stmt_num and a.p_idx < b.p_idx where a.value is not null and b.value is not null)"
query("corr_pearson_missing", "p_i:i p_j:i r:d n_pair:i", f"select p_i, p_j, {corr('x', 'y')} as r, count(*) as n_pair from {_HPAIRS} group by all")(lambda s, d: C.pearson(holed_sorts(s, d)))
query("corr_spearman", "p_i:i p_j:i r:d n_pair:i", f"select p_i, p_j, {corr('rx', 'ry')} as r, count(*) as n_pair from (select *, {mid('x', 'p_i, p_j')} as rx, {mid('y', 'p_i, p_j')} as ry from {_HPAIRS}) group by all")(lambda s, d: C.spearman(holed_sorts(s, d)))
query("corr_kendall", "p_i:i p_j:i r:d n_pair:i", f"""select p_i, p_j, s / sqrt(nx * ny) as r, {STATEMENTS} as n_pair from (select a.p_i, a.p_j, sum(sign(a.x - b.x) * sign(a.y - b.y)) as s, sum(sign(a.x - b.x) * sign(a.x - b.x)) as nx, sum(sign(a.y - b.y) * sign(a.y - b.y)) as ny
  from pairs a join pairs b on a.p_i = b.p_i and a.p_j = b.p_j and a.stmt_num < b.stmt_num group by all)""")(lambda s, d: C.kendall(sorts(s, d)))
query("corr_packed", "p_i:i p_j:i r:d", "select p_i, p_j, r from pearson")(lambda s, d: C.packed_correlation(sorts(s, d), 64))
query("sort_descriptives", "participant:s mean:d sd:d variance:d n:i", "select participant, avg(value) as mean, stddev_samp(value) as sd, var_samp(value) as variance, count(value) as n from sorts group by 1")(lambda s, d: C.sort_descriptives(tied := sorts(s, d)))
query("infer_deck", "grid_value:i quota:i", """select grid_value, quota from (select grid_value, quota, row_number() over (partition by grid_value order by count(*) desc, quota) as rn from
  (select p.participant, g.grid_value, count(s.value) as quota from (select distinct participant from sorts) p, (select unnest(range(-4, 5)) as grid_value) g left join sorts s on s.participant = p.participant and s.value = g.grid_value group by all) group by grid_value, quota) where rn = 1""")(lambda s, d: inferred_deck(sorts(s, d)))
query("check_deck", "participant:s conforms:b n_wrong:i", """select participant, n_wrong = 0 as conforms, n_wrong from (select participant, greatest(sum(greatest(n - q, 0)), sum(greatest(q - n, 0))) as n_wrong from
  (select p.participant, g.v, g.q, count(s.value) as n from (select distinct participant from sorts) p, (select unnest([-4, -3, -2, -1, 0, 1, 2, 3, 4]) as v, unnest([1, 2, 3, 3, 7, 3, 3, 2, 1]) as q) g left join (select participant, floor(value / 2) as value from sorts) s on s.participant = p.participant and s.value = g.v group by all) group by 1)""")(lambda s, d: C.check_distribution(tied_sorts(s, d), DECK))
query("forced_check", "study_id:s shapes:i forced:b", "select 'supplier_brand' as study_id, count(distinct shape) as shapes, count(distinct shape) = 1 as forced from (select participant, string_agg(value::int || ':' || n, ',' order by value) as shape from (select participant, value, count(*) as n from sorts group by all) group by 1)")(lambda s, d: C.forced_check(sorts(s, d)))
_DOUBLED = "(select participant, p_idx, stmt_num, value from sorts union all select 'copy', 1000000, stmt_num, value from sorts where p_idx = 1)"
query("duplicate_sorts", "p_i:i p_j:i r:d identical:b", f"select p_i, p_j, round(r, 4) as r, identical from (select a.p_idx as p_i, b.p_idx as p_j, {corr('a.value', 'b.value')} as r, bool_and(a.value = b.value) as identical from {_DOUBLED} a join {_DOUBLED} b on a.stmt_num = b.stmt_num and a.p_idx < b.p_idx group by all) where r > 0.95")(lambda s, d: C.duplicates(doubled_sorts(s, d)))
query("careless_scores", "participant:s variance:d mean_r:d pattern:d signs:i careless:b", f"""
select participant, variance, mean_r, pattern, signs, signs >= 2 as careless from (select *, (variance < 0.3 * 98 / 24.0)::int + coalesce(mean_r < med - 3 * case when mad > 0 then mad else sd end, false)::int + (pattern < 0.05)::int as signs from
 (select *, median(abs(mean_r - med)) over () * 1.4826 as mad from (select *, median(mean_r) over () as med, stddev_samp(mean_r) over () as sd from
  (select participant, p_idx, (s2 - s1 * s1 / n) / (n - 1) as variance, greatest(0.0, least(1.0, 1 - (0.6 * longest / n + 0.4 * turns / (n - 2)))) as pattern from
   (select participant, p_idx, max(run) as longest, sum(turns) as turns, sum(run)::double as n, sum(s1) as s1, sum(s2) as s2 from
    (select participant, p_idx, island, count(*) as run, sum(turn) as turns, sum(value) as s1, sum(value * value) as s2 from
     (select *, sum(case when d = 0 then 0 else 1 end) over (partition by participant order by stmt_num) as island, coalesce(sign(d) * sign(lag(d) over (partition by participant order by stmt_num)) < 0, false)::int as turn from
      (select *, value - lag(value) over (partition by participant order by stmt_num) as d from sorts)) group by all) group by all))
  join (select p_idx, (1 + sum(r)) / (count(r) + 1) as mean_r from (select p_i as p_idx, r from pearson union all select p_j, r from pearson) group by 1) using (p_idx))))""")(lambda s, d: C.careless(sorts(s, d), C.pearson_sums(sorts(s, d)), DECK))
query("completeness", "study_id:s n_participants:i n_statements:i completeness:d completeness_band:s n_band:s p_band:s", f"""select 'supplier_brand' as study_id, n as n_participants, j as n_statements, f / (n * j) as completeness, case when f = n * j then 'Complete' when f / (n * j) > 0.95 then 'Good' when f / (n * j) > 0.9 then 'Acceptable' else 'High missing' end as completeness_band,
  case when n >= 40 then 'Large' when n >= 20 then 'Adequate' when n >= 10 then 'Small' else 'Very small' end as n_band, case when j >= 60 then 'Large' when j >= 40 then 'Adequate' when j >= 20 then 'Small' else 'Very small' end as p_band
  from (select count(distinct p_idx) as n, count(distinct stmt_num) as j, count(value)::double as f from {_HOLED})""", ("sorts",))(lambda s, d: C.completeness(holed_sorts(s, d)))
query("average_correlation", "study_id:s avg_r:d band:s", "select 'supplier_brand' as study_id, avg(r) as avg_r, case when avg(r) > 0.5 then 'High' when avg(r) > 0.3 then 'Moderate' when avg(r) > 0.1 then 'Low' else 'Very low' end as band from pearson")(lambda s, d: C.average_correlation(C.pearson_sums(sorts(s, d))))

# --- viewpoints -----------------------------------------------------------------------------------------

query("viewpoint_loadings", "participant:s factor:i loading:d", "select participant, factor, loading from loadings")(viewpoints)
query("flags_auto", "participant:s factor:i flagged:b", "select participant, factor, flagged from flags")(flags)
query("flags_auto_nomajority", "participant:s factor:i flagged:b", f"select participant, factor, abs(loading) > {Z05} / sqrt({STATEMENTS}) as flagged from loadings")(lambda s, d: V.flag_auto(viewpoints(s, d), STATEMENTS, majority=False))
query("flags_theoretical", "participant:s factor:i flagged:b", "select participant, factor, abs(loading) > 0.38 and row_number() over (partition by participant order by abs(loading) desc, factor) = 1 as flagged from loadings")(lambda s, d: V.flag_theoretical(viewpoints(s, d), 0.38))
query("flags_manual", "participant:s factor:i flagged:b", "select participant, factor, false as flagged from loadings")(lambda s, d: V.flag_manual(viewpoints(s, d)))
query("communalities", "participant:s h2:d heywood:b", "select participant, sum(loading * loading) as h2, sum(loading * loading) > 1 as heywood from loadings group by 1")(lambda s, d: V.communalities(viewpoints(s, d)))
query("cumulative_communalities", "participant:s factor:i cumulative_h2:d", "select participant, factor, sum(loading * loading) over (partition by participant order by factor) as cumulative_h2 from loadings")(lambda s, d: V.cumulative_communalities(viewpoints(s, d)))
query("factor_weights", "participant:s factor:i weight:d", "select * from weights")(lambda s, d: V.factor_weights(flags(s, d)))
query("factor_zscores", "factor:i stmt_num:i zscore:d rank:i score:i", "select * from scores")(scores)
_TIEZ = "(select study_id, factor, stmt_num, round(zscore, 0) as zscore from zs)"
query("rounded_scores_ties", "factor:i stmt_num:i zscore:d score:i", f"""select factor, stmt_num, zscore, case when mid = floor(mid) then g[floor(mid)::int] else min(g[floor(mid)::int]) over (partition by factor, zscore) end as score
  from (select *, {mid("zscore", "factor")} as mid, [-4, -3, -3, -2, -2, -2, -1, -1, -1, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4] as g from {_TIEZ})""", ("zs",))(lambda s, d: V.with_grid_score(scores(s, d).withColumn("zscore", F.round("zscore", 0)), DECK))
query("factor_array", "factor:i place:i stmt_num:i zscore:d score:i", "select factor, row_number() over (partition by factor order by score desc, zscore desc, stmt_num) as place, stmt_num, round(zscore, 2) as zscore, score from scores")(lambda s, d: V.factor_array(scores(s, d)))
query("factor_characteristics", "factor:i n_flagged:i eigenvalue:d variance_pct:d cumulative_var_pct:d composite_reliability:d avg_loading:d se_factor:d", "select * from chars")(lambda s, d: V.characteristics(flags(s, d)))
query("sed_matrix", "f:i g:i sed:d", "select * from sed")(sed)
query("pairwise_differences", "stmt_num:i f:i g:i diff:d sed:d level:i", "select * from fpairs")(pairs)
query("statement_category", "stmt_num:i category:s consensus_level:s ranking_variance:d z_min:d z_max:d", "select * from class")(lambda s, d: V.statement_class(scores(s, d), pairs(s, d)))
query("distinguishing_all", "factor:i stmt_num:i stars:i", "select factor, stmt_num, least as stars from per where least >= 1")(lambda s, d: V.distinguishing(pairs(s, d)))
query("distinguishing_any", "factor:i stmt_num:i stars:i", "select factor, stmt_num, most as stars from per where most >= 1")(lambda s, d: V.distinguishing(pairs(s, d), "any"))
query("distinguishing_lens", "factor:i stmt_num:i stars:i", "select factor, stmt_num, least as stars from per where least >= 3")(lambda s, d: V.distinguishing(pairs(s, d), lens=3))
_CRIB = """(select *, row_number() over (partition by factor order by zscore desc, stmt_num) as down, row_number() over (partition by factor order by zscore, stmt_num desc) as up,
  (select max(o.score) from scores o where o.stmt_num = s.stmt_num and o.factor <> s.factor) as top, (select min(o.score) from scores o where o.stmt_num = s.stmt_num and o.factor <> s.factor) as bottom from scores s)"""
query("crib_sections", "factor:i section:s stmt_num:i zscore:d score:i", f"select factor, 'most_agree' as section, stmt_num, zscore, score from {_CRIB} where down <= 2 union all select factor, 'higher_than_all', stmt_num, zscore, score from {_CRIB} where score > top union all select factor, 'lower_than_all', stmt_num, zscore, score from {_CRIB} where score < bottom union all select factor, 'most_disagree', stmt_num, zscore, score from {_CRIB} where up <= 2", ("scores",))(lambda s, d: V.crib_sheet(scores(s, d)))
query("bipolar", "factor:i n_positive:i n_negative:i positive:s negative:s is_bipolar:b ratio:d", "select factor, np as n_positive, nn as n_negative, coalesce(p, '') as positive, coalesce(n, '') as negative, nn >= 2 as is_bipolar, case when np > 0 then nn / np::double end as ratio from (select factor, count(*) filter (loading > 0.392) as np, count(*) filter (loading < -0.392) as nn, string_agg(participant, ',' order by participant) filter (loading > 0.392) as p, string_agg(participant, ',' order by participant) filter (loading < -0.392) as n from loadings group by 1)")(lambda s, d: V.bipolar(viewpoints(s, d), 0.392))
query("split_bipolar", "participant:s factor:i loading:d", """select participant, factor, case when factor = 1 and neg and n >= 2 then 0.0 else loading end as loading from (select *, loading < -0.392 as neg, count(*) filter (factor = 1 and loading < -0.392) over () as n from loadings)
  union all select participant, 4, case when loading < -0.392 then -loading else 0.0 end from (select *, count(*) filter (loading < -0.392) over () as n from loadings where factor = 1) where n >= 2""")(lambda s, d: V.split_bipolar(viewpoints(s, d), 1, 0.392))
_ROT = "(select participant, study_id, factor, case factor when 1 then l1 * cos(radians(30)) + l2 * sin(radians(30)) when 2 then l2 * cos(radians(30)) - l1 * sin(radians(30)) else loading end as loading from (select *, max(loading) filter (factor = 1) over (partition by participant) as l1, max(loading) filter (factor = 2) over (partition by participant) as l2 from loadings))"
query("manual_rotation", "participant:s factor:i loading:d", f"select participant, factor, loading from {_ROT}", ("loadings",))(lambda s, d: V.rotate_manual(viewpoints(s, d), 1, 2, 30))
query("tucker", "f:i g:i phi:d", f"select a.factor as f, b.factor as g, sum(a.loading * b.loading) / sqrt(sum(a.loading * a.loading) * sum(b.loading * b.loading)) as phi from loadings a join {_ROT} b using (participant) group by 1, 2")(lambda s, d: V.tucker(viewpoints(s, d), V.rotate_manual(viewpoints(s, d), 1, 2, 30)))
query("defining_correlations", "factor:i n_flagged:i mean_r:d n_pairs:i", "select f.factor, f.n as n_flagged, m.r as mean_r, coalesce(m.k, 0) as n_pairs from (select factor, count(*) as n from flags where flagged group by 1) f left join (select a.factor, avg(r) as r, count(r) as k from pearson p join flags a on a.p_idx = p.p_i and a.flagged join flags b on b.p_idx = p.p_j and b.flagged and a.factor = b.factor group by 1) m using (factor)")(lambda s, d: V.defining_correlations(sorts(s, d), flags(s, d)))
query("score_correlations", "f:i g:i r:d", "select a.factor as f, b.factor as g, corr(a.zscore, b.zscore) as r from scores a join scores b on a.stmt_num = b.stmt_num and a.factor < b.factor group by 1, 2")(lambda s, d: V.score_correlations(scores(s, d)))
_CROSS = """(with m as (select f.participant, case when count(*) filter (flagged) = 0 then 0 when count(*) filter (flagged) > 1 then -1 else max(factor) filter (flagged) end as member from flags f group by 1), c as (select member, region as level, count(*) as n from m join attrs using (participant) group by all)
  select r.member, l.level, coalesce(c.n, 0) as n, r.n * l.n / (select sum(n) from c)::double as expected from (select member, sum(n) as n from c group by 1) r cross join (select level, sum(n) as n from c group by 1) l left join c on c.member = r.member and c.level = l.level)"""
query("membership_crosstab", "member:i level:s n:i expected:d", f"select * from {_CROSS}", ("flags", "attrs"))(lambda s, d: V.membership_crosstab(flags(s, d), region_levels(s, d)))
query("membership_chi2", "chi2:d df:i chi2_applies:b", f"select sum((n - expected) * (n - expected) / expected) as chi2, (count(distinct member) - 1) * (count(distinct level) - 1) as df, min(expected) >= 5 as chi2_applies from {_CROSS}", ("flags", "attrs"))(lambda s, d: V.chi_square(V.membership_crosstab(flags(s, d), region_levels(s, d))))
query("humphrey_two_loadings", "factor:i product:d humphrey:b n_significant:i two_loadings:b", "select factor, a1 * a2 as product, a1 * a2 > 0.4 as humphrey, k as n_significant, k >= 2 as two_loadings from (select factor, max(a) filter (rn = 1) as a1, max(a) filter (rn = 2) as a2, count(*) filter (a > 1.96 / 5) as k from (select factor, abs(loading) as a, row_number() over (partition by factor order by abs(loading) desc, participant) as rn from loadings) group by 1)")(lambda s, d: V.humphrey(viewpoints(s, d), STATEMENTS))
query("score_se", "factor:i n_flagged:i reliability:d se:d", "select factor, n as n_flagged, case when n >= 2 then s / (s + u / n) end as reliability, case when n >= 2 then sqrt(1 - s / (s + u / n)) end as se from (select factor, count(*) as n, sum(loading * loading) as s, sum(1 - loading * loading) as u from flags where flagged group by 1)")(lambda s, d: V.score_se(flags(s, d)))
query("loading_order", "participant:s dominant:i loading:d place:i", "select *, row_number() over (order by dominant, abs(loading) desc, participant) as place from (select participant, factor as dominant, loading from (select *, row_number() over (partition by participant order by abs(loading) desc, factor) as rn from loadings) where rn = 1)")(lambda s, d: V.loading_order(viewpoints(s, d)))
query("solution_summary", "n_participants:i n_flagged:i n_unflagged:i n_confounded:i n_statements:i n_distinguishing:i n_consensus:i", "select * from (select count(*) as n_participants, count(*) filter (k = 1) as n_flagged, count(*) filter (k = 0) as n_unflagged, count(*) filter (k > 1) as n_confounded from (select participant, count(*) filter (flagged) as k from flags group by 1)), (select count(*) as n_statements, count(*) filter (category like 'Dist%') as n_distinguishing, count(*) filter (category = 'Consensus') as n_consensus from class)")(lambda s, d: V.summary(flags(s, d), pairs(s, d), scores(s, d)))

# --- attributes -------------------------------------------------------------------------------------------

_FACTS = f"{CUSTOM_ATTRS} c"
query("attribute_match", "participant:s row:i", f"select participant, c.row from (select distinct participant from sorts) left join (select regexp_replace(lower(raw), '^(qsort|q|p|s)0*', '') as k, min(row) as row from {_FACTS} where attribute = 'record' group by 1) c on c.k = participant")(lambda s, d: A.match(sorts(s, d).select("study_id", "participant").distinct(), only_record(s, d)))
query("attribute_report", "study_id:s id_col:s matched:i unmatched:i unused_rows:i normalized:b", f"select 'supplier_brand' as study_id, 'record' as id_col, count(c.row) as matched, count(*) - count(c.row) as unmatched, (select count(distinct row) from {_FACTS} where attribute = 'record') - count(distinct c.row) as unused_rows, true as normalized from (select distinct participant from sorts) left join (select regexp_replace(lower(raw), '^(qsort|q|p|s)0*', '') as k, min(row) as row from {_FACTS} where attribute = 'record' group by 1) c on c.k = participant")(lambda s, d: A.match_report(sorts(s, d).select("study_id", "participant").distinct(), only_record(s, d)))
query("attribute_types", "attribute:s type:s n_levels:i", f"select attribute, case when bool_and(try_cast(raw as double) is not null) then 'numeric' when bool_and(regexp_matches(raw, '^[0-9]+-[0-9]+$|^[0-9]+[+]$')) then 'ordinal' else 'categorical' end as type, count(distinct raw) as n_levels from {_FACTS} group by 1")(lambda s, d: A.detect_types(customer_attributes(s, d)))
query("attribute_set_aside", "attribute:s set_aside:b", f"select attribute, (bool_or(try_cast(raw as double) is null) and count(*) = count(distinct raw) and count(*) >= 12) as set_aside from {_FACTS} group by 1")(lambda s, d: A.set_aside(customer_attributes(s, d)))
query("bin_numeric", "participant:s bin:s", "select participant, case when acctbal >= -1000 and acctbal <= 0 then 'debt' when acctbal > 0 and acctbal <= 5000 then 'some' when acctbal > 5000 and acctbal <= 9000 then 'much' end as bin from attrs")(lambda s, d: supplier_attributes(s, d).withColumn("bin", A.bin_numeric(F.col("acctbal"), [-1000, 0, 5000, 9000], ["debt", "some", "much"])))
query("bin_map", "participant:s bin:s", "select participant, case region when 'ASIA' then 'east' when 'EUROPE' then 'west' when 'AMERICA' then 'west' end as bin from attrs")(lambda s, d: supplier_attributes(s, d).withColumn("bin", A.bin_map(F.col("region"), {"ASIA": "east", "EUROPE": "west", "AMERICA": "west", "AFRICA": None})))
query("level_min_n", "participant:s attribute:s level:s", "select participant, attribute, case when count(*) over (partition by attribute, level) >= 20 then level end as level from groups_all")(lambda s, d: A.with_min_n(groups(s, d), 20))
query("range_absorption", "raw:s band:s", "select * from (values ('18-24', '18-40'), ('25-34', '18-40'), ('35-40', '18-40'), ('45-50', '41-70'), ('71+', '71+'), ('80-90', '71+'), ('30', '18-40')) v(raw, band)")(lambda s, d: A.absorb_ranges(s.createDataFrame([("18-24",), ("25-34",), ("35-40",), ("38-45",), ("45-50",), ("71+",), ("80-90",), ("30",)], "raw string"), s.createDataFrame([("18-40",), ("41-70",), ("71+",)], "band string")))

# --- shapes, decks, presentation -----------------------------------------------------------------------------

query("long_to_wide", "participant:s " + " ".join(f"{c}:d" for c in SORT_COLUMNS), "select participant, " + ", ".join(f"max(value) filter (stmt_num = {k}) as s{k}" for k in range(1, STATEMENTS + 1)) + " from sorts group by 1")(lambda s, d: long_to_wide(sorts(s, d), STATEMENTS))
query("wide_to_long", "participant:s stmt_num:i value:d", "select participant, stmt_num, value from sorts")(lambda s, d: wide_to_long(long_to_wide(sorts(s, d), STATEMENTS), SORT_COLUMNS))
query("deck_frame", "col_idx:i grid_value:i quota:i first:i last:i", "select * from (values (1, -4, 1, 1, 1), (2, -3, 2, 2, 3), (3, -2, 3, 4, 6), (4, -1, 3, 7, 9), (5, 0, 7, 10, 16), (6, 1, 3, 17, 19), (7, 2, 3, 20, 22), (8, 3, 2, 23, 24), (9, 4, 1, 25, 25)) v(col_idx, grid_value, quota, first, last)")(lambda s, d: deck_frame(s, default_deck(STATEMENTS)))
query("deck_neutral", "deck:s neutral:d", "select * from (values ('1,3,4,3,1', 0.0), ('1,2,2,1', 0.0), ('1,2,4,3,2', 0.25), ('1,2,3,2', 0.375)) v(deck, neutral)")(lambda s, d: s.createDataFrame([(x, deck_neutral([int(v) for v in x.split(",")])) for x in ("1,3,4,3,1", "1,2,2,1", "1,2,4,3,2", "1,2,3,2")], "deck string, neutral double"))
query("contrast_color", "p_brand:s colour:s text:s", """select p_brand, colour, case when 0.299 * ('0x' || substr(colour, 2, 2))::int + 0.587 * ('0x' || substr(colour, 4, 2))::int + 0.114 * ('0x' || substr(colour, 6, 2))::int > 0.6 * 255 then '#000000' else '#ffffff' end as text from (select p_brand, '#' || substr(md5(p_brand), 1, 6) as colour from (select distinct p_brand from part))""")(lambda s, d: G.contrast_color(s.read.parquet(f"{d}/part.parquet").select("p_brand").distinct().withColumn("colour", F.concat(F.lit("#"), F.substring(F.md5(F.col("p_brand").cast("binary")), 1, 6)))))
query("grid_cards", "factor:i stmt_num:i grid_value:i card_row:i", "select *, row_number() over (partition by factor, grid_value order by zscore desc, stmt_num) as card_row from (select factor, stmt_num, zscore, ([-4, -3, -3, -2, -2, -2, -1, -1, -1, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4])[row_number() over (partition by factor order by zscore, stmt_num desc)] as grid_value from scores)")(lambda s, d: V.grid_cards(scores(s, d), DECK))
query("plot_loadings", "participant:s factor:i loading:d flagged:b place:i", "select participant, factor, loading, flagged, row_number() over (partition by factor order by loading desc, participant) as place from flags")(lambda s, d: G.loadings_frame(flags(s, d)))
query("plot_scores", "factor:i stmt_num:i zscore:d pole:s", "select factor, stmt_num, zscore, case when row_number() over (partition by factor order by zscore desc, stmt_num) <= 3 then 'Top' when row_number() over (partition by factor order by zscore, stmt_num desc) <= 3 then 'Bottom' else 'Middle' end as pole from scores")(lambda s, d: G.scores_frame(scores(s, d), 3))
query("plot_factor_comparison", "stmt_num:i factor:i zscore:d variance:d spread:d place:i", "select stmt_num, factor, zscore, variance, spread, dense_rank() over (order by variance desc, stmt_num) as place from (select *, var_samp(zscore) over (partition by stmt_num) as variance, max(zscore) over (partition by stmt_num) - min(zscore) over (partition by stmt_num) as spread from scores)")(lambda s, d: G.comparison_frame(scores(s, d)))
query("plot_crib_panel", "factor:i stmt_num:i side:s", """select factor, stmt_num, side from (select s.factor, s.stmt_num, case when s.zscore > (select max(o.zscore) from scores o where o.stmt_num = s.stmt_num and o.factor <> s.factor) + 0.5 then 'Higher' when s.zscore < (select min(o.zscore) from scores o where o.stmt_num = s.stmt_num and o.factor <> s.factor) - 0.5 then 'Lower' end as side from scores s) where side is not null""")(lambda s, d: G.crib_panel_frame(scores(s, d)))
query("plot_panel_composition", "attribute:s level:s n:i pct:d", "select attribute, level, count(*) as n, 100.0 * count(*) / sum(count(*)) over (partition by attribute) as pct from groups_all group by attribute, level")(lambda s, d: G.composition_frame(groups(s, d)))
query("plot_priorities_ranking", "stmt_num:i mean:d rank:i side:s", "select stmt_num, mean, rank, case when round(mean, 12) >= 0 then 'right' else 'left' end as side from ranked")(lambda s, d: G.priorities_frame(R.ranked_table(sorts(s, d), DECK)))
query("plot_sort_pyramid", "participant:s grid_value:i card_row:i stmt_num:i", "select participant, value as grid_value, row_number() over (partition by participant, value order by stmt_num) as card_row, stmt_num from sorts")(lambda s, d: G.pyramid_frame(sorts(s, d)))


def only_record(spark, d):
    """The attribute file with one column that can match."""
    return customer_attributes(spark, d).where("attribute in ('record', 'age', 'name')")


def kenq_inverted(spark, d):
    from ..sources.kenq import statements_by_value_to_sorts

    s = sorts(spark, d).withColumn("slot", F.row_number().over(_slots()))
    return statements_by_value_to_sorts(s.select("study_id", "participant", "value", F.col("stmt_num").cast("string").alias("card")), STATEMENTS)


def _slots():
    from pyspark.sql import Window

    return Window.partitionBy("participant").orderBy("value", "stmt_num")


query("kenq_type1_invert", "participant:s stmt_num:i value:d", "select participant, stmt_num, value from sorts")(kenq_inverted)


# --- algebra, Monte Carlo and tests with p-values: no SQL, tested in tests/ ------------------------------------

from ..operators import bayes as B  # noqa: E402
from ..operators import extraction as X  # noqa: E402
from ..operators import predictive as P  # noqa: E402
from ..storage import kept  # noqa: E402

_LOAD = "participant:s factor:i loading:d"
query("pca_loadings", _LOAD)(lambda s, d: X.extract(sorts(s, d), 5))
query("centroid_loadings", _LOAD)(lambda s, d: X.extract(sorts(s, d), 3, "centroid"))
query("minres_loadings", _LOAD)(lambda s, d: X.extract(sorts(s, d), 3, "minres"))
for _rotation in ("varimax", "quartimax", "oblimin", "promax"):
    query(f"rotate_{_rotation}", _LOAD)(lambda s, d, r=_rotation: X.extract(sorts(s, d), 5, "pca", r))
query("eigenvalues", "k:i eigenvalue:d variance:d cumulative:d")(lambda s, d: X.eigenvalues(sorts(s, d)))
query("parallel_analysis", "k:i eigenvalue:d threshold:d retain:b")(lambda s, d: X.parallel_analysis(sorts(s, d)))
query("number_of_factors", "study_id:s k:i")(lambda s, d: X.number_of_factors(sorts(s, d)))
query("retention_evidence", "k:i eigenvalue:d variance:d cumulative:d threshold:d parallel:b kaiser:b humphrey:b two_loadings:b")(lambda s, d: X.retention_evidence(sorts(s, d)))
query("quality_metrics", "study_id:s kmo:d bartlett_p:d determinant:d avg_r:d kmo_band:s bartlett_band:s determinant_band:s")(lambda s, d: X.quality_metrics(sorts(s, d)))
query("validate", "study_id:s n_participants:i n_statements:i completeness:d n_nonconforming:i n_duplicates:i n_careless:i n_undefined_r:i valid:b")(lambda s, d: C.validate(sorts(s, d), DECK))
query("permanova_p", "attribute:s f:d r2:d p:d permutations:i passed:b")(lambda s, d: R.permanova_test(sorts(s, d), usable(s, d)))
query("neutral_tests", "stmt_num:i p:d exact:b rank_biserial:d hl:d hl_low:d hl_high:d p_adj:d flagged:b label:s")(lambda s, d: R.neutral_tests(sorts(s, d), DECK))


def gated_tests(s, d):
    return R.group_tests(sorts(s, d), usable(s, d), R.permanova_test(sorts(s, d), usable(s, d)), ["band"])


query("group_tests", "attribute:s stmt_num:i test:s n_levels:i effect:d hl:d p:d p_adj:d flagged:b label:s")(gated_tests)
query("priorities_verdict", "study_id:s n_statements:i n_departures:i n_differences:i n_attributes:i w:d band:s")(lambda s, d: R.verdict(R.neutral_tests(sorts(s, d), DECK), gated_tests(s, d), R.kendall_w(sorts(s, d))))


def replicates(s, d):
    return X.bootstrap(sorts(s, d), 3)


def boot_intervals(s, d):
    own = sorts(s, d).persist()  # read several times
    return X.bootstrap_ci(X.bootstrap(own, 3, level=0.95), X.original_solution(own, 3))


query("bootstrap_ci", "kind:s item:i factor:i boot_mean:d boot_sd:d ci_low:d ci_high:d n:i original:d bias:d bc_estimate:d")(boot_intervals)
query("bootstrap_stability", "kind:s mean:d sd:d min:d max:d replicates:i")(lambda s, d: X.bootstrap_stability(sorts(s, d).persist(), 3))
query("flag_frequency", "p_idx:i factor:i flag_frequency:d flag_frequency_when_sampled:d")(lambda s, d: X.bootstrap_flags(sorts(s, d), 3))
query("bootstrap_rank_range", "factor:i stmt_num:i best_rank:i worst_rank:i")(lambda s, d: X.rank_range(boot_intervals(s, d)))


#: Numbers of factors: those that a search tries by default, and one, for the verdict of a single viewpoint.
BAYES_KS = [1, 2, 3, 4, 5]


def posterior(s, d):
    """The draws as a table, sampled once for all queries of a session."""
    return kept(s, ("draws", d), lambda: B.draws(sorts(s, d), BAYES_KS, packed=True))


def checked(s, d):
    return kept(s, ("checked", d), lambda: P.checked_draws(posterior(s, d), sorts(s, d)))


query("bayes_loadings", "k:i item:i factor:i mean:d sd:d low:d high:d")(lambda s, d: B.summary(posterior(s, d), "loading"))
query("bayes_zscores", "k:i item:i factor:i mean:d sd:d low:d high:d")(lambda s, d: B.summary(posterior(s, d), "zscore"))
query("bayes_claims", "k:i item:i factor:i p:d claimed:b expected_false:d")(lambda s, d: B.flag_claims(posterior(s, d)))
query("bayes_ladder", "k:i supported:i adequate:b n_flags:i n_distinguishing:i")(lambda s, d: B.ladder(posterior(s, d)))
query("bayes_checks", "k:i n_draws:i agreement_p:d percentile:d paired_p:d worst_statement_p:d adequate:b")(lambda s, d: P.checks(checked(s, d)))
query("bayes_statement_checks", "k:i place:i p:d")(lambda s, d: P.statement_checks(checked(s, d)))
query("bayes_rejudged", "q:d verdict:s k_star:i k_fit:i k_support:i k_active:i k_source:s headline:s")(lambda s, d: P.rejudge(posterior(s, d), P.checks(checked(s, d))))
query("bayes_effective_sizes", "k:i kind:s item:i factor:i ess:d")(lambda s, d: B.effective_sizes(posterior(s, d)))
query("bayes_convergence", "k:i kind:s worst_rhat:d mean_rhat:d")(lambda s, d: B.convergence(posterior(s, d)))

from . import analyze as N  # noqa: E402


def analysis(s, d, part, **options):
    return N.analyze(sorts(s, d), DECK, 5, **options)[part]


query("analyze_characteristics", "factor:i n_flagged:i eigenvalue:d variance_pct:d composite_reliability:d se_factor:d")(lambda s, d: analysis(s, d, "characteristics"))
query("analyze_classes", "stmt_num:i category:s consensus_level:s ranking_variance:d")(lambda s, d: analysis(s, d, "statement_class"))
query("analyze_centroid_arrays", "factor:i place:i stmt_num:i zscore:d score:i")(lambda s, d: N.analyze(sorts(s, d), DECK, 3, "centroid", "quartimax")["arrays"])
query("reanalyze_rotated", "factor:i stmt_num:i zscore:d rank:i score:i", """select factor, stmt_num, zscore, rank, case when mid = floor(mid) then g[floor(mid)::int] else min(g[floor(mid)::int]) over (partition by factor, zscore) end as score from
  (select *, [-4, -3, -3, -2, -2, -2, -1, -1, -1, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4] as g, rank() over (partition by factor order by zscore desc) as rank, """ + mid("zscore", "factor") + """ as mid from
  (select factor, stmt_num, (w - avg(w) over (partition by factor)) / stddev_samp(w) over (partition by factor) as zscore from
  (select factor, stmt_num, sum(value * a / (1 - a * a)) as w from sorts join (select participant, factor, sign(loading) * least(0.9999, greatest(0.0001, abs(loading))) as a from
  (select *, abs(loading) > """ + Z05 + f""" / sqrt({STATEMENTS}) and loading * loading > sum(loading * loading) over (partition by participant) - loading * loading as flagged from {_ROT}) where flagged) using (participant) group by 1, 2)))""", ("loadings",))(lambda s, d: N.reanalyze_rotated(sorts(s, d), viewpoints(s, d).select("study_id", "participant", "factor", "loading"), DECK, 1, 2, 30)["scores"])
query("split_and_recalculate", "factor:i n_flagged:i composite_reliability:d se_factor:d")(lambda s, d: N.split_and_recalculate(sorts(s, d), viewpoints(s, d).select("study_id", "participant", "factor", "loading"), DECK, 1)["characteristics"])
query("priorities_numeric_gate", "attribute:s f:d r2:d p:d passed:b")(lambda s, d: N.priorities(sorts(s, d), DECK, None, numbers(s, d))["gates"])

from . import more  # noqa: E402, F401
