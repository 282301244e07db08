"""Queries of comparisons in full, attribute tables, figures and ladders, with their SQL; tails are computed there by another series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as L
from ..operators import attributes as A
from ..operators import bayes as B
from ..operators import comparisons as M
from ..operators import correlation as C
from ..operators import extraction as X
from ..operators import factors as V
from ..operators import plotdata as G
from ..operators import priorities as R
from ..sources import sinks as K
from ..operators.study import DECK, STATEMENTS, modal_deck, preference, preview, supplier_attributes
from . import analyze as N
from . import queries as Q
from .queries import flags, groups, numbers, only, pairs, query, scores, sed, sorts, viewpoints
from .sql import corr, mid

# --- tails in SQL, from log gamma --------------------------------------------------------------------


def p2(z: str) -> str:
    """Two-sided normal p."""
    terms = f"list_sum(list_transform(range(0, 240), lambda k: exp((2 * k + 1) * ln(abs({z})) - lgamma((2 * k + 2)::double) + k * ln(2.0) + lgamma((k + 1)::double) - {z} * {z} / 2)))"
    return f"case when {z} is null then null when {z} = 0 then 1.0 when abs({z}) > 9 then 0.0 else greatest(0.0, 1 - 2 * {terms} / sqrt(2 * pi())) end"


def chi2(x: str, df: str) -> str:
    terms = f"list_sum(list_transform(range(0, 400), lambda k: exp(({df} / 2.0 + k) * ln({x} / 2) - {x} / 2 - lgamma({df} / 2.0 + k + 1))))"
    return f"case when {x} <= 0 then 1.0 else greatest(0.0, 1 - {terms}) end"


def t2(t: str, df: str) -> str:
    """Two-sided p of Student's t by the incomplete beta series at t² / (df + t²)."""
    y = f"({t} * {t} / ({df} + {t} * {t}))"
    b = f"({df} / 2.0)"
    terms = f"list_sum(list_transform(range(0, 600), lambda k: exp(lgamma(0.5 + {b} + k) - lgamma(1.5 + k) - lgamma({b}) + k * ln({y}))))"
    return f"case when {t} is null then null when {t} = 0 then 1.0 else greatest(0.0, 1 - sqrt({y}) * pow(1 - {y}, {b}) * {terms}) end"


def bh(p: str, frame: str, by: str = "", tie: str = "") -> str:
    """``frame`` with ``p_adj``."""
    part = f"partition by {by} " if by else ""
    known = f"partition by {by + ', ' if by else ''}{p} is null "
    rn = f"row_number() over ({known}order by {p}{', ' + tie if tie else ''})"
    return f"(select * exclude (bh_m, bh_r), case when {p} is not null then least(1.0, min({p} * bh_m / bh_r) over ({known}order by bh_r desc rows unbounded preceding)) end as p_adj from (select *, count({p}) over ({part}) as bh_m, {rn} as bh_r from {frame}))"


# --- distinguishing statements in full ------------------------------------------------------------------

_PTESTS = f"(select *, {p2('d')} as p from (select *, diff / sed as d, round(diff, 3) as diff_3, repeat('*', level) as marks from fpairs))"
query("distinguish_pairs", "study_id:s stmt_num:i f:i g:i diff_3:d marks:s p:d p_adj:d", f"select * from {bh('p', _PTESTS, tie='stmt_num, f, g')}")(lambda s, d: M.distinguish(scores(s, d), sed(s, d))["pairs"])
_ASSUMED = "(select stmt_num, f, g, diff, case when abs(diff) > w * 3.29 then 3 when abs(diff) > w * 2.58 then 2 when abs(diff) > w * 1.96 then 1 else 0 end as level from (select *, sqrt(2) * 0.25 as w from fpairs))"
query("distinguish_assumed_sed", "stmt_num:i f:i g:i diff:d level:i", f"select * from {_ASSUMED}")(lambda s, d: M.distinguish(scores(s, d))["pairs"])
query("distinguish_marks", "factor:i stmt_num:i marks:s", "select factor, stmt_num, repeat('*', least) as marks from per where least >= 1")(lambda s, d: M.distinguish(scores(s, d), sed(s, d))["distinguishing"])
query("distinguish_one_factor", "stmt_num:i category:s consensus_level:s", "select distinct stmt_num, 'Consensus' as category, 'strict' as consensus_level from scores")(lambda s, d: M.distinguish(scores(s, d).where("factor = 1"))["classes"])
_SECTIONS = Q._CRIB
query("crib_details", "factor:i section:s stmt_num:i marker:s nearest:i gap:d other_scores:s sentence:s", f"""select * from (with crib as (select factor, 'most_agree' as section, stmt_num, zscore from {_SECTIONS} where down <= 2 union all select factor, 'higher_than_all', stmt_num, zscore from {_SECTIONS} where score > top union all select factor, 'lower_than_all', stmt_num, zscore from {_SECTIONS} where score < bottom union all select factor, 'most_disagree', stmt_num, zscore from {_SECTIONS} where up <= 2)
  select c.factor, section, c.stmt_num, case when p.least >= 1 then 'D' when k.category = 'Consensus' then 'C' else '' end as marker,
  (select o.factor from scores o where o.stmt_num = c.stmt_num and o.factor <> c.factor order by abs(c.zscore - o.zscore), o.factor limit 1) as nearest,
  (select c.zscore - o.zscore from scores o where o.stmt_num = c.stmt_num and o.factor <> c.factor order by abs(c.zscore - o.zscore), o.factor limit 1) as gap,
  (select string_agg('F' || o.factor || ': ' || o.score, ', ' order by o.factor) from scores o where o.stmt_num = c.stmt_num and o.factor <> c.factor) as other_scores,
  'Factor ' || c.factor || case section when 'most_agree' then ' agrees most with' when 'most_disagree' then ' disagrees most with' when 'higher_than_all' then ' ranks higher than any other' else ' ranks lower than any other' end || ': Statement ' || c.stmt_num as sentence
  from crib c join per p on p.stmt_num = c.stmt_num and p.factor = c.factor join class k on k.stmt_num = c.stmt_num)""", ("scores", "per", "class"))(lambda s, d: M.crib_details(scores(s, d), pairs(s, d)))
query("bipolar_advice", "factor:i is_bipolar:b recommendation:s", """select factor, nn >= 2 as is_bipolar, case when nn < 2 then 'Unipolar factor' when np = 0 or nn / np::double > 0.5 then 'Consider splitting into two factors' else 'Minor bipolar tendency - review negative loaders' end as recommendation
  from (select factor, count(*) filter (loading > 0.392) as np, count(*) filter (loading < -0.392) as nn from loadings group by 1)""")(lambda s, d: M.bipolar_advice(V.bipolar(viewpoints(s, d), 0.392)))
query("score_correlation_gate", "f:i g:i max_r:d gate:s", "select f, g, r as max_r, case when abs(r) > 0.6 then 'factors share much of their view' else 'factors are distinct' end as gate from (select a.factor as f, b.factor as g, corr(a.zscore, b.zscore) as r from scores a join scores b on a.stmt_num = b.stmt_num and a.factor < b.factor group by 1, 2) order by abs(r) desc, f, g limit 1")(lambda s, d: M.score_correlation_gate(V.score_correlations(scores(s, d))))


def band_levels(s, d):
    return supplier_attributes(s, d).select("study_id", "participant", F.when(F.col("participant").cast("int") % 7 < 3, "low").otherwise("high").alias("level"))


query("membership_test_p", "study_id:s test:s p:d")(lambda s, d: M.membership_test(V.membership_crosstab(flags(s, d), Q.region_levels(s, d))))
_EVEN = """(with m as (select f.participant, case when count(*) filter (flagged) = 0 then 0 when count(*) filter (flagged) > 1 then -1 else max(factor) filter (flagged) end > 0 as member from flags f group by 1), c as (select member::int as member, participant::int % 7 < 3 as level, count(*)::double as n from m group by all),
  x as (select r.member, l.level, coalesce(c.n, 0) as n, r.n * l.n / (select sum(n) from c) as e from (select member, sum(n) as n from c group by 1) r cross join (select level, sum(n) as n from c group by 1) l left join c on c.member = r.member and c.level = l.level)
  select sum((n - e) * (n - e) / e) as chi2, (count(distinct member) - 1) * (count(distinct level) - 1) as df, min(e) >= 5 as ok from x)"""


def any_member(s, d):
    """Whether a sort defines one factor, by participants of low and high remainders."""
    cells = V.membership_crosstab(flags(s, d), band_levels(s, d)).select("study_id", (F.col("member") > 0).cast("int").alias("member"), "level", "n")
    cells = cells.groupBy("study_id", "member", "level").agg(F.sum("n").alias("n"))
    rows, cols = cells.groupBy("study_id", "member").agg(F.sum("n").alias("r")), cells.groupBy("study_id", "level").agg(F.sum("n").alias("c"))
    total = cells.groupBy("study_id").agg(F.sum("n").alias("t"))
    return cells.join(rows, ["study_id", "member"]).join(cols, ["study_id", "level"]).join(total, "study_id").select("study_id", "member", "level", "n", (F.col("r") * F.col("c") / F.col("t")).alias("expected"))


query("membership_chi2_p", "chi2:d df:i p:d", f"select chi2, df, {chi2('chi2', 'df')} as p from {_EVEN} where ok", ("flags",))(lambda s, d: M.membership_test(any_member(s, d), draws=10).where("chi2_applies"))

# --- group comparisons in full ---------------------------------------------------------------------------


def tens(s, d):
    """Levels of ten participants or more: above that no distribution is drawn or counted."""
    return R.usable_levels(groups(s, d), 10)


def no_gates(s, d):
    return tens(s, d).select("study_id", "attribute").distinct().withColumn("passed", F.lit(True))


_T = """(select g.attribute, g.level, s.* from sorts s join (select * from (select *, min(level) over (partition by attribute) as lo, max(level) over (partition by attribute) as hi from groups_counted where level_n >= 10) where lo <> hi) g using (study_id, participant))"""
_TR = f"(select *, {mid('value', 'attribute, stmt_num')} as r, t * t - 1 as t3 from (select *, (count(*) over (partition by attribute, stmt_num, value))::double as t from {_T}))"
_MW = f"""(select attribute, stmt_num, level_a, level_b, n1 + n2 as n, z, {p2('z')} as p, ps from (select *, (w - n1 * (n1 + 1) / 2) / (n1 * n2) as ps, case when v > 1e-12 then (w - n1 * (n1 + n2 + 1) / 2) / sqrt(v) end as z from
  (select *, n1 * n2 / (n1 + n2) * (rr - (n1 + n2) * (n1 + n2 + 1) / 2 * (n1 + n2 + 1) / 2) / (n1 + n2 - 1) as v from
  (select attribute, stmt_num, min(level) as level_a, max(level) as level_b, (count(*) filter (level = 'first'))::double as n1, (count(*) filter (level = 'rest'))::double as n2, sum(case when level = 'first' then r else 0.0 end) as w, sum(r * r) as rr from {_TR} where attribute = 'pair' group by all))))"""
_KW = f"""(select attribute, stmt_num, n, df, h, h / (n - 1) as eps2, {chi2('h', 'df')} as p from (select *, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)) as h from
  (select attribute, stmt_num, sum(sr * sr / k) as s, sum(k) as n, sum(t) as t, count(*) - 1 as df from (select attribute, stmt_num, level, sum(r) as sr, count(*)::double as k, sum(t3) as t from {_TR} where attribute = 'region' group by all) group by all)))"""
_LBL = f"""(select attribute, stmt_num, n, z, {p2('z')} as p from (select *, r * sqrt(n - 1) as z from (select attribute, stmt_num, {corr('i', 'value')} as r, count(*)::double as n from (select *, (dense_rank() over (partition by attribute order by level))::double as i from {_T} where attribute = 'band') group by all)))"""
_DUNN0 = f"""(with g as (select attribute, stmt_num, level, avg(r) as m, count(*)::double as k, sum(t3) as t from {_TR} where attribute = 'region' group by all),
  h as (select *, sum(k) over (partition by attribute, stmt_num) as n, sum(t) over (partition by attribute, stmt_num) as tt from g)
  select a.attribute, a.stmt_num, a.level as level_a, b.level as level_b, (a.m - b.m) / sqrt((a.n * (a.n + 1) / 12 - a.tt / (12 * (a.n - 1))) * (1 / a.k + 1 / b.k)) as z from h a join h b on a.stmt_num = b.stmt_num and a.level < b.level)"""
_DUNN = bh("p", f"(select *, {p2('z')} as p, case when z > 0 then level_a else level_b end as winner from {_DUNN0})", "attribute, stmt_num", "level_a, level_b")
_NEED = ("sorts", "groups_counted")
query("mann_whitney_p", "attribute:s stmt_num:i z:d ps:d p:d", f"select * from {_MW}", _NEED)(lambda s, d: M.mann_whitney_p(sorts(s, d), only(tens(s, d), "pair")))
query("kruskal_p", "attribute:s stmt_num:i h:d df:i eps2:d p:d", f"select * from {_KW}", _NEED)(lambda s, d: M.kruskal_p(sorts(s, d), only(tens(s, d), "region")))
query("linear_p", "attribute:s stmt_num:i z:d p:d", f"select * from {_LBL}", _NEED)(lambda s, d: M.linear_p(sorts(s, d), only(tens(s, d), "band")))
query("dunn_p", "attribute:s stmt_num:i level_a:s level_b:s z:d p:d p_adj:d winner:s", f"select * from {_DUNN}", _NEED)(lambda s, d: M.dunn_p(sorts(s, d), only(tens(s, d), "region")))
_RHO = f"(select *, rho * sqrt((n - 2) / (1 - rho * rho)) as t from (select 'acctbal' as attribute, stmt_num, {corr('rx', 'ry')} as rho, count(*)::double as n from (select *, {mid('acctbal', 'stmt_num')} as rx, {mid('value', 'stmt_num')} as ry from sorts join attrs using (study_id, participant)) group by stmt_num))"
_SPEAR = f"(select attribute, stmt_num, rho, (n * n * n - n) * (1 - rho) / 6 as s, n, {t2('t', '(n - 2)')} as p from {_RHO})"
query("spearman_p", "attribute:s stmt_num:i rho:d s:d p:d n:i", f"select * from {_SPEAR}")(lambda s, d: M.spearman_p(sorts(s, d), numbers(s, d)))
_WIN = f"(select attribute, stmt_num, min_by(winner, struct_pack(p_adj := p_adj, a := level_a, b := level_b)) as winner from {_DUNN} where p_adj <= 0.05 group by all)"
_ALL = f"""(select attribute, stmt_num, 'mann_whitney' as test, z as statistic, p, ps as effect, case when ps > 0.5 then level_a when ps < 0.5 then level_b end as winner, n from {_MW} union all
  select k.attribute, k.stmt_num, 'kruskal_wallis', h, p, eps2, winner, n from {_KW} k left join {_WIN} w on w.stmt_num = k.stmt_num union all select attribute, stmt_num, 'linear_by_linear', z, p, z, null, n from {_LBL})"""
_Q = "case when p_adj < 0.001 then 'q < 0.001' when p_adj < 0.01 then printf('q = %.3f', p_adj) else printf('q = %.2f', p_adj) end"
query("compare_groups", "attribute:s stmt_num:i test:s statistic:d p:d p_adj:d flagged:b effect:d n_used:i label:s", f"""select *, n as n_used, p_adj <= 0.05 as flagged, case when p_adj > 0.05 then 'No evidence of a difference' when test = 'mann_whitney' then winner || ' higher (P = ' || printf('%.2f', greatest(effect, 1 - effect)) || ', ' || {_Q} || ')'
  when test = 'kruskal_wallis' then coalesce(winner || ' highest', 'Groups differ') || ' (' || {_Q} || ')' else case when effect < 0 then 'Falls' else 'Rises' end || ' with ' || attribute || ' (' || {_Q} || ')' end as label from {bh('p', _ALL, 'attribute', 'stmt_num')}""", _NEED)(lambda s, d: M.compare_groups(sorts(s, d), tens(s, d), no_gates(s, d), ["band"]))
query("compare_groups_gated", "attribute:s stmt_num:i flagged:b direction:s label:s", f"select attribute, stmt_num, false as flagged, case when test = 'mann_whitney' then winner || ' higher' when test = 'linear_by_linear' then case when effect > 0 then 'rises' when effect < 0 then 'falls' end || ' with ' || attribute end as direction, 'No overall group difference' as label from {_ALL}", _NEED)(lambda s, d: M.compare_groups(sorts(s, d), tens(s, d), no_gates(s, d).withColumn("passed", F.lit(False)), ["band"]))
query("compare_numbers", "attribute:s stmt_num:i test:s statistic:d p:d p_adj:d flagged:b effect:d label:s", f"select *, 'spearman' as test, s as statistic, rho as effect, p_adj <= 0.05 as flagged, case when p_adj > 0.05 then 'No evidence of a difference' else case when rho < 0 then 'Falls' else 'Rises' end || ' with acctbal (' || {_Q} || ')' end as label from {bh('p', _SPEAR, 'attribute', 'stmt_num')}")(lambda s, d: M.compare_numbers(sorts(s, d), numbers(s, d), s.createDataFrame([("supplier_brand", "acctbal", True)], "study_id string, attribute string, passed boolean")))
query("compare_small_groups", "attribute:s stmt_num:i test:s p:d p_adj:d flagged:b label:s")(lambda s, d: M.compare_groups(sorts(s, d), Q.usable(s, d), no_gates(s, d), ["band"]))

# --- studies, attributes ------------------------------------------------------------------------------------

query("preview", "stmt_num:i statement:s v1:d v2:d v3:d", "select stmt_num, 'Statement ' || stmt_num as statement, max(value) filter (participant = '1') as v1, max(value) filter (participant = '2') as v2, max(value) filter (participant = '3') as v3 from sorts group by 1")(lambda s, d: preview(sorts(s, d), ["1", "2", "3"]))
query("modal_deck", "shape:s votes:i", "select shape, count(*) as votes from (select participant, string_agg(v || ':' || n, ',' order by v) as shape from (select participant, value::int as v, count(*) as n from (select participant, floor(value / 2) as value from sorts) group by all) group by 1) group by 1 order by votes desc, shape limit 1")(lambda s, d: modal_deck(Q.tied_sorts(s, d)))
query("statement_names", "stmt_num:i text:s", "select distinct stmt_num, case when stmt_num % 3 = 0 then 'text ' || stmt_num else 'Statement ' || stmt_num end as text from sorts")(lambda s, d: M.statement_names(sorts(s, d).select("study_id", "stmt_num").distinct(), sorts(s, d).where("stmt_num % 3 = 0").select("study_id", "stmt_num", F.concat(F.lit("text "), F.col("stmt_num").cast("string")).alias("text"))))


def own_rows(s, d):
    """Attribute rows under the participants' own names: some twice, some missing, some of nobody."""
    a = Q.customer_attributes(s, d).where("attribute in ('age', 'nation')").withColumn("participant", F.col("row").cast("string"))
    again = a.where("row % 5 = 0").withColumn("row", F.col("row") + 1000000).withColumn("raw", F.lit("later"))
    return a.unionByName(again).unionByName(a.where("row = 1").withColumn("participant", F.lit("nobody")))


_ROWS = f"(select participant, attribute, raw, row from (select row::varchar as participant, * from {Q.CUSTOM_ATTRS} where attribute in ('age', 'nation')) union all select row::varchar, attribute, 'later', row + 1000000 from {Q.CUSTOM_ATTRS} where attribute in ('age', 'nation') and row % 5 = 0 union all select 'nobody', attribute, raw, row from {Q.CUSTOM_ATTRS} where attribute in ('age', 'nation') and row = 1)"
people = lambda s, d: sorts(s, d).select("study_id", "participant").distinct()
query("attributes_realigned", "participant:s attribute:s raw:s", f"select p.participant, a.attribute, r.raw from (select distinct participant from sorts) p cross join (select unnest(['age', 'nation']) as attribute) a left join (select participant, attribute, min_by(raw, row) as raw from {_ROWS} group by 1, 2) r on r.participant = p.participant and r.attribute = a.attribute")(lambda s, d: A.participant_attributes(people(s, d), own_rows(s, d)))
query("attributes_present", "study_id:s has_attributes:b", "select 'supplier_brand' as study_id, true as has_attributes")(lambda s, d: A.has_attributes(people(s, d), own_rows(s, d)))
query("attribute_alignment", "participant:s error:s", f"select coalesce(p.participant, r.participant) as participant, case when p.participant is null then 'not a participant' when r.n is null then 'no attribute row' else 'several attribute rows' end as error from (select distinct participant from sorts) p full join (select participant, count(distinct row) as n from {_ROWS} group by 1) r on r.participant = p.participant where p.participant is null or r.n is null or r.n > 1")(lambda s, d: A.alignment_errors(people(s, d), own_rows(s, d)))
query("attribute_spec", "attribute:s type:s levels:s", f"""select attribute, case attribute when 'nation' then 'categorical' when 'age' then 'ordinal' when 'record' then 'categorical' else 'categorical' end as type, case attribute when 'age' then '71+,31-40,18-30' else l end as levels from (select attribute, string_agg(distinct raw, ',' order by raw) as l from {Q.CUSTOM_ATTRS} where attribute in ('age', 'nation') group by 1)""")(
    lambda s, d: A.merged_spec(A.detect_types(Q.customer_attributes(s, d).where("attribute in ('age', 'nation')")).withColumn("levels", F.coalesce("levels", F.lit(None).cast("array<string>"))), s.createDataFrame([("supplier_brand", "nation", "categorical", None)], "study_id string, attribute string, type string, levels array<string>"), _age_spec(s, d)).withColumn("levels", F.array_join("levels", ",")))


def _age_spec(s, d):
    """What a study had before: age in falling order, and the nation's levels, which no number has."""
    nations = Q.customer_attributes(s, d).where("attribute = 'nation'").groupBy("study_id", "attribute").agg(F.lit("numeric").alias("type"), F.array_sort(F.collect_set("raw")).alias("levels"))
    return s.createDataFrame([("supplier_brand", "age", "ordinal", ["71+", "31-40", "18-30"])], "study_id string, attribute string, type string, levels array<string>").unionByName(nations)


query("attribute_report_full", "study_id:s id_col:s matched:i unmatched:i duplicates:i set_aside:s aligned:b", f"select 'supplier_brand' as study_id, 'record' as id_col, (select count(distinct row) from {Q.CUSTOM_ATTRS}) as matched, (select count(distinct participant) from sorts) - (select count(distinct row) from {Q.CUSTOM_ATTRS}) as unmatched, 0 as duplicates, (select string_agg(attribute, ',' order by attribute) from (select attribute from {Q.CUSTOM_ATTRS} group by 1 having count(*) = count(distinct raw) and count(*) >= 12 and bool_or(try_cast(raw as double) is null))) as set_aside, false as aligned", ("sorts",))(lambda s, d: A.full_report(people(s, d), Q.only_record(s, d)))
query("attributes_binned", "participant:s attribute:s level:s", "select participant, attribute, case attribute when 'region' then case level when 'ASIA' then 'east' when 'EUROPE' then 'west' when 'AMERICA' then 'west' end else level end as level from groups_all")(
    lambda s, d: A.binned(groups(s, d).withColumnRenamed("level", "raw"), {"region": A.checked_binning("categorical", mapping=A.renamed({"ASIA": "asia", "EUROPE": "west", "AMERICA": "west", "AFRICA": None, "MIDDLE EAST": None}, {"asia": "east"}), order=["east", "west"])}))
query("attribute_median_split", "participant:s level:s", "select participant, case when acctbal <= median(acctbal) over () then 'low' else 'high' end as level from attrs")(lambda s, d: A.median_bins(supplier_attributes(s, d).select("study_id", "participant", F.lit("acctbal").alias("attribute"), F.col("acctbal").cast("string").alias("raw"))))
query("validation_messages", "study_id:s kind:s message:s")(lambda s, d: C.validation_messages(C.validate(Q.holed_sorts(s, d), DECK), Q.holed_sorts(s, d), DECK))

# --- figures ------------------------------------------------------------------------------------------------

query("plot_distinguishing", "stmt_num:i factor:i zscore:d spread:d place:i", "select stmt_num, factor, zscore, spread, dense_rank() over (order by spread desc, stmt_num) as place from (select *, max(zscore) over (partition by stmt_num) - min(zscore) over (partition by stmt_num) as spread from scores where stmt_num in (select stmt_num from per where least >= 1))", ("per",))(lambda s, d: G.frame("distinguishing", {"scores": scores(s, d), "distinguishing": V.distinguishing(pairs(s, d))}))
query("plot_consensus", "stmt_num:i factor:i zscore:d spread:d place:i", "select stmt_num, factor, zscore, spread, dense_rank() over (order by spread desc, stmt_num) as place from (select *, max(zscore) over (partition by stmt_num) - min(zscore) over (partition by stmt_num) as spread from scores where stmt_num in (select stmt_num from class where category not like 'Dist%'))", ("class",))(lambda s, d: G.listed_scores(scores(s, d), V.statement_class(scores(s, d), pairs(s, d)).where("category not like 'Dist%'")))
query("plot_disagreement", "stmt_num:i spread:d highest:i lowest:i place:i", "select *, row_number() over (order by spread desc, stmt_num) as place from (select stmt_num, max(zscore) - min(zscore) as spread, arg_max(factor, zscore) as highest, arg_min(factor, zscore) as lowest from scores group by 1)")(lambda s, d: G.disagreement_frame(scores(s, d)))
query("plot_loadings_ci", "participant:s factor:i loading:d place:i low:d high:d", "select participant, factor, loading, row_number() over (partition by factor order by loading desc, participant) as place, loading - 0.1 as low, loading + 0.1 as high from loadings")(lambda s, d: G.frame("loadings", {"flags": flags(s, d), "loading_ci": viewpoints(s, d).select("study_id", "p_idx", "factor", (F.col("loading") - 0.1).alias("low"), (F.col("loading") + 0.1).alias("high"))}))
query("plot_correlation", "p_i:i p_j:i r:d row:i column:i")(lambda s, d: G.frame("correlation", {"correlation": C.pearson(sorts(s, d))}))

# --- extraction: identities that any correct solution has ---------------------------------------------------------

query("eigen_trace", "study_id:s total:d", "select 'supplier_brand' as study_id, count(distinct p_idx)::double as total from sorts")(lambda s, d: eigen_trace(s, d))


def eigen_trace(s, d):
    """What shares of variance are shares of: the sum of all eigenvalues, one for each participant."""
    return X.eigenvalues(sorts(s, d)).where("k = 1").groupBy("study_id").agg(F.max(F.col("eigenvalue") / F.col("variance")).alias("total"))


def eigen_gaps(s, d, k: int = 3):
    """Largest entry of R v - λ v for the loadings of each component, from correlations computed apart."""
    load = X.extract(sorts(s, d), k)
    rows = load.groupBy("study_id", "p_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("factor", "loading"))), lambda x: x["loading"]).alias("l"))
    sums = C.pearson_sums(sorts(s, d).join(rows, ["study_id", "p_idx"]), F.col("l"))
    product = sums.select("study_id", "p_idx", (F.col("at") + 1).alias("factor"), F.col("r_sum").alias("rv"))
    value = load.groupBy("study_id", "factor").agg(F.sum(F.col("loading") * F.col("loading")).alias("value"))
    gap = F.abs(F.col("rv") + F.col("loading") - F.col("value") * F.col("loading"))
    return load.join(product, ["study_id", "p_idx", "factor"]).join(value, ["study_id", "factor"]).groupBy("factor").agg(F.max(gap).alias("gap"))


query("eigen_gaps", "factor:i gap:d", "select unnest([1, 2, 3]) as factor, 0.0 as gap")(eigen_gaps)
query("suggested_k", "study_id:s k_parallel:i k_kaiser:i k_two:i")(lambda s, d: X.suggested_k(X.retention_evidence(sorts(s, d))))


# --- oblique solutions and what a bootstrap says ------------------------------------------------------------------


def oblique_gaps(s, d, rotation: str, k: int = 3):
    """How far pattern times structure is from each sort's communality before rotation, from factor correlations and loadings computed apart."""
    both = X.structure(X.extract(sorts(s, d), k, "pca", rotation), X.factor_correlations(sorts(s, d), k, rotation))
    plain = X.extract(sorts(s, d), k).groupBy("study_id", "p_idx").agg(F.sum(F.col("loading") * F.col("loading")).alias("h2"))
    return both.groupBy("study_id", "p_idx").agg(F.sum(F.col("loading") * F.col("structure")).alias("again")).join(plain, ["study_id", "p_idx"]).select("p_idx", F.abs(F.col("again") - F.col("h2")).alias("gap"))


for _rotation in ("oblimin", "promax"):
    query(f"factor_correlations_{_rotation}", "f:i g:i phi:d")(lambda s, d, r=_rotation: X.factor_correlations(sorts(s, d), 3, r))
    query(f"oblique_gaps_{_rotation}", "p_idx:i gap:d", "select distinct p_idx, 0.0 as gap from sorts")(lambda s, d, r=_rotation: oblique_gaps(s, d, r))


def original_flags(s, d):
    load = X.extract(sorts(s, d), 3, "pca", "varimax")
    return V.flag_auto(load, STATEMENTS)


query("bootstrap_success", "study_id:s done:i share:d status:s", "select 'supplier_brand' as study_id, 1000 as done, 1.0 as share, 'ok' as status")(lambda s, d: X.bootstrap_success(Q.replicates(s, d), 1000))
query("flag_agreement", "study_id:s mean:d sd:d min:d max:d replicates:i")(lambda s, d: X.flag_agreement(Q.replicates(s, d), original_flags(s, d)))
query("bootstrap_verdict", "factor:i phi:d median_width:d weak:b")(lambda s, d: X.stability_verdict(Q.boot_intervals(s, d)))

# --- ladders of K -----------------------------------------------------------------------------------------------

def rungs(s, d):
    """Rungs of ladders by nation, read off its customers: K by remainders of their keys, percentile and support by their balances."""
    c = s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("study_id"), (F.col("c_custkey") % 5 + 1).cast("int").alias("k"), F.col("c_acctbal").cast("double").alias("v"))
    out = c.groupBy("study_id", "k").agg((F.count_if(F.col("v") < 800) / F.count("*")).alias("percentile"), (F.avg("v") > 4500).alias("supported"))
    return out.withColumn("adequate", F.col("percentile").between(*B.ADEQUATE))


_CUSTOMERS = "(select *, percentile between 0.05 and 0.95 as adequate from (select 'n' || c_nationkey as study_id, (c_custkey % 5 + 1)::int as k, count(*) filter (c_acctbal < 800) / count(*)::double as percentile, avg(c_acctbal::double) > 4500 as supported from customer group by all))"
_VERDICT = f"""(select study_id, k_star, case when k_star is not null then 'selected' when k_fit is not null and k_support is not null then 'tension' when k_fit is not null then 'adequate_but_unsupported' when one then 'single_viewpoint' when k_support is not null then 'no_adequate_rung' else 'no_shared_structure' end as verdict, coalesce(k_star, k_fit, k_support, 1) as k_reported
  from (select study_id, min(k) filter (k >= 2 and adequate and supported) as k_star, min(k) filter (k >= 2 and adequate) as k_fit, max(k) filter (k >= 2 and supported) as k_support, bool_or(k = 1 and supported) as one from {_CUSTOMERS} group by 1))"""
query("ladder_verdicts", "study_id:s verdict:s k_star:i k_reported:i", f"select * from {_VERDICT}")(lambda s, d: B.verdicts(rungs(s, d)))
query("ladder_evidence", "study_id:s k:i in_band:b status:s", f"""select study_id, k, coalesce(percentile between 0.05 and 0.95, false) as in_band, case when k = k_reported and k = k_star then 'Reported · model''s pick' when k = k_reported then 'Reported' when k = k_star then 'model''s pick' when k > 1 and not supported then 'support incomplete at q = 0.05' when not coalesce(percentile between 0.05 and 0.95, false) then 'outside the adequate band' else '' end as status
  from {_CUSTOMERS} join {_VERDICT} using (study_id)""")(lambda s, d: B.ladder_evidence(rungs(s, d), B.verdicts(rungs(s, d))))
query("composition_full", "factor:i n_flagged:i n_positive:i n_negative:i n_unclassified:i n_sorts:i small:b", "select factor, count(*) filter (flagged) as n_flagged, count(*) filter (flagged and loading > 0) as n_positive, count(*) filter (flagged and loading < 0) as n_negative, (select count(*) from (select participant from flags group by 1 having not bool_or(flagged))) as n_unclassified, count(*) as n_sorts, count(*) filter (flagged) < 5 or coalesce((select composite_reliability from chars c where c.factor = f.factor) < 0.5, false) as small from flags f group by 1", ("flags", "chars"))(lambda s, d: B.full_composition(flags(s, d), V.characteristics(flags(s, d))))
query("statement_roles", "factor:i stmt_num:i score:i role:s", "select factor, s.stmt_num, score, coalesce(d.names, case when consensus_level = 'strict' then 'consensus' end, '') as role from scores s left join (select stmt_num, 'distinguishing ' || string_agg('F' || factor, ', ' order by factor) as names from per where least >= 1 group by 1) d using (stmt_num) join class using (stmt_num)", ("scores", "per", "class"))(lambda s, d: B.statement_roles(scores(s, d), V.distinguishing(pairs(s, d)), V.statement_class(scores(s, d), pairs(s, d)).where("consensus_level = 'strict'")))
query("person_check", "participant:s nearest:i r:d n_flags:i stands_apart:b", f"""select participant, nearest, r, n_flags, abs(r) < 0.3 as stands_apart from (select participant, arg_max(factor, struct_pack(a := abs(r), f := -factor)) as nearest, arg_max(r, struct_pack(a := abs(r), f := -factor)) as r from (select participant, z.factor, {corr('value', 'zscore')} as r from sorts join scores z using (stmt_num) group by 1, 2) group by 1) join (select participant, count(*) filter (flagged) as n_flags from flags group by 1) using (participant)""", ("sorts", "scores", "flags"))(lambda s, d: B.person_check(sorts(s, d), flags(s, d), scores(s, d)))


# --- readings of the priorities ---------------------------------------------------------------------------------


def ungated(s, d):
    return M.compare_groups(sorts(s, d), tens(s, d), no_gates(s, d), ["band"])


query("priorities_labels", "stmt_num:i rank:i neutral_label:s")(lambda s, d: M.ranked_with_labels(R.ranked_table(sorts(s, d), DECK), R.neutral_tests(sorts(s, d), DECK), ungated(s, d)))
query("verdict_line", "study_id:s top_statement:i by_attribute:s line:s")(lambda s, d: M.verdict_line(R.ranked_table(sorts(s, d), DECK), R.neutral_tests(sorts(s, d), DECK), ungated(s, d), R.kendall_w(sorts(s, d))))


# --- the factor workbook's overview and its audit view ---------------------------------------------------------------

_ITEMS = "(values (1, 'Project', 'supplier_brand'), (2, 'Statements', (select count(distinct stmt_num)::varchar from sorts)), (3, 'Sorts', (select count(distinct participant)::varchar from sorts)), (4, 'Factors', (select count(distinct factor)::varchar from flags)), (5, 'Extraction', 'pca'), (6, 'Rotation', 'varimax'), (7, 'Correlation', 'pearson'), (8, 'Flagging', 'auto at p < 0.05, majority of common variance'), (9, 'Exported', '2026-01-01 00:00')) v(place, item, value)"
query("workbook_overview", "study_id:s place:i item:s value:s", f"select 'supplier_brand' as study_id, * from {_ITEMS}", ("sorts", "flags"))(lambda s, d: K.overview(sorts(s, d), flags(s, d), exported="2026-01-01 00:00"))
query("unrotated_wide", "participant:s factor:i loading:d cumulative_h2:d")(lambda s, d: X.unrotated_wide(sorts(s, d), 3))


# --- solutions turned to another ----------------------------------------------------------------------------------


def turned_half(s, d):
    """Every second participant's viewpoints, turned by 30 degrees."""
    return V.rotate_manual(viewpoints(s, d).where("p_idx % 2 = 0"), 1, 2, 30)


def cycled_strangers(s, d):
    """The viewpoints in a cycle of three, one of them mirrored, of people with other names."""
    v = viewpoints(s, d)
    return v.select("study_id", F.concat(F.lit("x"), "participant").alias("participant"), (F.col("factor") % 3 + 1).alias("factor"), F.when(F.col("factor") == 2, -F.col("loading")).otherwise(F.col("loading")).alias("loading"))


query("aligned_by_names", "participant:s factor:i loading:d method:s", "select participant, factor, loading, 'names' as method from loadings where p_idx % 2 = 0")(lambda s, d: L.align_loadings(turned_half(s, d), viewpoints(s, d)))
query("aligned_by_curves", "participant:s factor:i loading:d method:s", "select 'x' || participant as participant, factor, loading, 'curves' as method from loadings")(lambda s, d: L.align_loadings(cycled_strangers(s, d), viewpoints(s, d)))


# --- readings of stored draws, where the participants are the draws -------------------------------------------------


def participant_draws(s, d):
    """Draws in the shape of the sampler's: each three participants are a draw of three factors over the statements, two chains in turn; a viewpoint's part is added so that factors differ."""
    x = sorts(s, d)
    trio = F.floor(F.col("p_idx") / 3)
    x = x.withColumn("factor", (F.col("p_idx") % 3 + 1).cast("int")).withColumn("z", F.col("value") + (preference(F.col("stmt_num"), F.col("factor") - 1) - 12) / 4)
    x = x.select("study_id", F.lit(3).alias("k"), (trio % 2).cast("int").alias("chain"), F.floor(trio / 2).cast("int").alias("draw"), F.col("stmt_num").alias("item"), "factor", "z")
    kinds = F.map_from_arrays(F.array(F.lit("loading"), F.lit("zscore")), F.array(F.col("z") / 8, F.col("z")))
    return x.select("study_id", "k", "chain", "draw", F.explode(kinds).alias("kind", "value"), "item", "factor")


_Z = f"(select study_id, 3 as k, (p_idx // 3) % 2 as chain, p_idx // 6 as draw, stmt_num as item, factor, value + (pref - 12) / 4.0 as z from sorts join prefs on j = stmt_num and factor = p_idx % 3 + 1)"
_D = f"(select study_id, k, chain, draw, item, factor, unnest(['loading', 'zscore']) as kind, unnest([z / 8, z]) as value from {_Z})"


def fdr(frame: str, ties: str = "item, factor", by: str = "k") -> str:
    upto = f"over (partition by {by} order by p desc, {ties} rows unbounded preceding)"
    return f"(select *, sum(case when claimed then 1 - p else 0.0 end) {upto} as expected_false from (select *, round(avg(1 - p) {upto}, 12) <= 0.05 as claimed from {frame}))"


_FLAGS = fdr(f"(select k, item, factor, avg(case when 2 * z * z / 64 > total and abs(z / 8) > 0.3 then 1.0 else 0.0 end) as p from (select *, sum(z * z / 64) over (partition by chain, draw, item) as total from {_Z}) group by all)")
_DISTINCT = fdr(f"(select k, item, factor, greatest(avg(case when z = hi then 1.0 else 0.0 end), avg(case when z = lo then 1.0 else 0.0 end)) as p from (select *, max(z) over (partition by chain, draw, item) as hi, min(z) over (partition by chain, draw, item) as lo from {_Z}) group by all)")
_SAME = fdr(f"(select k, item, 0 as factor, avg(case when spread < 0.75 then 1.0 else 0.0 end) as p from (select k, chain, draw, item, max(z) - min(z) as spread from {_Z} group by all) group by all)")
_STARS = fdr(f"(select a.k, a.item, a.factor, b.factor as other, avg(a.z - b.z) as diff, greatest(avg(case when a.z > b.z then 1.0 else 0.0 end), avg(case when a.z < b.z then 1.0 else 0.0 end)) as p from {_Z} a join {_Z} b on a.chain = b.chain and a.draw = b.draw and a.item = b.item and a.factor < b.factor group by all)", "item, factor, other")
_NEEDED = ("sorts", "prefs")
_CLAIMS = "k:i item:i factor:i p:d claimed:b expected_false:d"

query("draws_summary", "k:i item:i factor:i mean:d sd:d low:d high:d", f"select k, item, factor, avg(z) as mean, stddev_samp(z) as sd, quantile_cont(z, 0.025) as low, quantile_cont(z, 0.975) as high from {_Z} group by all", _NEEDED)(lambda s, d: B.summary(participant_draws(s, d), "zscore"))
query("draws_convergence", "k:i kind:s worst_rhat:d mean_rhat:d", f"select k, kind, max(rhat) as worst_rhat, avg(rhat) as mean_rhat from (select k, kind, item, factor, case when avg(v) > 0 then sqrt(((min(n) - 1) / min(n)::double * avg(v) + coalesce(var_samp(m), 0.0)) / avg(v)) end as rhat from (select k, kind, item, factor, chain, avg(value) as m, var_samp(value) as v, count(*) as n from {_D} group by all) group by all) group by all", _NEEDED)(lambda s, d: B.convergence(participant_draws(s, d)))
query("draws_flag_claims", _CLAIMS, f"select * from {_FLAGS}", _NEEDED)(lambda s, d: B.flag_claims(participant_draws(s, d)))
query("draws_distinguishing_claims", _CLAIMS, f"select * from {_DISTINCT}", _NEEDED)(lambda s, d: B.distinguishing_claims(participant_draws(s, d)))
query("draws_consensus_claims", _CLAIMS, f"select * from {_SAME}", _NEEDED)(lambda s, d: B.consensus_claims(participant_draws(s, d)))
query("draws_star_claims", "k:i item:i factor:i other:i diff:d p:d claimed:b expected_false:d", f"select * from {_STARS}", _NEEDED)(lambda s, d: B.star_claims(participant_draws(s, d)))
query("draws_claim_families", "k:i family:s n:i claimed:i expected_false:d", " union all ".join(f"select k, '{name}' as family, count(*) as n, count(*) filter (claimed) as claimed, sum(case when claimed then 1 - p else 0.0 end) as expected_false from {part} group by all" for name, part in (("flags", _FLAGS), ("distinguishing", _DISTINCT), ("consensus", _SAME), ("stars", _STARS))), _NEEDED)(lambda s, d: B.claim_families(participant_draws(s, d)))
query("draws_ladder", "k:i supported:i adequate:b n_flags:i n_distinguishing:i", f"""select k, count(*) filter (nf >= 2 and nd >= 1) as supported, bool_and(nf >= 2 and nd >= 1) as adequate, sum(nf) as n_flags, sum(nd) as n_distinguishing from
  (select k, factor, sum(f) as nf, sum(e) as nd from (select k, factor, claimed::int as f, 0 as e from {_FLAGS} union all select k, factor, 0, claimed::int from {_DISTINCT}) group by all) group by all""", _NEEDED)(lambda s, d: B.ladder(participant_draws(s, d)))
query("draws_bridge", "participant:s factor:i loading:d flagged:b", f"select participant, factor, avg(z / 8) as loading, coalesce(any_value(claimed), false) as flagged from (select distinct participant, p_idx from sorts) join {_Z} on item = p_idx left join (select item, factor, claimed from {_FLAGS}) using (item, factor) group by all", _NEEDED)(lambda s, d: B.to_flags(participant_draws(s, d), 3, sorts(s, d)))
query("bayes_stars", "k:i item:i factor:i other:i diff:d p:d claimed:b expected_false:d")(lambda s, d: B.star_claims(Q.posterior(s, d)))
query("bayes_claim_families", "k:i family:s n:i claimed:i expected_false:d")(lambda s, d: B.claim_families(Q.posterior(s, d)))


# --- people outside all factors, and flags edited by hand ---------------------------------------------------------


def unspanned(s, d):
    return flags(s, d).groupBy("study_id", "p_idx").agg(F.bool_or("flagged").alias("any")).where("not any").select("study_id", "p_idx")


_NEAR = "(select x.p_i, arg_max(x.p_j, struct_pack(r := round(x.r, 12), j := -x.p_j)) as p_j from (select p_i, p_j, r from pearson union all select p_j, p_i, r from pearson) x where x.r is not null and x.p_i in (select p_idx from flags group by 1 having not bool_or(flagged)) and x.p_j in (select p_idx from flags group by 1 having not bool_or(flagged)) group by 1)"
query("unspanned_clusters", "p_i:i p_j:i", f"select a.p_i, a.p_j from {_NEAR} a join {_NEAR} b on a.p_i = b.p_j and a.p_j = b.p_i where a.p_i < a.p_j", ("flags", "pearson"))(lambda s, d: B.unspanned_clusters(sorts(s, d), unspanned(s, d)))


def edited(s, d):
    """Every third participant's flags taken back by hand, factor 1 set for every seventh."""
    edits = flags(s, d).withColumn("flagged", F.when((F.col("p_idx") % 7 == 0) & (F.col("factor") == 1), True).when(F.col("p_idx") % 3 == 0, False).otherwise(F.col("flagged")))
    return N.recalculate_after_flagging(sorts(s, d), flags(s, d), edits, DECK)


query("edited_characteristics", "factor:i n_flagged:i composite_reliability:d se_factor:d avg_loading:d", """select factor, n_flagged, rel as composite_reliability, sqrt(1 - rel) as se_factor, avg_loading from (select *, case when n_flagged > 0 then 0.8 * n_flagged / (1 + (n_flagged - 1) * 0.8) end as rel
  from (select factor, count(*) filter (again) as n_flagged, avg(abs(loading)) filter (again) as avg_loading from (select *, case when p_idx % 7 = 0 and factor = 1 then true when p_idx % 3 = 0 then false else flagged end as again from flags) group by 1))""", ("flags",))(lambda s, d: edited(s, d)["characteristics"])
