"""Comparisons in full: pairs of factors with p-values, groups of participants with tests, contrasts and labels.

Statistics and tail probabilities are aggregations, windows and column
expressions. Only exact distributions and Monte Carlo draws of small levels run
in Python, one statement of one attribute at a time, seeded by its number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.distributions import chi2_sf, normal_p2, t_p2
from ..functions.ranks import mid_rank, with_bh
from . import factors as V
from . import priorities as R

BY = R.BY
#: Standard error assumed for each factor where none is known.
ASSUMED_SE = 0.25
#: Draws of the rank test of small levels and of the simulated exact test of a table; levels and expected counts below which they are used.
RANK_DRAWS, TABLE_DRAWS, SMALL_LEVEL, SMALL_EXPECTED = 100_000, 5_000, 10, 5


# --- factors --------------------------------------------------------------------------------------


def assumed_sed(scores: DataFrame, se: float = ASSUMED_SE) -> DataFrame:
    """Standard errors of differences where a study has none: √2 times an assumed standard error for each pair of factors."""
    f = scores.select("study_id", F.col("factor").alias("f")).distinct()
    g = scores.select("study_id", F.col("factor").alias("g")).distinct()
    return f.join(g, "study_id").select("study_id", "f", "g", F.when(F.col("f") != F.col("g"), F.lit(math.sqrt(2) * se)).alias("sed"))


def known_sed(scores: DataFrame, sed: DataFrame | None = None, se: DataFrame | None = None) -> DataFrame:
    """``sed`` if there is one, else from standard errors ``(study_id, factor, se_factor)``, else assumed."""
    return sed if sed is not None else V.sed_matrix(se) if se is not None else assumed_sed(scores)


def pair_tests(pairs: DataFrame) -> DataFrame:
    """``pairs`` of ``factors.pairwise`` with ``marks``, the difference to three places, exact two-sided p, and BH over all statements and pairs of a study."""
    p = F.when(F.col("sed") > 0, normal_p2(F.col("diff") / F.col("sed")))
    out = pairs.withColumn("p", p).withColumn("marks", F.repeat(F.lit("*"), F.col("level"))).withColumn("diff_3", F.round("diff", 3))
    return with_bh(out, "p", ["study_id"])


def distinguish(scores: DataFrame, sed: DataFrame | None = None, criterion: str = "all") -> dict[str, DataFrame]:
    """Pairs with p, categories, and distinguishing statements with marks. A study of one factor has no pairs; all its statements are consensus."""
    pairs = V.pairwise(scores, known_sed(scores, sed))
    marked = V.distinguishing(pairs, criterion).withColumn("marks", F.repeat(F.lit("*"), F.col("stars")))
    return {"pairs": pair_tests(pairs), "classes": V.statement_class(scores, pairs), "distinguishing": marked}


def crib_details(scores: DataFrame, pairs: DataFrame, n: int = 2, names: DataFrame | None = None) -> DataFrame:
    """The crib sheet with a marker (D distinguishing, C consensus), the nearest other factor, the difference to it, the other factors' scores and a sentence.

    ``names(study_id, stmt_num, text)``: statement texts; a statement without one is called by its number.
    """
    crib = V.crib_sheet(scores, n)
    other = scores.select(*V.STATEMENT, F.col("factor").alias("o"), F.col("zscore").alias("oz"), F.col("score").alias("os"))
    far = scores.select(*V.FACTOR, "stmt_num", "zscore").join(other, V.STATEMENT).where("factor <> o").withColumn("gap", F.col("zscore") - F.col("oz"))
    near = far.groupBy(*V.FACTOR, "stmt_num").agg(F.min_by(F.struct("o", "gap"), F.struct(F.abs("gap"), "o")).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "os"))), lambda x: F.concat(F.lit("F"), x["o"].cast("string"), F.lit(": "), x["os"].cast("string"))), ", ").alias("other_scores"))
    d = V.distinguishing(pairs).select(*V.FACTOR, "stmt_num", F.lit("D").alias("d"))
    c = V.statement_class(scores, pairs).where("category = 'Consensus'").select(*V.STATEMENT, F.lit("C").alias("c"))
    text = statement_names(crib.select(*V.STATEMENT).distinct(), names)
    out = crib.join(near, [*V.FACTOR, "stmt_num"], "left").join(d, [*V.FACTOR, "stmt_num"], "left").join(c, V.STATEMENT, "left").join(text, V.STATEMENT, "left")
    says = F.when(F.col("section") == "most_agree", "agrees most with").when(F.col("section") == "most_disagree", "disagrees most with").when(F.col("section") == "higher_than_all", "ranks higher than any other").otherwise("ranks lower than any other")
    sentence = F.concat(F.lit("Factor "), F.col("factor").cast("string"), F.lit(" "), says, F.lit(": "), F.col("text"))
    return out.select(*V.FACTOR, "section", "stmt_num", "zscore", "score", F.coalesce("d", "c", F.lit("")).alias("marker"), F.col("n.o").alias("nearest"), F.col("n.gap").alias("gap"), "other_scores", "text", sentence.alias("sentence"))


def statement_names(statements: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``(study_id, stmt_num, text)`` by number; without a text the statement's number stands for it."""
    fallback = F.concat(F.lit("Statement "), F.col("stmt_num").cast("string"))
    if names is None:
        return statements.select("study_id", "stmt_num", fallback.alias("text"))
    own = names.groupBy("study_id", "stmt_num").agg(F.min("text").alias("t"))
    return statements.join(own, ["study_id", "stmt_num"], "left").select("study_id", "stmt_num", F.coalesce(F.when(F.trim("t") != "", F.col("t")), fallback).alias("text"))


# What is said of a factor's poles.
SPLIT, REVIEW, UNIPOLAR = "Consider splitting into two factors", "Minor bipolar tendency - review negative loaders", "Unipolar factor"


def bipolar_advice(bipolar: DataFrame, share: float = 0.5) -> DataFrame:
    """``factors.bipolar`` with what to do: split where the negative pole has over ``share`` of the positive one's sorts."""
    split = F.col("ratio").isNull() | (F.col("ratio") > share)
    return bipolar.withColumn("recommendation", F.when(~F.col("is_bipolar"), UNIPOLAR).when(split, SPLIT).otherwise(REVIEW))


def score_correlation_gate(correlations: DataFrame, limit: float = 0.6) -> DataFrame:
    """Per study the largest correlation of factor scores, its pair, and whether factors are too alike."""
    top = correlations.groupBy("study_id").agg(F.max_by(F.struct("f", "g", "r"), F.struct(F.abs("r"), -F.col("f"), -F.col("g"))).alias("t"))
    return top.select("study_id", "t.f", "t.g", F.col("t.r").alias("max_r"), F.when(F.abs("t.r") > limit, "factors share much of their view").otherwise("factors are distinct").alias("gate"))


def membership_test(crosstab: DataFrame, draws: int = TABLE_DRAWS, seed: int = 42) -> DataFrame:
    """χ² where all expected counts are 5 or more, else the simulated exact test: a table as improbable as the one seen, margins kept."""
    chi = V.chi_square(crosstab)
    whole = crosstab.groupBy("study_id").agg(F.sort_array(F.collect_list(F.struct("member", "level", "n"))).alias("cells"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for study, cells in zip(pdf["study_id"], pdf["cells"], strict=True):
            rows, cols = ({v: i for i, v in enumerate(sorted({c[k] for c in cells}))} for k in ("member", "level"))
            t = np.zeros((len(rows), len(cols)), np.int64)
            for c in cells:
                t[rows[c["member"]], cols[c["level"]]] = c["n"]
            out.append({"study_id": study, "fisher_p": simulated_fisher(t, draws, seed)})
        return pd.DataFrame(out, columns=["study_id", "fisher_p"])

    fisher = whole.mapInPandas(lambda it: (run(x) for x in it), "study_id string, fisher_p double")
    small = chi.where("not chi2_applies").select("study_id")
    fisher = fisher.join(small, "study_id", "left_semi")
    return chi.join(fisher, "study_id", "left").select("study_id", "chi2", "df", "chi2_applies", F.when(F.col("chi2_applies"), F.lit("chi-square")).otherwise("simulated Fisher").alias("test"), F.when(F.col("chi2_applies"), chi2_sf(F.col("chi2"), F.col("df"))).otherwise(F.col("fisher_p")).alias("p"))


def simulated_fisher(table: np.ndarray, draws: int, seed: int) -> float:
    """p of a table by drawing tables with its margins: (as improbable ones + 1) / (draws + 1)."""
    r, c = np.repeat(np.arange(len(table)), table.sum(1)), np.repeat(np.arange(table.shape[1]), table.sum(0))
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, len(r) + 1)))])
    weight = lambda t: -log_factorial[t].sum()
    seen, rng, more = weight(table), np.random.default_rng(seed), 0
    for _ in range(draws):
        t = np.bincount(r * table.shape[1] + rng.permutation(c), minlength=table.size)
        more += weight(t) <= seen + 1e-7
    return (more + 1) / (draws + 1)


# --- groups ---------------------------------------------------------------------------------------


def mann_whitney_p(sorts: DataFrame, groups: DataFrame) -> DataFrame:
    """``priorities.mann_whitney`` with the two-sided p of its z."""
    return R.mann_whitney(sorts, groups).withColumn("p", normal_p2(F.col("z")))


def kruskal_p(sorts: DataFrame, groups: DataFrame) -> DataFrame:
    return R.kruskal_wallis(sorts, groups).withColumn("p", chi2_sf(F.col("h"), F.col("df")))


def linear_p(sorts: DataFrame, groups: DataFrame) -> DataFrame:
    return R.linear_by_linear(sorts, groups).withColumn("p", normal_p2(F.col("z")))


def spearman_p(sorts: DataFrame, numbers: DataFrame) -> DataFrame:
    """ρ, the sum of squared rank differences it stands for, p by t, n, and why there is none. ``numbers(study_id, participant, attribute, num)``."""
    g = sorts.where("value is not null").join(numbers.where("num is not null"), ["study_id", "participant"])
    g = g.withColumn("rx", mid_rank(F.col("num"), BY)).withColumn("ry", mid_rank(F.col("value"), BY))
    s = g.groupBy(*BY).agg(R._corr("rx", "ry").alias("rho"), F.count("*").alias("n"), (F.min("value") == F.max("value")).alias("flat"), (F.min("num") == F.max("num")).alias("flat_attribute"))
    n, few = F.col("n"), F.col("n") < 5
    rho = F.when(~few, F.col("rho"))
    t = rho * F.sqrt((n - 2) / (1 - rho * rho))
    note = F.when(few, F.concat(F.lit("not compared, n = "), n.cast("string"))).when(F.col("flat"), "no variation, not testable").when(F.col("flat_attribute"), "attribute has no variation, not testable")
    return s.select(*BY, rho.alias("rho"), ((n * n * n - n) * (1 - rho) / 6).alias("s"), F.when(F.abs(rho) >= 1, F.lit(0.0)).otherwise(t_p2(t, n - 2)).alias("p"), "n", note.alias("note"))


def dunn_p(sorts: DataFrame, groups: DataFrame) -> DataFrame:
    """``priorities.dunn`` with p, BH over the pairs of a statement, and the level that is higher."""
    return with_bh(R.dunn(sorts, groups).withColumn("p", normal_p2(F.col("z"))), "p", BY).withColumn("winner", F.when(F.col("z") > 0, F.col("level_a")).otherwise(F.col("level_b")))


def dunn_winner(contrasts: DataFrame, q: float = 0.05) -> DataFrame:
    """The winner of each statement's surest contrast with an adjusted p of at most ``q``; of equally sure ones the first by level names."""
    sure = contrasts.where(F.col("p_adj") <= q)
    return sure.groupBy(*BY).agg(F.min_by("winner", F.struct("p_adj", "level_a", "level_b")).alias("winner"))


def kruskal_draws(parts: list[np.ndarray], draws: int, seed: list[int]) -> float:
    """p of the rank test by permuting ranks among levels: the share of draws with as large a sum of squared rank sums over sizes."""
    r = stats.mid_ranks(np.concatenate(parts))
    sizes = np.array([len(p) for p in parts])
    cuts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    stat = lambda x: (np.add.reduceat(x, cuts, axis=-1) ** 2 / sizes).sum(-1)
    seen, rng, more, done = stat(r), np.random.default_rng(seed), 0, 0
    step = max(1, 2_000_000 // len(r))
    while done < draws:
        k = min(step, draws - done)
        more += int((stat(rng.permuted(np.broadcast_to(r, (k, len(r))), axis=1)) >= seen - 1e-9).sum())
        done += k
    return more / draws


def _small_tests(sorts: DataFrame, groups: DataFrame, draws: int) -> DataFrame:
    """p of statements with a small level: exact for two levels, drawn for more; the shift and interval of all pairs of two levels."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = sorted(pdf["level"].unique())
        parts = [pdf.loc[pdf["level"] == v, "value"].to_numpy(float) for v in levels]
        p, hl = math.nan, (math.nan,) * 3
        small = min(len(x) for x in parts) < SMALL_LEVEL and len(np.unique(pdf["value"])) > 1
        if len(parts) == 2:
            hl = stats.hodges_lehmann_two(*parts)
            p = stats.mann_whitney(*parts, exact_below=SMALL_LEVEL, work=math.inf)["p"] if small else p
        elif small and len(parts) > 2:
            p = kruskal_draws(parts, draws, [int(pdf["stmt_num"].iloc[0]), len(pdf)])
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in BY}, "small_p": p, "hl_shift": hl[0], "hl_lower": hl[1], "hl_upper": hl[2]}])

    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    out = sorts.where("value is not null").join(groups, ["study_id", "participant"]).groupBy(*BY).applyInPandas(test, "study_id string, attribute string, stmt_num int, small_p double, hl_shift double, hl_lower double, hl_upper double")
    return out.select(*BY, *[known(c) for c in ("small_p", "hl_shift", "hl_lower", "hl_upper")])


def compare_groups(sorts: DataFrame, groups: DataFrame, gates: DataFrame, ordinal: list[str] = (), q: float = 0.05, draws: int = RANK_DRAWS) -> DataFrame:
    """One test for each statement and attribute of ``groups`` (usable levels), with BH, contrasts and label.

    Two levels: Mann-Whitney, exact below ten in a level. More levels that are
    ``ordinal``: linear-by-linear. Else Kruskal-Wallis, drawn where a level has
    under ten, with Dunn's contrasts naming the highest level. BH runs over each
    attribute's statements; nothing is flagged whose attribute fails its gate
    ``(study_id, attribute, passed)``; no gate counts as passed.
    """
    kinds = groups.groupBy("study_id", "attribute").agg(F.count_distinct("level").alias("k"))
    test = F.when(F.col("k") == 2, "mann_whitney").when(F.col("attribute").isin(list(ordinal)), "linear_by_linear").otherwise("kruskal_wallis")
    kinds = kinds.select("study_id", "attribute", test.alias("test"))
    own = lambda name: groups.join(kinds.where(F.col("test") == name).select("study_id", "attribute"), ["study_id", "attribute"], "left_semi")
    used = sorts.where("value is not null").join(groups, ["study_id", "participant"]).groupBy(*BY).agg(F.count("*").alias("n_used"), F.count_distinct("level").alias("n_levels"), (F.min("value") == F.max("value")).alias("flat"))
    text = lambda form, *c: F.format_string(form, *c)
    none = F.lit(None)
    mw = mann_whitney_p(sorts, own("mann_whitney")).select(*BY, F.col("z").alias("statistic"), "p", F.col("ps").alias("effect"), text("P(%s > %s) = %.2f", F.col("level_a"), F.col("level_b"), F.col("ps")).alias("effect_label"), F.concat("winner", F.lit(" higher")).alias("direction"))
    contrasts = dunn_winner(dunn_p(sorts, own("kruskal_wallis")), q)
    kw = kruskal_p(sorts, own("kruskal_wallis")).join(contrasts, BY, "left").select(*BY, F.col("h").alias("statistic"), "p", F.col("eps2").alias("effect"), text("epsilon squared = %.2f", F.col("eps2")).alias("effect_label"), F.concat("winner", F.lit(" highest")).alias("direction"))
    lbl = linear_p(sorts, own("linear_by_linear")).select(*BY, F.col("z").alias("statistic"), "p", F.col("z").alias("effect"), text("z = %.2f", F.col("z")).alias("effect_label"), F.concat("direction", F.lit(" with "), "attribute").alias("direction"))
    out = used.join(kinds, ["study_id", "attribute"]).join(mw.unionByName(kw).unionByName(lbl), BY, "left").join(_small_tests(sorts, groups, draws), BY, "left")
    p = F.when(F.col("flat") | (F.col("n_levels") < 2), none.cast("double")).when(F.col("test") == "linear_by_linear", F.col("p")).otherwise(F.coalesce("small_p", "p"))
    note = F.when(F.col("flat"), "no variation, not testable").when(F.col("n_levels") < 2, "fewer than 2 groups with data, not compared")
    out = with_bh(out.withColumn("p", p).withColumn("note", note), "p", ["study_id", "attribute"])
    return _labelled(out, gates, q)


def compare_numbers(sorts: DataFrame, numbers: DataFrame, gates: DataFrame, q: float = 0.05) -> DataFrame:
    """Spearman tests of numeric attributes, with BH and label, in the columns of ``compare_groups``."""
    s = spearman_p(sorts, numbers)
    none = lambda kind: F.lit(None).cast(kind)
    direction = F.concat(F.when(F.col("rho") > 0, "rises with ").when(F.col("rho") < 0, "falls with "), "attribute")
    out = s.select(*BY, F.col("n").alias("n_used"), none("long").alias("n_levels"), F.lit("spearman").alias("test"), F.col("s").alias("statistic"), "p", F.col("rho").alias("effect"), F.when(F.col("rho").isNotNull(), F.format_string("rho = %.2f", "rho")).alias("effect_label"), direction.alias("direction"), *[none("double").alias(c) for c in ("hl_shift", "hl_lower", "hl_upper")], "note")
    return _labelled(with_bh(out, "p", ["study_id", "attribute"]), gates, q)


def q_text(q: Column) -> Column:
    return F.when(q.isNull(), "q = NA").when(q < 0.001, "q < 0.001").when(q < 0.01, F.format_string("q = %.3f", q)).otherwise(F.format_string("q = %.2f", q))


def _labelled(tests: DataFrame, gates: DataFrame, q: float) -> DataFrame:
    out = tests.join(gates.select("study_id", "attribute", "passed"), ["study_id", "attribute"], "left").withColumn("passed", F.coalesce("passed", F.lit(True)))
    flagged = F.coalesce((F.col("p_adj") <= q) & F.col("passed"), F.lit(False))
    kw = F.col("test") == "kruskal_wallis"
    sure = F.concat(F.lit(" ("), q_text(F.col("p_adj")), F.lit(")"))
    label = (
        F.when(~F.col("passed"), "No overall group difference")
        .when(F.col("p").isNull() & (F.col("note") == "no variation, not testable"), "Not testable (no variation)")
        .when(F.col("p").isNull(), "Not compared (insufficient data)")
        .when(~flagged, "No evidence of a difference")
        .when(F.col("test") == "mann_whitney", F.concat("direction", F.lit(" (P = "), F.format_string("%.2f", F.greatest(F.col("effect"), 1 - F.col("effect"))), F.lit(", "), q_text(F.col("p_adj")), F.lit(")")))
        .when(kw & F.col("direction").isNull(), F.concat(F.lit("Groups differ"), sure))
        .when(kw, F.concat("direction", sure))
        .otherwise(F.concat(F.when(F.col("effect") < 0, "Falls").otherwise("Rises"), F.lit(" with "), "attribute", sure))
    )
    direction = F.when(kw & ~flagged, F.lit(None)).otherwise(F.col("direction"))
    return out.select(*BY, "test", "statistic", "p", "p_adj", flagged.alias("flagged"), direction.alias("direction"), "effect", "effect_label", "hl_shift", "hl_lower", "hl_upper", "n_used", "n_levels", "note", label.alias("label"))


def ranked_with_labels(ranked: DataFrame, neutral: DataFrame, tests: DataFrame) -> DataFrame:
    """The ranked table with the label against the neutral point and, as a map by attribute, those of the group tests."""
    by = tests.groupBy("study_id", "stmt_num").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attribute", "label")))).alias("group_labels"))
    return ranked.join(neutral.select("study_id", "stmt_num", F.col("label").alias("neutral_label")), ["study_id", "stmt_num"], "left").join(by, ["study_id", "stmt_num"], "left")


def verdict_line(ranked: DataFrame, neutral: DataFrame, tests: DataFrame, w: DataFrame) -> DataFrame:
    """``priorities.verdict`` with the top statement and a sentence, and differing statements listed by attribute."""
    top = ranked.groupBy("study_id").agg(F.min_by("stmt_num", F.struct("rank", "stmt_num")).alias("top_statement"))
    per = tests.where("flagged").groupBy("study_id", "attribute").agg(F.count("*").alias("n")).groupBy("study_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attribute", "n"))), lambda x: F.concat(x["attribute"], F.lit(": "), x["n"].cast("string"))), ", ").alias("by_attribute"))
    out = R.verdict(neutral, tests, w).join(top, "study_id", "left").join(per, "study_id", "left").fillna("", ["by_attribute"])
    return out.withColumn("line", F.format_string("%d of %d statements depart from neutral; %d differ between groups; agreement is %s; statement %d leads.", "n_departures", "n_statements", "n_differences", F.coalesce("band", F.lit("undefined")), "top_statement"))
