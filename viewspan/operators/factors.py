"""From loadings to viewpoints: flags, weights, z-scores, arrays, characteristics, distinguishing statements, crib sheets.

Loadings are long, ``(study_id, participant, factor, loading)``; a factor is a
row, so every step is a group-by, a window or a join on
``(study_id, factor[, stmt_num])``. Where the number of statements or of
factors matters it is a parameter or a count of the data, never a collect.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import mid_rank, min_rank
from .study import fitted_deck, grid_at, grid_values

PERSON = ["study_id", "participant"]
FACTOR = ["study_id", "factor"]
STATEMENT = ["study_id", "stmt_num"]
#: Multiples of the standard error of a difference at p < .05, .01 and .001.
LEVELS = [(3, 3.29), (2, 2.58), (1, 1.96)]


def critical(p: float) -> float:
    return NormalDist().inv_cdf(1 - p / 2)


# --- flags --------------------------------------------------------------------------------------


def flag_auto(loadings: DataFrame, statements: int, p: float = 0.05, majority: bool = True) -> DataFrame:
    """A sort defines a factor if its loading is significant and (``majority``) its square exceeds all others' together."""
    square = F.col("loading") * F.col("loading")
    ok = F.abs("loading") > critical(p) / math.sqrt(statements)
    if majority:
        ok &= square > F.sum(square).over(Window.partitionBy(*PERSON)) - square
    return loadings.withColumn("flagged", F.coalesce(ok, F.lit(False)))


def flag_theoretical(loadings: DataFrame, threshold: float) -> DataFrame:
    """Loadings over a fixed threshold; of several of one sort only the largest, the first of equals."""
    first = F.row_number().over(Window.partitionBy(*PERSON).orderBy(F.abs("loading").desc(), "factor")) == 1
    return loadings.withColumn("flagged", F.coalesce((F.abs("loading") > threshold) & first, F.lit(False)))


def flag_manual(loadings: DataFrame) -> DataFrame:
    """No sort is flagged until someone does."""
    return loadings.withColumn("flagged", F.lit(False))


def communalities(loadings: DataFrame) -> DataFrame:
    """Sum of squared loadings; over 1 is a Heywood case."""
    h2 = F.sum(F.col("loading") * F.col("loading"))
    return loadings.groupBy(*PERSON).agg(h2.alias("h2"), (h2 > 1).alias("heywood"))


def cumulative_communalities(loadings: DataFrame) -> DataFrame:
    upto = Window.partitionBy(*PERSON).orderBy("factor").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return loadings.select(*PERSON, "factor", F.sum(F.col("loading") * F.col("loading")).over(upto).alias("cumulative_h2"))


# --- scores -------------------------------------------------------------------------------------


def weight(loading: Column) -> Column:
    """a / (1 - a²) with |a| held in [0.0001, 0.9999]; the sign stays and 0 weighs 0."""
    a = F.signum(loading) * F.least(F.lit(0.9999), F.greatest(F.lit(1e-4), F.abs(loading)))
    return a / (1 - a * a)


def factor_weights(flags: DataFrame) -> DataFrame:
    return flags.where("flagged").select(*PERSON, "factor", weight(F.col("loading")).alias("weight"))


def factor_scores(sorts: DataFrame, flags: DataFrame, deck: list[int] | None = None) -> DataFrame:
    """``(study_id, factor, stmt_num, zscore, rank, score)``: weighted sums standardised over statements, ranked and dealt on the deck.

    Factors without flagged sorts give no rows. Without a deck there is no score.
    """
    sums = sorts.join(factor_weights(flags), PERSON).groupBy(*FACTOR, "stmt_num").agg(F.sum(F.col("value") * F.col("weight")).alias("wsum"))
    w = Window.partitionBy(*FACTOR)
    sd = F.stddev_samp("wsum").over(w)
    z = F.when(sd > 0, (F.col("wsum") - F.avg("wsum").over(w)) / sd).otherwise(0.0)
    out = sums.select(*FACTOR, "stmt_num", z.alias("zscore"))
    out = out.withColumn("rank", min_rank(F.col("zscore"), FACTOR))
    return with_grid_score(out, deck) if deck else out


def with_grid_score(scores: DataFrame, deck: list[int], statements: int | None = None) -> DataFrame:
    """``score``: the grid value at each statement's mid-rank from the bottom.

    A tie group whose mid-rank is a fraction takes the least score its members
    would get; an odd one takes that of its middle place.
    """
    fitted = fitted_deck(deck, statements or sum(deck))
    mid = mid_rank(F.col("zscore"), FACTOR)
    out = scores.withColumn("_mid", mid).withColumn("_at", grid_at(F.floor("_mid"), fitted))
    low = F.min("_at").over(Window.partitionBy(*FACTOR, "zscore"))
    return out.withColumn("score", F.when(F.col("_mid") == F.floor("_mid"), F.col("_at")).otherwise(low)).drop("_mid", "_at")


# --- characteristics ------------------------------------------------------------------------------


def characteristics(flags: DataFrame, av_rel: float = 0.8) -> DataFrame:
    """Per factor: flagged sorts, eigenvalue, % and cumulative % of variance, composite reliability, mean flagged |loading|, standard error."""
    people = Window.partitionBy("study_id")
    each = flags.groupBy(*FACTOR).agg(F.count_if("flagged").alias("n_flagged"), F.sum(F.col("loading") * F.col("loading")).alias("eigenvalue"), F.count("*").alias("n"), F.avg(F.when(F.col("flagged"), F.abs("loading"))).alias("avg_loading"))
    p = F.col("n_flagged")
    rel = F.when(p > 0, av_rel * p / (1 + (p - 1) * av_rel))
    pct = 100 * F.col("eigenvalue") / F.col("n")
    upto = people.orderBy("factor").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.select(*FACTOR, "n_flagged", "eigenvalue", pct.alias("variance_pct"), F.sum(pct).over(upto).alias("cumulative_var_pct"), rel.alias("composite_reliability"), "avg_loading", F.sqrt(1 - rel).alias("se_factor"))


def sed_matrix(chars: DataFrame) -> DataFrame:
    """Standard errors of differences of all ordered pairs of factors (null on the diagonal)."""
    f = chars.select("study_id", F.col("factor").alias("f"), F.col("se_factor").alias("sf"))
    g = chars.select("study_id", F.col("factor").alias("g"), F.col("se_factor").alias("sg"))
    return f.join(g, "study_id").select("study_id", "f", "g", F.when(F.col("f") != F.col("g"), F.sqrt(F.col("sf") * F.col("sf") + F.col("sg") * F.col("sg"))).alias("sed"))


# --- distinguishing and consensus -----------------------------------------------------------------


def pairwise(scores: DataFrame, sed: DataFrame) -> DataFrame:
    """``(study_id, stmt_num, f, g, diff, sed, level)`` for f < g; level 3, 2, 1 or 0 by multiples of the standard error."""
    a = scores.select(*STATEMENT, F.col("factor").alias("f"), F.col("zscore").alias("zf"))
    b = scores.select(*STATEMENT, F.col("factor").alias("g"), F.col("zscore").alias("zg"))
    out = a.join(b, STATEMENT).where("f < g").join(sed, ["study_id", "f", "g"]).withColumn("diff", F.col("zf") - F.col("zg"))
    level = F.lit(0)
    for k, m in reversed(LEVELS):
        level = F.when(F.abs("diff") > F.col("sed") * m, k).otherwise(level)
    return out.select(*STATEMENT, "f", "g", "diff", "sed", level.alias("level"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(*STATEMENT, F.col("f").alias("factor"), F.col("g").alias("other"), "level").union(pairs.select(*STATEMENT, F.col("g"), F.col("f"), "level"))


def distinguishing(pairs: DataFrame, criterion: str = "all", lens: int = 1) -> DataFrame:
    """Statements that set a factor apart: from all others (stars: the weakest level) or from any (the strongest); ``lens`` asks for so many stars."""
    per = both_ways(pairs).groupBy(*FACTOR, "stmt_num").agg(F.min("level").alias("least"), F.max("level").alias("most"))
    stars = F.col("least") if criterion == "all" else F.col("most")
    return per.select(*FACTOR, "stmt_num", stars.alias("stars")).where(F.col("stars") >= lens)


def statement_class(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per statement: category, consensus level, variance and range of z over factors.

    All pairs differ: "Distinguishes all". Else the first factor that differs
    from all others, which don't differ among themselves: "Distinguishes F<k>*".
    No pair differs: "Consensus". Consensus level: strict (no pair differs),
    broad (none beyond the first level).
    """
    two = both_ways(pairs)
    per = two.groupBy(*STATEMENT, "factor").agg(F.count("*").alias("n_other"), F.count_if(F.col("level") > 0).alias("n_diff"))
    totals = pairs.groupBy(*STATEMENT).agg(F.count("*").alias("n_pairs"), F.count_if(F.col("level") > 0).alias("sig"), F.max("level").alias("top"))
    alone = per.join(totals, STATEMENT).where("n_diff = n_other and sig = n_diff").groupBy(*STATEMENT).agg(F.min("factor").alias("alone"))
    spread = scores.groupBy(*STATEMENT).agg(F.var_samp("zscore").alias("ranking_variance"), F.min("zscore").alias("z_min"), F.max("zscore").alias("z_max"))
    out = spread.join(totals, STATEMENT, "left").join(alone, STATEMENT, "left")
    category = (
        F.when(F.col("n_pairs").isNull(), "Consensus")
        .when(F.col("sig") == F.col("n_pairs"), "Distinguishes all")
        .when(F.col("alone").isNotNull(), F.concat(F.lit("Distinguishes F"), F.col("alone").cast("string"), F.lit("*")))
        .when(F.col("sig") == 0, "Consensus")
        .otherwise("")
    )
    level = F.when(F.coalesce("top", F.lit(0)) == 0, "strict").when(F.col("top") == 1, "broad").otherwise("")
    return out.select(*STATEMENT, category.alias("category"), level.alias("consensus_level"), "ranking_variance", "z_min", "z_max")


# --- readings of a factor -------------------------------------------------------------------------


def factor_array(scores: DataFrame) -> DataFrame:
    """Statements in the order of an array: score, then z, from the top."""
    place = F.row_number().over(Window.partitionBy(*FACTOR).orderBy(F.desc("score"), F.desc("zscore"), "stmt_num"))
    return scores.select(*FACTOR, place.alias("place"), "stmt_num", F.round("zscore", 2).alias("zscore"), "score")


def crib_sheet(scores: DataFrame, n: int = 2) -> DataFrame:
    """Sections of each factor: most_agree, most_disagree (``n`` by z), higher_than_all, lower_than_all (scores against every other factor)."""
    others = Window.partitionBy(*STATEMENT)
    # with the greatest and least two values over factors each factor's own can be left out, without a join of pairs
    ranked = scores.withColumn("hi", F.row_number().over(others.orderBy(F.desc("score"), "factor"))).withColumn("lo", F.row_number().over(others.orderBy("score", "factor")))
    pick = lambda c, k: F.max(F.when(F.col(c) == k, F.col("score"))).over(others)
    ranked = ranked.withColumns({"top": F.when(F.col("hi") == 1, pick("hi", 2)).otherwise(pick("hi", 1)), "bottom": F.when(F.col("lo") == 1, pick("lo", 2)).otherwise(pick("lo", 1))})
    by = Window.partitionBy(*FACTOR)
    ranked = ranked.withColumns({"down": F.row_number().over(by.orderBy(F.desc("zscore"), "stmt_num")), "up": F.row_number().over(by.orderBy("zscore", F.desc("stmt_num")))})
    sections = [
        ("most_agree", F.col("down") <= n),
        ("higher_than_all", F.coalesce(F.col("score") > F.col("top"), F.lit(True))),
        ("lower_than_all", F.coalesce(F.col("score") < F.col("bottom"), F.lit(True))),
        ("most_disagree", F.col("up") <= n),
    ]
    section = F.explode(F.filter(F.array(*[F.when(c, F.lit(s)) for s, c in sections]), lambda x: x.isNotNull()))
    return ranked.select(*FACTOR, section.alias("section"), "stmt_num", "zscore", "score")


def score_correlations(scores: DataFrame) -> DataFrame:
    """Correlations of the factors' z-scores, f < g."""
    a = scores.select(*STATEMENT, F.col("factor").alias("f"), F.col("zscore").alias("x"))
    b = scores.select(*STATEMENT, F.col("factor").alias("g"), F.col("zscore").alias("y"))
    return a.join(b, STATEMENT).where("f < g").groupBy("study_id", "f", "g").agg(F.corr("x", "y").alias("r"))


def defining_correlations(sorts: DataFrame, flags: DataFrame) -> DataFrame:
    """Mean correlation among each factor's flagged sorts (null under two); ``flags`` carry ``p_idx``. A factor's sums are found as those of a study of its sorts."""
    from .correlation import pearson_sums

    f = flags.where("flagged").select("study_id", "factor", "p_idx")
    sums = pearson_sums(sorts.join(f, ["study_id", "p_idx"]), by=("study_id", "factor"))
    mean = sums.groupBy(*FACTOR).agg(F.try_divide(F.sum("r_sum"), F.sum("n_r")).alias("mean_r"), (F.sum("n_r") / 2).cast("long").alias("n_pairs"))
    return f.groupBy(*FACTOR).agg(F.count("*").alias("n_flagged")).join(mean, FACTOR, "left").select(*FACTOR, "n_flagged", "mean_r", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"))


def tucker(a: DataFrame, b: DataFrame) -> DataFrame:
    """Congruence of each factor of ``a`` with each of ``b`` over shared participants."""
    x = a.select(*PERSON, F.col("factor").alias("f"), F.col("loading").alias("x"))
    y = b.select(*PERSON, F.col("factor").alias("g"), F.col("loading").alias("y"))
    s = x.join(y, PERSON).groupBy("study_id", "f", "g").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return s.select("study_id", "f", "g", F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("phi"))


def rotate_manual(loadings: DataFrame, f1: int, f2: int, degrees: float) -> DataFrame:
    """Turns a pair of factors: f1' = f1 cos + f2 sin, f2' = f2 cos - f1 sin."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    both = Window.partitionBy(*PERSON)
    one, two = (F.max(F.when(F.col("factor") == f, F.col("loading"))).over(both) for f in (f1, f2))
    return loadings.withColumn("loading", F.when(F.col("factor") == f1, one * c + two * s).when(F.col("factor") == f2, two * c - one * s).otherwise(F.col("loading")))


def bipolar(loadings: DataFrame, threshold: float) -> DataFrame:
    """Per factor the sorts beyond ± threshold; two negative ones make it bipolar."""
    pos, neg = F.col("loading") > threshold, F.col("loading") < -threshold
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("participant")))), ",")
    out = loadings.groupBy(*FACTOR).agg(F.count_if(pos).alias("n_positive"), F.count_if(neg).alias("n_negative"), names(pos).alias("positive"), names(neg).alias("negative"))
    return out.withColumn("is_bipolar", F.col("n_negative") >= 2).withColumn("ratio", F.when(F.col("n_positive") > 0, F.col("n_negative") / F.col("n_positive")))


def split_bipolar(loadings: DataFrame, factor: int, threshold: float) -> DataFrame:
    """The negative pole of a factor as a new last factor of positive loadings; fewer than two negative sorts leave it alone."""
    study = Window.partitionBy("study_id")
    neg = (F.col("factor") == factor) & (F.col("loading") < -threshold)
    marked = loadings.withColumns({"_neg": neg, "_n": F.count_if(neg).over(study), "_last": F.max("factor").over(study)})
    moved = F.col("_neg") & (F.col("_n") >= 2)
    old = F.struct(F.col("factor"), F.when(moved, 0.0).otherwise(F.col("loading")).alias("loading"))
    new = F.struct((F.col("_last") + 1).alias("factor"), F.when(moved, -F.col("loading")).otherwise(0.0).alias("loading"))
    rows = F.when((F.col("factor") == factor) & (F.col("_n") >= 2), F.array(old, new)).otherwise(F.array(old))
    return marked.select(*PERSON, F.explode(rows).alias("x")).select(*PERSON, "x.factor", "x.loading")


def score_se(flags: DataFrame) -> DataFrame:
    """Standard error from loadings: reliability Σa² / (Σa² + Σ(1 - a²)/n) over at least two flagged sorts."""
    a2 = F.col("loading") * F.col("loading")
    s = flags.where("flagged").groupBy(*FACTOR).agg(F.count("*").alias("n_flagged"), F.sum(a2).alias("s"), F.sum(1 - a2).alias("u"))
    rel = F.col("s") / (F.col("s") + F.col("u") / F.col("n_flagged"))
    return s.select(*FACTOR, "n_flagged", F.when(F.col("n_flagged") >= 2, rel).alias("reliability"), F.when(F.col("n_flagged") >= 2, F.sqrt(1 - rel)).alias("se"))


def humphrey(loadings: DataFrame, statements: int) -> DataFrame:
    """Humphrey's rule and the two-loadings rule of each factor."""
    rank = F.row_number().over(Window.partitionBy(*FACTOR).orderBy(F.abs("loading").desc(), "participant"))
    top = loadings.withColumn("rn", rank).groupBy(*FACTOR).agg(F.max(F.when(F.col("rn") == 1, F.abs("loading"))).alias("a1"), F.max(F.when(F.col("rn") == 2, F.abs("loading"))).alias("a2"), F.count_if(F.abs("loading") > 1.96 / math.sqrt(statements)).alias("n_significant"))
    return top.select(*FACTOR, (F.col("a1") * F.col("a2")).alias("product"), (F.col("a1") * F.col("a2") > 2 / math.sqrt(statements)).alias("humphrey"), "n_significant", (F.col("n_significant") >= 2).alias("two_loadings"))


def membership_crosstab(flags: DataFrame, levels: DataFrame) -> DataFrame:
    """Membership by level with expected counts; ``levels(study_id, participant, level)``. Unflagged sorts are factor 0, confounded ones -1."""
    member = F.when(F.count_if("flagged") == 0, 0).when(F.count_if("flagged") > 1, -1).otherwise(F.max(F.when(F.col("flagged"), F.col("factor"))))
    m = flags.groupBy(*PERSON).agg(member.alias("member")).join(levels, PERSON)
    cells = m.groupBy("study_id", "member", "level").agg(F.count("*").alias("n"))
    rows, cols = cells.groupBy("study_id", "member").agg(F.sum("n").alias("row_n")), cells.groupBy("study_id", "level").agg(F.sum("n").alias("col_n"))
    grid = rows.join(cols, "study_id").join(cells, ["study_id", "member", "level"], "left")
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("study_id"))
    return grid.select("study_id", "member", "level", F.coalesce("n", F.lit(0)).alias("n"), (F.col("row_n") * F.col("col_n") / total).alias("expected"))


def chi_square(crosstab: DataFrame) -> DataFrame:
    d = F.col("n") - F.col("expected")
    return crosstab.groupBy("study_id").agg(F.sum(d * d / F.col("expected")).alias("chi2"), ((F.count_distinct("member") - 1) * (F.count_distinct("level") - 1)).alias("df"), (F.min("expected") >= 5).alias("chi2_applies"))


def loading_order(flags: DataFrame) -> DataFrame:
    """Participants grouped by the factor of their largest loading, largest first."""
    best = flags.groupBy(*PERSON).agg(F.max_by(F.struct("factor", "loading"), F.struct(F.abs("loading"), -F.col("factor"))).alias("b"))
    place = F.row_number().over(Window.partitionBy("study_id").orderBy("b.factor", F.abs("b.loading").desc(), "participant"))
    return best.select(*PERSON, F.col("b.factor").alias("dominant"), F.col("b.loading").alias("loading"), place.alias("place"))


def summary(flags: DataFrame, pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Counts of a solution: participants flagged once, never, more than once; distinguishing and consensus statements."""
    per = flags.groupBy(*PERSON).agg(F.count_if("flagged").alias("k"))
    people = per.groupBy("study_id").agg(F.count("*").alias("n_participants"), F.count_if(F.expr("k = 1")).alias("n_flagged"), F.count_if(F.expr("k = 0")).alias("n_unflagged"), F.count_if(F.expr("k > 1")).alias("n_confounded"))
    cls = statement_class(scores, pairs).groupBy("study_id").agg(F.count("*").alias("n_statements"), F.count_if(F.col("category").startswith("Dist")).alias("n_distinguishing"), F.count_if(F.col("category") == "Consensus").alias("n_consensus"))
    return people.join(cls, "study_id")


def grid_cards(scores: DataFrame, deck: list[int]) -> DataFrame:
    """Card coordinates of a factor array: column and row from the bottom, filled from low to high z."""
    order = F.row_number().over(Window.partitionBy(*FACTOR).orderBy("zscore", F.desc("stmt_num")))
    cards = scores.withColumn("grid_value", grid_at(order, fitted_deck(deck, sum(deck))))
    row = F.row_number().over(Window.partitionBy(*FACTOR, "grid_value").orderBy(F.desc("zscore"), "stmt_num"))
    return cards.select(*FACTOR, "stmt_num", "grid_value", row.alias("card_row"))


assert len(grid_values(9)) == 9
