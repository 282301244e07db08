"""Studies: long sorts, decks, and the constructors that make them.

A study is a set of tables keyed by ``study_id``; the central one is
``sorts(study_id, participant, p_idx, stmt_num, value)``. Every operator groups
by ``study_id`` first, so many studies are one job.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SORTS = "study_id string, participant string, p_idx int, stmt_num int, value double"

# Default decks for up to so many statements.
DEFAULT_DECKS = {9: [1, 1, 2, 1, 1], 13: [1, 2, 2, 3, 2, 2, 1], 18: [1, 2, 3, 4, 3, 2, 1], 25: [1, 2, 3, 3, 5, 3, 3, 2, 1], 36: [2, 3, 4, 5, 6, 5, 4, 3, 2], 48: [2, 3, 4, 5, 6, 7, 6, 5, 4, 3, 2]}


def grid_values(columns: int) -> list[int]:
    """Grid values of a deck: -h..h, without 0 if the number of columns is even."""
    h = columns // 2
    return [v for v in range(-h, h + 1) if v or columns % 2]


def deck_neutral(deck: list[int]) -> float:
    """Mean grid value of a deck."""
    if not deck or any(q < 0 for q in deck) or sum(deck) == 0:
        raise ValueError("deck quotas must be non-negative and not all zero")
    return sum(q * v for q, v in zip(deck, grid_values(len(deck)), strict=True)) / sum(deck)


def default_deck(statements: int) -> list[int]:
    """The deck for ``statements`` statements: the smallest template that fits, the middle column taking the difference."""
    for most, deck in DEFAULT_DECKS.items():
        if statements <= most:
            out = list(deck)
            break
    else:
        columns = 11 if statements <= 60 else 13
        half = columns // 2
        weights = [1 + k for k in range(half)]
        out = [max(1, round(statements * w / (2 * sum(weights) + half + 1))) for w in weights]
        out = [*out, 0, *out[::-1]]
    out[len(out) // 2] = max(0, out[len(out) // 2] + statements - sum(out))
    return out


def fitted_deck(deck: list[int], statements: int) -> list[int]:
    """A deck scaled to ``statements``: rounded half to even, the rest in the middle column, a negative middle shared out evenly."""
    total = sum(deck)
    if total == statements:
        return list(deck)
    out = [round(q * statements / total) for q in deck]
    mid = math.ceil(len(out) / 2) - 1
    out[mid] += statements - sum(out)
    if out[mid] < 0:
        share, more = divmod(statements, len(out))
        out = [share + (k < more) for k in range(len(out))]
    return out


def deck_frame(spark: SparkSession, deck: list[int], study_id: str | None = None) -> DataFrame:
    """``(col_idx, grid_value, quota, first, last)``: the deck's columns with the positions they cover, from the lowest."""
    rows, at = [], 0
    for k, (v, q) in enumerate(zip(grid_values(len(deck)), deck, strict=True), 1):
        rows.append((k, v, q, at + 1, at + q))
        at += q
    out = spark.createDataFrame(rows, "col_idx int, grid_value int, quota int, first int, last int")
    return out.withColumn("study_id", F.lit(study_id)) if study_id is not None else out


def grid_at(position: Column, deck: list[int]) -> Column:
    """Grid value at a position (1 is lowest) of a deck; a literal lookup, no join."""
    values = [v for v, q in zip(grid_values(len(deck)), deck, strict=True) for _ in range(q)]
    return F.element_at(F.array(*[F.lit(v) for v in values]), position.cast("int"))


def unique_ids(df: DataFrame, id_col: str, by: list[str], order: list[str]) -> DataFrame:
    """Later holders of an id get ``_1``, ``_2``, ... in ``order``."""
    n = F.row_number().over(Window.partitionBy(*by, id_col).orderBy(*order)) - 1
    return df.withColumn(id_col, F.when(n == 0, F.col(id_col)).otherwise(F.concat_ws("_", F.col(id_col), n.cast("string"))))


def wide_to_long(wide: DataFrame, statements: list[str], participant: str = "participant", study_id: str = "study_id", order: str | None = None) -> DataFrame:
    """Sorts of a table with a column for each statement; what doesn't read as a number is null. Repeated ids are made unique."""
    keep = [study_id, participant] + ([order] if order else [])
    df = wide.select(*keep, *[F.expr(f"try_cast(`{s}` as double)").alias(f"s{k}") for k, s in enumerate(statements, 1)])
    df = unique_ids(df, participant, [study_id], [order or participant])
    idx = F.dense_rank().over(Window.partitionBy(study_id).orderBy(*([order] if order else []), participant))
    df = df.withColumn("p_idx", idx)
    values = F.posexplode(F.array(*[f"s{k}" for k in range(1, len(statements) + 1)])).alias("at", "value")
    return df.select(F.col(study_id).alias("study_id"), F.col(participant).cast("string").alias("participant"), "p_idx", values).select("study_id", "participant", "p_idx", (F.col("at") + 1).alias("stmt_num"), "value")


def long_to_wide(sorts: DataFrame, statements: int) -> DataFrame:
    """A row for each participant with columns ``s1``..; the number of statements is stated, so no extra job looks for it."""
    return sorts.groupBy("study_id", "participant").pivot("stmt_num", list(range(1, statements + 1))).agg(F.first("value")).withColumnsRenamed({str(k): f"s{k}" for k in range(1, statements + 1)})


def inferred_deck(sorts: DataFrame) -> DataFrame:
    """``(study_id, grid_value, quota)``: the commonest number of cards that participants put on each value, the smaller of equals.

    Values run from the least to the greatest; participants who leave one out count as 0 there.
    """
    span = sorts.groupBy("study_id").agg(F.floor(F.min("value")).cast("int").alias("lo"), F.ceil(F.max("value")).cast("int").alias("hi"))
    people = sorts.select("study_id", "participant").distinct().join(span, "study_id")
    cells = people.select("study_id", "participant", F.explode(F.sequence("lo", "hi")).alias("grid_value"))
    counts = sorts.groupBy("study_id", "participant", F.col("value").cast("int").alias("grid_value")).agg(F.count("*").alias("n"))
    filled = cells.join(counts, ["study_id", "participant", "grid_value"], "left").select("study_id", "grid_value", F.coalesce("n", F.lit(0)).alias("quota"))
    modes = filled.groupBy("study_id", "grid_value", "quota").agg(F.count("*").alias("votes"))
    best = F.row_number().over(Window.partitionBy("study_id", "grid_value").orderBy(F.desc("votes"), "quota"))
    return modes.withColumn("rn", best).where("rn = 1").select("study_id", "grid_value", F.col("quota").cast("long").alias("quota"))


# --- a study from the star-schema tables -----------------------------------------------------------

DECK = [1, 2, 3, 3, 7, 3, 3, 2, 1]
STATEMENTS = 25
#: Points that a region's viewpoint adds to the mean quantity.
PLANTED = 40


def preference(j: Column, region: Column | int) -> Column:
    """The viewpoint of a region: how much it favours statement ``j``."""
    return (j * (2 * (F.lit(region) if isinstance(region, int) else region) + 3)) % STATEMENTS


def supplier_brand_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorts of suppliers over brands: mean quantities with a planted preference of each region, dealt on a forced deck."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    cells = read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))
    regions = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("r"))
    # brands are a fixed set of 25; ranking inside each supplier avoids a global window because every cell is filled
    own = Window.partitionBy("l_suppkey")
    ranked = cells.withColumn("j", F.row_number().over(own.orderBy("p_brand")))
    score = F.floor(F.col("qty").cast("double") * 100 / F.col("n")) + PLANTED * preference(F.col("j"), F.col("r"))
    scored = ranked.join(regions, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("score", score)
    pos = F.row_number().over(own.orderBy("score", "j"))
    return scored.select(
        F.lit("supplier_brand").alias("study_id"),
        F.col("l_suppkey").cast("string").alias("participant"),
        F.col("l_suppkey").cast("int").alias("p_idx"),
        F.col("j").cast("int").alias("stmt_num"),
        grid_at(pos, DECK).cast("double").alias("value"),
    )


def supplier_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(study_id, participant, region, region_key, acctbal, band, pair)``: attributes of the suppliers."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    s = read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    bal = F.col("s_acctbal").cast("double")
    return s.select(
        F.lit("supplier_brand").alias("study_id"),
        F.col("s_suppkey").cast("string").alias("participant"),
        F.col("r_name").alias("region"),
        F.col("n_regionkey").cast("int").alias("region_key"),
        bal.alias("acctbal"),
        F.when(bal < 2000, "1 low").when(bal < 6000, "2 middle").otherwise("3 high").alias("band"),
        F.when(F.col("n_regionkey") <= 1, "first").otherwise("rest").alias("pair"),
    )


def preview(sorts: DataFrame, participants: list[str], names: DataFrame | None = None) -> DataFrame:
    """Statements down, the named participants across: number, text and a column ``v1``.. for each of ``participants``."""
    own = sorts.where(F.col("participant").isin(participants))
    wide = own.groupBy("study_id", "stmt_num").pivot("participant", participants).agg(F.first("value")).withColumnsRenamed({p: f"v{k}" for k, p in enumerate(participants, 1)})
    fallback = F.concat(F.lit("Statement "), F.col("stmt_num").cast("string"))
    if names is None:
        return wide.withColumn("statement", fallback)
    return wide.join(names.select("study_id", "stmt_num", F.col("text").alias("statement")), ["study_id", "stmt_num"], "left").withColumn("statement", F.coalesce("statement", fallback))


def modal_deck(sorts: DataFrame) -> DataFrame:
    """``(study_id, shape, votes)``: the commonest whole shape of a sort, as its counts by value; the first by name of equals."""
    cells = sorts.where("value is not null").groupBy("study_id", "participant", "value").agg(F.count("*").alias("n"))
    shapes = cells.groupBy("study_id", "participant").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value", "n"))), lambda x: F.concat_ws(":", x["value"].cast("int").cast("string"), x["n"].cast("string"))), ",").alias("shape"))
    votes = shapes.groupBy("study_id", "shape").agg(F.count("*").alias("votes"))
    return votes.groupBy("study_id").agg(F.min_by(F.struct("shape", "votes"), F.struct(-F.col("votes"), "shape")).alias("b")).select("study_id", "b.shape", "b.votes")
