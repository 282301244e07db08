"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with target weight w and n of all N rows is repeated at the mean rate
``w * size / n``. Each document draws its number of copies by inverting the
Poisson distribution at a uniform number hashed from its id and a seed, so the
draw doesn't depend on partitions, order or retries. Copies are exploded and
dealt to random partitions in random order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, read, shuffle_partitions, spare, stored

SEED = 20240501
#: Default target: weights in proportion to rows ** TEMPERATURE, as many rows as there are.
TEMPERATURE = 0.7
#: Largest rate inverted at once; a higher one is drawn as a sum of independent parts.
PART = 64.0
#: Rates of at most so many sources (1.5 KB each at most) are sent to all tasks; more are joined by hash.
SENT_SOURCES = 4_000
#: Bits of a uniform number.
BITS = 52


def uniform(*parts: Column | str | int) -> Column:
    """A number in (0, 1) hashed from ``parts``: the middle of one of 2**52 equal cells."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, int) else F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << BITS)


def poisson_terms(rate: float) -> int:
    """Terms after which the upper tail is below 2**-53."""
    return math.ceil(rate + 10 * math.sqrt(rate) + 40)


def cumulative(rate: Column) -> Column:
    """array: P(X <= 0), P(X <= 1), ... of a Poisson variable of mean ``rate`` (at most ``PART``), until the upper tail is below 2**-53."""
    zero = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.ceil(rate + 10 * F.sqrt(rate) + 40).cast("int")), zero, step, lambda a: a["all"])


def source_rates(docs: DataFrame, weights: DataFrame | None = None, size: int | None = None, source: str = "source", temperature: float = TEMPERATURE) -> DataFrame:
    """``(source, n, rate, parts, cdf)``: one row a source, with the mean number of copies of its rows.

    ``weights(source, weight)``: targets, normalised over the sources that have
    rows; absent sources and null or negative weights count as 0. Without it the
    weights go with ``n ** temperature``. ``size``: rows wanted, by default as
    many as there are. Null is a source of its own.
    """
    counts = stored(docs.groupBy(F.col(quoted(source)).alias("source")).agg(F.count("*").alias("n")))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        own = weights.groupBy(F.col("source").alias("s")).agg(F.max("weight").cast("double").alias("w"))
        weighed = counts.join(own, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)).alias("w"))
    total = weighed.agg(F.sum("w"), F.sum("n")).first()
    w, n = float(total[0] or 0), int(total[1] or 0)
    rate = F.col("w") / (w or 1.0) * float(n if size is None else size) / F.col("n")
    return (
        weighed.withColumn("rate", rate)
        .withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
        .withColumn("cdf", cumulative(F.col("rate") / F.col("parts")))
        .select("source", "n", "rate", "parts", "cdf")
    )


def copies(cdf: Column, parts: Column, seed: int, *key: str) -> Column:
    """Number of copies: for each part the least k whose cumulative probability reaches the uniform number."""
    # the numbers come first, so that each is hashed once and not for every term it is compared with
    numbers = F.transform(F.sequence(F.lit(1), parts), lambda i: uniform(F.lit(seed), *key, i))
    return F.aggregate(numbers, F.lit(0), lambda a, u: a + F.size(F.filter(cdf, lambda c: c < u)))


def mix(docs: DataFrame, weights: DataFrame | None = None, size: int | None = None, id_col: str = "doc_id", source: str = "source", seed: int = SEED, temperature: float = TEMPERATURE, copy: str | None = "copy_no", shuffle: bool = True) -> DataFrame:
    """The rows of ``docs``, each as often as its Poisson draw says, in random order.

    ``copy`` names an added column that numbers a row's copies from 0; a column
    of ``docs`` with that name is replaced. Sources keep their target share in
    the mean; no row is capped and a source of any size is drawn row by row.
    Rows with equal ids (null included) and sources draw alike. An empty table
    stays empty. Rates are a row a source: those of up to ``SENT_SOURCES``
    sources are sent to the tasks, so that documents move only once, in the
    shuffle of the result; those of more are joined by hash. ``shuffle``: deal
    the copies to random partitions, there sorted by a hash.
    """
    s, parts, cdf, k, c, h = (spare(docs, f"_vs_{x}") for x in ("s", "parts", "cdf", "k", "c", "h"))
    rates = stored(source_rates(docs, weights, size, source, temperature).select(F.col("source").alias(s), F.col("parts").alias(parts), F.col("cdf").alias(cdf)))
    if rates.count() <= SENT_SOURCES:
        rates = F.broadcast(rates)
    drawn = docs.join(rates, F.col(quoted(source)).eqNullSafe(F.col(s))).withColumn(k, copies(F.col(cdf), F.col(parts), seed, quoted(id_col))).where(F.col(k) > 0)
    out = drawn.select(*[F.col(quoted(x)) for x in docs.columns], F.explode(F.sequence(F.lit(0), F.col(k) - 1)).alias(c))
    if shuffle:
        out = out.withColumn(h, F.xxhash64(F.lit(seed), F.col(quoted(id_col)), F.col(c)))
        out = out.repartition(shuffle_partitions(docs.sparkSession), h).sortWithinPartitions(h)
    return out.select(*[F.col(quoted(x)) for x in docs.columns if x != copy], *([F.col(c).cast("int").alias(copy)] if copy else []))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


#: The same draw in DuckDB: rates by source, then the least k whose cumulative probability reaches the hashed number.
OP9_SQL = f"""
with recursive counts as (select source, count(*) as n from documents group by source),
total as (select sum(pow(n::double, {TEMPERATURE}::double)) as w, sum(n)::double as n from counts),
rates as (select source, pow(c.n::double, {TEMPERATURE}::double) / t.w * t.n / c.n as rate from counts c, total t),
parted as (select source, rate, greatest(1, ceil(rate / {PART}))::int as parts from rates),
terms as (
  select source, parts, rate / parts as r, 0 as k, exp(-(rate / parts)) as p, exp(-(rate / parts)) as c from parted
  union all
  select source, parts, r, k + 1, p * r / (k + 1), c + p * r / (k + 1) from terms where k < {poisson_terms(PART)}),
cdfs as (select source, any_value(parts) as parts, list(c order by k) as cdf from terms group by source),
drawn as (
  select d.*, list_sum(list_transform(range(1, f.parts + 1), lambda i:
    len(list_filter(f.cdf, lambda c: c < ((('0x' || substr(md5(concat_ws(':', '{SEED}', d.doc_id::varchar, i::varchar)), 1, {BITS // 4}))::bigint)::double + 0.5) / {1 << BITS}::double))))::bigint as k
  from documents d join cdfs f on d.source is not distinct from f.source)
select doc_id, text, lang, source, n_chars, unnest(range(0, k))::int as copy_no from drawn where k > 0
"""
