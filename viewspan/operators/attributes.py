"""Participant attributes: matching to sorts, types, binning, groups.

Attribute tables are long, ``(study_id, row, attribute, raw)``, as they come
from files of any width; ids are matched by joins on normalised keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How ranges and numbers are recognised, and names that mark an id column.
RANGE = r"^\s*-?[0-9]+\s*(?:-|–|to)\s*-?[0-9]+\s*$|^\s*[0-9]+\s*\+\s*$"
NUMBER = r"^\s*-?[0-9.]+\s*$"
ID_NAME = r"(?i)^id$|participant|record"
PREFIX = r"^(qsort|q|p|s)0*"


def id_key(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def stripped_key(c: Column) -> Column:
    return F.regexp_replace(id_key(c), PREFIX, "")


def is_range(c: Column) -> Column:
    return c.rlike(RANGE)


def lower_bound(c: Column) -> Column:
    return F.expr("null").cast("int") if c is None else F.regexp_extract(c, r"(-?[0-9]+)", 1).try_cast("int")


def id_column(participants: DataFrame, attributes: DataFrame) -> DataFrame:
    """``(study_id, attribute, overlap, normalized)``: the column whose values match most participants.

    Ties go to a column with the name of an id, then to the first by name. If
    nothing matches, prefixes (qsort, q, p, s and zeros) are taken off both sides.
    """
    out = None
    for normalized, key in ((False, id_key), (True, stripped_key)):
        p = participants.select("study_id", key(F.col("participant")).alias("k")).where("k <> ''").distinct()
        a = attributes.select("study_id", "attribute", key(F.col("raw")).alias("k")).where("k <> ''").distinct()
        hit = a.join(p, ["study_id", "k"]).groupBy("study_id", "attribute").agg(F.count("*").alias("overlap")).withColumn("normalized", F.lit(normalized))
        out = hit if out is None else out.union(hit)
    best = F.row_number().over(Window.partitionBy("study_id").orderBy("normalized", F.desc("overlap"), F.desc(F.col("attribute").rlike(ID_NAME)), "attribute"))
    return out.withColumn("_rn", best).where("_rn = 1").drop("_rn")


def match(participants: DataFrame, attributes: DataFrame) -> DataFrame:
    """``(study_id, participant, row)``: the attribute row of each participant, null without one; of several rows the first."""
    chosen = id_column(participants, attributes)
    rows = attributes.join(chosen.select("study_id", "attribute", "normalized"), ["study_id", "attribute"])
    k = F.when(F.col("normalized"), stripped_key(F.col("raw"))).otherwise(id_key(F.col("raw")))
    rows = rows.withColumn("k", k).where("k <> ''").groupBy("study_id", "k").agg(F.min("row").alias("row"))
    p = participants.join(chosen.select("study_id", "normalized"), "study_id", "left")
    p = p.withColumn("k", F.when(F.coalesce("normalized", F.lit(False)), stripped_key(F.col("participant"))).otherwise(id_key(F.col("participant"))))
    return p.join(rows, ["study_id", "k"], "left").select("study_id", "participant", "row")


def match_report(participants: DataFrame, attributes: DataFrame) -> DataFrame:
    """Per study: matched and unmatched participants, rows used and unused, the id column and whether prefixes were taken off."""
    m = match(participants, attributes).groupBy("study_id").agg(F.count("row").alias("matched"), F.count_if(F.col("row").isNull()).alias("unmatched"), F.count_distinct("row").alias("used"))
    rows = attributes.groupBy("study_id").agg(F.count_distinct("row").alias("rows"))
    return m.join(rows, "study_id", "left").join(id_column(participants, attributes), "study_id", "left").select("study_id", F.col("attribute").alias("id_col"), "matched", "unmatched", (F.coalesce("rows", F.lit(0)) - F.col("used")).alias("unused_rows"), F.coalesce("normalized", F.lit(False)).alias("normalized"))


def attach(participants: DataFrame, attributes: DataFrame) -> DataFrame:
    """``(study_id, participant, attribute, raw)`` for matched participants, the id column and identifier-like ones set aside."""
    aside = set_aside(attributes).where("set_aside").select("study_id", "attribute")
    own = id_column(participants, attributes).select("study_id", "attribute")
    kept = attributes.join(aside.union(own), ["study_id", "attribute"], "left_anti")
    return match(participants, attributes).where("row is not null").join(kept, ["study_id", "row"]).select("study_id", "participant", "attribute", "raw")


def set_aside(attributes: DataFrame, least: int = 12) -> DataFrame:
    """Columns that only identify: an id's name, or text that never repeats over at least ``least`` values."""
    text = F.count_if(~F.coalesce(F.col("raw").rlike(NUMBER), F.lit(True))) > 0
    s = attributes.where("raw is not null and trim(raw) <> ''").groupBy("study_id", "attribute").agg(F.count("*").alias("n"), F.count_distinct("raw").alias("d"), text.alias("text"))
    return s.select("study_id", "attribute", (F.col("attribute").rlike(r"(?i)^id$|record.?id|participant.?id") | (F.col("text") & (F.col("n") == F.col("d")) & (F.col("n") >= least))).alias("set_aside"))


def detect_types(attributes: DataFrame) -> DataFrame:
    """``(study_id, attribute, type, n_levels, levels)``: numeric, ordinal (all values are ranges, by lower bound) or categorical (by name)."""
    v = attributes.where("raw is not null and trim(raw) <> ''").select("study_id", "attribute", F.trim("raw").alias("raw"))
    numeric = F.bool_and(F.col("raw").rlike(NUMBER) & F.col("raw").try_cast("double").isNotNull())
    s = v.groupBy("study_id", "attribute").agg(numeric.alias("numeric"), F.bool_and(is_range(F.col("raw"))).alias("ranges"), F.collect_set(F.struct(F.when(is_range(F.col("raw")), lower_bound(F.col("raw"))).alias("lo"), F.col("raw").alias("raw"))).alias("l"))
    by_bound = F.transform(F.array_sort("l"), lambda x: x["raw"])
    by_name = F.array_sort(F.transform("l", lambda x: x["raw"]))
    kind = F.when(F.col("numeric"), "numeric").when(F.col("ranges"), "ordinal").otherwise("categorical")
    return s.select("study_id", "attribute", kind.alias("type"), F.size("l").alias("n_levels"), F.when(F.col("numeric"), F.lit(None)).when(F.col("ranges"), by_bound).otherwise(by_name).alias("levels"))


def bin_numeric(value: Column, breaks: list[float], labels: list[str]) -> Column:
    """Right-closed intervals, the first closed on both sides; outside is null."""
    if any(a >= b for a, b in zip(breaks, breaks[1:], strict=False)) or len(labels) != len(breaks) - 1:
        raise ValueError("breaks must rise strictly and labels must be one fewer")
    out = F.when((value >= breaks[0]) & (value <= breaks[1]), labels[0])
    for lo, hi, name in zip(breaks[1:], breaks[2:], labels[1:], strict=False):
        out = out.when((value > lo) & (value <= hi), name)
    return out


def bin_map(value: Column, mapping: dict[str, str | None]) -> Column:
    """Recoded levels; null targets and levels without a target are null."""
    pairs = [F.lit(x) for k, v in mapping.items() if v is not None for x in (k, v)]
    return F.try_element_at(F.create_map(*pairs), value) if pairs else F.lit(None).cast("string")


def with_min_n(groups: DataFrame, min_n: int) -> DataFrame:
    """Levels of fewer than ``min_n`` participants become null."""
    n = F.count("*").over(Window.partitionBy("study_id", "attribute", "level"))
    return groups.withColumn("_n", n).withColumn("level", F.when(F.col("_n") >= min_n, F.col("level"))).drop("_n")


def absorb_ranges(raw: DataFrame, typed: DataFrame) -> DataFrame:
    """Raw bands ``(raw)`` that lie inside typed bands ``(band)``: a range join on bounds, the narrowest band winning.

    Bands are bucketed by the tens they cover, so that the join has an equal key.
    """
    lo = lambda c: F.regexp_extract(c, r"^\s*([0-9]+)", 1).try_cast("int")
    hi = lambda c: F.when(F.col(c).rlike(r"\+\s*$"), 1000).otherwise(F.coalesce(F.regexp_extract(c, r"([0-9]+)\s*$", 1).try_cast("int"), lo(c)))
    r = raw.select("raw", lo("raw").alias("r_lo"), hi("raw").alias("r_hi")).withColumn("k", F.floor(F.col("r_lo") / 10))
    t = typed.select("band", lo("band").alias("t_lo"), hi("band").alias("t_hi")).withColumn("k", F.explode(F.sequence(F.floor(F.col("t_lo") / 10), F.floor(F.col("t_hi") / 10))))
    hit = r.join(t, "k").where("r_lo >= t_lo and r_hi <= t_hi")
    return hit.groupBy("raw").agg(F.min_by("band", F.struct(F.col("t_hi") - F.col("t_lo"), F.col("band"))).alias("band"))


# --- attribute tables and their specification ----------------------------------------------------------


def realigned(participants: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row a participant and attribute by the participant's own name: the first of several rows, null where there is none.

    ``attributes(study_id, participant, row, attribute, raw)``.
    """
    own = attributes.groupBy("study_id", "participant", "attribute").agg(F.min_by("raw", "row").alias("raw"))
    names = attributes.select("study_id", "attribute").distinct()
    return participants.select("study_id", "participant").join(names, "study_id").join(own, ["study_id", "participant", "attribute"], "left").select("study_id", "participant", "attribute", "raw")


def participant_attributes(participants: DataFrame, attributes: DataFrame | None, legacy: DataFrame | None = None) -> DataFrame:
    """A study's attributes; studies without any take those of the older demographics table."""
    if attributes is None:
        return realigned(participants, legacy)
    own = realigned(participants, attributes)
    if legacy is None:
        return own
    return own.unionByName(realigned(participants, legacy).join(attributes.select("study_id").distinct(), "study_id", "left_anti"))


def has_attributes(participants: DataFrame, attributes: DataFrame) -> DataFrame:
    """Per study whether it has any attribute value."""
    any_value = attributes.groupBy("study_id").agg((F.count("raw") > 0).alias("has"))
    return participants.select("study_id").distinct().join(any_value, "study_id", "left").select("study_id", F.coalesce("has", F.lit(False)).alias("has_attributes"))


def alignment_errors(participants: DataFrame, attributes: DataFrame) -> DataFrame:
    """Rows that keep attributes from being set: participants without a row, with several, and rows of nobody."""
    rows = attributes.groupBy("study_id", "participant").agg(F.count_distinct("row").alias("n"))
    p = participants.select("study_id", "participant").distinct().withColumn("known", F.lit(True))
    both = p.join(rows, ["study_id", "participant"], "full")
    error = F.when(F.col("known").isNull(), "not a participant").when(F.col("n").isNull(), "no attribute row").when(F.col("n") > 1, "several attribute rows")
    return both.select("study_id", "participant", error.alias("error")).where("error is not null")


def merged_spec(detected: DataFrame, supplied: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """``(study_id, attribute, type, levels)``: what was detected fills up what is supplied, which overrides only what it names over what was there."""
    out = detected.select("study_id", "attribute", F.col("type").alias("t0"), F.col("levels").alias("l0"))
    for k, spec in enumerate((supplied, existing), 1):
        s = spec.select("study_id", "attribute", F.col("type").alias(f"t{k}"), F.col("levels").alias(f"l{k}")) if spec is not None else None
        out = out.join(s, ["study_id", "attribute"], "left") if s is not None else out.withColumns({f"t{k}": F.lit(None).cast("string"), f"l{k}": F.lit(None).cast("array<string>")})
    return out.select("study_id", "attribute", F.coalesce("t1", "t2", "t0").alias("type"), F.coalesce("l1", "l2", "l0").alias("levels"))


def bad_types(attributes: DataFrame, spec: DataFrame) -> DataFrame:
    """Specified attributes that the data contradict: values that aren't numbers, or levels that the specification doesn't list."""
    v = attributes.where("raw is not null").join(spec, ["study_id", "attribute"])
    number = (F.col("type") == "numeric") & F.col("raw").try_cast("double").isNull()
    level = (F.col("type") != "numeric") & ~F.array_contains("levels", F.col("raw"))
    return v.where(number | level).groupBy("study_id", "attribute").agg(F.count("*").alias("n_bad"), F.min("raw").alias("example"))


def checked_binning(kind: str, levels: list[str] | None = None, breaks: list[float] | None = None, labels: list[str] | None = None, mapping: dict[str, str | None] | None = None, order: list[str] | None = None) -> dict:
    """A binning as settings, or ValueError: breaks that rise and one label fewer for numbers, else a map of every level whose targets are the order's."""
    if kind == "numeric":
        if not breaks or len(breaks) < 2 or any(a >= b for a, b in zip(breaks, breaks[1:], strict=False)) or len(labels or []) != len(breaks) - 1:
            raise ValueError("breaks must rise strictly and labels must be one fewer")
        return {"kind": kind, "breaks": list(breaks), "labels": list(labels)}
    if not mapping or set(levels or []) - set(mapping):
        raise ValueError("the map must cover every level")
    targets = {v for v in mapping.values() if v is not None}
    if order is not None and (set(order) != targets or len(order) != len(targets)):
        raise ValueError("the order must hold the map's targets, each once")
    return {"kind": kind, "mapping": dict(mapping), "order": list(order or sorted(targets))}


def binned(attributes: DataFrame, bins: dict[str, dict]) -> DataFrame:
    """``level`` of each value under the binnings by attribute; an attribute without one (or with its binning taken back) keeps its values."""
    level = F.col("raw")
    for name, b in bins.items():
        own = bin_numeric(F.col("raw").try_cast("double"), b["breaks"], b["labels"]) if b["kind"] == "numeric" else bin_map(F.col("raw"), b["mapping"])
        level = F.when(F.col("attribute") == name, own).otherwise(level)
    return attributes.select("study_id", "participant", "attribute", level.alias("level"))


def median_bins(attributes: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """Numeric attributes split at their median, which falls to the lower half."""
    v = attributes.withColumn("num", F.col("raw").try_cast("double")).where("num is not null")
    med = F.median("num").over(Window.partitionBy("study_id", "attribute"))
    return v.select("study_id", "participant", "attribute", F.when(F.col("num") <= med, low).otherwise(high).alias("level"))


def renamed(mapping: dict[str, str | None], *more: dict[str, str | None]) -> dict[str, str | None]:
    """Renames one after the other as one map: a later one sees what the earlier ones made."""
    out = dict(mapping)
    for m in more:
        out = {k: m.get(v, v) if v is not None else None for k, v in out.items()}
    return out


def full_report(participants: DataFrame, attributes: DataFrame) -> DataFrame:
    """``match_report`` with the ids that several rows share, the columns set aside, whether all is aligned, and messages."""
    chosen = id_column(participants, attributes)
    keys = attributes.join(chosen.select("study_id", "attribute", "normalized"), ["study_id", "attribute"]).withColumn("k", F.when(F.col("normalized"), stripped_key(F.col("raw"))).otherwise(id_key(F.col("raw")))).where("k <> ''")
    twice = keys.groupBy("study_id", "k").agg(F.count("*").alias("n")).where("n > 1").groupBy("study_id").agg(F.count("*").alias("duplicates"))
    aside = set_aside(attributes).where("set_aside").groupBy("study_id").agg(F.array_join(F.array_sort(F.collect_list("attribute")), ",").alias("set_aside"))
    out = match_report(participants, attributes).join(twice, "study_id", "left").join(aside, "study_id", "left").fillna(0, ["duplicates"]).fillna("", ["set_aside"])
    said = [
        F.when(F.col("unmatched") > 0, F.concat(F.col("unmatched").cast("string"), F.lit(" participants have no attribute row"))),
        F.when(F.col("unused_rows") > 0, F.concat(F.col("unused_rows").cast("string"), F.lit(" attribute rows match no participant"))),
        F.when(F.col("duplicates") > 0, F.concat(F.col("duplicates").cast("string"), F.lit(" ids come more than once; the first row counts"))),
        F.when(F.col("normalized"), F.lit("ids matched without their prefixes and leading zeros")),
    ]
    return out.withColumn("aligned", (F.col("unmatched") == 0) & (F.col("unused_rows") == 0) & (F.col("duplicates") == 0)).withColumn("messages", F.concat_ws("; ", *said))
