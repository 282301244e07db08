"""Merkle manifest of a dataset: ranks from digit histograms, trie nodes keyed by rank digits, proofs.

1. A leaf is the SHA-256 of a row's fields, each with its length.
2. The rank of a leaf in its source is found without a sort of the table. Ids are
   counted, the counts are added up digit by digit (a digit is 12 bits of the
   id), and the number of smaller ids is the sum, over the digits, of the counts
   of smaller digits under the same prefix. Every window is over one prefix and
   so over 4,096 rows at most. Equal ids are ranked the same way by the digits of
   their leaves, and equal leaves by the digits of a row number, so no number of
   copies is in one window.
3. Rank digits to the base of the fanout are the keys of a trie. Nodes of the
   longest prefix are reduced first: a group of up to 16 children gives the next
   node, and each level has a sixteenth of the rows of the one below.
4. Going down again, every run of leaves gets the siblings of its ancestors as one
   array, once for the run; leaves are folded with it where they stand.

Nothing but the largest counts, which set the number of levels, reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, read, stored

FANOUT = 16
#: Bits of a digit of the histograms, hence the most rows of a window: 2 ** DIGIT.
DIGIT = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case and nothing else; the fast built-in where all is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWERED))


def _field(c: Column) -> Column:
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (hex) of the fields: ``-`` for null, else UTF-8 length, a colon and the value."""
    return _sha(F.concat(*[_field(c) for c in fields]))


# --- ranks ----------------------------------------------------------------------------------------


def with_ranks(rows: DataFrame, group: list[str], key: str, start: str, same: str) -> tuple[DataFrame, int]:
    """``rows`` with ``start``, the number of rows of the group with a smaller ``key`` (a long; null is the least), and ``same``, that with an equal one; and the largest ``same``.

    The histogram of the keys is added up over their 12-bit digits; a window
    never has more rows than a digit has values, however rows are distributed,
    and repeated keys are counted before anything is shuffled.
    """
    counts = stored(rows.groupBy(*group, F.col(key).alias("k")).agg(F.count("*").alias("c")))
    least, largest, most = counts.agg(F.min("k"), F.max("k"), F.max("c")).first()
    span = 0 if least is None else largest - least
    # the key as an unsigned number; null has prefix and digit -1, before all others
    number = F.col("k").bitwiseXOR(F.lit(-(1 << 63))) if span >> 63 else F.col("k") - F.lit(least or 0)
    prefix = lambda c: F.coalesce(F.shiftrightunsigned(c, DIGIT), F.lit(-1))
    digit = lambda c: F.coalesce(c.bitwiseAND(F.lit((1 << DIGIT) - 1)), F.lit(-1))
    levels = [counts.select(*group, "k", "c", prefix(number).alias("p"), digit(number).alias("d"))]
    for _ in range(-(-span.bit_length() // DIGIT) - 1):
        up = levels[-1].groupBy(*group, F.col("p").alias("k")).agg(F.sum("c").alias("c"))
        known = F.when(F.col("k") >= 0, F.col("k"))
        levels.append(up.select(*group, "k", "c", prefix(known).alias("p"), digit(known).alias("d")))
    top = levels[-1].groupBy(*group, "p").agg(F.sum("c").alias("c"))  # -1 and 0
    before = top.select(*group, "p", (F.sum("c").over(Window.partitionBy(*group).orderBy("p")) - F.col("c")).alias("before"))
    here = Window.partitionBy(*group, "p").orderBy("d")
    for level in reversed(levels):
        inside = level.withColumn("inside", F.sum("c").over(here) - F.col("c"))
        known = _same(inside, before, [*group, "p"]).select(*[f"l.{g}" for g in group], "l.k", "l.c", (F.col("l.inside") + F.col("r.before")).alias("before"))
        before = known.select(*group, F.col("k").alias("p"), "before")
    keyed = known.select(*group, F.col("k").alias(key), F.col("before").alias(start), F.col("c").alias(same))
    return _same(rows, keyed, [*group, key]).select("l.*", f"r.{start}", f"r.{same}"), most or 0


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null; sides are ``l`` and ``r``."""
    on = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    return left.alias("l").join(right.alias("r"), on)


def leaf_ranks(leaves: DataFrame, group: str = "source", id_col: str = "id", leaf: str = "leaf", seq: str = "seq") -> DataFrame:
    """``leaves`` with ``r``, the place from 0 in the group by id (null first), then by leaf, then by row number."""
    ranked, most = with_ranks(leaves, [group], id_col, "r", "same")
    if most <= 1:
        return ranked.drop("same")
    ranked = stored(ranked)
    # 60 bits of the digest; leaves that share them (in practice equal ones) go by row number
    ties = ranked.where("same > 1").drop("same").withColumn("lead", F.conv(F.substring(leaf, 1, 15), 16, 10).cast("long"))
    ties, most = with_ranks(ties, [group, id_col], "lead", "r2", "same")
    ties = stored(ties.withColumn("r", F.col("r") + F.col("r2")).drop("r2"))
    alone = ranked.where("same = 1").unionByName(ties.where("same = 1").drop("lead")).drop("same")
    if most <= 1:
        return alone
    equal, _ = with_ranks(ties.where("same > 1").drop("same"), [group, id_col, "lead"], seq, "r3", "same")
    return alone.unionByName(equal.withColumn("r", F.col("r") + F.col("r3")).drop("lead", "r3", "same"))


def text_ranks(names: DataFrame, name: str) -> DataFrame:
    """``names`` (distinct strings) with ``r``, their place from 0: null first, then by bytes.

    As long as more names share a prefix than a window may hold, prefixes get
    three hexadecimal digits longer and the counts of smaller digits are added.
    """
    key = F.coalesce(F.concat(F.lit("1"), F.hex(F.col(name).cast("binary"))), F.lit(""))
    rows = names.withColumns({"_key": key, "_bucket": F.lit(""), "_start": F.lit(0).cast("long")})
    most, width = names.count(), 0
    while most > 1 << DIGIT:
        rows = rows.withColumn("_digit", F.substring("_key", width + 1, DIGIT // 4))
        counts = rows.groupBy("_bucket", "_digit").agg(F.count("*").alias("_c"))
        offsets = counts.withColumn("_o", F.sum("_c").over(Window.partitionBy("_bucket").orderBy("_digit")) - F.col("_c"))
        rows = rows.join(offsets, ["_bucket", "_digit"]).withColumns({"_bucket": F.concat("_bucket", "_digit"), "_start": F.col("_start") + F.col("_o")}).drop("_digit", "_c", "_o")
        rows = stored(rows)
        width += DIGIT // 4
        most = rows.groupBy("_bucket").count().agg(F.max("count")).first()[0]
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key")) - 1
    return rows.select(*names.columns, (F.col("_start") + place).alias("r"))


# --- the trie -------------------------------------------------------------------------------------


def _levels(most: int) -> int:
    """Levels of nodes above ``most`` nodes."""
    n = 0
    while most > 1:
        most, n = -(-most // FANOUT), n + 1
    return n


def _grouped(nodes: DataFrame, group: list[str], n: str) -> DataFrame:
    """Groups of children ``(group, n, p, kids)``: nodes ``(group, n, p, digest)`` with one prefix of rank digits, in order.

    ``n`` counts the nodes of the level; a group that has only one is finished and isn't taken up again.
    """
    up = nodes.where(F.col(n) > 1).groupBy(*group, n, F.shiftright("p", 4).alias("p"))
    kids = up.agg(F.sort_array(F.collect_list(F.struct(F.col("p").bitwiseAND(F.lit(FANOUT - 1)).alias("d"), "digest"))).alias("kids"))
    return kids.select(*group, (F.shiftright(F.col(n) - 1, 4) + 1).alias(n), "p", F.transform("kids", lambda k: k["digest"]).alias("kids"))


def _digest_of(kids: DataFrame, group: list[str], n: str) -> DataFrame:
    return kids.select(*group, n, "p", _sha(F.array_join("kids", "")).alias("digest"))


def _joined(kids: Column, first, length) -> Column:
    return F.array_join(F.slice(kids, first, length), "")


def _with_up(level: DataFrame, group: list[str]) -> DataFrame:
    """For each child of the groups of ``level`` ``(.., p, kids, up)``: ``(.., p, up)``, siblings of its own level first."""
    child = level.select(*group, "p", "kids", "up", F.posexplode("kids").alias("i", "_"))
    own = F.struct(_joined(F.col("kids"), F.lit(1), F.col("i")).alias("l"), _joined(F.col("kids"), F.col("i") + 2, F.lit(FANOUT)).alias("r"))
    return child.select(*group, (F.col("p") * FANOUT + F.col("i")).alias("p"), F.concat(F.array(own), "up").alias("up"))


def _downwards(levels: list[DataFrame], group: list[str], top: DataFrame | None) -> DataFrame | None:
    """``(group, p, up)`` of the nodes under the lowest of ``levels``, if there are any; ``top`` has the ``up`` of each group's uppermost node (none: empty)."""
    path = None
    for level in reversed(levels):
        ends = level.where("n = 1").drop("n")
        here = _same(ends, top, group).select("l.*", "r.up") if top is not None else ends.withColumn("up", F.expr(EMPTY))
        if path is not None:
            here = here.unionByName(_same(level.where("n > 1").drop("n"), path, [*group, "p"]).select("l.*", "r.up"))
        path = _with_up(here, group)
    return path


#: The path of a root to itself.
EMPTY = "cast(array() as array<struct<l: string, r: string>>)"


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group: str = "source", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id_col, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``fields`` make the leaf, in order. In a ``group`` leaves ascend by id; every
    16 consecutive nodes are hashed to one until one is left, the subroot, and
    subroots (null group first, then by bytes) are reduced to the root likewise.
    ``folded_root`` is computed from the row's leaf and its siblings; where
    ``tampered`` (a condition on ``docs``) holds, from the leaf with the text's
    A-Z in lower case, as a reader of changed data would find it.

    Ids are integers (a null id comes first). Repeated ids go by leaf, and rows
    equal in all fields are interchangeable. Null and empty fields differ (``-``
    and ``0:``). Other columns aren't read; an empty table gives no rows.
    """
    col = lambda c: F.col(quoted(c))
    changed = tampered if tampered is not None else F.lit(False)
    honest = [col(c) for c in fields]
    false = [ascii_lower(col(c)) if c == text else col(c) for c in fields]
    leaves = docs.select(col(group).cast("string").alias("source"), col(id_col).cast("long").alias("id"), leaf_digest(honest).alias("leaf"), F.when(changed, leaf_digest(false)).alias("other"))
    leaves = stored(leaves.withColumn("seq", F.monotonically_increasing_id()))
    ranked = leaf_ranks(leaves)
    sizes = stored(leaves.groupBy("source").agg(F.count("*").alias("n")))
    most, n_groups = sizes.agg(F.max("n"), F.count("*")).first()
    digit = F.col("r").bitwiseAND(F.lit(FANOUT - 1))
    runs = ranked.groupBy("source", F.shiftright("r", 4).alias("p")).agg(F.sort_array(F.collect_list(F.struct(digit.alias("d"), "leaf", "other", "id"))).alias("docs"))
    runs = stored(_same(runs, sizes, ["source"]).select("l.*", "r.n"))
    leaf_list = F.transform("docs", lambda d: d["leaf"])
    lone = F.col("n") == 1
    node = runs.select("source", (F.shiftright(F.col("n") - 1, 4) + 1).alias("n"), "p", F.when(lone, F.element_at(leaf_list, 1)).otherwise(_sha(F.array_join(leaf_list, ""))).alias("digest"))
    source_levels, ends = [], [node.where("n = 1")]
    for _ in range(_levels(most or 0) - 1):
        kids = stored(_grouped(node, ["source"], "n"))
        source_levels.append(kids)
        node = _digest_of(kids, ["source"], "n")
        ends.append(node.where("n = 1"))
    subroots = stored(reduce(DataFrame.unionByName, ends).select("source", F.col("digest").alias("subroot")))

    ranks = stored(text_ranks(subroots, "source"))
    node = ranks.select(F.lit(n_groups).alias("n"), F.col("r").alias("p"), F.col("subroot").alias("digest"))
    top_levels = []
    for _ in range(_levels(n_groups)):
        kids = stored(_grouped(node, [], "n"))
        top_levels.append(kids)
        node = _digest_of(kids, [], "n")
    last = node.select("digest").first()  # one digest
    named = ranks.withColumn("root", F.lit(last[0] if last else None).cast("string"))
    path = _downwards(top_levels, [], None)
    named = stored(named.withColumn("up", F.expr(EMPTY)) if path is None else named.join(path.withColumnRenamed("p", "r"), "r"))

    # downwards in the sources: the runs' own paths
    lowest = _downwards(source_levels, ["source"], named)
    short = _same(runs.where(F.col("n") <= FANOUT), named, ["source"]).select("l.*", "r.up", "r.subroot", "r.root")
    if lowest is not None:
        deep = _same(runs.where(F.col("n") > FANOUT), lowest, ["source", "p"]).select("l.*", "r.up")
        deep = _same(deep, named, ["source"]).select("l.*", "r.subroot", "r.root")
        short = short.unionByName(deep)
    above = F.array_join(F.transform("up", lambda u: F.concat(u["l"], u["r"])), "")
    each = short.select("docs", "n", "up", "subroot", "root", above.alias("above"), leaf_list.alias("all")).select("*", F.posexplode("docs").alias("i", "doc")).drop("docs")
    left, right = _joined(F.col("all"), F.lit(1), F.col("i")), _joined(F.col("all"), F.col("i") + 2, F.lit(FANOUT))
    each = each.select("n", "up", "subroot", "root", "above", F.col("doc.id").alias(id_col), F.col("doc.leaf").alias("leaf"), F.coalesce("doc.other", "doc.leaf").alias("shown"), left.alias("l"), right.alias("r"))
    first = F.when(F.col("n") == 1, F.col("shown")).otherwise(_sha(F.concat("l", "shown", "r")))
    folded = F.aggregate("up", first, lambda acc, u: _sha(F.concat(u["l"], acc, u["r"])))
    out = each.select(id_col, "leaf", "subroot", "root", _sha(F.concat("l", "r", "above")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of ``documents``, with the texts of every row whose id's CRC-32 5 divides in lower case when proofs are checked."""
    docs = read(spark, sf_dir, "documents")
    return merkle_manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
