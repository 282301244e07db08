"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, quoted, read, spare, stored

#: Words are maximal runs of these bytes of the UTF-8 text (ASCII letters and digits, and all non-ASCII); the rest becomes a blank.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text whose search tables are sent to the tasks at once; more is searched block by block.
BLOCK_BYTES = 4_000_000
#: Blocks that are with the tasks at one time; a larger benchmark takes several passes over the documents.
BLOCKS_AT_ONCE = 8


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class WuManber:
    """Searches word sequences for patterns that all have ``m`` words.

    A block is the last two words of the place looked at (one if ``m`` is 1).
    ``shift`` says how far a block is from the end of the pattern in which it
    stands last, so places that can't end a pattern are skipped; a shift of
    zero leads to the patterns that end in the block, compared word by word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], list]) -> None:
        self.m = m = len(next(iter(patterns)))
        self.b = b = min(2, m)
        self.default = m - b + 1
        self.shift: dict = {}
        self.suffix: dict = defaultdict(dict)
        for p, items in patterns.items():
            for end in range(b, m + 1):
                block = p[end - b : end]
                self.shift[block] = min(self.shift.get(block, self.default), m - end)
            self.suffix[p[m - b :]][p] = items
        self.suffix = dict(self.suffix)

    def scan(self, text: list[bytes]):
        """(first word, items) of each occurrence."""
        m, b, default, shift, suffix = self.m, self.b, self.default, self.shift, self.suffix
        at, n = m, len(text)
        while at <= n:
            block = tuple(text[at - b : at])
            step = shift.get(block, default)
            if step:
                at += step
            else:
                items = suffix[block].get(tuple(text[at - m : at]))
                if items is not None:
                    yield at - m, items
                at += 1


def matchers(items: list[tuple[object, str | None]], window: int = WINDOW) -> list[WuManber]:
    """A matcher for each pattern length: ``window`` words, and the whole of each shorter item."""
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for p in {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else ():
            by_length[m][p].append(item)
    return [WuManber(dict(by_length[m])) for m in sorted(by_length, reverse=True)]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, prefix: str = "bench_") -> DataFrame:
    """``docs`` with ``<prefix>n_words``, ``<prefix>spans`` and ``<prefix>items``.

    spans: array of <start, end> in words, end exclusive, disjoint and ascending,
    of words inside any occurrence of a window; items: distinct ids, as strings,
    of items with occurring windows, ascending.

    The distinct items are split by hash into as many blocks as their bytes
    need. Documents stream through one narrow step for each block, and nothing
    is shuffled, while the blocks fit ``BLOCKS_AT_ONCE``. A larger benchmark is
    searched in passes of that many blocks: each pass stores the hits of the
    texts that have any, frees its tables, and at last the hits are joined to
    the documents by a digest of the text. So what is sent to the tasks never
    grows with the benchmark. Null texts have no words and null or blank items
    no windows; an item with a null id marks words but isn't listed. Repeated
    items count once, repeated rows are returned as often as they come, columns
    with the names of the new ones are replaced. No benchmark rows: nothing is hit.
    """
    items = benchmark.select(F.col(quoted(item_id)).cast("string").alias("i"), F.col(quoted(item_text)).alias("t")).where("t is not null").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    items = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    if n > 1:
        items = stored(items)
    fields = _fields(prefix)
    if n <= BLOCKS_AT_ONCE:
        return _searched(docs, items, range(n), text, fields, window)[0]
    key = spare(docs, f"_{prefix}text")
    digest = F.md5(F.coalesce(F.col(quoted(text)), F.lit("")).cast("binary"))
    names = [f[0] for f in fields]
    hits = None
    for first in range(0, n, BLOCKS_AT_ONCE):
        own, sent = _searched(docs.select(digest.alias("k"), F.col(quoted(text)).alias("t")), items, range(first, min(n, first + BLOCKS_AT_ONCE)), "t", fields, window)
        found = stored(own.where(F.size(names[1]) > 0).select("k", *names[1:]).dropDuplicates(["k"]))
        for x in sent:
            x.destroy()
        hits = found if hits is None else hits.union(found)
    both = hits.groupBy("k").agg(F.flatten(F.collect_list(names[1])).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(names[2])))).alias("i"))
    both = add_columns(both, [("s", *fields[1][1:])], lambda batch: [[[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in s])] for s in batch.column(batch.schema.get_field_index("s")).to_pylist()]])
    kept = docs.select(*[F.col(quoted(c)) for c in docs.columns if c not in names])
    counted = add_columns(kept.withColumn(key, digest), fields[:1], lambda batch: [[len(words(t.as_py())) for t in batch.column(batch.schema.get_field_index(text))]])
    joined = counted.join(both, counted[key] == both["k"], "left")
    return joined.select(*[F.col(quoted(c)) for c in kept.columns], names[0], F.coalesce("s", F.array().cast(fields[1][1])).alias(names[1]), F.coalesce("i", F.array().cast(fields[2][1])).alias(names[2]))


def _fields(prefix: str) -> list:
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return [(f"{prefix}n_words", T.LongType(), pa.int64()), (f"{prefix}spans", span, arrow_span), (f"{prefix}items", T.ArrayType(T.StringType()), pa.list_(pa.string()))]


def _searched(docs: DataFrame, items: DataFrame, blocks: range, text: str, fields: list, window: int) -> tuple[DataFrame, list]:
    """``docs`` with the hits of these blocks of items, and what was sent to the tasks for it."""
    sent = []
    for block in blocks:
        rows = [tuple(r) for r in items.where(F.col("b") == block).select("i", "t").collect()]
        sent.append(docs.sparkSession.sparkContext.broadcast(rows))
        docs = add_columns(docs, fields, _searcher(sent[-1], text, [f[0] for f in fields] if len(sent) > 1 else None, window))
    return docs, sent


def _searcher(sent, text, before, window):
    found: list = []  # the tables, built once in each task

    def make(batch):
        if not found:
            found.append(matchers(sent.value, window))
        column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
        old = zip(column(before[1]), column(before[2]), strict=True) if before else ((None, None),) * batch.num_rows
        out = [[], [], []]
        for t, (old_spans, old_items) in zip(column(text), old, strict=True):
            w = words(t)
            spans, ids = [(s["start"], s["end"]) for s in old_spans or ()], set(old_items or ())
            for k in found[0]:
                for start, items in k.scan(w):
                    spans.append((start, start + k.m))
                    ids.update(items)
            ids.discard(None)
            out[0].append(len(w))
            out[1].append([{"start": a, "end": b} for a, b in merged(spans)])
            out[2].append(sorted(ids))
        return out

    return make


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ascending spans that cover the same places."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest of op3 for each row of ``docs``."""
    hits = benchmark_hits(docs.select(F.col(id_col), F.col(text).alias("text")), benchmark)
    n_hit = F.aggregate("bench_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return hits.select(
        F.col(id_col),
        F.col("bench_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bench_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contamination`` of every document by the whole benchmark."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_SQL_WORDS = "coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
#: The same digest in DuckDB: windows of items joined to all windows of documents of their length.
OP3_SQL = f"""
with docs as (select row_number() over () as rid, doc_id, {_SQL_WORDS} as ws from documents),
items as (select distinct item_id::varchar as item, {_SQL_WORDS} as ws from benchmark),
sized as (select *, least({WINDOW}, len(ws)) as m from items where len(ws) > 0),
wanted as (select distinct item, m, array_to_string(ws[i:i + m - 1], ' ') as gram from (select *, unnest(range(1, len(ws) - m + 2)) as i from sized)),
grams as (select rid, m, i, array_to_string(ws[i:i + m - 1], ' ') as gram from (select rid, ws, m, unnest(range(1, len(ws) - m + 2)) as i from docs, (select distinct m from sized))),
hits as (select rid, item, g.m, i from grams g join wanted w on w.m = g.m and w.gram = g.gram),
words_hit as (select rid, count(distinct place) as n from (select rid, unnest(range(i, i + m)) as place from hits) group by 1),
items_hit as (select rid, count(*) as n, string_agg(item, ',' order by item) as list from (select distinct rid, item from hits where item is not null) group by 1)
select doc_id, len(ws)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(t.n, 0)::bigint as n_items, sha256(coalesce(list, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from docs left join words_hit h using (rid) left join items_hit t using (rid)
"""
