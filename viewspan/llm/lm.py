"""Stupid-backoff scores: n-gram counts of the whole corpus, tables partitioned by hash, joined to the n-grams of each document.

N-grams travel in blocks. A block is a bounded run of documents: its distinct
n-grams, as 64-bit hashes, are dealt by hash to the partitions of the count
tables; a partition adds up what all blocks bring and answers each block with
the corpus counts of just the n-grams it asked for; a block's documents are
then scored where the answers meet their n-grams and summed per document. So
each n-gram crosses the network once a block and not once an occurrence, no
table or group is held in one place, and a frequent n-gram costs one entry a block.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, shuffle_partitions

#: Longest n-gram, backoff factor (Brants et al., 2007), and count below which an n-gram of two words or more backs off.
ORDER, BACKOFF, MIN_COUNT = 2, 0.4, 2
#: Words and documents of a block, about.
BLOCK_WORDS, BLOCK_DOCS = 1_000_000, 100_000
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_words: dict[bytes, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word (runs of ASCII letters, digits and non-ASCII characters; A-Z lower-cased)."""
    global _words
    ws = (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()
    if len(_words) > 2_000_000:
        _words = {}
    for w in set(ws).difference(_words):
        _words[w] = xxhash.xxh64_intdigest(w)
    return np.array([_words[w] for w in ws], np.uint64)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n-gram of a run of word hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k : len(hashes) - n + 1 + k] * np.uint64(0x9E3779B97F4A7C15)
    return out


def _planes(codes: np.ndarray) -> bytes:
    """uint32 codes, mostly small, packed byte plane by byte plane."""
    return zlib.compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unplanes(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel().astype(np.int64)


def _coded(grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Distinct n-grams, their counts in the block, and the block's text as places among them, packed.

    Words are numbered by falling count and kept as such; longer n-grams in
    order of arrival, kept as the distance back to the newest (0: a new one).
    """
    own, index, inverse, counts = np.unique(grams, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable") if n == 1 else np.argsort(index)
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own))
    places = rank[inverse]
    if n > 1:
        newest = np.maximum.accumulate(places) if len(places) else places
        before = np.concatenate([[-1], newest[:-1]])[: len(places)]
        places = np.where(places > before, 0, before + 1 - places)
    return own[order], counts[order], _planes(places)


def _decoded(b: bytes, n: int) -> np.ndarray:
    codes = _unplanes(b)
    if n == 1:
        return codes
    known = np.cumsum(codes == 0)
    return known - np.maximum(codes, 1)


def _block(ids: list, hashes: list[np.ndarray], order: int, buckets: int):
    """The rows of one block: what it asks of each bucket, and its documents as places among what it asks."""
    lens = np.array([len(h) for h in hashes], np.int64)
    name = xxhash.xxh3_64_intdigest(repr(ids).encode() + lens.tobytes() + b"".join(h.tobytes() for h in hashes)) >> 1
    parts = []
    for n in range(1, order + 1):
        keys, counts, packed = _coded(np.concatenate([ngrams(h, n) for h in hashes]), n)
        parts.append(packed)
        to = _bucket(keys, buckets)
        at = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[at], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            i = at[cuts[b] : cuts[b + 1]]
            yield name, n, b, _six(keys[i]), _small(counts[i]), _planes(np.diff(i, prepend=0)), None, None, None
    yield name, 0, name % buckets, None, None, None, parts, ids, lens.tobytes()


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket (of at most 65,536) from the high two bytes alone, which ``_six`` leaves out."""
    return ((keys >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int64)


def _six(keys: np.ndarray) -> bytes:
    """The low six bytes of each key. The bucket was chosen by the other two, so keys of a bucket are told apart by 48 bits and as many more as the bucket's number has."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _of_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _small(c: np.ndarray) -> bytes:
    """Counts in as few bytes as they need, the width first."""
    kind = np.uint8 if not len(c) or c.max() < 1 << 8 else np.uint16 if c.max() < 1 << 16 else np.uint32 if c.max() < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + c.astype(kind).tobytes()


def _large(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"u{b[0]}", offset=1).astype(np.int64)


def _arrow(id_type: str) -> pa.Schema:
    kind = pa.string() if id_type == "string" else pa.int64()
    return pa.schema([("block", pa.int64()), ("n", pa.int32()), ("b", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("at", pa.binary()), ("parts", pa.list_(pa.binary())), ("ids", pa.list_(kind)), ("lens", pa.binary())])


def _asked(order: int, buckets: int, id_type: str):
    schema = _arrow(id_type)

    def out(ids, hashes):
        rows = list(_block(ids, hashes, order, buckets))
        for k in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[k : k + 1000], strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        ids, hashes, size = [], [], 0
        for batch in batches:
            for d, t in zip(batch.column(batch.schema.get_field_index("id")).to_pylist(), batch.column(batch.schema.get_field_index("t")), strict=True):
                ids.append(d)
                hashes.append(word_hashes(t.as_py()))
                size += len(hashes[-1])
                if size >= BLOCK_WORDS or len(ids) >= BLOCK_DOCS:
                    yield from out(ids, hashes)
                    ids, hashes, size = [], [], 0
        if ids:
            yield from out(ids, hashes)

    return run


def _groups(batches, by: list[str]):
    """Runs of rows of sorted batches that agree on ``by``."""
    held, key = [], None
    for batch in batches:
        for r in batch.to_pylist():
            k = tuple(r[c] for c in by)
            if k != key and held:
                yield held
                held = []
            key = k
            held.append(r)
    if held:
        yield held


def _answers(id_type: str):
    """Corpus counts in place of the counts of each block, bucket by bucket; the documents of blocks pass through."""
    schema = _arrow(id_type)

    def run(batches):
        for rows in _groups(batches, ["n", "b"]):
            if rows[0]["n"]:
                keys = [_of_six(r["keys"]) for r in rows]
                own, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                total = np.zeros(len(own), np.int64)
                np.add.at(total, inverse, np.concatenate([_large(r["counts"]) for r in rows]))
                total, at = total[inverse], 0
                for r, k in zip(rows, keys, strict=True):
                    r["keys"], r["counts"] = None, _small(total[at : at + len(k)])
                    at += len(k)
            for k in range(0, len(rows), 500):
                yield pa.RecordBatch.from_pylist(rows[k : k + 500], schema=schema)

    return run


def stupid_backoff(places: list[np.ndarray], counts: list[np.ndarray], backoff: float, min_count: int) -> tuple[float, int]:
    """Log score of one document but for its single words' denominator, and how many words have that denominator.

    ``places``: for each order the document's n-grams as places in ``counts`` of
    that order. The score of a word is count(n-gram) / count(its first n - 1
    words) for the longest n-gram that ends in it and comes at least
    ``min_count`` times, times ``backoff`` for each order left out; a single
    word's is its share of all words, a total that is known at the end.
    """
    score = np.log(counts[0][places[0]]) if len(places[0]) else np.zeros(0)
    single = np.ones(len(score), bool)
    for n in range(2, len(places) + 1):
        c = counts[n - 1][places[n - 1]]
        if not len(c):
            break
        seen = c >= min_count
        before = counts[n - 2][places[n - 2][: len(c)]]
        score[n - 1 :] = np.where(seen, np.log(c / before), math.log(backoff) + score[n - 1 :])
        single[n - 1 :] &= ~seen
    return float(score.sum()), int(single.sum())


def _scored(order: int, backoff: float, min_count: int, id_type: str):
    kind = pa.string() if id_type == "string" else pa.int64()

    def run(batches):
        for rows in _groups(batches, ["block"]):
            counts = []
            for n in range(1, order + 1):
                answers = {r["b"]: r for r in rows if r["n"] == n}.values()  # an equal block brings equal answers
                at = np.concatenate([np.cumsum(_unplanes(r["at"])) for r in answers] or [np.zeros(0, np.int64)])
                own = np.zeros(len(at))
                own[at] = np.concatenate([_large(r["counts"]) for r in answers] or [np.zeros(0, np.int64)])
                counts.append(own)
            for r in rows:
                if r["n"]:
                    continue
                lens = np.frombuffer(r["lens"], np.int64)
                places = [_decoded(p, n) for n, p in enumerate(r["parts"], 1)]
                ends = [np.cumsum(np.maximum(lens - n, 0)) for n in range(order)]
                scores = []
                for k, n_words in enumerate(lens.tolist()):
                    own = [p[e[k] - max(0, n_words - n) : e[k]] for n, (p, e) in enumerate(zip(places, ends, strict=True))]
                    scores.append(stupid_backoff(own, counts, backoff, min_count))
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], kind), pa.array(lens), pa.array([s for s, _ in scores], pa.float64()), pa.array([m for _, m in scores], pa.int64())], names=["id", "n_words", "part", "unigrams"])

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """For each row of ``docs``: id (bigint or string), ``n_words``, ``log_score`` (sum over words, natural log) and ``per_word``.

    All n-grams of all rows are counted, repeated rows as often as they come. A
    text without words, null included, scores 0 and null a word. An empty table
    gives no rows. N-grams are known by 48 bits of a hash and a bucket chosen by
    the other 16. Columns other than id and text are not read.
    """
    spark = docs.sparkSession
    id_type = "string" if dict(docs.dtypes)[id_col] == "string" else "bigint"
    schema = f"block long, n int, b int, keys binary, counts binary, at binary, parts array<binary>, ids array<{id_type}>, lens binary"
    buckets = min(1 << 16, max(8, shuffle_partitions(spark)))
    asked = docs.select(F.col(id_col).cast(id_type).alias("id"), F.col(text).alias("t")).mapInArrow(_asked(order, buckets, id_type), schema)
    answers = asked.repartition(buckets, "n", "b").sortWithinPartitions("n", "b").mapInArrow(_answers(id_type), schema)
    scored = cut(answers.repartition(buckets, "block").sortWithinPartitions("block").mapInArrow(_scored(order, backoff, min_count, id_type), f"id {id_type}, n_words long, part double, unigrams long"))
    words = scored.agg(F.sum("n_words")).first()[0] or 1
    total = F.col("part") - F.col("unigrams") * F.lit(math.log(words))
    return scored.select(F.col("id").alias(id_col), "n_words", total.alias("log_score"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("per_word"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lm_scores`` of every document; sums to four places, since they are added in another order each time."""
    scores = lm_scores(read(spark, sf_dir, "documents"))
    return scores.withColumns({"log_score": F.round("log_score", 4) + F.lit(0.0), "per_word": F.round("per_word", 6) + F.lit(0.0)})


#: The same scores in DuckDB, from tables of word and word-pair counts joined to each document's pairs.
OP7_SQL = f"""
with docs as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
tokens as (select rid, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from docs),
pairs as (select a.rid, a.w as v, b.w as w from tokens a join tokens b on a.rid = b.rid and b.i = a.i + 1),
c1 as (select w, count(*)::double as c from tokens group by 1),
c2 as (select v, w, count(*)::double as c from pairs group by 1, 2),
total as (select count(*)::double as n from tokens),
firsts as (select rid, ln(c1.c / n) as s from tokens join c1 using (w), total where i = 1),
others as (select rid, case when c2.c >= {MIN_COUNT} then ln(c2.c / cv.c) else ln({BACKOFF}) + ln(cw.c / n) end as s
  from pairs p join c2 on c2.v = p.v and c2.w = p.w join c1 cv on cv.w = p.v join c1 cw on cw.w = p.w, total),
summed as (select rid, sum(s) as s from (select * from firsts union all select * from others) group by 1)
select doc_id, coalesce(len(ws), 0)::bigint as n_words, round(coalesce(s, 0.0), 4) + 0.0 as log_score, case when len(ws) > 0 then round(s / len(ws), 6) + 0.0 end as per_word from docs left join summed using (rid)
"""
