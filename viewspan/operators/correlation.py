"""By-person correlation and what hangs on it: descriptives, duplicates, careless sorts, quality.

Participants travel in chunks, as rows of a matrix, and meet block against block; a
block is sent once for each block it meets, and a study has ``BLOCKS`` of them at
most, so what is sent grows with the participants. Within two blocks rows
with the same missing cells are one product of unit rows over the statements that both
sides have. What only needs sums of correlations, near pairs or nearest people is
found there; pairs leave a task only where they are the result. Sums of correlations
of studies with few kinds of gaps need no blocks: each participant meets the sums of all others.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gram import HELD, _bytes, _dealt, _sums
from .study import grid_values

#: Participants of a chunk, most blocks of a study, pairs of a piece of a product, and pairs of a group of equal gaps below which pairwise kernels are used.
CHUNK, BLOCKS, PIECE, FEW = 256, 32, 1 << 20, 512
#: Most kinds of gaps in a study whose sums are found without pairs.
KINDS = 64


def _ratio(cov: np.ndarray, vx: np.ndarray, vy: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """r from a covariance and two variances (times n²), nan where a side is constant; ``scale``: what is rounding error beside it."""
    defined = (vx > 1e-12 * scale) & (vy > 1e-12 * scale)
    return np.divide(cov, np.sqrt(np.where(defined, vx * vy, 1.0)), out=np.full(cov.shape, np.nan), where=defined)


def _masked_r(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(r, n): Pearson's r of each row of ``x`` with each of ``y`` over the columns that both have, by six products."""
    mx, my = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
    x, y = np.nan_to_num(x), np.nan_to_num(y)
    n, sx, sy = mx @ my.T, x @ my.T, mx @ y.T
    sxx, syy = (x * x) @ my.T, mx @ (y * y).T
    r = _ratio(n * (x @ y.T) - sx * sy, n * sxx - sx * sx, n * syy - sy * sy, n * np.maximum(sxx, syy) + 1e-300)
    return r, n


def _order(x: np.ndarray) -> np.ndarray:
    """For each row and pair of columns (s, t): 1 if t's value is below s's, a half if equal, 0 if above or missing."""
    with np.errstate(invalid="ignore"):
        return ((x[:, None, :] < x[:, :, None]) + 0.5 * (x[:, None, :] == x[:, :, None])).astype(np.float32)


def _ranked_r(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_masked_r`` of mid-ranks, taken within the columns that a pair has in common."""
    if not np.isnan(x).any() and not np.isnan(y).any():
        rank = lambda v: pd.DataFrame(v.T).rank().to_numpy().T
        return _masked_r(rank(x), rank(y))
    my = (~np.isnan(y)).astype(np.float32)
    by = _order(y)
    r, n = np.empty((len(x), len(y))), np.empty((len(x), len(y)))
    for i, row in enumerate(x):
        both = my * ~np.isnan(row)
        a = (both @ _order(row[None])[0].T + 0.5) * both
        b = (np.matmul(by, both[:, :, None])[:, :, 0] + 0.5) * both
        a, b = a.astype(float), b.astype(float)
        n[i] = both.sum(axis=1)
        sa, sb = a.sum(axis=1), b.sum(axis=1)
        saa, sbb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        r[i] = _ratio(n[i] * (a * b).sum(axis=1) - sa * sb, n[i] * saa - sa * sa, n[i] * sbb - sb * sb, n[i] * np.maximum(saa, sbb) + 1e-300)
    return r, n


def _unit(x: np.ndarray) -> np.ndarray:
    """Complete rows centred and scaled to length 1; nan where a row is constant, by the measure of ``_masked_r``."""
    c = x - x.mean(axis=1, keepdims=True)
    size = (c * c).sum(axis=1, keepdims=True)
    return np.divide(c, np.sqrt(size), out=np.full_like(c, np.nan), where=size > 1e-12 * (x * x).sum(axis=1, keepdims=True) + 1e-300)


def _mid_ranks(x: np.ndarray) -> np.ndarray:
    """Mid-ranks within complete rows; of few rows by comparing all values, which needs no sort of each."""
    if x.size * x.shape[1] > PIECE:
        return pd.DataFrame(x.T).rank().to_numpy().T
    below, equal = (op(x[:, None, :], x[:, :, None]).sum(axis=2) for op in (np.less, np.equal))
    return below + (equal + 1) / 2


def _unit_ranks(x: np.ndarray) -> np.ndarray:
    return _unit(_mid_ranks(x))


def _unit_signs(x: np.ndarray) -> np.ndarray:
    """Signs of all statement pairs over the root of how many differ: products are tau-b."""
    if x.shape[1] < 2:  # no pair of statements, so no tau
        return np.full((len(x), 1), np.nan)
    first, second = np.triu_indices(x.shape[1], 1)
    s = np.sign(x[:, first] - x[:, second])
    n = np.abs(s).sum(axis=1, keepdims=True)
    return np.divide(s, np.sqrt(n), out=np.full_like(s, np.nan), where=n > 0)


def _signed_r(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tau-b, n) of rows with missing cells: pairs of statements that a side lacks or finds equal are 0."""
    first, second = np.triu_indices(x.shape[1], 1)
    signs = lambda v: np.nan_to_num(np.sign(v[:, first] - v[:, second]))
    there = lambda v: (~np.isnan(v[:, first] + v[:, second])).astype(float)
    a, b = signs(x), signs(y)
    nx, ny = np.abs(a) @ there(y).T, there(x) @ np.abs(b).T
    r = np.divide(a @ b.T, np.sqrt(nx * ny), out=np.full(nx.shape, np.nan), where=(nx > 0) & (ny > 0))
    return r, (~np.isnan(x)).astype(float) @ (~np.isnan(y)).astype(float).T


#: Of each kind of correlation: unit rows of complete rows, and the kernel of any two sets of rows.
KERNELS = {"pearson": (_unit, _masked_r), "spearman": (_unit_ranks, _ranked_r), "kendall": (_unit_signs, _signed_r)}


def _gaps(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(columns that are there, rows) of each group of rows with the same missing cells."""
    masks, of = np.unique(~np.isnan(x), axis=0, return_inverse=True)
    of = of.reshape(-1)
    return [(m, np.flatnonzero(of == k)) for k, m in enumerate(masks)]


def _units(x: np.ndarray, y: np.ndarray, unit):
    """``(rows of x, rows of y, unit rows of both, n)`` of each two groups of ``_gaps``; None where groups are so small that the pairwise kernel is faster."""
    left, right = _gaps(x), _gaps(y)
    if len(left) * len(right) > max(1, len(x) * len(y) // FEW):
        return None
    both = ((i, j, mi & mj) for mi, i in left for mj, j in right)
    return ((i, j, unit(x[i][:, c]), unit(y[j][:, c]), int(c.sum())) for i, j, c in both if c.any())


def _pieces(x: np.ndarray, y: np.ndarray, kind: str):
    """``(rows of x, rows of y, r, n)`` in pieces of bounded size that together are all pairs with a statement in common (or n is 0)."""
    unit, kernel = KERNELS[kind]
    step = lambda width: max(1, PIECE // max(width, 1))
    met = _units(x, y, unit)
    if met is None:
        for k in range(0, len(x), step(len(y))):
            rows = np.arange(k, min(len(x), k + step(len(y))))
            yield rows, np.arange(len(y)), *kernel(x[rows], y)
        return
    for i, j, u, v, n in met:
        for k in range(0, len(i), step(len(j))):
            r = u[k : k + step(len(j))] @ v.T
            yield i[k : k + step(len(j))], j, r, np.broadcast_to(float(n), r.shape)


def _row_pieces(x: np.ndarray, y: np.ndarray, kind: str):
    """As ``_pieces``, but with all rows of ``y`` in each piece (n is 0 where there is nothing in common): many small groups of gaps make few pieces."""
    met = _units(x, y, KERNELS[kind][0])
    if met is None:
        yield from _pieces(x, y, kind)
        return
    step = max(1, PIECE // max(len(y), 1))
    for _, group in groupby(met, key=lambda g: g[0][0]):
        group = list(group)
        i = group[0][0]
        for k in range(0, len(i), step):
            rows = i[k : k + step]
            if len(group[0][1]) == len(y):
                r = group[0][2][k : k + step] @ group[0][3].T
                n = np.broadcast_to(float(group[0][4]), r.shape)
            else:
                r, n = np.full((len(rows), len(y)), np.nan), np.zeros((len(rows), len(y)), np.int64)
                for _, j, u, v, common in group:
                    r[:, j], n[:, j] = u[k : k + step] @ v.T, common
            yield rows, np.arange(len(y)), r, n


def _people(sorts: DataFrame, by: list[str], extra: Column | None = None) -> DataFrame:
    """``(*by, p_idx, n, j, w, v)``: a row for each participant; ``v`` its values by statement (nan: missing), ``w`` the numbers of array ``extra``, ``n`` and ``j`` the study's participants and statements. Kept by Spark, as several steps read it."""
    here = sorts.groupBy(*by, "p_idx").agg(F.map_from_entries(F.collect_list(F.struct("stmt_num", F.col("value").cast("double").alias("value")))).alias("m"), F.first(extra if extra is not None else F.array().cast("array<double>")).alias("w"))
    statements = sorts.groupBy(*by).agg(F.array_sort(F.collect_set("stmt_num")).alias("s"), F.count_distinct("p_idx").alias("n"))
    return here.join(F.broadcast(statements), by).select(*by, "p_idx", "n", F.size("s").alias("j"), "w", F.transform("s", lambda s: F.coalesce(F.try_element_at("m", s), F.lit(float("nan")))).alias("v")).persist()


def _chunks(sorts: DataFrame, by: list[str], block: int, extra: Column | None = None) -> DataFrame:
    """``(*by, bi, bj, block, chunk, who, j, v, w)``: chunks of ``_people`` in order of p_idx, once for each two blocks they are part of."""
    return _chunks_of(_people(sorts, by, extra), by, block)


def _chunks_of(rows: DataFrame, by: list[str], block: int) -> DataFrame:
    rows = rows.withColumn("chunk", F.floor(F.col("p_idx") / F.least(F.lit(CHUNK), F.lit(block))))
    chunks = rows.groupBy(*by, "n", "j", "chunk").agg(F.array_sort(F.collect_list(F.struct("p_idx", "v", "w"))).alias("c"))
    chunks = chunks.select(*by, "n", "j", "chunk", F.transform("c", lambda c: c["p_idx"]).alias("who"), F.flatten(F.transform("c", lambda c: c["v"])).alias("v"), F.flatten(F.transform("c", lambda c: c["w"])).alias("w"))
    # blocks hold equal numbers of participants, however far apart their p_idx are
    sizes = rows.groupBy(*by, "n", "chunk").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = sizes.select(*by, "chunk", F.floor(before / F.greatest(F.lit(block), F.ceil(F.col("n") / BLOCKS))).cast("int").alias("block"))
    pairs = placed.groupBy(*by).agg(F.sort_array(F.collect_set("block")).alias("all"))
    met = placed.join(F.broadcast(pairs), by).withColumn("other", F.explode("all")).select(*by, "chunk", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    return _dealt(chunks.drop("n").join(met, [*by, "chunk"]), *by, "bi", "bj").sortWithinPartitions(*by, "bi", "bj", "block", "chunk")


def _blocked(sorts: DataFrame, block: int, make, schema: str) -> DataFrame:
    return _met(_chunks(sorts, ["study_id"], block), make, schema, ("study_id",))


def _met(chunks: DataFrame, make, schema: str, by: tuple[str, ...]) -> DataFrame:
    """``make(left, right)`` of each two blocks, the two the same object for a block with itself; a block is ``(p_idx, values, extra)``, results are tuples of arrays after the keys."""
    fields = [f.split() for f in schema.split(", ")]
    by = list(by)
    plain = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    kinds = [(plain | {f"array<{k}>": pa.list_(t) for k, t in plain.items()})[k] for _, k in fields]

    def block_of(parts):
        j = parts[0].j
        who = np.concatenate([p.who for p in parts]).astype(np.int64)
        return who, np.concatenate([p.v for p in parts]).astype(float).reshape(len(who), j), np.concatenate([p.w for p in parts]).astype(float).reshape(len(who), -1)

    def solve(key, held):
        left = block_of([p for p in held if p.block == key[-2]])
        right = left if key[-2] == key[-1] else block_of([p for p in held if p.block == key[-1]])
        for columns in make(left, right):
            n = len(columns[0])
            if n:
                keys = [pa.repeat(pa.scalar(k, t), n) for k, t in zip(key, kinds[: len(by)])]
                arrays = [*keys, *(c if isinstance(c, pa.Array) else pa.array(c).cast(t) for c, t in zip(columns, kinds[len(by) :], strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=[f for f, _ in fields])

    def run(batches):
        key, held = None, []
        for batch in batches:
            for row in batch.to_pandas().itertuples(index=False):
                this = tuple(getattr(row, c) for c in (*by, "bi", "bj"))
                if this != key:
                    if held:
                        yield from solve(key, held)
                    key, held = this, []
                held.append(row)
        if held:
            yield from solve(key, held)

    return chunks.mapInArrow(run, schema)


PAIR_LISTS = "study_id string, p_i int, p_j array<int>, r array<double>, n_pair array<long>"


def _listed(who: np.ndarray, others: np.ndarray, *values: np.ndarray):
    """``(p_i, p_j, *values)`` with a row for each of ``who`` that has others above it, lists of what it has with these; both ids ascend. A value that all pairs share is a list of one."""
    start = np.searchsorted(others, who, side="right")
    rows = np.flatnonzero(start < len(others))
    if not len(rows):
        return
    start = start[rows]
    above = None if not start.any() else np.arange(len(others)) >= start[:, None]
    ends = np.r_[0, np.cumsum(len(others) - start)].astype(np.int32)

    def lists(v, kind):
        if v.strides == (0, 0):
            return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32)), pa.array(np.full(len(rows), v[0, 0]).astype(kind)))
        v = v if len(rows) == len(v) else v[rows]
        v = v.ravel() if above is None else v[above]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(kind, copy=False)))

    ids = np.broadcast_to(others.astype(np.int32), (len(who), len(others)))
    yield who[rows], lists(ids, np.int32), *(lists(v, kind) for v, kind in zip(values, (np.float64, np.int64)))


def _spread(lists: DataFrame) -> DataFrame:
    """A row for each pair of ``PAIR_LISTS``, made where the lists arrive: a pair costs neither a row nor the study's name between Python and Spark."""
    counted = "n_pair" in lists.columns
    each = lists.select("study_id", "p_i", "p_j", *(["n_pair"] if counted else []), F.posexplode("r").alias("at", "r"))
    n = F.when(F.size("n_pair") == 1, F.get("n_pair", F.lit(0))).otherwise(F.get("n_pair", "at"))
    return each.select("study_id", "p_i", F.get("p_j", "at").alias("p_j"), "r", *([n.alias("n_pair")] if counted else []))


def _defined(pairs: DataFrame) -> DataFrame:
    return pairs.where("n_pair > 0").withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def _pairs(sorts: DataFrame, block: int, kind: str) -> DataFrame:
    def make(left, right):
        for i, j, r, n in _row_pieces(left[1], right[1], kind):
            yield from _listed(left[0][i], right[0][j], r, n)

    return _defined(_spread(_blocked(sorts, block, make, PAIR_LISTS)))


def pearson(sorts: DataFrame, block: int = 512) -> DataFrame:
    """``(study_id, p_i, p_j, r, n_pair)`` for ``p_i < p_j``, pairwise complete; null where a side is constant."""
    return _pairs(sorts, block, "pearson")


def spearman(sorts: DataFrame, block: int = 256) -> DataFrame:
    """Like ``pearson`` on mid-ranks, which are taken again within the complete statements of each pair."""
    return _pairs(sorts, block, "spearman")


def kendall(sorts: DataFrame, block: int = 256) -> DataFrame:
    """Kendall's tau-b of each pair of participants: a product of the signs of all statement pairs, 0 where both values are equal."""
    return _pairs(sorts, block, "kendall")


CORRELATIONS = {"pearson": pearson, "spearman": spearman, "kendall": kendall}


def packed_correlation(sorts: DataFrame, block: int = 512) -> DataFrame:
    """Pearson correlations of complete sorts, block against block of ``block`` participants or more; nan where a side is constant or incomplete."""

    def make(left, right):
        u, v = (np.where(np.isnan(x).any(axis=1, keepdims=True), np.nan, _unit(x)) for x in (left[1], right[1]))
        step = max(1, PIECE // max(len(v), 1))
        for k in range(0, len(u), step):
            yield from _listed(left[0][k : k + step], right[0], u[k : k + step] @ v.T)

    return _spread(_blocked(sorts, block, make, PAIR_LISTS.rpartition(", ")[0]))


SUMS = "p_idx int, at int, r_sum double, n_r long, n_undefined long"


def pearson_sums(sorts: DataFrame, weights: Column | None = None, by: tuple[str, ...] = ("study_id",), block: int = 512) -> DataFrame:
    """``(*by, p_idx, at, r_sum, n_r, n_undefined)``: of each participant the sum of ``weights[at]`` (1 without) times r over all others, how many r there are and how many are undefined.

    The sum over rows with the same missing cells is a product with the sum of their unit rows, so no pair is
    formed and each participant's row stays where it is, unless gaps are of over ``KINDS`` kinds (or of many for so few rows).
    """
    keys = list(by)
    people = _people(sorts, keys, weights).withColumn("gap", F.array_join(F.transform("v", lambda x: F.when(F.isnan(x), "0").otherwise("1")), ""))
    kinds = people.groupBy(*keys, "gap").agg(F.count("*").alias("c"))
    few = kinds.groupBy(*keys).agg(F.count("*").cast("double").alias("g"), F.sum("c").cast("double").alias("n")).where((F.col("g") <= KINDS) & (F.col("g") * F.col("g") <= F.greatest(F.lit(1.0), F.floor(F.col("n") * F.col("n") / FEW)))).select(*keys)
    gaps = kinds.join(F.broadcast(few), keys).groupBy(*keys).agg(F.array_sort(F.collect_list("gap")).alias("gaps"))
    rest = people.drop("gap").join(F.broadcast(few), keys, "left_anti")
    return _sums_by_gaps(people, gaps, keys, weights is None).unionByName(_sums_by_blocks(rest, weights is None, by, block))


def _sums_by_gaps(people: DataFrame, gaps: DataFrame, by: list[str], one: bool) -> DataFrame:
    """``pearson_sums`` of studies with few kinds of ``gaps``: each kind's unit rows over the statements that it has in common with each other kind are added up."""
    types = [f"{c} {people.schema[c].dataType.simpleString()}" for c in by]

    def met(own):
        """(rows, kind, other kind, unit rows over what both have, which columns these are)."""
        masks = np.array([[c == "1" for c in g] for g in own["gaps"].iloc[0]])
        x = np.stack(own["v"].to_numpy()).astype(float)
        for mask, at in _gaps(x):
            g = int(np.flatnonzero((masks == mask).all(axis=1))[0])
            for h, other in enumerate(masks):
                both = mask & other
                if both.any():
                    yield at, g, h, _unit(x[at][:, both]), both

    def weights_of(own):
        return np.ones((len(own), 1)) if one else np.stack(own["w"].to_numpy()).astype(float)

    def studies(pdf):
        return ((k, own) for k, own in pdf.groupby(by, sort=False, dropna=False))

    def add(parts):
        held, size = {}, 0
        for pdf in parts:
            for key, own in studies(pdf):
                w = weights_of(own)
                for at, g, h, u, both in met(own):
                    ok = ~np.isnan(u[:, 0])
                    new = np.concatenate([[len(at), ok.sum()], (u[ok].T @ w[at][ok]).ravel()])
                    if (*key, g, h) in held:
                        held[*key, g, h] += new
                    else:
                        held[*key, g, h] = new
                        size += new.nbytes
            if size > HELD:
                yield _summed(held)
                held, size = {}, 0
        yield _summed(held)

    def _summed(held):
        return pd.DataFrame([(*k, _bytes(x)) for k, x in held.items()], columns=[*by, "g", "h", "part"])

    def find(parts):
        for pdf in parts:
            for key, own in studies(pdf):
                w, who = weights_of(own), own["p_idx"].to_numpy()
                m = w.shape[1]
                others = {(x["g"], x["h"]): np.frombuffer(x["part"], np.float64) for x in own["sums"].iloc[0]}
                total, counts, there = np.zeros((len(own), m)), np.zeros((len(own), 2), np.int64), np.zeros(len(own), bool)
                for at, g, h, u, both in met(own):
                    other = others[h, g]
                    ok, itself = ~np.isnan(u[:, 0]), int(g == h)
                    total[at] += np.nan_to_num(u) @ other[2:].reshape(-1, m) - itself * w[at] * ok[:, None]
                    n_r = (ok * (int(other[1]) - itself)).astype(np.int64)
                    counts[at] += np.stack([n_r, int(other[0]) - itself - n_r], axis=1)
                    there[at] = True
                n = int(there.sum())
                out = pd.DataFrame({"p_idx": np.repeat(who[there], m), "at": np.tile(np.arange(m), n), "r_sum": total[there].ravel(), "n_r": np.repeat(counts[there, 0], m), "n_undefined": np.repeat(counts[there, 1], m)})
                for name, k in zip(by, key, strict=True):
                    out[name] = k
                yield out[[*by, *out.columns[: -len(by)]]]

    rows = people.join(F.broadcast(gaps), by).select(*by, "p_idx", "v", "w", "gaps")
    parts = rows.mapInPandas(add, ", ".join([*types, "g int, h int, part binary"]))
    sums = _sums(parts, [*by, "g", "h"]).groupBy(*by).agg(F.collect_list(F.struct("g", "h", "part")).alias("sums"))
    return rows.join(F.broadcast(sums), by).mapInPandas(find, ", ".join([*types, SUMS]))


def _sums_by_blocks(people: DataFrame, one: bool, by: tuple[str, ...], block: int) -> DataFrame:
    """``pearson_sums`` of studies with many kinds of gaps: pair by pair, where the blocks meet."""

    def side(who, u, v, wv, n_others, own):
        # own: weights of the rows of u, where both sides are the same rows
        ok, there = ~np.isnan(u[:, 0]), ~np.isnan(v[:, 0])
        total = np.nan_to_num(u) @ (np.nan_to_num(v).T @ wv)
        if own is not None:
            total -= own * ok[:, None]
        self = 0 if own is None else 1
        n_r = ok * (there.sum() - self)
        return who, total, n_r.astype(np.int64), (n_others - self - n_r).astype(np.int64)

    def make(left, right):
        same = left is right
        (pi, x, wx), (pj, y, wy) = left, right
        wx, wy = (np.ones((len(p), 1)) if one else w for p, w in ((pi, wx), (pj, wy)))
        met = _units(x, y, _unit)
        found = []
        if met is not None:
            for i, j, u, v, _ in met:
                found.append(side(pi[i], u, v, wy[j], len(j), wx[i] if same and np.array_equal(i, j) else None))
                if not same:
                    found.append(side(pj[j], v, u, wx[i], len(i), None))
        else:
            for i, j, r, n in _pieces(x, y, "pearson"):
                r, common = np.array(r), n > 0
                if same:
                    r[np.arange(len(i)), i], common[np.arange(len(i)), i] = np.nan, False
                ok = ~np.isnan(r)
                r = np.where(ok, r, 0.0)
                found.append((pi[i], r @ wy[j], ok.sum(1), (common & ~ok).sum(1)))
                if not same:
                    found.append((pj[j], r.T @ wx[i], ok.sum(0), (common & ~ok).sum(0)))
        # what a block finds of a participant leaves as one row
        people, of = np.unique(np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64), return_inverse=True)
        m = wx.shape[1]
        total, counts = np.zeros((len(people), m)), np.zeros((len(people), 2), np.int64)
        at = 0
        for who, s, n_r, undefined in found:
            here = of[at : at + len(who)]
            at += len(who)
            total[here] += s
            counts[here] += np.stack([n_r, undefined], axis=1)
        yield np.repeat(people, m), np.tile(np.arange(m), len(people)), total.ravel(), np.repeat(counts[:, 0], m), np.repeat(counts[:, 1], m)

    keys = ", ".join(f"{c} {people.schema[c].dataType.simpleString()}" for c in by)
    found = _met(_chunks_of(people, list(by), block), make, f"{keys}, {SUMS}", by)
    return found.groupBy(*by, "p_idx", "at").agg(F.sum("r_sum").alias("r_sum"), F.sum("n_r").alias("n_r"), F.sum("n_undefined").alias("n_undefined"))


def near_pairs(sorts: DataFrame, threshold: float = 0.95, block: int = 512) -> DataFrame:
    """``(study_id, p_i, p_j, r, identical)`` of the pairs with r over ``threshold``, found where the blocks meet; identical: equal wherever both have a value."""

    def make(left, right):
        for i, j, r, n in _pieces(left[1], right[1], "pearson"):
            with np.errstate(invalid="ignore"):
                k, l = np.nonzero(r > threshold)
            a, b, value = i[k], j[l], r[k, l]
            there = left[0][a] < right[0][b]
            a, b, value = a[there], b[there], value[there]
            x, y = left[1][a], right[1][b]
            yield left[0][a], right[0][b], value, ((x == y) | np.isnan(x) | np.isnan(y)).all(axis=1)

    return _blocked(sorts, block, make, "study_id string, p_i int, p_j int, r double, identical boolean")


def near_counts(sorts: DataFrame, threshold: float = 0.95, block: int = 512) -> DataFrame:
    """``(study_id, n)``: how many ``near_pairs`` a study has, counted where the blocks meet; no row where it has none."""

    def make(left, right):
        n_near = 0
        for i, j, r, n in _pieces(left[1], right[1], "pearson"):
            with np.errstate(invalid="ignore"):
                near = r > threshold
            if left is right:
                near &= left[0][i][:, None] < right[0][j][None, :]
            n_near += int(np.count_nonzero(near))
        if n_near:
            yield ([n_near],)

    return _blocked(sorts, block, make, "study_id string, n long").groupBy("study_id").agg(F.sum("n").alias("n"))


def nearest(sorts: DataFrame, block: int = 512) -> DataFrame:
    """``(study_id, p_i, p_j)``: of each participant the one with the largest r, compared to 12 places, of equal ones the least p_idx; none without any r."""

    def best(who, others, r):
        # what can be largest after rounding is within 2e-12 of the largest; others ascend
        top = r.max(axis=1)
        i, j = np.nonzero(r >= np.where(top > -np.inf, top - 2e-12, np.inf)[:, None])
        value = np.round(r[i, j], 12)
        order = np.lexsort((j, -value, i))
        i, j, value = i[order], j[order], value[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        return who[i[first]], others[j[first]], value[first]

    def make(left, right):
        same = left is right
        for i, j, r, n in _pieces(left[1], right[1], "pearson"):
            r = np.fmax(r, -np.inf)  # undefined: less than all
            if n.strides != (0, 0):
                r = np.where(n > 0, r, -np.inf)
            if same:
                r[left[0][i][:, None] == right[0][j][None, :]] = -np.inf
            yield best(left[0][i], right[0][j], r)
            if not same:
                yield best(right[0][j], left[0][i], r.T)

    found = _blocked(sorts, block, make, "study_id string, p_i int, p_j int, r double")
    return found.groupBy("study_id", "p_i").agg(F.max_by("p_j", F.struct("r", -F.col("p_j"))).alias("p_j"))


def mirrored(corr: DataFrame) -> DataFrame:
    """Both directions of each pair, without the diagonal."""
    return corr.select("study_id", "p_i", "p_j", "r").union(corr.select("study_id", F.col("p_j"), F.col("p_i"), "r"))


def sort_descriptives(sorts: DataFrame) -> DataFrame:
    return sorts.groupBy("study_id", "participant").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.var_samp("value").alias("variance"), F.count("value").alias("n"))


def statement_descriptives(sorts: DataFrame) -> DataFrame:
    return sorts.groupBy("study_id", "stmt_num").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.median("value").alias("median"), F.count("value").alias("n"))


def deck_counts(sorts: DataFrame) -> DataFrame:
    """Cards of each participant on each value."""
    return sorts.where("value is not null").groupBy("study_id", "participant", F.col("value").cast("int").alias("grid_value")).agg(F.count("*").alias("n"))


def check_distribution(sorts: DataFrame, deck: list[int]) -> DataFrame:
    """``(study_id, participant, conforms, n_wrong)``: whether each participant filled the deck exactly; n_wrong counts cards to move."""
    quotas = F.create_map(*[F.lit(x) for v, q in zip(grid_values(len(deck)), deck, strict=True) for x in (v, q)])
    counted = deck_counts(sorts).withColumn("quota", F.coalesce(F.try_element_at(quotas, F.col("grid_value")), F.lit(0)))
    over = counted.groupBy("study_id", "participant").agg(F.sum(F.greatest(F.col("n") - F.col("quota"), F.lit(0))).alias("over"), F.sum("n").alias("placed"))
    n_wrong = F.greatest(F.col("over"), F.lit(sum(deck)) - F.col("placed") + F.col("over"))
    return over.select("study_id", "participant", (n_wrong == 0).alias("conforms"), n_wrong.cast("long").alias("n_wrong"))


def forced_check(sorts: DataFrame) -> DataFrame:
    """Whether all participants of a study have the same counts: a forced distribution."""
    shape = deck_counts(sorts).groupBy("study_id", "participant").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("grid_value", "n"))), lambda s: F.concat_ws(":", s["grid_value"].cast("string"), s["n"].cast("string"))), ",").alias("shape"))
    return shape.groupBy("study_id").agg(F.count_distinct("shape").alias("shapes"), (F.count_distinct("shape") == 1).alias("forced"))


def duplicates(sorts: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``near_pairs`` with r to four places."""
    return near_pairs(sorts, threshold).withColumn("r", F.round("r", 4))


def _mean_r(corr: DataFrame) -> DataFrame:
    """Each participant's mean correlation with all, itself included, from pairs or from ``pearson_sums``."""
    if "r_sum" not in corr.columns:
        pairs = mirrored(corr).groupBy("study_id", F.col("p_i").alias("p_idx"))
        return pairs.agg(((1 + F.sum("r")) / (F.count("r") + 1)).alias("mean_r"))
    return corr.select("study_id", "p_idx", F.when(F.col("n_r") > 0, (1 + F.col("r_sum")) / (F.col("n_r") + 1)).alias("mean_r"))


def careless(sorts: DataFrame, corr: DataFrame, deck: list[int]) -> DataFrame:
    """Three signs of a careless sort and whether at least two hold; ``corr``: pairs or ``pearson_sums``.

    Variance under 0.3 of the deck's; mean correlation with all (itself
    included) under the median less three times the scaled median absolute
    deviation (the standard deviation where that is 0); a pattern score of long
    runs and regular alternation under 0.05.
    """
    flat = [v for v, q in zip(grid_values(len(deck)), deck, strict=True) for _ in range(q)]
    mean = sum(flat) / len(flat)
    expected = sum((v - mean) ** 2 for v in flat) / (len(flat) - 1)
    one = Window.partitionBy("study_id", "participant")
    seq = sorts.where("value is not null").withColumn("d", F.col("value") - F.lag("value").over(one.orderBy("stmt_num")))
    seq = seq.withColumn("turn", (F.signum("d") * F.signum(F.lag("d").over(one.orderBy("stmt_num"))) < 0).cast("int"))
    seq = seq.withColumn("island", F.sum(F.when(F.col("d") == 0, 0).otherwise(1)).over(one.orderBy("stmt_num")))
    runs = seq.groupBy("study_id", "participant", "p_idx", "island").agg(F.count("*").alias("run"), F.sum("turn").alias("turns"), F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    each = runs.groupBy("study_id", "participant", "p_idx").agg(F.max("run").alias("longest"), F.sum("turns").alias("turns"), F.sum("run").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    n = F.col("n").cast("double")
    each = each.withColumn("variance", (F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1))
    raw = 1 - (0.6 * F.col("longest") / n + 0.4 * F.coalesce(F.col("turns"), F.lit(0)) / (n - 2))
    each = each.withColumn("pattern", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    each = each.join(_mean_r(corr), ["study_id", "p_idx"], "left").persist()
    mid = each.groupBy("study_id").agg(F.median("mean_r").alias("med"), F.stddev_samp("mean_r").alias("sd"))
    each = each.join(mid, "study_id")
    mad = each.groupBy("study_id").agg((F.median(F.abs(F.col("mean_r") - F.col("med"))) * 1.4826).alias("mad"))
    each = each.join(mad, "study_id")
    spread = F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("sd"))
    low_var, low_r, odd = F.col("variance") < 0.3 * expected, F.coalesce(F.col("mean_r") < F.col("med") - 3 * spread, F.lit(False)), F.col("pattern") < 0.05
    signs = low_var.cast("int") + low_r.cast("int") + odd.cast("int")
    return each.select("study_id", "participant", "variance", "mean_r", "pattern", signs.alias("signs"), (signs >= 2).alias("careless"))


def completeness(sorts: DataFrame) -> DataFrame:
    """Size, share of cells filled, and the bands by which they are read."""
    out = sorts.groupBy("study_id").agg(F.count_distinct("p_idx").alias("n_participants"), F.count_distinct("stmt_num").alias("n_statements"), F.count("value").alias("filled"))
    share = F.col("filled") / (F.col("n_participants") * F.col("n_statements"))
    band = lambda x, *steps: _banded(x, steps)
    return out.select(
        "study_id", "n_participants", "n_statements", share.alias("completeness"),
        F.when(share == 1, "Complete").when(share > 0.95, "Good").when(share > 0.90, "Acceptable").otherwise("High missing").alias("completeness_band"),
        band(F.col("n_participants"), (40, "Large"), (20, "Adequate"), (10, "Small"), (0, "Very small")).alias("n_band"),
        band(F.col("n_statements"), (60, "Large"), (40, "Adequate"), (20, "Small"), (0, "Very small")).alias("p_band"),
    )


def _banded(x: Column, steps) -> Column:
    out = None
    for low, name in steps:
        out = F.when(x >= low, name) if out is None else out.when(x >= low, name)
    return out


def average_correlation(sums: DataFrame) -> DataFrame:
    """Mean r over pairs, from ``pearson_sums``."""
    avg = F.try_divide(F.sum("r_sum"), F.sum("n_r"))
    return sums.where("n_r + n_undefined > 0").groupBy("study_id").agg(avg.alias("avg_r"), F.when(avg > 0.5, "High").when(avg > 0.3, "Moderate").when(avg > 0.1, "Low").otherwise("Very low").alias("band"))


def validate(sorts: DataFrame, deck: list[int]) -> DataFrame:
    """One row for each study: counts behind each issue and warning, and ``valid``."""
    sorts = sorts.persist()
    sums = pearson_sums(sorts).persist()
    c = completeness(sorts).select("study_id", "n_participants", "n_statements", "completeness")
    wrong = check_distribution(sorts, deck).groupBy("study_id").agg(F.count_if(~F.col("conforms")).alias("n_nonconforming"))
    dup = near_counts(sorts).withColumnRenamed("n", "n_duplicates")
    bad = careless(sorts, sums, deck).groupBy("study_id").agg(F.count_if("careless").alias("n_careless"))
    na = sums.groupBy("study_id").agg((F.sum("n_undefined") / 2).cast("long").alias("n_undefined_r"))
    out = c
    for part in (wrong, dup, bad, na):
        out = out.join(part, "study_id", "left")
    out = out.fillna(0, ["n_nonconforming", "n_duplicates", "n_careless", "n_undefined_r"])
    ok = (F.col("n_participants") >= 2) & (F.col("n_statements") >= 5) & (F.col("completeness") >= 0.9) & (F.col("n_nonconforming") == 0) & (F.col("n_undefined_r") == 0)
    return out.withColumn("valid", ok)


def validation_messages(checks: DataFrame, sorts: DataFrame, deck: list[int], most_missing: float = 0.1) -> DataFrame:
    """``validate`` as rows ``(study_id, kind, message)``: issues that stop an analysis, and warnings.

    Issues: under two participants or five statements, over ``most_missing`` of
    the cells missing, sorts off the deck, undefined correlations. Warnings:
    fewer missing cells, values beyond the deck's, duplicates, careless sorts.
    """
    top = (len(deck) - 1) // 2
    out_of = sorts.groupBy("study_id").agg(F.count_if(F.abs("value") > top).alias("n_range"))
    c = checks.join(out_of, "study_id", "left")
    said = lambda kind, when, form, *cols: F.when(when, F.struct(F.lit(kind).alias("kind"), F.format_string(form, *cols).alias("message")))
    missing = 1 - F.col("completeness")
    rows = [
        said("issue", F.col("n_participants") < 2, "%d participants, at least 2 are needed", "n_participants"),
        said("issue", F.col("n_statements") < 5, "%d statements, at least 5 are needed", "n_statements"),
        said("issue", missing > most_missing, "%.1f %% of the values are missing", missing * 100),
        said("issue", F.col("n_nonconforming") > 0, "%d sorts do not keep to the deck", "n_nonconforming"),
        said("issue", F.col("n_undefined_r") > 0, "%d correlations are undefined", "n_undefined_r"),
        said("warning", (missing > 0) & (missing <= most_missing), "%.1f %% of the values are missing", missing * 100),
        said("warning", F.col("n_range") > 0, "%d values lie beyond the deck", "n_range"),
        said("warning", F.col("n_duplicates") > 0, "%d pairs of sorts are nearly equal", "n_duplicates"),
        said("warning", F.col("n_careless") > 0, "%d sorts look careless", "n_careless"),
    ]
    return c.select("study_id", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("m")).select("study_id", "m.kind", "m.message")
