"""Extraction, rotation and bootstrap of studies of any number of participants, from sums over participants.

By-person correlations of complete sorts are R = U U' (a unit row of ``J`` values for
each participant), so all that R says is in the J x J matrix U' U: its eigenvectors V
give the loadings U V. It is a sum over participants, and so are the moments of
the loadings that a rotation depends on (second and fourth order). Tasks add up
what they hold of a study, a study's sums meet in one small group, and loadings
are found where the participants stand. A participant isn't sent anywhere but to
its own row, and no task holds a study.

A bootstrap replicate is a vector of weights, not a copy: how often a participant
was drawn. The draws of a study are multinomial; they are split into
multinomial draws for blocks of participants, seeded by (seed, replicate, block), so
every block knows its weights without any other and results don't depend on
partitions. Weighted sums give the replicate's matrix, its eigenvectors and its
rotation; the turn to the original loadings follows from the same matrix.

Studies with missing cells or constant sorts have another R; they aren't ``whole`` and are left to ``extraction``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg as L

#: Participants of a block, replicates of a task at a time, and bytes of partial sums held before they are passed on.
BLOCK, CHUNK, HELD = 4096, 25, 64_000_000
#: Participants whose outer products are formed together.
SLICE = 256
Z05 = 1.959963984540054


def packed(sorts: DataFrame) -> DataFrame:
    """One row for each participant: ``study_id, p_idx, participant, s, v``, its statements and values in order, missing cells left out."""
    cell = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.struct("stmt_num", "value"))
    rows = sorts.groupBy("study_id", "p_idx").agg(F.min("participant").alias("participant"), F.array_sort(F.collect_list(cell)).alias("c"))
    return rows.select("study_id", "p_idx", "participant", F.transform("c", lambda c: c["stmt_num"]).alias("s"), F.transform("c", lambda c: c["value"].cast("double")).alias("v"))


def studies_of(rows: DataFrame) -> DataFrame:
    """``(study_id, n, whole, s)``: participants, whether all have the same statements and none is constant, and the statements."""
    same = F.min(F.xxhash64("s")) == F.max(F.xxhash64("s"))
    varied = F.bool_and((F.size("v") > 1) & (F.array_min("v") < F.array_max("v")))
    return rows.groupBy("study_id").agg(F.count("*").alias("n"), (same & varied).alias("whole"), F.max("s").alias("s"))


def whole_rows(sorts: DataFrame) -> DataFrame:
    """``packed`` rows of whole studies, with ``n``."""
    rows = packed(sorts)
    return rows.join(studies_of(rows).where("whole").select("study_id", "n"), "study_id")


def unwhole_sorts(sorts: DataFrame) -> DataFrame:
    """The sorts of studies that aren't whole."""
    return sorts.join(studies_of(packed(sorts)).where("not whole").select("study_id"), "study_id", "left_semi")


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.float64).tobytes()


def _floats(b: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(b, np.float64).reshape(shape)


def _stack(values) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values])


def _partial_sums(rows: DataFrame, of_rows) -> DataFrame:
    """``(study_id, n, part)``: of each study's rows in a task the sum of ``of_rows(pdf) -> flat array``."""

    def run(parts):
        held: dict = {}
        size = 0

        def out():
            return pd.DataFrame({"study_id": list(held), "n": [x[0] for x in held.values()], "part": [_bytes(x[1]) for x in held.values()]})

        for pdf in parts:
            for study, own in pdf.groupby("study_id", sort=False):
                new = of_rows(own)
                if study in held:
                    held[study][1] += new
                else:
                    held[study] = [own["n"].iloc[0], new]
                    size += new.nbytes
            if size > HELD:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    return rows.mapInPandas(run, "study_id string, n long, part binary")


def _sums(parts: DataFrame, keys: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, also, part)``: the parts of each key added up as they stream by in order, so that none is held but the sum."""
    names = [*keys, *also]

    def run(batches):
        key, total = None, None
        for pdf in batches:
            done = []
            for *this, part in zip(*(pdf[c] for c in names), pdf["part"], strict=True):
                if this != key:
                    if key is not None:
                        done.append((*key, _bytes(total)))
                    key, total = this, np.frombuffer(part, np.float64).copy()
                else:
                    total += np.frombuffer(part, np.float64)
            yield pd.DataFrame(done, columns=[*names, "part"])
        if key is not None:
            yield pd.DataFrame([(*key, _bytes(total))], columns=[*names, "part"])

    schema = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in (*names, "part"))
    return parts.select(*names, "part").repartition(*keys).sortWithinPartitions(*keys, "part").mapInPandas(run, schema)


def _each(rows: DataFrame, solve, schema: str) -> DataFrame:
    """``solve(row) -> tuple`` of each row, in Arrow batches."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([solve(row) for row in pdf.itertuples(index=False)], columns=names)

    return rows.mapInPandas(run, schema)


def grams(rows: DataFrame) -> DataFrame:
    """``(study_id, n, part)`` of ``whole_rows``: U'U and the sum of U, for each study."""

    def of_rows(own):
        u = L.unit_rows(_stack(own["v"]))
        return np.concatenate([(u.T @ u).ravel(), u.sum(axis=0)])

    return _sums(_partial_sums(rows, of_rows), ["study_id"], ("n",))


def _gram_of(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(part, np.float64)
    j = int((math.isqrt(1 + 4 * len(flat)) - 1) // 2)  # j * j + j numbers
    return flat[: j * j].reshape(j, j), flat[j * j :]


def spectra(rows: DataFrame) -> DataFrame:
    """``(study_id, n, j, w, avg_r)``: all eigenvalues of R that can differ from 0, and its mean off-diagonal entry."""

    def solve(row):
        (g, total), n = _gram_of(row.part), row.n
        w = np.maximum(L.eigen(g)[0], 0)[:n]
        return row.study_id, n, len(g), w, (total @ total - n) / (n * (n - 1)) if n > 1 else math.nan

    return _each(grams(rows), solve, "study_id string, n long, j int, w array<double>, avg_r double")


# --- loadings and rotation ------------------------------------------------------------------------


def _bases(gram: DataFrame, k: int) -> DataFrame:
    """``(study_id, basis)``: the first eigenvectors, J x k by rows."""

    def solve(row):
        g, _ = _gram_of(row.part)
        return row.study_id, _bytes(L.eigen(g)[1][:, : min(k, len(g), row.n)])

    return _each(gram, solve, "study_id string, basis binary")


def _loads(own: pd.DataFrame, basis: str = "basis") -> np.ndarray:
    u = L.unit_rows(_stack(own["v"]))
    return u @ _floats(own[basis].iloc[0], u.shape[1], -1)


def _moments_of(load: np.ndarray, method: str, w: np.ndarray | None = None) -> np.ndarray:
    x = L.kaiser(load) if method in L.NORMALISED else load
    m2, m4 = L.moments(x, w)
    return np.concatenate([m2.ravel(), m4.ravel()])


def _split_moments(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = next(k for k in range(1, len(flat) + 1) if k * k + k**4 == len(flat))
    return flat[: k * k].reshape(k, k), flat[k * k :].reshape(k, k, k, k)


SOLUTION = "study_id string, basis binary, turn binary, phi binary"


def solution(rows: DataFrame, k: int, rotation: str = "none") -> DataFrame:
    """``(study_id, basis, turn, phi)`` of ``whole_rows``: loadings are the unit rows times ``basis`` (J x k), ``turn`` (k x k) led to them from the unrotated ones, ``phi`` are the factors' correlations.

    Columns are flipped so that the entry of largest size among the participants is positive.
    """
    bases = _bases(grams(rows), k)
    placed = rows.join(bases, "study_id")
    turned = bases.withColumns({"turn": F.lit(None).cast("binary"), "phi": F.lit(None).cast("binary")})
    if rotation != "none" and k > 1:
        moments = _sums(_partial_sums(placed, lambda own: _moments_of(_loads(own), rotation)), ["study_id"], ("n",))

        def rotate(row):
            t, phi = L.turn_of(rotation, *_split_moments(np.frombuffer(row.part, np.float64)), row.n)
            return row.study_id, _bytes(_floats(row.basis, -1, len(t)) @ t), _bytes(t), _bytes(phi)

        turned = _each(moments.join(bases, "study_id"), rotate, SOLUTION)
        if rotation == "promax":
            turned = _promax(rows, turned)
    return _signed(rows, turned)


def _promax(rows: DataFrame, varimax: DataFrame) -> DataFrame:
    """Promax from a varimax solution: one more sum over participants, of the loadings with their powers."""

    def of_rows(own):
        x = _loads(own)
        return np.concatenate([(x.T @ x).ravel(), (x.T @ L.promax_target(x)).ravel()])

    sums = _sums(_partial_sums(rows.join(varimax.select("study_id", "basis"), "study_id"), of_rows), ["study_id"], ("n",))

    def finish(row):
        flat = np.frombuffer(row.part, np.float64)
        k = math.isqrt(len(flat) // 2)
        t, phi, more = L.promax_turn(_floats(row.turn, k, k), *flat.reshape(2, k, k))
        return row.study_id, _bytes(_floats(row.basis, -1, k) @ more), _bytes(t), _bytes(phi)

    return _each(sums.join(varimax, "study_id"), finish, SOLUTION)


def _signed(rows: DataFrame, turned: DataFrame) -> DataFrame:
    def extremes(parts):
        for pdf in parts:
            for study, own in pdf.groupby("study_id", sort=False):
                load = _loads(own)
                at = np.abs(load).argmax(axis=0)
                yield pd.DataFrame({"study_id": study, "factor": np.arange(load.shape[1]), "size": np.abs(load[at, np.arange(load.shape[1])]), "p_idx": own["p_idx"].to_numpy()[at], "value": load[at, np.arange(load.shape[1])]})

    top = rows.join(turned.select("study_id", "basis"), "study_id").mapInPandas(extremes, "study_id string, factor int, size double, p_idx long, value double")
    least = top.groupBy("study_id", "factor").agg(F.max_by("value", F.struct(F.round("size", 12), -F.col("p_idx"))).alias("value"))
    signs = least.groupBy("study_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("factor", "value"))), lambda x: F.when(x["value"] < 0, -1.0).otherwise(1.0)).alias("signs"))

    def flip(row):
        d = np.asarray(row.signs, float)
        k = len(d)
        turn, phi = (_floats(b, k, k) if b is not None else np.eye(k) for b in (row.turn, row.phi))
        return row.study_id, _bytes(_floats(row.basis, -1, k) * d), _bytes(turn * d), _bytes(phi * np.outer(d, d))

    return _each(turned.join(signs, "study_id"), flip, SOLUTION)


LOADINGS = "study_id string, participant string, p_idx int, factor int, loading double"


def _long(study: str, own: pd.DataFrame, load: np.ndarray) -> pd.DataFrame:
    n, m = load.shape
    return pd.DataFrame({"study_id": study, "participant": np.repeat(own["participant"].to_numpy(), m), "p_idx": np.repeat(own["p_idx"].to_numpy(), m), "factor": np.tile(np.arange(1, m + 1), n), "loading": load.ravel()})


def loadings(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """``(study_id, participant, p_idx, factor, loading)``, each computed where the participant's row is."""

    def run(parts):
        for pdf in parts:
            for study, own in pdf.groupby("study_id", sort=False):
                yield _long(study, own, _loads(own))

    return rows.join(solved.select("study_id", "basis"), "study_id").mapInPandas(run, LOADINGS)


#: Fewest participants whose minres factors are found from sums (a pass takes at least nine tenths off the error there), and passes over them.
MINRES_ROWS, MINRES_PASSES = 256, 6


def _minres_fit(own, k: int) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(own, np.float64)
    return flat[:-k].reshape(-1, k), flat[-k:]


def minres(rows: DataFrame, k: int) -> DataFrame:
    """``(study_id, participant, p_idx, factor, loading)`` of ``whole_rows`` by minres, where there are more statements than ``k`` and ``MINRES_ROWS`` participants or more.

    A participant's loadings follow from the k products U'L and squared lengths of L (``linalg.minres_rows``),
    which are found anew from sums over participants in each pass.
    """
    flat = lambda z, mu: _bytes(np.concatenate([z.ravel(), mu]))
    fits = _each(grams(rows), lambda row: (row.study_id, flat(*L.minres_start(_gram_of(row.part)[0], k))), "study_id string, fit binary")

    def sums_of(own):
        z, mu = _minres_fit(own["fit"].iloc[0], k)
        # mu travels with the sums, so that a pass reads the one before only once
        return np.append(L.minres_sums(L.unit_rows(_stack(own["v"])), z, mu).ravel(), mu * len(own))

    def step(row):
        sums, mu = np.split(np.frombuffer(row.part, np.float64), [-k])
        j = math.isqrt(len(sums) // (3 * k))
        return row.study_id, flat(*L.minres_step(sums.reshape(3 * k, j, j), mu / row.n))

    for _ in range(MINRES_PASSES):
        sums = _sums(_partial_sums(rows.join(F.broadcast(fits), "study_id"), sums_of), ["study_id"], ("n",))
        fits = _each(sums, step, "study_id string, fit binary")

    def run(parts):
        for pdf in parts:
            for study, own in pdf.groupby("study_id", sort=False):
                load = L.minres_rows(L.unit_rows(_stack(own["v"])), *_minres_fit(own["fit"].iloc[0], k))[0]
                yield _long(study, own, load)

    load = rows.join(F.broadcast(fits), "study_id").mapInPandas(run, LOADINGS)
    # the entry of largest size of each column is positive
    least = load.groupBy("study_id", "factor").agg(F.max_by("loading", F.struct(F.round(F.abs("loading"), 12), -F.col("p_idx"))).alias("top"))
    return load.join(F.broadcast(least), ["study_id", "factor"]).select("study_id", "participant", "p_idx", "factor", F.when(F.col("top") < 0, -F.col("loading")).otherwise(F.col("loading")).alias("loading"))


def centroid(rows: DataFrame, k: int, rotation: str) -> DataFrame:
    """As ``minres`` by centroid factors. Each flip of a sort decides the next, so one task follows a study's flips over its unit rows (J + k numbers a participant); R is never formed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p_idx")
        return _long(pdf["study_id"].iloc[0], pdf, L.signed(L.rotate(L.centroid_of_rows(_stack(pdf["v"]), k), rotation)))

    return rows.select("study_id", "p_idx", "participant", "v").groupBy("study_id").applyInPandas(run, LOADINGS)


def factor_correlations(solved: DataFrame) -> DataFrame:
    """``(study_id, f, g, phi)``: correlations of the factors, those of an orthogonal rotation 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        phi = np.frombuffer(pdf["phi"].iloc[0], np.float64)
        k = math.isqrt(len(phi))
        return pd.DataFrame({"study_id": pdf["study_id"].iloc[0], "f": np.repeat(np.arange(1, k + 1), k), "g": np.tile(np.arange(1, k + 1), k), "phi": phi})

    return solved.groupBy("study_id").applyInPandas(run, "study_id string, f int, g int, phi double")


# --- nulls of parallel analysis -------------------------------------------------------------------


def permuted_share(counts: list[np.ndarray], sizes: np.ndarray, at: int, seed: int, b: int) -> list[np.ndarray]:
    """How many of each value of each statement a permutation ``b`` of the whole column leaves in block ``at`` of blocks with ``sizes`` participants.

    Blocks are halved again and again; each half's share is a hypergeometric draw of its own seed, so a block finds its share without the others.
    """
    lo, hi = 0, len(sizes)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, b, lo, hi])
        left = [rng.multivariate_hypergeometric(c, int(sizes[lo:mid].sum()), method="marginals") for c in counts]
        if at < mid:
            counts, hi = left, mid
        else:
            counts, lo = [c - x for c, x in zip(counts, left, strict=True)], mid
    return counts


def null_spectra(rows: DataFrame, replicates: int, null: str, seed: int) -> DataFrame:
    """``(study_id, b, n, w)`` of ``whole_rows``: the eigenvalues of each null that can differ from 0.

    Null values come from how often each value occurs, in all cells or by statement (``permute_columns``), so a block
    of participants draws its own and sends only its sums. Rows that a null makes constant correlate with nothing and add an eigenvalue of 1 each.
    """
    cells = rows.select("study_id", F.posexplode("v").alias("at_s", "x"))
    if null != "permute_columns":
        cells = cells.withColumn("at_s", F.lit(0))
    counted = cells.groupBy("study_id", "at_s", "x").agg(F.count("*").alias("c"))
    pools = counted.groupBy("study_id").agg(F.array_sort(F.collect_list(F.struct("at_s", "x", "c"))).alias("z"))
    pools = pools.select("study_id", F.col("z.at_s").alias("at_s"), F.col("z.x").alias("x"), F.col("z.c").alias("c"))
    blocks = _dealt(_blocks(rows, replicates).join(F.broadcast(pools), "study_id"), "study_id", "at", "chunk")

    def draw(row):
        sizes, column = np.asarray(row.sizes, np.int64), np.asarray(row.at_s)
        m, values, counts = int(sizes[row.at]), np.asarray(row.x, float), np.asarray(row.c, np.int64)
        j = len(row.v) // m
        out = {}
        for b in range(row.chunk * CHUNK, min(replicates, (row.chunk + 1) * CHUNK)):
            rng = np.random.default_rng([seed, b, row.at])
            if null == "permute_columns":
                share = permuted_share([counts[column == k] for k in range(j)], sizes, row.at, seed, b)
                y = np.stack([rng.permutation(np.repeat(values[column == k], share[k])) for k in range(j)], axis=1)
            else:
                y = values[rng.choice(len(values), size=(m, j), p=counts / counts.sum())]
            u = L.unit_rows(y)
            out[b] = np.append((u.T @ u).ravel(), (np.abs(u).sum(axis=1) == 0).sum())
        return out

    def solve(row):
        flat = np.frombuffer(row.part, np.float64)
        j = math.isqrt(len(flat) - 1)
        w = np.concatenate([np.maximum(L.eigen(flat[:-1].reshape(j, j))[0], 0), np.ones(int(flat[-1]))])
        return row.study_id, row.b, row.n, -np.sort(-w)[: row.n]

    return _each(_per_replicate(blocks, draw), solve, "study_id string, b int, n long, w array<double>")


# --- bootstrap ------------------------------------------------------------------------------------


def block_weights(sizes: np.ndarray, at: int, seed: int, b: int) -> np.ndarray:
    """How often replicate ``b`` draws each participant of block ``at``, of blocks with ``sizes`` participants: its share of one multinomial draw."""
    sizes = np.asarray(sizes, np.int64)
    n = int(sizes.sum())
    total = np.random.default_rng([seed, b]).multinomial(n, sizes / n)[at] if len(sizes) > 1 else n
    return np.random.default_rng([seed, b, at + 1]).multinomial(total, np.full(sizes[at], 1 / sizes[at]))


def _blocks(rows: DataFrame, replicates: int) -> DataFrame:
    """Blocks of participants, once for each chunk of replicates: ``study_id, n, at, sizes, who, v, s, chunk``."""
    placed = rows.withColumn("at", F.floor(F.col("p_idx") / BLOCK).cast("int"))
    block = placed.groupBy("study_id", "n", "at").agg(F.array_sort(F.collect_list(F.struct("p_idx", "v"))).alias("c"), F.max("s").alias("s"))
    sizes = block.groupBy("study_id").agg(F.array_sort(F.collect_list(F.struct("at", F.size("c").alias("size")))).alias("z"))
    out = block.join(sizes, "study_id").select("study_id", "n", F.transform("z", lambda z: z["size"]).alias("sizes"), (F.array_position(F.transform("z", lambda z: z["at"]), F.col("at")) - 1).cast("int").alias("at"), F.transform("c", lambda c: c["p_idx"]).alias("who"), F.flatten(F.transform("c", lambda c: c["v"])).alias("v"), "s")
    return _dealt(out.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // CHUNK) - 1)))), "study_id", "at", "chunk")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """A stated number of tasks: there is much work in few bytes."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def _drawn(row, seed: int, replicates: int):
    """(values, unit rows, replicates of the chunk, their weights) of a block."""
    x = np.asarray(row.v, float).reshape(len(row.who), -1)
    bs = range(row.chunk * CHUNK, min(replicates, (row.chunk + 1) * CHUNK))
    return x, L.unit_rows(x), bs, np.stack([block_weights(row.sizes, row.at, seed, b) for b in bs]).astype(float)


def _per_replicate(blocks: DataFrame, make) -> DataFrame:
    """``(study_id, b, n, part)``: the sums of ``make(row) -> {b: flat array}`` over the blocks of each study."""

    def run(parts):
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                got = make(row)
                yield pd.DataFrame({"study_id": row.study_id, "b": list(got), "n": row.n, "part": [_bytes(x) for x in got.values()]})

    return _sums(blocks.mapInPandas(run, "study_id string, b int, n long, part binary"), ["study_id", "b"], ("n",))


def _with_chunk(blocks: DataFrame, solved: DataFrame, column: str) -> DataFrame:
    """Blocks with ``bases``: ``(b, column)`` of the replicates of their chunk."""
    mine = solved.groupBy("study_id", F.floor(F.col("b") / CHUNK).cast("int").alias("chunk")).agg(F.collect_list(F.struct("b", F.col(column).alias("basis"))).alias("bases"))
    return _dealt(blocks.join(mine, ["study_id", "chunk"]), "study_id", "at", "chunk")


def _bases_of(row) -> dict[int, bytes]:
    return {int(x["b"]): x["basis"] for x in row.bases}


def flagged_loads(load: np.ndarray, statements: int, z: float = Z05) -> np.ndarray:
    sq = load**2
    return (np.abs(load) > z / math.sqrt(statements)) & (sq > sq.sum(axis=1, keepdims=True) - sq)


def weights_of(a: np.ndarray) -> np.ndarray:
    c = np.sign(a) * np.clip(np.abs(a), 1e-4, 0.9999)
    return c / (1 - c * c)


def replicate_bases(rows: DataFrame, k: int, rotation: str, replicates: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The blocks, and ``(study_id, b, basis)``: of each replicate the J x k matrix that gives its loadings, turned to the original ones."""
    blocks = _blocks(rows, replicates)

    def gram(row):
        _, u, bs, w = _drawn(row, seed, replicates)
        j = u.shape[1]
        out = np.zeros((len(bs), j * j))
        for k0 in range(0, len(u), SLICE):
            part = u[k0 : k0 + SLICE]
            out += w[:, k0 : k0 + SLICE] @ (part[:, :, None] * part[:, None, :]).reshape(len(part), -1)
        return dict(zip(bs, out, strict=True))

    def solve(row):
        j = math.isqrt(len(row.part) // 8)
        return row.study_id, row.b, row.part, _bytes(L.eigen(_floats(row.part, j, j))[1][:, :k])

    solved = _each(_per_replicate(blocks, gram), solve, "study_id string, b int, gram binary, basis binary")
    target = solution(rows, k, rotation).select("study_id", F.col("basis").alias("target"))
    if rotation != "none" and k > 1:

        def moments(row):
            _, u, bs, w = _drawn(row, seed, replicates)
            return {b: _moments_of(u @ _floats(v, u.shape[1], -1), rotation, w[b - bs[0]]) for b, v in _bases_of(row).items()}

        summed = _per_replicate(_with_chunk(blocks, solved, "basis"), moments)
        solved = solved.join(summed, ["study_id", "b"])

    def turn(row):
        j = math.isqrt(len(row.gram) // 8)
        g, a, t = _floats(row.gram, j, j), _floats(row.basis, j, -1), _floats(row.target, j, -1)
        if hasattr(row, "part"):
            a = a @ L.turn_of(rotation, *_split_moments(np.frombuffer(row.part, np.float64)), row.n)[0]
        u, _, vt = np.linalg.svd(t.T @ g @ a)
        return row.study_id, row.b, _bytes(a @ vt.T @ u.T)

    turned = _each(_dealt(solved.join(target, "study_id"), "study_id", "b"), turn, "study_id string, b int, basis binary")
    return blocks, turned


REPLICATES = "study_id string, b int, kind string, item int, factor int, value double, flagged boolean"


def bootstrap(rows: DataFrame, k: int, replicates: int, rotation: str, seed: int) -> DataFrame:
    """Replicates of whole studies as long rows, see ``extraction.bootstrap``."""
    blocks, turned = replicate_bases(rows, k, rotation, replicates, seed)
    placed = _with_chunk(blocks, turned, "basis")

    def people(parts):
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                _, u, bs, w = _drawn(row, seed, replicates)
                who = np.asarray(row.who)
                for b, v in _bases_of(row).items():
                    there = w[b - bs[0]] > 0
                    load = u[there] @ _floats(v, u.shape[1], -1)
                    n, m = load.shape
                    yield pd.DataFrame({"study_id": row.study_id, "b": b, "kind": "loading", "item": np.repeat(who[there], m), "factor": np.tile(np.arange(1, m + 1), n), "value": load.ravel(), "flagged": flagged_loads(load, u.shape[1]).ravel()})

    return placed.mapInPandas(people, REPLICATES).unionByName(_scores_of(placed, replicates, seed))


def _scores_of(placed: DataFrame, replicates: int, seed: int) -> DataFrame:
    """The rows of kind zscore of ``bootstrap``."""

    def scores(parts):
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                x, u, bs, w = _drawn(row, seed, replicates)
                j = u.shape[1]
                for b, v in _bases_of(row).items():
                    load = u @ _floats(v, j, -1)
                    own = flagged_loads(load, j) * w[b - bs[0]][:, None]
                    sums = (weights_of(load) * own).T @ x
                    m = load.shape[1]
                    yield pd.DataFrame({"study_id": row.study_id, "b": b, "item": np.tile(np.asarray(row.s), m), "factor": np.repeat(np.arange(1, m + 1), j), "wsum": sums.ravel(), "any": np.repeat(own.sum(axis=0), j)})

    summed = placed.mapInPandas(scores, "study_id string, b int, item int, factor int, wsum double, any double").groupBy("study_id", "b", "factor", "item").agg(F.sum("wsum").alias("wsum"), F.sum("any").alias("any"))
    z = standardised(summed, ["study_id", "b", "factor"], F.col("any") > 0)
    return z.select("study_id", "b", F.lit("zscore").alias("kind"), "item", "factor", F.col("zscore").alias("value"), F.lit(False).alias("flagged"))


INTERVALS = "study_id string, kind string, item int, factor int, boot_mean double, boot_sd double, ci_low double, ci_high double, n long"


def bootstrap_intervals(rows: DataFrame, k: int, replicates: int, rotation: str, seed: int, level: float) -> tuple[DataFrame, DataFrame]:
    """What ``extraction.intervals`` says of the loadings of ``bootstrap`` (``INTERVALS``), found where a block of participants is, and the rows of its z-scores."""
    rows = rows.persist()
    blocks, turned = replicate_bases(rows, k, rotation, replicates, seed)
    turned = turned.persist()
    bases = turned.groupBy("study_id").agg(F.array_sort(F.collect_list(F.struct("b", "basis"))).alias("bases"))
    whole = _dealt(blocks.where("chunk = 0").join(F.broadcast(bases), "study_id"), "study_id", "at")
    at = np.array([(1 - level) / 2, (1 + level) / 2])

    def run(parts):
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                u = L.unit_rows(np.asarray(row.v, float).reshape(len(row.who), -1))
                found = _bases_of(row)
                turns = np.stack([_floats(v, u.shape[1], -1) for v in found.values()], axis=1)
                drawn = np.stack([block_weights(row.sizes, row.at, seed, b) > 0 for b in found], axis=1)
                m = turns.shape[2]
                for k0 in range(0, len(u), SLICE):
                    some = drawn[k0 : k0 + SLICE].any(axis=1)
                    there, who = drawn[k0 : k0 + SLICE][some], np.asarray(row.who)[k0 : k0 + SLICE][some]
                    if not len(who):
                        continue
                    load = (u[k0 : k0 + SLICE][some] @ turns.reshape(len(turns), -1)).reshape(len(who), len(found), m)
                    load[~there] = np.nan
                    n = there.sum(axis=1)[:, None]
                    mean = np.nansum(load, axis=1) / n
                    sd = np.sqrt(np.nansum((load - mean[:, None]) ** 2, axis=1) / np.where(n > 1, n - 1, np.nan))
                    load.sort(axis=1)  # undefined values come last
                    place = at[:, None, None] * (n - 1)
                    low = np.floor(place).astype(np.int64)
                    below, above = (np.stack([np.take_along_axis(load, np.broadcast_to(p[:, None], (len(who), 1, m)), axis=1)[:, 0] for p in q]) for q in (low, np.ceil(place).astype(np.int64)))
                    ends = below + (place - low) * (above - below)
                    yield pd.DataFrame({"study_id": row.study_id, "kind": "loading", "item": np.repeat(who, m), "factor": np.tile(np.arange(1, m + 1), len(who)), "boot_mean": mean.ravel(), "boot_sd": sd.ravel(), "ci_low": ends[0].ravel(), "ci_high": ends[1].ravel(), "n": np.repeat(n.ravel(), m)})

    own = whole.mapInPandas(run, INTERVALS).withColumn("boot_sd", F.when(F.col("n") > 1, F.col("boot_sd")))
    return own, _scores_of(_with_chunk(blocks, turned, "basis"), replicates, seed)


def bootstrap_agreement(rows: DataFrame, k: int, replicates: int, rotation: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """``(study_id, kind, b, r)``: the correlation of each replicate's loadings with the original ones, from sums over blocks of participants, and the rows of ``bootstrap``'s z-scores."""
    rows = rows.persist()
    blocks, turned = replicate_bases(rows, k, rotation, replicates, seed)
    turned = turned.persist()
    target = solution(rows, k, rotation).select("study_id", F.col("basis").alias("target"))
    placed = _with_chunk(blocks, turned, "basis")

    def sums(row):
        _, u, bs, w = _drawn(row, seed, replicates)
        o = u @ _floats(row.target, u.shape[1], -1)
        out = {}
        for b, v in _bases_of(row).items():
            there = w[b - bs[0]] > 0
            x, y = (u[there] @ _floats(v, u.shape[1], -1)).ravel(), o[there].ravel()
            out[b] = np.array([len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y])
        return out

    def solve(row):
        n, x, y, xx, yy, xy = np.frombuffer(row.part, np.float64)
        return row.study_id, "loading", row.b, (n * xy - x * y) / math.sqrt((n * xx - x * x) * (n * yy - y * y))

    r = _each(_per_replicate(placed.join(F.broadcast(target), "study_id"), sums), solve, "study_id string, kind string, b int, r double")
    return r, _scores_of(placed, replicates, seed)


def flag_counts(rows: DataFrame, k: int, replicates: int, rotation: str, seed: int) -> DataFrame:
    """``(study_id, p_idx, factor, k, n)``: in how many replicates of ``bootstrap`` a participant is flagged and in how many it is drawn, counted where its block is."""
    blocks, turned = replicate_bases(rows, k, rotation, replicates, seed)

    def count(parts):
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                _, u, bs, w = _drawn(row, seed, replicates)
                hits, drawn = 0, np.zeros(len(u), np.int64)
                for b, v in _bases_of(row).items():
                    there = w[b - bs[0]] > 0
                    hits = hits + (flagged_loads(u @ _floats(v, u.shape[1], -1), u.shape[1]) & there[:, None])
                    drawn += there
                n, m = hits.shape
                yield pd.DataFrame({"study_id": row.study_id, "p_idx": np.repeat(np.asarray(row.who), m), "factor": np.tile(np.arange(1, m + 1), n), "k": hits.ravel().astype(np.int64), "n": np.repeat(drawn, m)})

    found = _with_chunk(blocks, turned, "basis").mapInPandas(count, "study_id string, p_idx int, factor int, k long, n long")
    return found.groupBy("study_id", "p_idx", "factor").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).where("n > 0")


def standardised(sums: DataFrame, by: list[str], defined) -> DataFrame:
    """``sums`` with ``zscore``: ``wsum`` standardised over the statements of ``by``, 0 without spread, nan where not ``defined``."""
    w = Window.partitionBy(*by)
    sd = F.stddev_samp("wsum").over(w)
    return sums.withColumn("zscore", F.when(~defined, F.lit(math.nan)).when(sd > 0, (F.col("wsum") - F.avg("wsum").over(w)) / sd).otherwise(0.0))
