"""Points to coefficients.

All estimators rest on one shape: an Arrow kernel turns each partition of points into partial sums, one row for each
epoch, degree and order (or one block of the normal matrix), and Spark adds these up. Points never move; the shuffle
holds partitions x unknowns numbers. Only matrices of the unknowns come to the driver.

In a series every epoch is solved from the points that it has values for. Epochs with the same points share a matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions import units
from orbweave.functions.geo import FOUR_PI
from orbweave.functions.kernels import columns, design, ordinals, waves
from orbweave.operators.blocks import Block, analysed, blocked, blocks_in, synthesised
from orbweave.operators.synthesis import sets_of
from orbweave.plans import planner
from orbweave.sources.storage import discard, stored

COEFFS = "epoch_id int, n int, m int, c double, s double"
#: Bytes of sums that a task holds before it hands them on.
HELD_BYTES = 1 << 26
#: Epochs of one call that needs normal matrices.
EPOCHS = 100_000


def with_epoch(points: DataFrame) -> DataFrame:
    return points if "epoch_id" in points.columns else points.withColumn("epoch_id", F.lit(0))


def measured(weighted: DataFrame) -> DataFrame:
    """The rows that count: coordinates, weight and value are there and are numbers. Of a series, each epoch has the points
    that it has values for."""
    rows = with_epoch(weighted)
    ok = F.lit(True)
    for c in ("lat", "lon", "w", *(["value"] if "value" in rows.columns else [])):
        ok &= F.col(c).isNotNull() & ~F.isnan(c)
    return rows.where(ok & F.col("epoch_id").isNotNull())


def _rows(weighted: DataFrame) -> DataFrame:
    if "vals" in weighted.columns:  # stored blocks
        return weighted
    return measured(weighted).select(*[F.col(c).cast("int" if c == "epoch_id" else "double").alias(c) for c in ("lat", "lon", "value", "w", "epoch_id")])


def held_blocks(weighted: DataFrame) -> DataFrame:
    """The measured points as stored blocks, for what passes over them several times: places with a vector of epochs each,
    a fraction of the rows' size, and handed to Python a block at a time. quadrature, quadrature_planned, residuals and
    the iterations take them in place of points."""
    return stored(blocked(_rows(weighted)), "blocks")


def places(weighted: DataFrame) -> DataFrame:
    """lat, lon of the different places."""
    if "vals" in weighted.columns:
        return weighted.select(F.explode(F.arrays_zip("lat", "lon")).alias("p")).select("p.lat", "p.lon").distinct()
    return measured(weighted.drop("value")).select("lat", "lon").distinct()


class _Sums:
    """Sums by epoch, handed on when they exceed HELD_BYTES."""

    def __init__(self, nmax: int):
        self.nmax, self.held = nmax, {}

    def add(self, epochs: np.ndarray, sums: np.ndarray) -> None:
        """2 x degrees x orders x epochs."""
        for k, e in enumerate(epochs.tolist()):
            self.held[e] = self.held[e] + sums[..., k] if e in self.held else np.ascontiguousarray(sums[..., k])

    def full(self) -> bool:
        return len(self.held) * 16 * (self.nmax + 1) ** 2 > HELD_BYTES

    def drain(self) -> Iterator[pa.RecordBatch]:
        n, m = np.tril_indices(self.nmax + 1)
        for e, out in self.held.items():
            cols = [np.full(len(n), e, np.int32), n.astype(np.int32), m.astype(np.int32), out[0, n, m], out[1, n, m]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["epoch_id", "n", "m", "c", "s"])
        self.held = {}


def quadrature(weighted: DataFrame, nmax: int, circle: tuple[float, int] | None = None) -> DataFrame:
    """coeffs (epoch_id, n, m, c, s): sums of w * value * basis over the points, by 4 pi. weighted: lat, lon, value, w
    and epoch_id if there are several, or stored blocks. Rows with a null or NaN in these are left out. The basis of a
    task's places serves all epochs that it has there. circle: as in ``quadrature_fft``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(nmax)
        for block in blocks_in(batches):
            sums.add(block.epochs, analysed(block, nmax, circle=circle))
            if sums.full():
                yield from sums.drain()
        yield from sums.drain()

    return _total(_rows(weighted).mapInArrow(run, COEFFS))


def _total(partial: DataFrame) -> DataFrame:
    out = partial.groupBy("epoch_id", "n", "m").agg((F.sum("c") / F.lit(FOUR_PI)).alias("c"), (F.sum("s") / F.lit(FOUR_PI)).alias("s"))
    return out.withColumn("s", F.when(F.col("m") == 0, F.lit(0.0)).otherwise(F.col("s")))


def quadrature_fft(weighted: DataFrame, nmax: int, first_lon: float, nlon: int) -> DataFrame:
    """The same where all longitudes are first_lon plus whole steps of 360 / nlon. What a task has of a circle of latitude
    is one row of nlon numbers, zero elsewhere; an FFT gives all orders at once, the start of the circle turns their
    phases. The transform being linear, parts of a circle add up, and points may be missing: nothing is shuffled but sums."""
    return quadrature(weighted, nmax, (first_lon, nlon))


def quadrature_planned(weighted: DataFrame, nmax: int, longitude: str = "auto") -> tuple[DataFrame, planner.LongitudePlan]:
    """Quadrature by FFT where the places of the points make a full even grid, else directly. Values may be missing, and
    epochs of a series may lack some of the places."""
    found = places(weighted).persist()  # looked at twice
    try:
        plan = planner.plan_longitude(found, nmax, longitude)
    finally:
        found.unpersist()
    if plan.path == "fft":
        return quadrature_fft(weighted, nmax, plan.first_lon, plan.nlon), plan
    return quadrature(weighted, nmax), plan


def richardson(weighted: DataFrame, nmax: int, steps: int = 1) -> DataFrame:
    """Quadrature, then ``steps`` times the quadrature of what is left added to it. The coefficients, nmax squared numbers
    an epoch, come to the driver between steps, which keeps the plans short."""
    spark, points = weighted.sparkSession, held_blocks(weighted)
    x = flat(quadrature(points, nmax), nmax)
    for _ in range(steps):
        rest = _passed(points, nmax, x, lambda block, v: block.weighted() - np.where(np.isnan(block.vals), 0.0, v) * block.w[:, None])
        x = {e: v + rest.get(e, 0.0) for e, v in x.items()}
    discard(points)
    return to_coeffs(spark, nmax, x)


def _passed(points: DataFrame, nmax: int, x: dict[int, np.ndarray], what) -> dict[int, np.ndarray]:
    """One pass over the epochs of x: the field of x at the places of a block, what(block, field), and its quadrature."""
    sets = {e: squared(v, nmax) for e, v in x.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(nmax)
        for block in blocks_in(batches):
            mine = [k for k, e in enumerate(block.epochs.tolist()) if e in sets]
            if not mine:
                continue
            block = Block(block.lat, block.lon, block.w, block.epochs[mine], block.vals[:, mine])
            field = synthesised(block, np.stack([sets[e] for e in block.epochs.tolist()], -1))
            sums.add(block.epochs, analysed(block, nmax, what(block, field)))
            if sums.full():
                yield from sums.drain()
        yield from sums.drain()

    return flat(_total(_rows(points).mapInArrow(run, COEFFS)), nmax)


#: Unknowns for which normal matrices are formed at most.
LARGEST = 4000
#: Bytes of normal matrices of different sets of points that are on the driver at once, about.
MATRICES = 1 << 28



@dataclass
class Normal:
    """A'WA of one set of points, and of each epoch that has this set A'Wf and f'Wf."""

    nmax: int
    matrix: np.ndarray
    rhs: dict[int, np.ndarray] = field(default_factory=dict)
    power: dict[int, float] = field(default_factory=dict)


def _hashes(*x: np.ndarray) -> list[np.ndarray]:
    """Two numbers below 2**31 for each place."""
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        h = np.full(len(x[0]), seed, np.uint64)
        for v in x:
            h = (h ^ (v + 0.0).view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        out.append((h >> np.uint64(33)).astype(np.int64))
    return out


def point_sets(weighted: DataFrame) -> dict[int, list[int]]:
    """The epochs that have the same points and weights: the least of them to all of them. One row an epoch comes to the
    driver; sets are told apart by their number of points and two sums of hashes."""
    kind = "epoch_id int, n long, h0 long, h1 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_in(batches):
            there = (~np.isnan(block.vals)).astype(np.int64)
            cols = [block.epochs.astype(np.int32), there.sum(0), *[h @ there for h in _hashes(block.lat, block.lon, block.w)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["epoch_id", "n", "h0", "h1"])

    marks = _any_values(weighted).mapInArrow(run, kind).groupBy("epoch_id").agg(*[F.sum(c).alias(c) for c in ("n", "h0", "h1")]).where("n > 0")
    marks = marks.orderBy("epoch_id").limit(EPOCHS + 1).toPandas()
    if len(marks) > EPOCHS:
        raise ValueError(f"more than {EPOCHS} epochs for one call; filter epochs first")
    return {int(g["epoch_id"].iloc[0]): [int(e) for e in g["epoch_id"]] for _, g in marks.groupby(["n", "h0", "h1"])}


def _any_values(weighted: DataFrame) -> DataFrame:
    """Rows for blocks, with a value of 0 where the points have none at all."""
    return _rows(weighted if "value" in weighted.columns or "vals" in weighted.columns else weighted.withColumn("value", F.lit(0.0)))


#: Unknowns of a tile of a normal matrix, on either side.
TILE = 256


def _tiles(points: DataFrame, nmax: int, rhs: bool, sets: dict[int, list[int]]) -> DataFrame:
    """Sums over stored blocks: of A'WA, in tiles on and above the diagonal, by set (row >= 0), and if asked for of A'Wf and
    f'Wf by epoch (row -1). A task hands on each tile once; sums meet first in as many teams as the root of the tasks, so
    that neither step of the adding gathers more than that root."""
    size, firsts = (nmax + 1) ** 2, sorted(sets)
    belongs = {e: f for f, epochs in sets.items() for e in epochs}
    kind = "key int, row int, col int, team int, v array<double>"
    teams = max(1, int(np.sqrt(points.rdd.getNumPartitions())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, r = {}, {}
        team = TaskContext.get().partitionId() % teams
        for block in blocks_in(batches):
            there = ~np.isnan(block.vals)
            at = {e: k for k, e in enumerate(block.epochs.tolist())}
            mine = [k for e, k in at.items() if e in belongs] if rhs else []
            masks: dict[bytes, list[int]] = {}
            for f in firsts:
                if f in at and there[:, at[f]].any():
                    masks.setdefault(np.packbits(there[:, at[f]]).tobytes(), []).append(f)
            weighed = block.weighted()[:, mine]
            power = (weighed * np.where(there, block.vals, 0.0)[:, mine]).sum(0)
            own = np.zeros((len(mine), size))
            for k in range(0, len(block.lat), 2000):
                part = slice(k, k + 2000)
                a = design(block.lat[part], block.lon[part], nmax)
                for held in masks.values():
                    here = there[part, at[held[0]]]
                    half = (a[here] * block.w[part][here][:, None]).T
                    sums = [half[i : i + TILE] @ a[here][:, i:] for i in range(0, size, TILE)]
                    for f in held:
                        g[f] = [x + y for x, y in zip(g[f], sums)] if f in g else sums
                if mine:
                    own += weighed[part].T @ a
            for k, v, p in zip(mine, own, power):
                e = int(block.epochs[k])
                r[e] = r.get(e, 0.0) + np.append(v, p)
            if len(r) * size * 8 > HELD_BYTES:
                for e, v in r.items():
                    yield emit([(e, -1, 0, v)], team)
                r = {}
        for f, rows in g.items():
            yield emit([(f, i * TILE, j, x[:, j - i * TILE : j - i * TILE + TILE].ravel()) for i, x in enumerate(rows) for j in range(i * TILE, size, TILE)], team)
        for e, v in r.items():
            yield emit([(e, -1, 0, v)], team)

    def emit(rows: list[tuple], team: int) -> pa.RecordBatch:
        key, row, col, v = zip(*rows)
        cols = [pa.array(x, pa.int32()) for x in (key, row, col, [team] * len(rows))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(v, pa.list_(pa.float64()))], names=["key", "row", "col", "team", "v"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(pdf["v"].to_numpy()), axis=0)
        return pd.DataFrame({c: [pdf[c].iloc[0]] for c in ("key", "row", "col")} | {"team": [0], "v": [total]})

    out = points.mapInArrow(run, kind)
    out = out.groupBy("key", "row", "col", "team").applyInPandas(added, kind)
    return out.groupBy("key", "row", "col").applyInPandas(added, kind)


def normals(weighted: DataFrame, nmax: int, rhs: bool = True) -> Iterator[Normal]:
    """The normal equations of each set of points, some of them at a time. The points are looked at once, however many sets
    there are; what follows passes over their blocks."""
    size = (nmax + 1) ** 2
    if size > LARGEST:
        raise ValueError(f"{size} unknowns; normal matrices are formed for {LARGEST} at most")
    points = weighted if "vals" in weighted.columns else stored(blocked(_any_values(weighted)), "blocks")
    sets = point_sets(points)
    firsts, some = sorted(sets), max(1, MATRICES // (8 * size * size))
    for k in range(0, len(firsts), some):
        now = {f: sets[f] for f in firsts[k : k + some]}
        rows = _tiles(points, nmax, rhs, now).toArrow().to_pandas()
        sums = rows[rows["row"] < 0]
        for first, epochs in now.items():
            out = Normal(nmax, np.zeros((size, size)))
            for t in rows[(rows["row"] >= 0) & (rows["key"] == first)].itertuples():
                i, j = min(TILE, size - t.row), min(TILE, size - t.col)
                tile = np.asarray(t.v).reshape(i, j)
                out.matrix[t.row : t.row + i, t.col : t.col + j] = tile
                out.matrix[t.col : t.col + j, t.row : t.row + i] = tile.T
            for e, v in zip(sums["key"], sums["v"]):
                if e in epochs:
                    out.rhs[int(e)], out.power[int(e)] = np.asarray(v)[:size], float(np.asarray(v)[size])
            yield out
    if points is not weighted:
        discard(points)


def normal(weighted: DataFrame, nmax: int, rhs: bool = True) -> Normal:
    """The normal equations of points that all epochs have."""
    found = list(normals(weighted, nmax, rhs))
    if len(found) > 1:
        raise ValueError(f"the epochs have {len(found)} different sets of points; take one of them")
    size = (nmax + 1) ** 2
    return found[0] if found else Normal(nmax, np.zeros((size, size)))


def gram(weighted: DataFrame, nmax: int) -> np.ndarray:
    """The completeness matrix A'WA / 4 pi: the identity where the weights are exact."""
    return normal(weighted, nmax, rhs=False).matrix / FOUR_PI


#: Multiplications that are spent to judge completeness: by the whole matrix, and by probes.
WHOLE, PROBED = 1e11, 1e13
#: Random vectors of a probe.
PROBES = 8


def judged_by(points: int, sets: int, nmax: int) -> str:
    """full, probe or order 0: how completeness is judged, by the multiplications that it takes over so many points."""
    size = (nmax + 1) ** 2
    if size <= LARGEST and points * sets * size * size <= WHOLE:
        return "full"
    return "probe" if 4 * points * sets * size * PROBES <= PROBED else "order 0"


def checked_deviation(weighted: DataFrame, nmax: int) -> tuple[float, str]:
    """How far the completeness matrix is from the identity, over all sets of points, and what was looked at: ``full``, all
    of it, its largest entry; ``probe``, the largest root mean square of a row's product with random signs, which is the
    row's length on average and so no less than its largest entry; ``order 0``, the diagonal of order 0 alone."""
    points = weighted if "vals" in weighted.columns else stored(blocked(_any_values(weighted)), "blocks")
    sets = point_sets(points)
    most = points.select(F.explode(F.zip_with("epochs", F.transform("epochs", lambda e: F.size("lat")), lambda e, n: F.struct(e.alias("e"), n.alias("n")))).alias("x"))
    n = most.groupBy("x.e").agg(F.sum("x.n").alias("n")).agg(F.max("n")).first()[0] or 0
    how = judged_by(n, len(sets), nmax)
    if how == "full":
        out = max((float(np.abs(eq.matrix / FOUR_PI - np.eye(len(eq.matrix))).max()) for eq in normals(points, nmax, rhs=False)), default=float("nan"))
    else:
        out = probed_deviation(points, nmax, sorted(sets)) if how == "probe" else diagonal_deviation(points, nmax)
    if points is not weighted:
        discard(points)
    return out, how


def deviation(weighted: DataFrame, nmax: int) -> float:
    return checked_deviation(weighted, nmax)[0]


def probed_deviation(points: DataFrame, nmax: int, firsts: list[int], seed: int = 0) -> float:
    """The largest length of a row of the completeness matrix less the identity, from PROBES products of it with vectors of
    random signs, for the epochs ``firsts`` in one pass over stored blocks."""
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], ((nmax + 1) ** 2, PROBES))
    sets = np.stack([squared(v, nmax) for v in signs.T], -1)
    worst = 0.0
    for k in range(0, len(firsts), 256):
        some = firsts[k : k + 256]

        def run(batches: Iterator[pa.RecordBatch], some: list[int] = some) -> Iterator[pa.RecordBatch]:
            sums = _Sums(nmax)
            for block in blocks_in(batches):
                at = {e: c for c, e in enumerate(block.epochs.tolist())}
                mine = [e for e in some if e in at]
                if not mine:
                    continue
                field = synthesised(block, sets) * block.w[:, None]
                for e in mine:
                    keys = np.arange(PROBES) + PROBES * some.index(e)
                    sums.add(keys, analysed(block, nmax, np.where(np.isnan(block.vals[:, at[e]])[:, None], 0.0, field)))
                if sums.full():
                    yield from sums.drain()
            yield from sums.drain()

        got = flat(_total(points.mapInArrow(run, COEFFS)), nmax)
        for i in range(len(some)):
            off = np.stack([got.get(PROBES * i + j, np.zeros(len(signs))) - signs[:, j] for j in range(PROBES)])
            worst = max(worst, float(np.sqrt((off**2).mean(0)).max()))
    return worst


def diagonal_deviation(weighted: DataFrame, nmax: int) -> float:
    """max over degrees and epochs of |sum of w P_n0^2 / 4 pi - 1|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for block in blocks_in(batches):
            lats, i = np.unique(block.lat, return_inverse=True)
            w = np.zeros((len(lats), len(block.epochs)))
            np.add.at(w, i, ~np.isnan(block.vals) * block.w[:, None])
            for k in range(0, len(lats), 20_000):
                _, p = next(columns(lats[k : k + 20_000], nmax, 0))
                for e, v in zip(block.epochs.tolist(), (p**2 @ w[k : k + 20_000]).T):
                    held[e] = held.get(e, 0.0) + v
        for e, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([e] * len(v), pa.int32()), pa.array(range(len(v)), pa.int32()), pa.array(v)], names=["epoch_id", "n", "v"])

    sums = _any_values(weighted).mapInArrow(run, "epoch_id int, n int, v double").groupBy("epoch_id", "n").agg(F.sum("v").alias("v"))
    return sums.agg(F.max(F.abs(F.col("v") / FOUR_PI - 1.0))).first()[0]


def gram_rows(weighted: DataFrame, nmax: int) -> DataFrame:
    """The completeness matrix as rows (part1, n1, m1, part2, n2, m2, k)."""
    k, names = gram(weighted, nmax), ordinals(nmax)
    rows = [(*a, *b, float(k[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return weighted.sparkSession.createDataFrame(rows, "part1 string, n1 int, m1 int, part2 string, n2 int, m2 int, k double")


def to_coeffs(spark, nmax: int, solved: dict[int, np.ndarray]) -> DataFrame:
    """Flat solutions by epoch as coeffs."""
    n, m = np.tril_indices(nmax + 1)
    both = [squared(x, nmax)[:, n, m] for x in solved.values()]
    cols = [np.repeat(np.array(list(solved), np.int32), len(n)), np.tile(n.astype(np.int32), len(both)), np.tile(m.astype(np.int32), len(both))]
    cols += [np.concatenate([b[k] for b in both]) if both else np.zeros(0) for k in range(2)]
    return spark.createDataFrame(pa.table([pa.array(c) for c in cols], names=["epoch_id", "n", "m", "c", "s"]), COEFFS)


def penalty(kind: str, nmax: int, degree_rms: np.ndarray | None = None, power: float = 2.0, scale: float = 1e-5) -> np.ndarray:
    """Square roots of the diagonal regularisation: ones, or by degree against an expected spectrum or (n+1)**power."""
    n = np.array([n for _, n, _ in ordinals(nmax)])
    if kind == "tikhonov":
        return np.ones(len(n))
    if kind == "kaula":
        if degree_rms is not None:
            floor = max(float(np.max(degree_rms)) * 1e-8, 1e-300)
            return 1.0 / (np.maximum(degree_rms, floor)[n] * (n + 1.0) ** power)
        return (n + 1.0) ** power / scale
    raise ValueError(f"unknown regularisation {kind!r}")


def first_pass(weighted: DataFrame, nmax: int) -> np.ndarray:
    """Root mean square by degree of the quadrature of all epochs, as the spectrum to expect."""
    c = quadrature(weighted, nmax)
    rows = c.groupBy("n").agg(F.sqrt(F.sum(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / (2.0 * F.count("*"))).alias("rms")).toPandas()
    out = np.zeros(nmax + 1)
    out[rows["n"]] = rows["rms"]
    return out


def lcurve(g: np.ndarray, b: np.ndarray, ff: float, alphas: np.ndarray) -> float:
    """The alpha at the L-curve's sharpest bend. Misfits follow from the normal matrices alone."""
    lam, v = np.linalg.eigh(g)
    y = v.T @ b
    x = y[None, :] / (np.maximum(lam, 0)[None, :] + alphas[:, None] ** 2)
    miss = np.sqrt(np.maximum(1e-300, ff - 2 * (x * y).sum(1) + (x**2 * lam).sum(1)))
    size = np.sqrt(np.maximum(1e-300, (x**2).sum(1)))
    p, q, t = np.log(miss), np.log(size), np.log(alphas)
    dp, dq = np.gradient(p, t), np.gradient(q, t)
    bend = np.abs(dp * np.gradient(dq, t) - dq * np.gradient(dp, t)) / np.maximum(1e-300, (dp**2 + dq**2) ** 1.5)
    return float(alphas[np.argmax(bend)])


def least_squares(
    weighted: DataFrame, nmax: int, reg: str = "none", alpha: float | None = None, sigma: str | None = None, degree_rms: np.ndarray | None = None,
    power: float = 2.0, scale: float | None = None,
) -> tuple[DataFrame, dict]:
    """Weighted least squares from distributed normal matrices, one for each set of points that epochs have. reg none,
    tikhonov or kaula, with penalty alpha**2 r**2; without alpha it comes from the L-curve of a set's first epoch (1e-6
    beyond 2500 unknowns). kaula goes by degree_rms, by the absolute law with ``scale``, or by the spectrum of a first
    quadrature. sigma: column of standard deviations; rows weigh w / sigma**2. The figures are those of the worst set.
    Beyond LARGEST unknowns no matrix is formed: ``krylov.solve`` iterates, and condition_number is that of its
    preconditioned system."""
    if sigma:
        weighted = weighted.withColumn("w", F.col("w") / (F.col(sigma) * F.col(sigma)))
    if alpha is not None and reg == "none":
        reg = "tikhonov"
    r = None
    if reg != "none":
        if reg == "kaula" and degree_rms is None and scale is None:
            degree_rms = first_pass(weighted, nmax)
        r = penalty(reg, nmax, degree_rms, power, scale or 1e-5)
    size = (nmax + 1) ** 2
    if size > LARGEST:
        from orbweave.operators import krylov

        used, points = (alpha if alpha is not None else 1e-6) if r is not None else None, held_blocks(weighted)
        done = krylov.solve(points, nmax, None if r is None else used * r)
        discard(points)
        return to_coeffs(weighted.sparkSession, nmax, done.x), {"alpha": used, "regularization": reg, "condition_number": done.condition, "iterations": done.steps}
    solved, used, cond = {}, alpha, 0.0
    for eq in normals(weighted, nmax):
        g = eq.matrix
        if r is not None:
            if alpha is None:
                e = min(eq.rhs)
                used = 1e-6 if len(g) > 2500 else lcurve(g / np.outer(r, r), eq.rhs[e] / r, eq.power[e], np.logspace(-12, 2, 15))
            g = g + np.diag((used * r) ** 2)
        lam = np.linalg.eigvalsh(g)
        mine = float(np.sqrt(lam[-1] / lam[0])) if lam[0] > 0 else float("inf")
        cond = max(cond, mine)
        epochs = sorted(eq.rhs)
        b = np.stack([eq.rhs[e] for e in epochs], 1)
        x = np.linalg.solve(g, b) if mine < 1e8 else np.linalg.lstsq(g, b, rcond=1e-15)[0]
        solved |= {e: x[:, k] for k, e in enumerate(epochs)}
    return to_coeffs(weighted.sparkSession, nmax, solved), {"alpha": used, "regularization": reg, "condition_number": cond}


def conjugate_gradients(weighted: DataFrame, nmax: int, rtol: float = 1e-10, most: int | None = None) -> tuple[DataFrame, int]:
    """Least squares with W on both sides, by iterations. Up to LARGEST unknowns they run on the driver with the matrix of
    each set of points; beyond, no matrix is formed, and an iteration is one pass over stored blocks of the points for all
    epochs that are not yet done. Either way each epoch's own points count."""
    spark, size = weighted.sparkSession, (nmax + 1) ** 2
    most = most or min(2000, 20 * size)
    if size <= LARGEST:
        solved, done = {}, 0
        for eq in normals(weighted, nmax):
            x, k = _iterate(lambda v, g=eq.matrix: {e: g @ y for e, y in v.items()}, eq.rhs, rtol, most)
            solved, done = solved | x, max(done, k)
        return to_coeffs(spark, nmax, solved), done
    from orbweave.operators import krylov

    points = held_blocks(weighted)
    out = krylov.solve(points, nmax, rtol=rtol, most=most)
    discard(points)
    return to_coeffs(spark, nmax, out.x), out.steps


def _iterate(apply, rhs: dict[int, np.ndarray], rtol: float, most: int) -> tuple[dict[int, np.ndarray], int]:
    """Conjugate gradients of all epochs side by side: the solutions, and the most steps that one took."""
    x = {e: np.zeros_like(b) for e, b in rhs.items()}
    r, p = {e: b.copy() for e, b in rhs.items()}, {e: b.copy() for e, b in rhs.items()}
    rr = {e: float(b @ b) for e, b in rhs.items()}
    for k in range(most):
        open_ = [e for e, b in rhs.items() if np.sqrt(rr[e]) > rtol * np.linalg.norm(b)]
        if not open_:
            return x, k
        ap = apply({e: p[e] for e in open_})
        for e in open_:
            step = rr[e] / (p[e] @ ap[e])
            x[e], r[e] = x[e] + step * p[e], r[e] - step * ap[e]
            new = float(r[e] @ r[e])
            p[e], rr[e] = r[e] + new / rr[e] * p[e], new
    return x, most


def flat(coeffs: DataFrame, nmax: int) -> dict[int, np.ndarray]:
    """Solutions by epoch in the order of ``ordinals``; of a bounded number of coefficients."""
    at = spots(nmax)
    return {e: v[at] for e, v in sets_of(coeffs, nmax).items()}


def squared(x: np.ndarray, nmax: int) -> np.ndarray:
    """A flat solution as 2 x degrees x orders."""
    out = np.zeros((2, nmax + 1, nmax + 1))
    out[spots(nmax)] = x
    return out


def spots(nmax: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(0 for cosines, 1 for sines; n; m) of ``ordinals``."""
    part, n, m = zip(*ordinals(nmax))
    return np.array([int(p == "s") for p in part]), np.array(n), np.array(m)


def projection(weighted: DataFrame, nmax: int, tau: float | None = None) -> DataFrame:
    """A'Wf / 4 pi with the weights as areas. tau in (0, 1]: divides by the eigenvalues of the completeness matrix that
    reach tau, and drops the others; each set of points has its own."""
    if tau is None:
        return quadrature(weighted, nmax)
    if not 0 < tau <= 1:
        raise ValueError("tau is in (0, 1]")
    solved = {}
    for eq in normals(weighted, nmax):
        lam, v = np.linalg.eigh(eq.matrix / FOUR_PI)
        keep = lam >= tau
        solved |= {e: v[:, keep] @ ((v[:, keep].T @ b / FOUR_PI) / lam[keep]) for e, b in eq.rhs.items()}
    return to_coeffs(weighted.sparkSession, nmax, solved)


def residuals(weighted: DataFrame, coeffs: DataFrame | dict[int, np.ndarray], nmax: int) -> DataFrame:
    """By epoch, over the measured points: n_points, data_rms, residual_rms, residual_rms_weighted, dc_mean, total weight.
    One set of coefficients with epoch 0 serves all epochs; sets may be given as ``synthesis.sets_of`` has them. Tasks hand on
    sums, not points."""
    sets = coeffs if isinstance(coeffs, dict) else sets_of(coeffs, nmax)
    single = list(sets) == [0]
    names = ["n", "ff", "dd", "wdd", "wf", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        unknown = np.full((2, nmax + 1, nmax + 1), np.nan)
        for block in blocks_in(batches):
            x = np.stack([sets.get(0 if single else e, unknown) for e in block.epochs.tolist()], -1)
            f, w = block.vals, block.w[:, None]
            d = f - synthesised(block, x)
            there = ~np.isnan(f)
            f, d, w = np.where(there, f, 0.0), np.where(there, d, 0.0), w * there
            sums = np.stack([there.sum(0), (f * f).sum(0), (d * d).sum(0), (w * d * d).sum(0), (w * f).sum(0), w.sum(0)], 1)
            for e, v in zip(block.epochs.tolist(), sums):
                held[e] = held.get(e, 0.0) + v
        if held:
            cols = [pa.array(list(held), pa.int32()), *[pa.array(x) for x in np.stack(list(held.values()), 1)]]
            yield pa.RecordBatch.from_arrays(cols, names=["epoch_id", *names])

    rows = _rows(weighted).mapInArrow(run, "epoch_id int, " + ", ".join(f"{c} double" for c in names))
    total = rows.groupBy("epoch_id").agg(*[F.sum(c).alias(c) for c in names])
    known = lambda x: F.when(~F.isnan(x), x)  # noqa: E731  null where an epoch has no coefficients
    return total.select(
        "epoch_id", F.col("n").cast("long").alias("n_points"), F.sqrt(F.col("ff") / F.col("n")).alias("data_rms"), known(F.sqrt(F.col("dd") / F.col("n"))).alias("residual_rms"),
        known(F.sqrt(F.col("wdd") / F.nullif("w", F.lit(0.0)))).alias("residual_rms_weighted"), (F.col("wf") / F.lit(FOUR_PI)).alias("dc_mean"), F.col("w").alias("weight_sum"),
    )


#: What each method takes besides.
OPTIONS = {"quadrature": (), "iterative": ("steps",), "projection": ("tau",), "wlsq": ("reg", "alpha", "sigma", "degree_rms", "power", "scale"), "cg": ("rtol", "most")}


def health(weighted: DataFrame, nmax: int) -> tuple[float, float, int]:
    """(deviation of the completeness matrix, coverage, points): the first and the last of the epoch whose measured points
    are worst, coverage of the points of all epochs together."""
    from orbweave.operators.weights import report

    row = measured(weighted).groupBy("epoch_id").agg(F.count("*").alias("n")).agg(F.min("n")).first()
    return deviation(weighted, nmax), report(weighted).first()["coverage"] or 0.0, row[0] or 0


def analyse(
    weighted: DataFrame, nmax: int, method: str = "auto", longitude: str = "auto", field_unit: str | None = None, target_unit: str | None = None,
    love: DataFrame | None = None, **how,
) -> tuple[DataFrame, str]:
    """Coefficients and the method taken: auto looks at the quadrature's completeness and coverage first. ``how`` may hold
    the options of any method; those of others are passed over when auto chooses, and refused when one is asked for.

    field_unit says what the values are: the field's coefficients a become geopotential ones, a / f, by its factors; a
    target_unit that no factor leads to is refused here, not after the work."""
    if unknown := set(how) - set().union(*OPTIONS.values()):
        raise ValueError(f"no method takes {sorted(unknown)}")
    if field_unit is not None and target_unit is not None:
        units.require_convertible(field_unit, target_unit)
    if method == "auto":
        method = planner.choose_method(*health(weighted, nmax), (nmax + 1) ** 2)
        how = {k: v for k, v in how.items() if k in OPTIONS[method]}
    if method not in OPTIONS:
        raise ValueError(f"unknown method {method!r}")
    how = {k: v for k, v in how.items() if v is not None}
    if foreign := set(how) - set(OPTIONS[method]):
        raise ValueError(f"{method} takes no {sorted(foreign)}")
    if method == "quadrature":
        out = quadrature_planned(weighted, nmax, longitude)[0]
    elif method == "iterative":
        out = richardson(weighted, nmax, how.get("steps", 3))
    elif method == "projection":
        out = projection(weighted, nmax, how.get("tau"))
    elif method == "wlsq":
        out = least_squares(weighted, nmax, **how)[0]
    else:
        out = conjugate_gradients(weighted, nmax, **how)[0]
    return units.canonical(out, field_unit, love) if field_unit is not None else out, method
