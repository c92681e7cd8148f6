"""Series of coefficients in time: means, fits, filters and what is read off them.

All (n, m) share one design in time, so its p x p normal matrix is formed once from the epoch table on the driver, and
the solution operator, p numbers an epoch, joins the coefficients; the fit itself is a grouped sum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.calendar import DAYS, seconds
from orbweave.operators.coeffs import less_single, missing_epochs

YEAR = 365.25


def time_mean(coeffs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """n, m, c, s: weighted mean over the epochs that aren't missing. weights: epoch_id, w."""
    rows = coeffs.join(missing_epochs(coeffs), "epoch_id", "left_anti")
    rows = rows.join(weights, "epoch_id") if weights is not None else rows.withColumn("w", F.lit(1.0))
    return rows.groupBy("n", "m").agg(*[(F.sum(F.col("w") * F.col(x)) / F.sum("w")).alias(x) for x in ("c", "s")])


def anomaly(coeffs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    return less_single(coeffs, time_mean(coeffs, weights))


@dataclass
class Fit:
    """terms: names; tref: seconds of the reference time; span: seconds of the first and last epoch fitted; frame: term, n,
    m, c, s; solve: term, epoch_id, h; design: term, epoch_id, x; cond and rank of the design; notes; used and excluded
    epochs; coeffs: the series."""

    terms: list[str]
    tref: float
    span: tuple[float, float]
    frame: DataFrame
    solve: DataFrame
    design: DataFrame
    cond: float
    rank: int
    notes: list[str]
    used: list[int]
    excluded: list[int]
    coeffs: DataFrame

    def term(self, name: str) -> DataFrame:
        return self.frame.where(F.col("term") == name).select("n", "m", "c", "s")

    def amplitude_phase(self, period: float) -> DataFrame:
        """n, m, amplitude and phase (radians and days after the reference time) of c and s at a period in years."""
        p = _name(period)
        a, b = self.term(f"cos{p}"), self.term(f"sin{p}").withColumnsRenamed({"c": "_c", "s": "_s"})
        out = a.join(b, ["n", "m"])
        cols = []
        for x in ("c", "s"):
            phase = F.atan2(f"_{x}", x)
            cols += [F.hypot(x, f"_{x}").alias(f"amplitude_{x}"), phase.alias(f"phase_{x}"), (F.pmod(phase, F.lit(2 * np.pi)) / (2 * np.pi) * period * YEAR).alias(f"phase_days_{x}")]
        return out.select("n", "m", *cols)

    def model(self, terms: list[str] | None = None) -> DataFrame:
        """The fitted series (epoch_id, n, m, c, s), of some of the terms."""
        use = self.design.where(F.col("term").isin(terms or self.terms))
        return self.frame.join(use, "term").groupBy("epoch_id", "n", "m").agg(*[F.sum(F.col(x) * F.col("x")).alias(x) for x in ("c", "s")])


    def evaluate(self, at: DataFrame) -> DataFrame:
        """epoch_id, n, m, c, s, extrapolated: the fitted terms at the dates of at (epoch_id, ts), which may lie outside the
        span that was fitted. Terms from extra columns are taken from columns of at with their names."""
        years = (seconds(F.col("ts")) - self.tref) / (DAYS * YEAR)
        x = {name: _term(name, years) for name in self.terms}
        out = (seconds(F.col("ts")) < self.span[0] - 1e-3) | (seconds(F.col("ts")) > self.span[1] + 1e-3)
        parts = F.explode(F.array(*[F.struct(F.lit(k).alias("term"), v.cast("double").alias("x")) for k, v in x.items()])).alias("t")
        rows = at.select("epoch_id", out.alias("extrapolated"), parts).select("epoch_id", "extrapolated", "t.term", "t.x")
        sums = [F.sum(F.col(v) * F.col("x")).alias(v) for v in ("c", "s")]
        return rows.join(self.frame, "term").groupBy("epoch_id", "n", "m").agg(*sums, F.first("extrapolated").alias("extrapolated"))

    def summary(self) -> str:
        """What the fit is worth, as text."""
        left = anomaly_reduction(self.coeffs.where(F.col("epoch_id").isin(self.used)), self)
        row = left.agg(F.median("residual_rms").alias("mid"), F.max("residual_rms").alias("most"), F.sqrt(F.avg(F.col("anomaly_rms") ** 2)).alias("anomaly"), F.sqrt(F.avg(F.col("residual_rms") ** 2)).alias("rest")).first()
        gone = f" (without {self.excluded[:6]})" if self.excluded else ""
        share = f"{100 * (1 - row['rest'] / row['anomaly']):.1f} %" if row["anomaly"] else "nothing"
        lines = [
            f"terms: {', '.join(self.terms)}", f"epochs: {len(self.used)} of {len(self.used) + len(self.excluded)}{gone}",
            f"design: condition number {self.cond:.3g}, rank {self.rank} of {len(self.terms)}",
            f"residual RMS: median {row['mid']:.6g}, most {row['most']:.6g}", f"anomaly RMS: {row['anomaly']:.6g}, of which the terms explain {share}",
        ]
        return "\n".join(lines + [f"note: {x}" for x in self.notes])


def _term(name: str, years: Column) -> Column:
    """A term as a function of the years from the reference time."""
    if name in ("const", "trend"):
        return F.lit(1.0) if name == "const" else years
    if name.startswith("poly") and name[4:].isdigit():
        return F.pow(years, F.lit(int(name[4:])))
    for wave, f in (("cos", F.cos), ("sin", F.sin)):
        if name.startswith(wave) and _number(name[3:]):
            return f(years * (2 * np.pi / float(name[3:])))
    return F.col(name)


def _number(x: str) -> bool:
    try:
        float(x)
    except ValueError:
        return False
    return True


def _name(period: float) -> str:
    return f"{period:g}"


def terms_of(order: int, periods: list[float]) -> list[str]:
    names = ["const", "trend"] + [f"poly{k}" for k in range(2, order + 1)]
    return names[: order + 1] + [f"{f}{_name(p)}" for p in periods for f in ("cos", "sin")]


def design_matrix(years: np.ndarray, order: int, periods: list[float]) -> np.ndarray:
    cols = [years**k for k in range(order + 1)]
    for p in periods:
        cols += [np.cos(2 * np.pi * years / p), np.sin(2 * np.pi * years / p)]
    return np.stack(cols, 1)


def operator(epochs: pd.DataFrame, order: int, periods: list[float], extra: dict[str, np.ndarray] | None = None):
    """(terms, tref, design, solution operator p x epochs, cond, rank, notes) of epochs (epoch_id, sec, w)."""
    w = epochs["w"].to_numpy(float)
    if (w < 0).any() or not np.isfinite(w).all():
        raise ValueError("weights of epochs are finite and not negative")
    sec = epochs["sec"].to_numpy(float)
    tref = float((sec.min() + sec.max()) / 2)
    years = (sec - tref) / (DAYS * YEAR)
    x = design_matrix(years, order, periods)
    terms = terms_of(order, periods)
    for name, col in (extra or {}).items():
        terms, x = [*terms, name], np.column_stack([x, col])
    if (w > 0).sum() < x.shape[1]:
        raise ValueError(f"{int((w > 0).sum())} epochs for {x.shape[1]} terms")
    h = np.linalg.pinv(x * np.sqrt(w)[:, None]) * np.sqrt(w)[None, :]
    cond, rank = float(np.linalg.cond(x)), int(np.linalg.matrix_rank(x))
    gaps = np.diff(np.sort(sec)) / DAYS
    notes = []
    if cond > 100:
        notes.append(f"condition number {cond:.3g}")
    if rank < x.shape[1]:
        notes.append(f"rank {rank} of {x.shape[1]}")
    if len(gaps) and np.abs(gaps - np.median(gaps)).max() > 3:
        notes.append("epochs are irregular")
    return terms, tref, x, h, cond, rank, notes


def _tables(spark, ids: np.ndarray, terms: list[str], x: np.ndarray, h: np.ndarray) -> tuple[DataFrame, DataFrame]:
    long = lambda a, v: spark.createDataFrame([(t, int(e), float(a[j, i])) for j, t in enumerate(terms) for i, e in enumerate(ids)], f"term string, epoch_id int, {v} double")
    return long(h, "h"), long(x.T, "x")


#: Epochs of one fit.
EPOCHS = 100_000


def _known(rows: DataFrame) -> pd.DataFrame:
    """A row an epoch, on the driver."""
    table = rows.limit(EPOCHS + 1).toPandas()
    if len(table) > EPOCHS:
        raise ValueError(f"more than {EPOCHS} epochs for one fit; filter epochs first")
    return table


def fit(
    coeffs: DataFrame, epochs: DataFrame, order: int = 1, periods: list[float] | None = None, weights: DataFrame | None = None, keep: list[int] | None = None,
    extra: DataFrame | None = None,
) -> Fit:
    """Least squares of polynomial and periodic terms (periods in years) over the epochs that are kept and not missing.
    extra: further terms as columns beside epoch_id, with a number for every epoch. An epoch with nulls or NaN in part is
    an error; coefficients without a row count as 0, as they do everywhere."""
    odd = coeffs.groupBy("epoch_id").agg(F.count_if(F.isnan("c") | F.col("c").isNull()).alias("bad"), F.count("*").alias("n"))
    state = _known(odd)
    if ((state["bad"] > 0) & (state["bad"] < state["n"])).any():
        raise ValueError("an epoch lacks some of its coefficients")
    good = set(state.loc[state["bad"] == 0, "epoch_id"]) & (set(keep) if keep is not None else set(state["epoch_id"]))
    rows = epochs.select("epoch_id", seconds(F.col("ts")).alias("sec"))
    rows = rows.join(weights.select("epoch_id", "w"), "epoch_id") if weights is not None else rows.withColumn("w", F.lit(1.0))
    names = [c for c in extra.columns if c != "epoch_id"] if extra is not None else []
    rows = rows.join(extra, "epoch_id", "left") if names else rows
    rows = _known(rows).sort_values("epoch_id", ignore_index=True)
    if names and not np.isfinite(rows[names].to_numpy(float)).all():
        raise ValueError("an extra term has no number for some epoch")
    rows.loc[~rows["epoch_id"].isin(good), "w"] = 0.0
    terms, tref, x, h, cond, rank, notes = operator(rows, order, periods or [], {c: rows[c].to_numpy(float) for c in names})
    ids, some = rows["epoch_id"].to_numpy(), rows["epoch_id"].isin(good).to_numpy()
    _, design = _tables(coeffs.sparkSession, ids, terms, x, h)
    solve, _ = _tables(coeffs.sparkSession, ids[some], terms, x[some], h[:, some])
    frame = coeffs.join(solve, "epoch_id").groupBy("term", "n", "m").agg(*[F.sum(F.col(v) * F.col("h")).alias(v) for v in ("c", "s")])
    used = rows["w"] > 0
    ids, sec = rows["epoch_id"].astype(int), rows["sec"]
    return Fit(terms, tref, (float(sec[used].min()), float(sec[used].max())), frame, solve, design, cond, rank, notes, ids[used].tolist(), ids[~used].tolist(), coeffs)


def detrended(coeffs: DataFrame, epochs: DataFrame, order: int = 1, periods: list[float] | None = None) -> DataFrame:
    """The series less its mean and trend."""
    f = fit(coeffs, epochs, order, periods)
    return _less(coeffs, f.model([t for t in f.terms if t in ("const", "trend") or t.startswith("poly")]))


def deseasonalised(coeffs: DataFrame, epochs: DataFrame, order: int = 1, periods: list[float] | None = None) -> DataFrame:
    f = fit(coeffs, epochs, order, periods or [1.0, 0.5])
    return _less(coeffs, f.model([t for t in f.terms if t.startswith(("cos", "sin"))]))


def _less(a: DataFrame, b: DataFrame) -> DataFrame:
    from orbweave.operators.coeffs import combine

    return combine(a, b, -1, check=False)


def anomaly_reduction(coeffs: DataFrame, f: Fit) -> DataFrame:
    """By epoch: rms of what the fit leaves, and of the anomaly from the mean."""
    rms = F.sqrt(F.avg(F.col("c") * F.col("c") + F.col("s") * F.col("s")))
    left = _less(coeffs, f.model()).groupBy("epoch_id").agg(rms.alias("residual_rms"))
    return left.join(anomaly(coeffs).groupBy("epoch_id").agg(rms.alias("anomaly_rms")), "epoch_id")


def gaussian_in_time(coeffs: DataFrame, epochs: DataFrame, sigma_years: float, reach: float = 4.0) -> DataFrame:
    """The series under a Gaussian kernel in true time, cut at ``reach`` sigmas, weights normalised over the epochs that
    aren't missing; an epoch that nothing reaches stays as it is. Epochs meet in boxes of the reach."""
    sigma = sigma_years * YEAR * DAYS
    box = F.lit(max(reach * sigma, 1.0))
    t = epochs.select("epoch_id", seconds(F.col("ts")).alias("x"))
    good = t.join(missing_epochs(coeffs), "epoch_id", "left_anti").select(F.col("epoch_id").alias("other"), F.col("x").alias("y")).withColumn("b", F.floor(F.col("y") / box))
    own = t.withColumn("b", F.explode(F.array(*[F.floor(F.col("x") / box) + k for k in (-1, 0, 1)])))
    pairs = own.join(good, "b").where(F.abs(F.col("x") - F.col("y")) <= reach * sigma)
    pairs = pairs.select("epoch_id", "other", F.exp(-0.5 * F.pow((F.col("x") - F.col("y")) / sigma, 2.0)).alias("g"))
    pairs = pairs.withColumn("g", F.col("g") / F.sum("g").over(Window.partitionBy("epoch_id")))
    named = coeffs.select(F.col("epoch_id").alias("other"), "n", "m", "c", "s")
    out = named.join(pairs, "other").groupBy("epoch_id", "n", "m").agg(*[F.sum(F.col("g") * F.col(x)).alias(x) for x in ("c", "s")])
    rest = coeffs.join(pairs.select("epoch_id").distinct(), "epoch_id", "left_anti").select("epoch_id", "n", "m", "c", "s")
    return out.unionByName(rest)


def kernel_report(epochs: DataFrame, sigma_years: float, reach: float = 4.0) -> DataFrame:
    """epoch_id, effective: 1 / sum of squared normalised weights; below 1.5 the filter does nothing there."""
    sigma = sigma_years * YEAR * DAYS
    box = F.lit(max(reach * sigma, 1.0))
    t = epochs.select("epoch_id", seconds(F.col("ts")).alias("x"))
    own = t.withColumn("b", F.explode(F.array(*[F.floor(F.col("x") / box) + k for k in (-1, 0, 1)])))
    other = t.select(F.col("x").alias("y"), F.floor(F.col("x") / box).alias("b"))
    g = F.exp(-0.5 * F.pow((F.col("x") - F.col("y")) / sigma, 2.0))
    pairs = own.join(other, "b").where(F.abs(F.col("x") - F.col("y")) <= reach * sigma).withColumn("g", g)
    return pairs.groupBy("epoch_id").agg((F.sum("g") * F.sum("g") / F.sum(F.col("g") * F.col("g"))).alias("effective"))


def basin_average(field: DataFrame, key: str = "basin") -> DataFrame:
    """field (epoch_id, value, w, key) to the weighted mean, area and points of each basin and epoch."""
    f = field.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return f.groupBy(key, "epoch_id").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("mean"), F.sum("w").alias("area"), F.count("*").alias("n_points"))


def cell_fits(field: DataFrame, epochs: DataFrame, order: int = 1, periods: list[float] | None = None, cell: str = "point_id") -> DataFrame:
    """cell, term, value, n_used: the same fit for each cell of a field (cell, epoch_id, value); a cell with a gap gets
    nulls."""
    rows = _known(epochs.select("epoch_id", seconds(F.col("ts")).alias("sec")).withColumn("w", F.lit(1.0))).sort_values("epoch_id", ignore_index=True)
    terms, _, x, h, *_ = operator(rows, order, periods or [])
    wide = field.sparkSession.createDataFrame([(int(e), *map(float, h[:, k])) for k, e in enumerate(rows["epoch_id"])], "epoch_id int, " + ", ".join(f"_h{j} double" for j in range(len(terms))))
    sums = [F.sum(F.col("value") * F.col(f"_h{j}")).alias(f"_t{j}") for j in range(len(terms))]
    out = field.join(wide, "epoch_id").groupBy(cell).agg(*sums, F.count_if(F.col("value").isNotNull() & ~F.isnan("value")).alias("n_used"))
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"_t{j}").alias("value")) for j, t in enumerate(terms)])).alias("x")
    out = out.select(cell, "n_used", each).select(cell, "x.term", "x.value", "n_used")
    return out.withColumn("value", F.when(F.col("n_used") == len(rows), F.col("value")))


def outliers(table: DataFrame, value: str = "value", most: float = 3.0) -> DataFrame:
    """table with z = 0.6745 (v - median) / MAD and outlier (|z| above ``most``, or not finite). Fewer than 4 good values
    or no spread: only what isn't finite."""
    v = F.col(value)
    good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    mid = table.where(good).agg(F.median(value).alias("_m"), F.count("*").alias("_n"))
    with_mid = table.join(F.broadcast(mid))
    mad = with_mid.where(good).agg(F.median(F.abs(v - F.col("_m"))).alias("_d"))
    z = F.when((F.col("_n") >= 4) & (F.col("_d") > 0) & good, 0.6745 * (v - F.col("_m")) / F.col("_d"))
    out = with_mid.join(F.broadcast(mad)).withColumn("z", z)
    return out.withColumn("outlier", ~good | F.coalesce(F.abs("z") > most, F.lit(False))).drop("_m", "_n", "_d")
