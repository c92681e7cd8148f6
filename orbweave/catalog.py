"""The queries of the spherical-harmonic operators on the star-schema tables, and the same in DuckDB's SQL.

Numbers are rounded where sums may be added up in another order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions import calendar, geo, kernels, units
from orbweave.operators import analysis, coeffs, report, slepian, spectrum, synthesis, timeaxis, timeseries, weights
from orbweave.plans import planner
from orbweave.sources import carriers
from orbweave.streaming import quadrature as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def r(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.select(*[r(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def rr(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0e0"


def solved(source: str, keys: str, n: int, m: int = 1) -> str:
    """CTEs x0, x1, ... that solve n equations by elimination: source has keys, a0_0 .. and b0_0 .. (right-hand sides). The
    solutions are b0_0 .. of the last of them, ``x{n}``."""
    a, b = [f"a{i}_{j}" for i in range(n) for j in range(n)], [f"b{i}_{j}" for i in range(n) for j in range(m)]
    out = [f"x0 AS (SELECT {keys}{', ' if keys else ''}{', '.join(a + b)} FROM {source})"]
    for k in range(n):
        cols = []
        for i in range(n):
            for kind, wide in (("a", n), ("b", m)):
                for j in range(wide):
                    here = f"{kind}{i}_{j}"
                    cols.append(f"{kind}{k}_{j} / a{k}_{k} AS {here}" if i == k else f"{here} - a{i}_{k} * {kind}{k}_{j} / a{k}_{k} AS {here}")
        out.append(f"x{k + 1} AS (SELECT {keys}{', ' if keys else ''}{', '.join(cols)} FROM x{k})")
    return ", ".join(out)


BASIS4 = ["1.0e0", "sqrt(3.0e0) * t", "sqrt(3.0e0) * u * cos(l)", "sqrt(3.0e0) * u * sin(l)"]


def normal4(source: str, keys: str = "", ridge: str = "0.0e0") -> str:
    """CTE eq: the normal equations of the four unknowns up to degree 1 of source (w, value, t, u, l), by keys."""
    cols = [f"sum(w * ({p}) * ({q})) + {ridge if i == j else '0.0e0'} AS a{i}_{j}" for i, p in enumerate(BASIS4) for j, q in enumerate(BASIS4)]
    cols += [f"sum(w * value * ({p})) AS b{i}_0" for i, p in enumerate(BASIS4)]
    return f"eq AS (SELECT {keys}{', ' if keys else ''}{', '.join(cols)} FROM {source} {'GROUP BY ' + keys if keys else ''})"


def rows4(digits: int = 6, keys: str = "") -> str:
    """The solutions of four unknowns as rows n, m, c, s."""
    k = f"{keys}, " if keys else ""
    parts = [f"SELECT {k}{n} AS n, {m} AS m, {rr(c, digits)} AS c, {rr(s, digits)} AS s FROM x4" for n, m, c, s in ((0, 0, "b0_0", "0.0e0"), (1, 0, "b1_0", "0.0e0"), (1, 1, "b2_0", "b3_0"))]
    return " UNION ALL ".join(parts)


# --- carriers in SQL -------------------------------------------------------------------------------------------------
TURN = f"{np.pi * (1.0 + 5.0**0.5)!r}e0"
TWO_PI, FOUR_PI = f"{2 * np.pi!r}e0", f"{4 * np.pi!r}e0"
SCATTER = f"""p AS (
  SELECT c_custkey AS point_id, c_acctbal AS value, c_nationkey AS nation, degrees(asin(1.0e0 - 2.0e0 * (c_custkey + 0.5e0) / n)) AS lat,
         degrees(({TURN} * c_custkey) % {TWO_PI}) % 360.0e0 AS lon, n
  FROM customer, (SELECT CAST(count(*) AS DOUBLE) AS n FROM customer))"""
GRID = """g AS (
  SELECT CAST(ilat * 36 + ilon AS BIGINT) AS point_id, ilat, ilon, ilat * 10.0e0 - 85.0e0 AS lat, ilon * 10.0e0 AS lon, value
  FROM (SELECT CAST(l_partkey % 18 AS INT) AS ilat, CAST(l_orderkey % 36 AS INT) AS ilon, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2))"""
YEARS = """g AS (
  SELECT epoch_id, ilat * 10.0e0 - 85.0e0 AS lat, ilon * 10.0e0 AS lon, value
  FROM (SELECT CAST(l_partkey % 18 AS INT) AS ilat, CAST(l_orderkey % 36 AS INT) AS ilon, CAST(year(l_shipdate) AS INT) AS epoch_id, avg(l_quantity) AS value
        FROM lineitem GROUP BY 1, 2, 3))"""
MONTHLY = """g AS (
  SELECT CAST(ilat * 36 + ilon AS BIGINT) AS point_id, epoch_id, ilat * 10.0e0 - 85.0e0 AS lat, ilon * 10.0e0 AS lon, value
  FROM (SELECT CAST(l_partkey % 18 AS INT) AS ilat, CAST(l_orderkey % 36 AS INT) AS ilon, CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INT) AS epoch_id, avg(l_quantity) AS value
        FROM lineitem GROUP BY 1, 2, 3))"""
#: Exact areas of the 10 degree cells; the outer bands reach the poles at -90 and 90.
AREA = f"({float(np.radians(10.0))!r}e0 * (sin(radians(lat + 5.0e0)) - sin(radians(lat - 5.0e0))))"
LOW = {(0, 0): "1.0e0", (1, 0): "sqrt(3.0e0) * t", (1, 1): "sqrt(3.0e0) * u", (2, 0): "sqrt(5.0e0) / 2.0e0 * (3.0e0 * t * t - 1.0e0)", (2, 1): "sqrt(15.0e0) * t * u", (2, 2): "sqrt(15.0e0) / 2.0e0 * u * u"}


def low(source: str, keep: str, nmax: int = 2) -> str:
    """Rows of source for each (n, m): keep, n, m, bc, bs (basis terms)."""
    parts = [f"SELECT {keep}, {n} AS n, {m} AS m, ({p}) * cos({m} * radians(lon)) AS bc, ({p}) * sin({m} * radians(lon)) AS bs FROM (SELECT *, sin(radians(lat)) AS t, cos(radians(lat)) AS u FROM {source})" for (n, m), p in LOW.items() if n <= nmax]
    return " UNION ALL ".join(parts)


def leg(lats: str, nmax: int) -> str:
    """CTE leg (lat, n, m, p) for the latitudes of a query with a column lat."""
    return f"""lt AS (SELECT DISTINCT lat, sin(radians(lat)) AS t, cos(radians(lat)) AS u FROM ({lats})),
seed AS (
  SELECT lat, t, u, 0 AS m, 1.0e0 AS p FROM lt
  UNION ALL
  SELECT lat, t, u, m + 1, p * u * CASE WHEN m = 0 THEN sqrt(3.0e0) ELSE sqrt((2.0e0 * m + 3.0e0) / (2.0e0 * m + 2.0e0)) END FROM seed WHERE m < {nmax}),
leg AS (
  SELECT lat, t, m, m AS n, p, 0.0e0 AS q FROM seed
  UNION ALL
  SELECT lat, t, m, n + 1,
         sqrt((2.0e0 * n + 1.0e0) * (2.0e0 * n + 3.0e0) / ((n + 1.0e0 - m) * (n + 1.0e0 + m))) * t * p
         - CASE WHEN n = m THEN 0.0e0 ELSE sqrt((2.0e0 * n + 3.0e0) * (n + m) * (n - m + 0.0e0) / ((2.0e0 * n - 1.0e0) * (n + 1.0e0 + m) * (n + 1.0e0 - m))) END * q,
         p
  FROM leg WHERE n < {nmax})"""


L8 = f"""{GRID}, {leg("SELECT lat FROM g", 8)},
k AS (
  SELECT n, m, sum({AREA.replace("lat", "g.lat")} * value * p * cos(m * radians(lon))) / {FOUR_PI} AS c, sum({AREA.replace("lat", "g.lat")} * value * p * sin(m * radians(lon))) / {FOUR_PI} AS s
  FROM g JOIN leg USING (lat) GROUP BY n, m)"""


def area_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.grid(carriers.cells(spark, sf_dir))


def l8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.quadrature(area_grid(spark, sf_dir), 8)


# --- geometry and weights --------------------------------------------------------------------------------------------
@query("fib_points", f"WITH {SCATTER} SELECT point_id, {rr('lat', 8)} AS lat, {rr('lon', 6)} AS lon FROM p")
def _(spark, sf):
    return carriers.scatter(spark, sf).select("point_id", r("lat", 8).alias("lat"), r("lon").alias("lon"))


@query("lonlat_to_xyz", f"WITH {SCATTER} SELECT point_id, {rr('cos(radians(lat)) * cos(radians(lon))')} AS x, {rr('cos(radians(lat)) * sin(radians(lon))')} AS y, {rr('sin(radians(lat))')} AS z FROM p")
def _(spark, sf):
    x, y, z = geo.lonlat_to_xyz(F.col("lon"), F.col("lat"))
    return carriers.scatter(spark, sf).select("point_id", r(x).alias("x"), r(y).alias("y"), r(z).alias("z"))


@query("xyz_to_lonlat", f"WITH {SCATTER} SELECT point_id, {rr('lat')} AS lat, {rr('lon')} AS lon FROM p")
def _(spark, sf):
    lon, lat = geo.xyz_to_lonlat(*geo.lonlat_to_xyz(F.col("lon"), F.col("lat")))
    return carriers.scatter(spark, sf).select("point_id", r(lat).alias("lat"), r(lon).alias("lon"))


@query("weights_uniform", f"WITH {SCATTER} SELECT point_id, {rr(FOUR_PI + ' / n', 12)} AS w FROM p")
def _(spark, sf):
    return weights.uniform(carriers.scatter(spark, sf)).select("point_id", r("w", 12).alias("w"))


@query("weights_grid", f"WITH {GRID} SELECT point_id, {rr(AREA, 10)} AS w FROM g")
def _(spark, sf):
    return area_grid(spark, sf).select("point_id", r("w", 10).alias("w"))


@query("weights_lattice", f"WITH {GRID} SELECT point_id, {rr(AREA, 10)} AS w FROM g")
def _(spark, sf):
    return weights.lattice(carriers.cells(spark, sf)).select("point_id", r("w", 10).alias("w"))


@query("weights_dh", f"""WITH {GRID},
a AS (SELECT lat, 4.0e0 / 18 * sin(radians(90.0e0 - lat)) * sum(sin((2.0e0 * k + 1.0e0) * radians(90.0e0 - lat)) / (2.0e0 * k + 1.0e0)) AS b
      FROM (SELECT DISTINCT lat FROM g), range(9) AS t(k) GROUP BY lat)
SELECT point_id, {rr(f'b * {TWO_PI} / 36', 10)} AS w FROM g JOIN a USING (lat)""")
def _(spark, sf):
    return weights.dh(carriers.cells(spark, sf)).select("point_id", r("w", 10).alias("w"))


@query("weights_cap_density", f"""WITH {SCATTER}
SELECT a.point_id, {rr(f'{float(2 * np.pi * (1 - np.cos(np.radians(9.0))))!r}e0 / count(*)', 10)} AS w
FROM p a JOIN p b ON a.point_id = b.point_id OR sin(radians(a.lat)) * sin(radians(b.lat)) + cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(a.lon) - radians(b.lon)) >= {float(np.cos(np.radians(9.0)))!r}e0
GROUP BY a.point_id""")
def _(spark, sf):
    return weights.cap_density(carriers.scatter(spark, sf), 9.0).select("point_id", r("w", 10).alias("w"))


@query("point_spacing", f"""WITH {SCATTER}, d AS (
  SELECT a.point_id, max(sin(radians(a.lat)) * sin(radians(b.lat)) + cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(a.lon) - radians(b.lon))) AS c FROM p a JOIN p b ON a.point_id <> b.point_id GROUP BY a.point_id)
SELECT point_id, {rr('degrees(acos(c))', 5)} AS degrees FROM d""")
def _(spark, sf):
    return rounded(weights.spacing(carriers.scatter(spark, sf)), 5, "degrees")


@query("weights_voronoi")
def _(spark, sf):
    return weights.voronoi(carriers.scatter(spark, sf)).select("point_id", "w")


@query("weights_delaunay")
def _(spark, sf):
    return weights.delaunay(carriers.scatter(spark, sf)).select("point_id", "w")


def tri(a: tuple[str, str, str], b: tuple[str, str, str], c: tuple[str, str, str]) -> str:
    """Area of a spherical triangle of unit vectors in SQL."""
    dot = lambda p, q: f"({p[0]} * {q[0]} + {p[1]} * {q[1]} + {p[2]} * {q[2]})"
    triple = f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) + {a[1]} * ({b[2]} * {c[0]} - {b[0]} * {c[2]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"
    return f"(2.0e0 * atan2(abs({triple}), 1.0e0 + {dot(a, b)} + {dot(b, c)} + {dot(c, a)}))"


def at(lat: str, lon: str) -> tuple[str, str, str]:
    return f"(cos({lat}) * cos({lon}))", f"(cos({lat}) * sin({lon}))", f"sin({lat})"


STEP = f"{float(np.radians(5.0))!r}e0"


def _cell_sides() -> str:
    """Cell of a point of the 10 degree grid around its own meridian: the corners are the middles of the circles through
    four neighbours, or a pole."""
    corner = lambda a, b: f"atan(cos({STEP}) * (cos({a}) - cos({b})) / (sin({b}) - sin({a})))"
    phi, up, down = "radians(lat)", "radians(lat + 10.0e0)", "radians(lat - 10.0e0)"
    north = f"CASE WHEN lat > 80 THEN {np.pi / 2!r}e0 ELSE {corner(phi, up)} END"
    south = f"CASE WHEN lat < -80 THEN {-np.pi / 2!r}e0 ELSE {corner(down, phi)} END"
    return f"v AS (SELECT lat, {phi} AS phi, {north} AS n, {south} AS s FROM (SELECT DISTINCT lat FROM g))"


@query("voronoi_cells", f"""WITH {GRID}, {_cell_sides()}
SELECT point_id, {rr(f"{tri(at('phi', '0.0e0'), at('n', STEP), at('n', '-' + STEP))} + 2.0e0 * {tri(at('phi', '0.0e0'), at('n', STEP), at('s', STEP))} + {tri(at('phi', '0.0e0'), at('s', STEP), at('s', '-' + STEP))}", 9)} AS w
FROM g JOIN v USING (lat)""")
def _(spark, sf):
    return weights.voronoi(carriers.cells(spark, sf)).select("point_id", r("w", 9).alias("w"))


WIDE = f"{float(np.radians(10.0))!r}e0"


@query("delaunay_rows", f"""WITH {GRID}, b AS (SELECT DISTINCT lat, radians(lat) AS lo, radians(lat + 10.0e0) AS hi FROM g WHERE lat < 80),
t AS (SELECT lat, {tri(at('lo', '0.0e0'), at('lo', WIDE), at('hi', '0.0e0'))} AS low, {tri(at('hi', '0.0e0'), at('hi', WIDE), at('lo', '0.0e0'))} AS high FROM b),
p AS (SELECT lat, 36 * (low * 2 + high) / 3.0e0 AS w FROM t UNION ALL SELECT lat + 10.0e0, 36 * (low + high * 2) / 3.0e0 FROM t
      UNION ALL SELECT lat, 36 * {tri(at('radians(abs(lat))', '0.0e0'), at('radians(abs(lat))', WIDE), ('0.0e0', '0.0e0', '1.0e0'))} FROM (SELECT DISTINCT lat FROM g WHERE abs(lat) > 80))
SELECT {rr('lat')} AS lat, {rr('sum(w)', 8)} AS w, 36 AS n FROM p GROUP BY lat""")
def _(spark, sf):
    """Which way a square of four points on a circle is halved is open, but a row's sum is not; at a pole 36 points are on one
    circle."""
    w = weights.delaunay(carriers.cells(spark, sf)).groupBy("lat")
    return w.agg(r(F.sum("w"), 8).alias("w"), F.count("*").cast("int").alias("n")).withColumn("lat", r("lat"))


@query("weight_report", f"WITH {GRID} SELECT count(*) AS n_points, {rr(f'sum({AREA})')} AS total, {rr(f'sum({AREA}) / {FOUR_PI}')} AS coverage, {rr(f'max({AREA}) / min({AREA})')} AS heterogeneity FROM g")
def _(spark, sf):
    return rounded(weights.report(area_grid(spark, sf)), 6, "total", "coverage", "heterogeneity")


@query("axis_cells", f"""WITH {SCATTER}, v AS (SELECT DISTINCT lat FROM p),
e AS (SELECT lat, lag(lat) OVER (ORDER BY lat) AS a, lead(lat) OVER (ORDER BY lat) AS b FROM v)
SELECT {rr('lat')} AS lat, {rr('sin(radians(least(90.0e0, coalesce((lat + b) * 0.5e0, lat + 0.5e0 * (lat - a))))) - sin(radians(greatest(-90.0e0, coalesce((a + lat) * 0.5e0, lat - 0.5e0 * (b - lat)))))', 10)} AS band FROM e""")
def _(spark, sf):
    return rounded(rounded(weights.lat_bands(carriers.scatter(spark, sf)), 6, "lat"), 10, "band")


LAYOUT = """SELECT count(*) AS n, count(DISTINCT lat) AS nlat, count(DISTINCT lon) AS nlon, max(lat) AS hi, min(lat) AS lo, max(lon) - min(lon) AS span FROM {0}"""


@query("rule_auto", f"""WITH {GRID}, {SCATTER}, x AS (SELECT 'cells' AS carrier, * FROM ({LAYOUT.format('g')}) UNION ALL SELECT 'scatter', * FROM ({LAYOUT.format('p')}))
SELECT carrier, n, nlat, nlon, CASE WHEN nlat * nlon = n AND span > 300 THEN CASE WHEN nlon = 2 * nlat AND nlat % 2 = 0 THEN 'dh' ELSE 'grid' END
  WHEN span > 300 AND hi > 60 AND lo < -60 THEN 'voronoi' WHEN nlat * nlon = n THEN 'grid' ELSE 'delaunay' END AS rule FROM x""")
def _(spark, sf):
    a = planner.rule_row(carriers.cells(spark, sf)).select(F.lit("cells").alias("carrier"), "n", "nlat", "nlon", "rule")
    return a.unionByName(planner.rule_row(carriers.scatter(spark, sf)).select(F.lit("scatter").alias("carrier"), "n", "nlat", "nlon", "rule"))


@query("rule_auto_series", f"""WITH {MONTHLY}, x AS (SELECT count(*) AS n, count(DISTINCT lat) AS nlat, count(DISTINCT lon) AS nlon, max(lon) - min(lon) AS span FROM (SELECT DISTINCT lat, lon FROM g))
SELECT n, nlat, nlon, CASE WHEN nlat * nlon = n AND span > 300 AND nlon = 2 * nlat AND nlat % 2 = 0 THEN 'dh' END AS rule FROM x""")
def _(spark, sf):
    return planner.rule_row(carriers.monthly_cells(spark, sf)).select("n", "nlat", "nlon", "rule")


@query("series_uniform", f"WITH {MONTHLY} SELECT epoch_id, point_id, {rr(f'{FOUR_PI} / (SELECT count(DISTINCT point_id) FROM g)', 12)} AS w FROM g")
def _(spark, sf):
    return weights.uniform(carriers.monthly_cells(spark, sf)).select("epoch_id", "point_id", r("w", 12).alias("w"))


@query("series_cap_density", f"""WITH {MONTHLY}, p AS (SELECT DISTINCT point_id, radians(lat) AS la, radians(lon) AS lo FROM g),
k AS (SELECT a.point_id, {rr(f'{float(2 * np.pi * (1 - np.cos(np.radians(13.0))))!r}e0 / count(*)', 10)} AS w FROM p a JOIN p b ON sin(a.la) * sin(b.la) + cos(a.la) * cos(b.la) * cos(a.lo - b.lo) >= {float(np.cos(np.radians(13.0)))!r}e0 GROUP BY a.point_id)
SELECT epoch_id, point_id, w FROM g JOIN k USING (point_id)""")
def _(spark, sf):
    return weights.cap_density(carriers.monthly_cells(spark, sf), 13.0).select("epoch_id", "point_id", r("w", 10).alias("w"))


@query("series_weight_report", f"WITH {MONTHLY}, p AS (SELECT DISTINCT point_id, lat, lon FROM g) SELECT count(*) AS n_points, {rr(f'sum({AREA}) / {FOUR_PI}')} AS coverage, {rr(f'max({AREA}) / min({AREA})')} AS heterogeneity FROM p")
def _(spark, sf):
    return rounded(weights.report(weights.grid(carriers.monthly_cells(spark, sf))).drop("total"), 6, "coverage", "heterogeneity")


@query("lattice_test", f"""WITH {GRID}, v AS (SELECT 'lat' AS axis, lat AS v FROM g GROUP BY lat UNION ALL SELECT 'lon', lon FROM g GROUP BY lon),
d AS (SELECT axis, lead(v) OVER (PARTITION BY axis ORDER BY v) - v AS gap FROM v),
e AS (SELECT axis, gap, min(gap) OVER (PARTITION BY axis) AS low FROM d WHERE gap IS NOT NULL)
SELECT count(*) FILTER (WHERE ok) = 2 AS is_lattice FROM (
  SELECT axis, count(*) >= 2 AND avg(CASE WHEN gap <= 1.5e0 * low THEN 1.0e0 ELSE 0.0e0 END) >= 0.8e0 AND max(CASE WHEN gap <= 1.5e0 * low THEN gap END) / min(gap) - 1.0e0 <= 0.05e0 AS ok FROM e GROUP BY axis)""")
def _(spark, sf):
    return planner.layout(carriers.cells(spark, sf)).select("is_lattice")


@query("lattice_step", f"""WITH {GRID}, d AS (SELECT lead(lat) OVER (ORDER BY lat) - lat AS gap FROM (SELECT DISTINCT lat FROM g)),
e AS (SELECT gap, min(gap) OVER () AS low FROM d WHERE gap IS NOT NULL) SELECT {rr('median(gap)')} AS step FROM e WHERE gap <= 1.5e0 * low""")
def _(spark, sf):
    return rounded(weights.lattice_step(carriers.cells(spark, sf), "lat"), 6, "step")


# --- Legendre functions, analysis and synthesis ----------------------------------------------------------------------
@query("legendre_table", f"WITH RECURSIVE {GRID}, {leg('SELECT lat FROM g', 8)} SELECT {rr('lat')} AS lat, CAST(n AS INT) AS n, CAST(m AS INT) AS m, {rr('p', 9)} AS p FROM leg")
def _(spark, sf):
    lats = carriers.cells(spark, sf).select("lat").distinct()

    def run(batches):
        import pandas as pd

        n, m = np.tril_indices(8 + 1)
        for b in batches:
            p = kernels.triangle(b["lat"].to_numpy(), 8)[:, n, m]
            yield pd.DataFrame({"lat": np.repeat(b["lat"].to_numpy(), len(n)), "n": np.tile(n, len(b)), "m": np.tile(m, len(b)), "p": p.ravel()})

    return rounded(rounded(lats.mapInPandas(run, "lat double, n int, m int, p double"), 6, "lat"), 9, "p")


@query("quadrature_l2", f"""WITH {SCATTER}, b AS ({low('p', 'value, n AS np')})
SELECT n, m, {rr(f'sum({FOUR_PI} / np * value * bc) / {FOUR_PI}')} AS c, {rr(f'sum({FOUR_PI} / np * value * bs) / {FOUR_PI}')} AS s FROM b GROUP BY n, m""")
def _(spark, sf):
    return rounded(analysis.quadrature(weights.uniform(carriers.scatter(spark, sf)), 2), 6, "c", "s").drop("epoch_id")


@query("quadrature_l8", f"WITH RECURSIVE {L8} SELECT CAST(n AS INT) AS n, CAST(m AS INT) AS m, {rr('c', 8)} AS c, {rr('s', 8)} AS s FROM k")
def _(spark, sf):
    return rounded(l8(spark, sf), 8, "c", "s").drop("epoch_id")


@query("grid_fft", ORACLES["quadrature_l8"])
def _(spark, sf):
    return rounded(analysis.quadrature_planned(area_grid(spark, sf), 8, "fft")[0], 8, "c", "s").drop("epoch_id")


@query("quadrature_series", f"""WITH RECURSIVE {YEARS}, {leg('SELECT lat FROM g', 4)}
SELECT epoch_id, CAST(n AS INT) AS n, CAST(m AS INT) AS m, {rr(f'sum({AREA.replace("lat", "g.lat")} * value * p * cos(m * radians(lon))) / {FOUR_PI}', 8)} AS c,
       {rr(f'sum({AREA.replace("lat", "g.lat")} * value * p * sin(m * radians(lon))) / {FOUR_PI}', 8)} AS s
FROM g JOIN leg USING (lat) GROUP BY epoch_id, n, m""")
def _(spark, sf):
    return rounded(analysis.quadrature(weights.grid(carriers.yearly_cells(spark, sf)), 4), 8, "c", "s")


@query("dc_identity", f"WITH {GRID} SELECT {rr(f'sum({AREA} * value) / {FOUR_PI}', 8)} AS c00, {rr(f'sum({AREA} * value) / {FOUR_PI}', 8)} AS mean FROM g")
def _(spark, sf):
    g = area_grid(spark, sf)
    c00 = analysis.quadrature(g, 0).select(r("c", 8).alias("c00"))
    return c00.join(g.agg(r(F.sum(F.col("w") * F.col("value")) / F.lit(geo.FOUR_PI), 8).alias("mean")))


GRAM1 = f"""{GRID}, t AS (SELECT {AREA} AS w, sin(radians(lat)) AS t, cos(radians(lat)) AS u, radians(lon) AS l FROM g),
b AS (SELECT w, unnest([1.0e0, sqrt(3.0e0) * t, sqrt(3.0e0) * u * cos(l), sqrt(3.0e0) * u * sin(l)]) AS v, unnest(['c', 'c', 'c', 's']) AS part, unnest([0, 1, 1, 1]) AS n, unnest([0, 0, 1, 1]) AS m, point_id
      FROM (SELECT t.*, row_number() OVER () AS point_id FROM t)),
q AS (SELECT a.part AS part1, a.n AS n1, a.m AS m1, b.part AS part2, b.n AS n2, b.m AS m2, sum(a.w * a.v * b.v) / {FOUR_PI} AS k FROM b a JOIN b ON a.point_id = b.point_id GROUP BY ALL)"""


@query("gram_l1", f"WITH {GRAM1} SELECT part1, n1, m1, part2, n2, m2, {rr('k', 9)} AS k FROM q")
def _(spark, sf):
    return rounded(analysis.gram_rows(area_grid(spark, sf), 1), 9, "k")


@query("gram_deviation", f"WITH {GRAM1} SELECT {rr('max(abs(k - CASE WHEN part1 = part2 AND n1 = n2 AND m1 = m2 THEN 1.0e0 ELSE 0.0e0 END))', 9)} AS deviation FROM q")
def _(spark, sf):
    same = (F.col("part1") == F.col("part2")) & (F.col("n1") == F.col("n2")) & (F.col("m1") == F.col("m2"))
    return analysis.gram_rows(area_grid(spark, sf), 1).agg(r(F.max(F.abs(F.col("k") - F.when(same, 1.0).otherwise(0.0))), 9).alias("deviation"))


SYNTH = f"""WITH RECURSIVE {L8},
f AS (SELECT g.point_id, any_value(g.value) AS value, any_value({AREA.replace("lat", "g.lat")}) AS w, sum(p * (k.c * cos(m * radians(lon)) + k.s * sin(m * radians(lon)))) AS fitted
      FROM g JOIN leg USING (lat) JOIN k USING (n, m) GROUP BY g.point_id)"""


@query("synth_grid", f"{SYNTH} SELECT point_id, {rr('fitted')} AS fitted FROM f")
def _(spark, sf):
    return synthesis.synthesise(carriers.cells(spark, sf), l8(spark, sf), 8, "fitted").select("point_id", r("fitted").alias("fitted"))


@query("synth_fft", f"{SYNTH} SELECT {rr('lat')} AS lat, CAST(ilon AS INT) AS ilon, {rr('fitted')} AS fitted FROM f JOIN g USING (point_id)")
def _(spark, sf):
    lats = carriers.cells(spark, sf).select("lat").distinct()
    return synthesis.synthesise_rows(lats, l8(spark, sf), 8, 36).select(r("lat").alias("lat"), "ilon", r("value").alias("fitted"))


@query("residual_rms", f"{SYNTH} SELECT count(*) AS n_points, {rr('sqrt(avg(value * value))')} AS data_rms, {rr('sqrt(avg((value - fitted) * (value - fitted)))')} AS residual_rms, {rr('sqrt(sum(w * (value - fitted) * (value - fitted)) / sum(w))')} AS residual_rms_weighted FROM f")
def _(spark, sf):
    g = area_grid(spark, sf)
    out = analysis.residuals(g, analysis.quadrature(g, 8), 8).select("n_points", "data_rms", "residual_rms", "residual_rms_weighted")
    return rounded(out, 6, "data_rms", "residual_rms", "residual_rms_weighted")


@query("richardson_1", f"""WITH {SCATTER}, b AS ({low('p', 'point_id, value, n AS np', 1)}),
k AS (SELECT n, m, sum(value * bc / np) AS c, sum(value * bs / np) AS s FROM b GROUP BY n, m),
f AS (SELECT point_id, any_value(value) - sum(k.c * bc + k.s * bs) AS rest FROM b JOIN k USING (n, m) GROUP BY point_id),
d AS (SELECT n, m, sum(rest * bc / np) AS c, sum(rest * bs / np) AS s FROM b JOIN f USING (point_id) GROUP BY n, m)
SELECT n, m, {rr('k.c + d.c')} AS c, {rr('k.s + d.s')} AS s FROM k JOIN d USING (n, m)""")
def _(spark, sf):
    return rounded(analysis.richardson(weights.uniform(carriers.scatter(spark, sf)), 1, 1), 6, "c", "s").drop("epoch_id")


UNIFORM4 = f"q AS (SELECT {FOUR_PI} / n AS w, value, sin(radians(lat)) AS t, cos(radians(lat)) AS u, radians(lon) AS l FROM p)"
WLSQ = f"WITH {SCATTER}, {UNIFORM4}, {normal4('q')}, {solved('eq', '', 4)} {rows4()}"


@query("wlsq_l1", WLSQ)
def _(spark, sf):
    return rounded(analysis.least_squares(weights.uniform(carriers.scatter(spark, sf)), 1)[0], 6, "c", "s").drop("epoch_id")


@query("cg_l1", WLSQ)
def _(spark, sf):
    return rounded(analysis.conjugate_gradients(weights.uniform(carriers.scatter(spark, sf)), 1, rtol=1e-14)[0], 6, "c", "s").drop("epoch_id")


@query("tikhonov_l1", f"WITH {SCATTER}, {UNIFORM4}, {normal4('q', ridge='0.1e0 * 0.1e0')}, {solved('eq', '', 4)} {rows4()}")
def _(spark, sf):
    return rounded(analysis.least_squares(weights.uniform(carriers.scatter(spark, sf)), 1, "tikhonov", 0.1)[0], 6, "c", "s").drop("epoch_id")


KAULA = ["1.0e0", "pow(2.0e0, 4)", "pow(2.0e0, 4)", "pow(2.0e0, 4)"]  # (n + 1)**(2 * 2)


@query("kaula_l1", f"""WITH {SCATTER}, {UNIFORM4}, {normal4('q')},
kq AS (SELECT {', '.join(f"a{i}_{j}" + (f" + 0.25e0 * {KAULA[i]} AS a{i}_{j}" if i == j else "") for i in range(4) for j in range(4))}, b0_0, b1_0, b2_0, b3_0 FROM eq), {solved('kq', '', 4)} {rows4()}""")
def _(spark, sf):
    return rounded(analysis.least_squares(weights.uniform(carriers.scatter(spark, sf)), 1, "kaula", 0.5, scale=1.0)[0], 6, "c", "s").drop("epoch_id")


@query("kaula_l4")
def _(spark, sf):
    return analysis.least_squares(weights.uniform(carriers.scatter(spark, sf)), 4, "kaula")[0]


@query("cg_l4")
def _(spark, sf):
    return analysis.conjugate_gradients(weights.uniform(carriers.scatter(spark, sf)), 4)[0]


GAPS4 = f"q AS (SELECT epoch_id, {AREA} AS w, value, sin(radians(lat)) AS t, cos(radians(lat)) AS u, radians(lon) AS l FROM g)"


@query("series_gaps_wlsq", f"WITH {MONTHLY}, {GAPS4}, {normal4('q', 'epoch_id')}, {solved('eq', 'epoch_id', 4)} {rows4(6, 'epoch_id')}")
def _(spark, sf):
    """Months have values in some of the cells only, each in others."""
    return rounded(analysis.least_squares(weights.grid(carriers.monthly_cells(spark, sf)), 1)[0], 6, "c", "s")


@query("series_gaps_cg", ORACLES["series_gaps_wlsq"])
def _(spark, sf):
    return rounded(analysis.conjugate_gradients(weights.grid(carriers.monthly_cells(spark, sf)), 1, rtol=1e-14)[0], 6, "c", "s")


@query("series_gaps_fft", f"""WITH RECURSIVE {MONTHLY}, {leg('SELECT lat FROM g', 4)}
SELECT epoch_id, CAST(n AS INT) AS n, CAST(m AS INT) AS m, {rr(f'sum({AREA.replace("lat", "g.lat")} * value * p * cos(m * radians(lon))) / {FOUR_PI}', 8)} AS c,
       {rr(f'sum({AREA.replace("lat", "g.lat")} * value * p * sin(m * radians(lon))) / {FOUR_PI}', 8)} AS s
FROM g JOIN leg USING (lat) GROUP BY epoch_id, n, m""")
def _(spark, sf):
    return rounded(analysis.quadrature_planned(weights.grid(carriers.monthly_cells(spark, sf)), 4, "fft")[0], 8, "c", "s")


#: On half of the grid the completeness matrix up to degree 1 is [[a, b], [b, d]] of c00 and c10, and e for c11 and s11.
HALF = f"""h AS (SELECT {AREA} AS w, value, sin(radians(lat)) AS t, cos(radians(lat)) AS u, radians(lon) AS l FROM g WHERE lat > 0),
k AS (SELECT sum(w) / {FOUR_PI} AS a, sum(w * sqrt(3.0e0) * t) / {FOUR_PI} AS b, sum(w * 3.0e0 * t * t) / {FOUR_PI} AS d, sum(w * 3.0e0 * u * u * cos(l) * cos(l)) / {FOUR_PI} AS e, sum(w * 3.0e0 * u * u * sin(l) * sin(l)) / {FOUR_PI} AS f,
             {', '.join(f"sum(w * value * ({p})) / {FOUR_PI} AS r{i}" for i, p in enumerate(BASIS4))} FROM h),
v AS (SELECT *, (a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b) AS big, (a + d) / 2 - sqrt(pow((a - d) / 2, 2) + b * b) AS small FROM k),
y AS (SELECT *, b / sqrt(b * b + pow(big - a, 2)) AS p, (big - a) / sqrt(b * b + pow(big - a, 2)) AS q FROM v)"""


def _kept(least: float, more: str) -> str:
    """The part of the right-hand side in the functions whose share is large: that of the larger root, and those of c11 and
    s11 where they are."""
    z = "(p * r0 + q * r1) / big"
    one = lambda x, share: f"CASE WHEN {share} {more} {least!r}e0 THEN {x} / {share} ELSE 0.0e0 END"
    low = f"CASE WHEN small {more} {least!r}e0 THEN (p * r1 - q * r0) / small ELSE 0.0e0 END"
    return (f"SELECT 0 AS n, 0 AS m, {rr(f'p * {z} - q * ({low})')} AS c, 0.0e0 AS s FROM y UNION ALL SELECT 1, 0, {rr(f'q * {z} + p * ({low})')}, 0.0e0 FROM y"
            f" UNION ALL SELECT 1, 1, {rr(one('r2', 'e'))}, {rr(one('r3', 'f'))} FROM y")  # fmt: skip


@query("projection_tau_l1", f"WITH {GRID}, {HALF} {_kept(0.3, '>=')}")
def _(spark, sf):
    return rounded(analysis.projection(area_grid(spark, sf).where("lat > 0"), 1, 0.3), 6, "c", "s").drop("epoch_id")


@query("slepian_l1", f"WITH {GRID}, {HALF} {_kept(0.7, '>')}")
def _(spark, sf):
    return rounded(slepian.analyse(area_grid(spark, sf).where("lat > 0"), 1, 0.7), 6, "c", "s").drop("epoch_id")


@query("slepian_spectrum_l1", f"WITH {GRID}, {HALF}, z AS (SELECT unnest([big, small, e, f]) AS x FROM y) SELECT CAST(row_number() OVER (ORDER BY x DESC) - 1 AS INT) AS alpha, {rr('x')} AS lambda FROM z")
def _(spark, sf):
    return rounded(slepian.basis(area_grid(spark, sf).where("lat > 0"), 1).tables(spark)[0], 6, "lambda")


@query("projection_tau")
def _(spark, sf):
    north = area_grid(spark, sf).where("lat > 0")
    return analysis.projection(north, 4, 0.3)


@query("slepian_l4")
def _(spark, sf):
    return slepian.analyse(area_grid(spark, sf).where("lat > 0"), 4)


@query("slepian_spectrum")
def _(spark, sf):
    return slepian.basis(area_grid(spark, sf).where("lat > 0"), 4).tables(spark)[0]


@query("analysis_auto", f"WITH RECURSIVE {L8} SELECT CAST(n AS INT) AS n, CAST(m AS INT) AS m, {rr('c')} AS c, {rr('s')} AS s, 'quadrature' AS method FROM k WHERE n <= 1")
def _(spark, sf):
    x, method = analysis.analyse(area_grid(spark, sf), 1)
    return rounded(x, 6, "c", "s").drop("epoch_id").withColumn("method", F.lit(method))


@query("completeness_order_0", f"""WITH RECURSIVE {GRID}, {leg('SELECT lat FROM g', 8)} SELECT {rr('max(abs(x - 1.0e0))', 9)} AS deviation FROM (
  SELECT n, sum({AREA.replace('lat', 'g.lat')} * p * p) / {FOUR_PI} AS x FROM g JOIN leg USING (lat) WHERE m = 0 GROUP BY n)""")
def _(spark, sf):
    return spark.createDataFrame([(analysis.diagonal_deviation(area_grid(spark, sf), 8),)], "deviation double").select(r("deviation", 9).alias("deviation"))


@query("horizontal_l1", f"""WITH {GRID} SELECT point_id, {rr('sqrt(3.0e0) * cos(radians(lat)) * 2.0e0 - sqrt(3.0e0) * cos(radians(lon)) * sin(radians(lat))')} AS north, {rr('-sqrt(3.0e0) * sin(radians(lon))')} AS east FROM g""")
def _(spark, sf):
    unit = spark.createDataFrame([(0, 1, 0, 2.0, 0.0), (0, 1, 1, 1.0, 0.0)], analysis.COEFFS)
    return synthesis.horizontal(carriers.cells(spark, sf), unit, 1, scale=False).select("point_id", r("north").alias("north"), r("east").alias("east"))


#: p at m + 1 and m - 1 give the slope; d holds them.
GRADIENT = """SELECT {0}, round(sum(d * (k.c * cos(m * radians(lon)) + k.s * sin(m * radians(lon)))), 5) + 0.0e0 AS by_colat,
       round(sum(p * m * (k.s * cos(m * radians(lon)) - k.c * sin(m * radians(lon)))) / cos(radians(any_value(g.lat))), 5) + 0.0e0 AS by_lon
FROM g JOIN (SELECT a.lat, a.n, a.m, a.p,
  CASE WHEN a.m = 0 THEN -sqrt(a.n * (a.n + 1) / 2.0e0) * coalesce(u.p, 0.0e0)
       ELSE 0.5e0 * sqrt((a.n + a.m) * (a.n - a.m + 1) * CASE WHEN a.m = 1 THEN 2.0e0 ELSE 1.0e0 END) * coalesce(l.p, 0.0e0) - 0.5e0 * sqrt((a.n - a.m) * (a.n + a.m + 1.0e0)) * coalesce(u.p, 0.0e0) END AS d
  FROM leg a LEFT JOIN leg u ON u.lat = a.lat AND u.n = a.n AND u.m = a.m + 1 LEFT JOIN leg l ON l.lat = a.lat AND l.n = a.n AND l.m = a.m - 1) leg USING (lat) JOIN k USING (n, m)"""


@query("gradient_l8", f"""{SYNTH.replace('f AS (', 'f0 AS (')}
{GRADIENT.format('g.point_id')} GROUP BY g.point_id""")
def _(spark, sf):
    return synthesis.gradient(carriers.cells(spark, sf), l8(spark, sf), 8).select("point_id", r("by_colat", 5).alias("by_colat"), r("by_lon", 5).alias("by_lon"))


@query("gradient_fft", f"""{SYNTH.replace('f AS (', 'f0 AS (')}
{GRADIENT.format(rr('g.lat') + ' AS lat, CAST(any_value(ilon) AS INT) AS ilon')} GROUP BY g.point_id, g.lat""")
def _(spark, sf):
    lats = carriers.cells(spark, sf).select("lat").distinct()
    return synthesis.gradient_rows(lats, l8(spark, sf), 8, 36).select(r("lat").alias("lat"), "ilon", r("by_colat", 5).alias("by_colat"), r("by_lon", 5).alias("by_lon"))


LOVE = "love AS (SELECT CAST(n AS INT) AS n, 0.1e0 / (n + 1) AS lv, -0.2e0 / (n + 1) AS kv FROM range(9) AS t(n))"


@query("horizontal_love", f"""{SYNTH.replace('f AS (', 'f0 AS (')}, {LOVE}, kk AS (SELECT k.n, m, c * 6378136.46e0 * lv / (1.0e0 + kv) / 1.0e6 AS c, s * 6378136.46e0 * lv / (1.0e0 + kv) / 1.0e6 AS s FROM k JOIN love USING (n)),
z AS ({GRADIENT.format('g.point_id').replace('JOIN k USING', 'JOIN kk k USING')} GROUP BY g.point_id)
SELECT point_id, {rr('-by_colat', 5)} AS north, {rr('by_lon', 5)} AS east FROM z""")
def _(spark, sf):
    """With load Love numbers made up by a rule, in thousands of km."""
    love = spark.range(9).select(F.col("id").cast("int").alias("n"), F.lit(0.0).alias("h"), (0.1 / (F.col("id") + 1)).alias("l"), (-0.2 / (F.col("id") + 1)).alias("k"))
    small = coeffs.scaled(l8(spark, sf), 1e-6)
    out = synthesis.horizontal(carriers.cells(spark, sf), small, 8, "geopotential", love)
    return rounded(out.select("point_id", "north", "east"), 5, "north", "east")


@query("series_report", f"""WITH RECURSIVE {YEARS}, {leg('SELECT lat FROM g', 2)},
h AS (SELECT row_number() OVER () AS id, *, {AREA} AS w FROM g),
k AS (SELECT epoch_id, n, m, sum(w * value * p * cos(m * radians(lon))) / {FOUR_PI} AS c, sum(w * value * p * sin(m * radians(lon))) / {FOUR_PI} AS s FROM h JOIN leg USING (lat) GROUP BY epoch_id, n, m),
f AS (SELECT h.id, any_value(h.epoch_id) AS epoch_id, any_value(value) AS value, any_value(w) AS w, sum(p * (k.c * cos(leg.m * radians(lon)) + k.s * sin(leg.m * radians(lon)))) AS fitted
      FROM h JOIN leg USING (lat) JOIN k ON k.epoch_id = h.epoch_id AND k.n = leg.n AND k.m = leg.m GROUP BY h.id),
e AS (SELECT f.epoch_id, count(*) AS n_points, sqrt(avg(value * value)) AS data_rms, any_value(k.c) AS c00, sum(w * value) / {FOUR_PI} AS dc_mean, sum(w) / {FOUR_PI} AS coverage, sqrt(avg((value - fitted) * (value - fitted))) AS residual_rms
      FROM f JOIN k ON k.epoch_id = f.epoch_id AND k.n = 0 GROUP BY f.epoch_id),
a AS (SELECT median(c00) AS mid FROM e), b AS (SELECT median(abs(c00 - mid)) AS mad FROM e, a)
SELECT epoch_id, n_points, {rr('data_rms')} AS data_rms, {rr('c00')} AS c00, {rr('dc_mean')} AS dc_mean, {rr('coverage')} AS coverage, {rr('residual_rms')} AS residual_rms, {rr('residual_rms / data_rms')} AS fit_rmse_rel,
       {rr('0.6745e0 * (c00 - mid) / mad', 4)} AS z, abs(0.6745e0 * (c00 - mid) / mad) > 3 AS outlier FROM e, a, b""")
def _(spark, sf):
    y = weights.grid(carriers.yearly_cells(spark, sf))
    out = report.series_report(y, analysis.quadrature(y, 2), 2)
    return rounded(rounded(out, 6, "data_rms", "c00", "dc_mean", "coverage", "residual_rms", "fit_rmse_rel"), 4, "z")


# --- spectra, units and filters --------------------------------------------------------------------------------------
POWER = "sum(c * c + s * s)"


@query("degree_rms", f"WITH RECURSIVE {L8} SELECT CAST(n AS INT) AS n, {rr(f'sqrt({POWER} / (2.0e0 * (n + 1)))')} AS rms, {rr(f'sqrt({POWER} / (2.0e0 * n + 1.0e0))')} AS rms_filled FROM k GROUP BY n")
def _(spark, sf):
    return rounded(spectrum.degree_rms(l8(spark, sf)), 6, "rms", "rms_filled")


@query("degree_power", f"WITH RECURSIVE {L8} SELECT CAST(n AS INT) AS n, {rr(POWER)} AS power FROM k GROUP BY n")
def _(spark, sf):
    return rounded(spectrum.degree_power(l8(spark, sf)), 6, "power")


TRUNC = f"WITH RECURSIVE {L8}, d AS (SELECT n, {POWER} AS power FROM k GROUP BY n), e AS (SELECT n, power, sum(power) OVER (ORDER BY n) / sum(power) OVER () AS retained FROM d)"


@query("truncation_table", f"{TRUNC} SELECT CAST(n AS INT) AS n, {rr('power')} AS power, {rr('retained')} AS retained, {rr('sqrt(greatest(0.0e0, 1.0e0 - retained))', 5)} AS error, CASE WHEN n > 0 THEN {rr(f'{float(np.pi * 6371.0)!r}e0 / n', 4)} ELSE -1.0e0 END AS resolution_km FROM e")
def _(spark, sf):
    t = rounded(rounded(spectrum.truncation_table(l8(spark, sf)), 6, "power", "retained"), 5, "error")
    return t.withColumn("resolution_km", F.when(F.col("n") > 0, r("resolution_km", 4)).otherwise(F.lit(-1.0)))


@query("nmax_for_tol", f"{TRUNC} SELECT CAST(min(n) AS INT) AS nmax FROM e WHERE retained >= 1.0e0 - 0.03e0 * 0.03e0")
def _(spark, sf):
    return spectrum.degree_for(l8(spark, sf), 0.03)


@query("diagnose_nmax", f"""{TRUNC.replace('WITH RECURSIVE', 'WITH RECURSIVE')}, z AS (SELECT count(*) AS n, sum({AREA}) / {FOUR_PI} AS cov FROM g)
SELECT (SELECT CAST(greatest(0, floor(sqrt(n / (cov * 2.0e0))) - 1) AS INT) FROM z) AS sampling_nmax, CAST(min(CASE WHEN retained >= 1.0e0 - 0.01e0 * 0.01e0 THEN n END) AS INT) AS power_nmax,
       CASE WHEN max(CASE WHEN n > 0 THEN power END) / avg(CASE WHEN n > 0 THEN power END) < 3 THEN 'flat' WHEN max(CASE WHEN n > 0 THEN power END) / avg(CASE WHEN n > 0 THEN power END) > 20 THEN 'red' ELSE 'neither' END AS shape FROM e""")
def _(spark, sf):
    row = weights.report(area_grid(spark, sf)).first()
    return spectrum.diagnose(l8(spark, sf), row["n_points"], round(row["coverage"], 9))


KN = "CASE n WHEN 1 THEN 0.02617e0 WHEN 2 THEN -0.30516e0 ELSE 0.0e0 END"
EWH = f"({6378136.46 * 5517.0 / 3000.0!r}e0 * (2.0e0 * n + 1.0e0) / (1.0e0 + {KN}))"


@query("unit_factors", f"SELECT CAST(n AS INT) AS n, 6378136.46e0 AS geoid, {rr(EWH.replace(repr(6378136.46 * 5517.0 / 3000.0), repr(6378136.46 * 5517.0 / 3.0)), 2)} AS surface_density, {rr(EWH, 4)} AS ewh FROM range(3) AS t(n)")
def _(spark, sf):
    n = spark.range(3).select(F.col("id").cast("int").alias("n"))
    k = units.known_love(F.col("n"))
    return n.select("n", units.factor("geoid", F.col("n")).alias("geoid"), r(units.factor("surface_density", F.col("n"), k), 2).alias("surface_density"), r(units.factor("ewh", F.col("n"), k), 4).alias("ewh"))


L2 = f"{GRID}, b AS ({low('g', f'value, {AREA} AS w')}), k AS (SELECT n, m, sum(w * value * bc) / {FOUR_PI} AS c, sum(w * value * bs) / {FOUR_PI} AS s FROM b GROUP BY n, m)"


def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.quadrature(area_grid(spark, sf_dir), 2)


@query("convert_geoid", f"WITH {L2} SELECT n, m, {rr('c / 6378136.46e0 * 1.0e9')} AS c, {rr('s / 6378136.46e0 * 1.0e9')} AS s FROM k")
def _(spark, sf):
    return rounded(coeffs.scaled(units.convert(l2(spark, sf), "geoid", "geopotential"), 1e9), 6, "c", "s").drop("epoch_id")


@query("convert_ewh", f"WITH {L2} SELECT n, m, {rr(f'c / {EWH} * 6378136.46e0 * 1.0e3', 8)} AS c, {rr(f's / {EWH} * 6378136.46e0 * 1.0e3', 8)} AS s FROM k")
def _(spark, sf):
    return rounded(coeffs.scaled(units.convert(l2(spark, sf), "ewh", "geoid"), 1e3), 8, "c", "s").drop("epoch_id")


GAUSS_B = float(np.log(2.0) / (1.0 - np.cos(2000.0 / 6378.1363)))


@query("gaussian_filter", f"""WITH RECURSIVE w AS (
  SELECT 1 AS n, 1.0e0 AS a, (1.0e0 + exp(-2.0e0 * {GAUSS_B!r}e0)) / (1.0e0 - exp(-2.0e0 * {GAUSS_B!r}e0)) - 1.0e0 / {GAUSS_B!r}e0 AS b
  UNION ALL SELECT n + 1, b, a - (2.0e0 * n + 1.0e0) / {GAUSS_B!r}e0 * b FROM w WHERE n < 2), v AS (SELECT 0 AS n, 1.0e0 AS w UNION ALL SELECT n, b FROM w), {L2}
SELECT k.n, m, {rr('c * w')} AS c, {rr('s * w')} AS s FROM k JOIN v USING (n)""")
def _(spark, sf):
    return rounded(coeffs.smoothed(l2(spark, sf), 2000.0, 2, "frc"), 6, "c", "s").drop("epoch_id")


GLQ_B = float(np.log(2.0) / (1.0 - np.cos(300.0 / 6378.1363)))


@query("gaussian_glq", f"""WITH RECURSIVE w AS (SELECT 0 AS n, 1.0e0 AS a, 1.0e0 - 1.0e0 / {GLQ_B!r}e0 AS b UNION ALL SELECT n + 1, b, a - (2.0e0 * (n + 1) + 1.0e0) / {GLQ_B!r}e0 * b FROM w WHERE n < 20)
SELECT CAST(n AS INT) AS n, {rr('a', 7)} AS w FROM w""")
def _(spark, sf):
    """A narrow filter: there the upward recurrence of the SQL is accurate."""
    return rounded(coeffs.degree_table(spark, coeffs.gaussian(300.0, 20)), 7, "w")


@query("gaussian_applied", f"""WITH RECURSIVE w AS (SELECT 0 AS n, 1.0e0 AS a, 1.0e0 - 1.0e0 / {GLQ_B!r}e0 AS b UNION ALL SELECT n + 1, b, a - (2.0e0 * (n + 1) + 1.0e0) / {GLQ_B!r}e0 * b FROM w WHERE n < 8), {L8}
SELECT CAST(k.n AS INT) AS n, CAST(m AS INT) AS m, {rr('c * a')} AS c, {rr('s * a')} AS s FROM k JOIN w ON w.n = k.n""")
def _(spark, sf):
    return rounded(coeffs.smoothed(l8(spark, sf), 300.0, 8), 6, "c", "s").drop("epoch_id")


@query("truncate_pad", f"WITH {L2}, z AS (SELECT CAST(n AS INT) AS n, CAST(m AS INT) AS m FROM range(5) t(n), range(5) u(m) WHERE m <= n) SELECT n, m, {rr('coalesce(c, 0.0e0)')} AS c, {rr('coalesce(s, 0.0e0)')} AS s FROM z LEFT JOIN k USING (n, m)")
def _(spark, sf):
    return rounded(coeffs.truncate(l2(spark, sf), 4), 6, "c", "s").drop("epoch_id")


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = area_grid(spark, sf_dir)
    return analysis.quadrature(g, 2), analysis.quadrature(g.withColumn("value", F.col("value") * F.col("value")), 1)


PAIR = f"WITH {L2}, q AS (SELECT n, m, sum(w * value * value * bc) / {FOUR_PI} AS c, sum(w * value * value * bs) / {FOUR_PI} AS s FROM b WHERE n <= 1 GROUP BY n, m)"


@query("coeff_add", f"{PAIR} SELECT n, m, {rr('k.c + coalesce(q.c, 0.0e0)')} AS c, {rr('k.s + coalesce(q.s, 0.0e0)')} AS s FROM k LEFT JOIN q USING (n, m)")
def _(spark, sf):
    return rounded(coeffs.combine(*_pair(spark, sf)), 6, "c", "s").drop("epoch_id")


@query("coeff_sub", f"{PAIR} SELECT n, m, {rr('k.c - coalesce(q.c, 0.0e0)')} AS c, {rr('k.s - coalesce(q.s, 0.0e0)')} AS s FROM k LEFT JOIN q USING (n, m)")
def _(spark, sf):
    return rounded(coeffs.combine(*_pair(spark, sf), -1), 6, "c", "s").drop("epoch_id")


@query("drop_c00", f"WITH {L2} SELECT n, m, CASE WHEN n = 0 THEN 0.0e0 ELSE {rr('c')} END AS c, {rr('s')} AS s FROM k")
def _(spark, sf):
    return rounded(coeffs.without_mean(l2(spark, sf)), 6, "c", "s").drop("epoch_id")


@query("flat_order", f"WITH {L2}, o AS (SELECT 'c' AS part, n, m, c AS v FROM k UNION ALL SELECT 's', n, m, s FROM k WHERE m > 0) SELECT CAST(row_number() OVER (ORDER BY part, m, n) - 1 AS INT) AS k, part, n, m, {rr('v')} AS v FROM o")
def _(spark, sf):
    return rounded(coeffs.flat(l2(spark, sf), 2), 6, "v").select(F.col("k").cast("int").alias("k"), "part", "n", "m", "v")


# --- epochs and series -----------------------------------------------------------------------------------------------
DAYS = "d AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INT) AS epoch_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts, avg(value) AS value FROM events GROUP BY 1, 2)"
MONTHS = """r AS (SELECT *, CAST(l_partkey % 3 AS INT) AS n FROM lineitem),
k AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INT) AS epoch_id, date_trunc('month', l_shipdate) AS ts, n, CAST(l_orderkey % (n + 1) AS INT) AS m, l_quantity, l_discount FROM r),
s AS (SELECT epoch_id, any_value(ts) AS ts, n, m, avg(l_quantity) AS c, avg(CASE WHEN m > 0 THEN l_discount ELSE 0.0e0 END) AS s FROM k GROUP BY epoch_id, n, m)"""


def months(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The monthly series and its epochs."""
    x = coeffs.held(carriers.months(spark, sf_dir))
    return x, x.select("epoch_id", "ts").distinct()


TICKS = "d AS (SELECT CAST(event_id AS BIGINT) AS epoch_id, ts, date_diff('second', TIMESTAMP '1970-01-01', ts) - date_diff('second', TIMESTAMP '1970-01-01', lag(ts) OVER (ORDER BY ts, event_id)) AS seconds FROM events)"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an epoch, to the second: their gaps are as they come."""
    return carriers.table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("epoch_id"), F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("epoch_gaps", f"WITH {TICKS} SELECT epoch_id, {rr('seconds / 86400.0e0')} AS gap_days FROM d WHERE seconds > 864")
def _(spark, sf):
    return rounded(timeaxis.missing(ticks(spark, sf), 0.01).select("epoch_id", "gap_days"), 6, "gap_days")


@query("epoch_duplicates", f"""WITH {TICKS}, u AS (SELECT epoch_id, sum(CASE WHEN seconds / 86400.0e0 < 0.0005e0 THEN 0 ELSE 1 END) OVER (ORDER BY ts, epoch_id) AS run FROM d)
SELECT epoch_id, CAST(run AS BIGINT) AS run FROM u WHERE run IN (SELECT run FROM u GROUP BY run HAVING count(*) > 1)""")
def _(spark, sf):
    return timeaxis.duplicates(ticks(spark, sf), 0.0005).select("epoch_id", "run")


@query("epoch_regular", """WITH e AS (SELECT DISTINCT date_trunc('month', l_shipdate) AS ts FROM lineitem), q AS (SELECT CAST(date_diff('day', lag(ts) OVER (ORDER BY ts), ts) AS DOUBLE) AS gap FROM e)
SELECT median(gap) AS median_days, max(abs(gap - (SELECT median(gap) FROM q))) <= 3 AS regular FROM q WHERE gap IS NOT NULL""")
def _(spark, sf):
    return timeaxis.regular(months(spark, sf)[1])


@query("decimal_year", f"""SELECT o_orderkey AS id, {rr("year(o_orderdate) + (dayofyear(o_orderdate) - 1 + (hour(o_orderdate) * 3600.0e0 + minute(o_orderdate) * 60.0e0 + second(o_orderdate)) / 86400.0e0) / CASE WHEN year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0) THEN 366.0e0 ELSE 365.0e0 END", 8)} AS decimal_year FROM orders""")
def _(spark, sf):
    return carriers.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), r(calendar.decimal_year(F.col("o_orderdate")), 8).alias("decimal_year"))


@query("date_of_year", "SELECT o_orderkey AS id, date_trunc('second', o_orderdate) AS ts FROM orders")
def _(spark, sf):
    year = calendar.decimal_year(F.col("o_orderdate"))
    return carriers.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), calendar.date_of(year).alias("ts"))


@query("epoch_midpoint", """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) + to_hours(CAST(12 * (o_orderkey % 40 + 1) AS BIGINT)) AS mid FROM orders""")
def _(spark, sf):
    day = F.to_date("o_orderdate")
    mid, _ = calendar.midpoint(day, F.date_add(day, (F.col("o_orderkey") % 40).cast("int")))
    return carriers.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), mid.alias("mid"))


@query("model_names", """SELECT o_orderkey AS id, 'GSM' AS product, 'GRAC' AS mission, 'UTCSR' AS center, 'BA01' AS degtype, '0600' AS rl, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start_date, CAST(CAST(o_orderdate + INTERVAL 29 DAY AS DATE) AS VARCHAR) AS end_date, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 15 DAY AS mid FROM orders""")
def _(spark, sf):
    ydd = lambda d: F.concat(F.lpad(F.year(d).cast("string"), 4, "0"), F.lpad(F.dayofyear(d).cast("string"), 3, "0"))
    day = F.to_date("o_orderdate")
    name = F.concat(F.lit("GSM-2_"), ydd(day), F.lit("-"), ydd(F.date_add(day, 29)), F.lit("_GRAC_UTCSR_BA01_0600.gfc"))
    files = carriers.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), name.alias("name"))
    return timeaxis.from_names(files).select("id", "product", "mission", "center", "degtype", "rl", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"), "mid")


@query("epoch_nearest", f"WITH {DAYS} SELECT epoch_id FROM d ORDER BY abs(date_diff('second', ts, TIMESTAMP '2024-01-15 12:00:00')), ts LIMIT 1")
def _(spark, sf):
    return timeaxis.nearest(carriers.days(spark, sf), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).select("epoch_id")


@query("epoch_window", f"WITH {DAYS} SELECT epoch_id, {rr('value')} AS value FROM d WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'")
def _(spark, sf):
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    return timeaxis.between(carriers.days(spark, sf), ts("2024-01-10"), ts("2024-01-20")).select("epoch_id", r("value").alias("value"))


@query("match_epochs", f"""WITH {DAYS}, a AS (SELECT epoch_id, epoch_id * 86400.0e0 AS x FROM d), b AS (SELECT epoch_id AS other_id, epoch_id * 86400.0e0 + 50000.0e0 AS y FROM d),
q AS (SELECT epoch_id, other_id, abs(x - y) / 86400.0e0 AS gap, row_number() OVER (PARTITION BY epoch_id ORDER BY abs(x - y), other_id) AS k FROM a, b WHERE abs(x - y) <= 1.2e0 * 86400.0e0)
SELECT epoch_id, other_id, {rr('gap')} AS gap_days FROM q WHERE k = 1""")
def _(spark, sf):
    d = carriers.days(spark, sf)
    late = d.withColumn("ts", F.col("ts") + F.expr("interval 50000 seconds"))
    return rounded(timeaxis.match(d, late, 1.2), 6, "gap_days")


@query("time_mean", f"WITH {MONTHS} SELECT n, m, {rr('avg(c)')} AS c, {rr('avg(s)', 8)} AS s FROM s GROUP BY n, m")
def _(spark, sf):
    return rounded(rounded(timeseries.time_mean(months(spark, sf)[0]), 6, "c"), 8, "s")


@query("anomaly", f"WITH {MONTHS} SELECT epoch_id, n, m, {rr('c - avg(c) OVER (PARTITION BY n, m)')} AS c, {rr('s - avg(s) OVER (PARTITION BY n, m)', 8)} AS s FROM s")
def _(spark, sf):
    return rounded(rounded(timeseries.anomaly(months(spark, sf)[0]), 6, "c"), 8, "s")


YEARS_OF = f"(date_diff('second', TIMESTAMP '1970-01-01', ts) - (SELECT (min(date_diff('second', TIMESTAMP '1970-01-01', ts)) + max(date_diff('second', TIMESTAMP '1970-01-01', ts))) / 2.0e0 FROM s)) / {86400.0 * 365.25!r}e0"


@query("trend_fit", f"WITH {MONTHS}, y AS (SELECT *, {YEARS_OF} AS x FROM s) SELECT n, m, {rr('regr_slope(c, x)')} AS c, {rr('regr_slope(s, x)', 8)} AS s FROM y GROUP BY n, m")
def _(spark, sf):
    f = timeseries.fit(*months(spark, sf), 1)
    return rounded(rounded(f.term("trend"), 6, "c"), 8, "s")


@query("detrend", f"WITH {MONTHS}, y AS (SELECT *, {YEARS_OF} AS x FROM s), f AS (SELECT n, m, regr_slope(c, x) AS b, regr_intercept(c, x) AS a FROM y GROUP BY n, m) SELECT epoch_id, n, m, {rr('c - a - b * x')} AS c FROM y JOIN f USING (n, m)")
def _(spark, sf):
    return timeseries.detrended(*months(spark, sf), 1).select("epoch_id", "n", "m", r("c").alias("c"))


def fit_sql(source: str, keys: str, terms: list[str], values: list[str]) -> str:
    """CTEs that fit terms (of x) to values by keys."""
    k = f"{keys}, " if keys else ""
    cols = [f"sum(({p}) * ({q})) AS a{i}_{j}" for i, p in enumerate(terms) for j, q in enumerate(terms)]
    cols += [f"sum(({p}) * {v}) AS b{i}_{j}" for i, p in enumerate(terms) for j, v in enumerate(values)]
    return f"eq AS (SELECT {k}{', '.join(cols)} FROM {source} GROUP BY {keys}), {solved('eq', keys, len(terms), len(values))}"


def waves_of(*periods: float) -> list[str]:
    return [f"{f}({2 * np.pi / p!r}e0 * x)" for p in periods for f in ("cos", "sin")]


SEASONS = ["1.0e0", "x", *waves_of(1.0, 0.5)]


@query("seasonal_fit", f"""WITH {MONTHS}, y AS (SELECT *, {YEARS_OF} AS x FROM s), {fit_sql('y', 'n, m', SEASONS, ['c', 's'])}
{' UNION ALL '.join(f"SELECT '{t}' AS term, n, m, {rr(f'b{i}_0', 5)} AS c, {rr(f'b{i}_1', 7)} AS s FROM x6" for i, t in enumerate(['const', 'trend', 'cos1', 'sin1', 'cos0.5', 'sin0.5']))}""")
def _(spark, sf):
    return rounded(rounded(timeseries.fit(*months(spark, sf), 1, [1.0, 0.5]).frame, 5, "c"), 7, "s")


@query("amplitude_phase", f"""WITH {MONTHS}, y AS (SELECT *, {YEARS_OF} AS x FROM s), {fit_sql('y', 'n, m', ['1.0e0', 'x', *waves_of(1.0)], ['c'])}
SELECT n, m, {rr('sqrt(b2_0 * b2_0 + b3_0 * b3_0)', 5)} AS amplitude_c, {rr('atan2(b3_0, b2_0)', 4)} AS phase_c FROM x4""")
def _(spark, sf):
    out = timeseries.fit(*months(spark, sf), 1, [1.0]).amplitude_phase(1.0)
    return rounded(rounded(out.select("n", "m", "amplitude_c", "phase_c"), 5, "amplitude_c"), 4, "phase_c")


@query("deseasonalised", f"""WITH {MONTHS}, y AS (SELECT *, {YEARS_OF} AS x FROM s), {fit_sql('y', 'n, m', SEASONS, ['c'])}
SELECT epoch_id, n, m, {rr(f"c - b2_0 * {SEASONS[2]} - b3_0 * {SEASONS[3]} - b4_0 * {SEASONS[4]} - b5_0 * {SEASONS[5]}", 5)} AS c FROM y JOIN x6 USING (n, m)""")
def _(spark, sf):
    return timeseries.deseasonalised(*months(spark, sf), 1).select("epoch_id", "n", "m", r("c", 5).alias("c"))


@query("fit_evaluated", f"""WITH {MONTHS}, y AS (SELECT *, {YEARS_OF} AS x FROM s), f AS (SELECT n, m, regr_slope(c, x) AS b, regr_intercept(c, x) AS a FROM y GROUP BY n, m),
w AS (SELECT unnest([1, 2]) AS epoch_id, unnest([TIMESTAMP '1998-03-01', TIMESTAMP '2030-01-01']) AS ts),
v AS (SELECT epoch_id, {YEARS_OF} AS x FROM w) SELECT CAST(epoch_id AS INT) AS epoch_id, n, m, {rr('a + b * x', 5)} AS c, epoch_id = 2 AS extrapolated FROM v, f""")
def _(spark, sf):
    """The trend at a date inside the series and at one after it."""
    at = spark.sql("SELECT 1 AS epoch_id, TIMESTAMP_NTZ '1998-03-01' AS ts UNION ALL SELECT 2, TIMESTAMP_NTZ '2030-01-01'")
    return timeseries.fit(*months(spark, sf), 1).evaluate(at).select("epoch_id", "n", "m", r("c", 5).alias("c"), "extrapolated")


SIGMA = f"{0.2 * 365.25 * 86400.0!r}e0"


@query("time_gaussian", f"""WITH {MONTHS}, t AS (SELECT DISTINCT epoch_id, date_diff('second', TIMESTAMP '1970-01-01', ts) * 1.0e0 AS x FROM s),
q AS (SELECT a.epoch_id, b.epoch_id AS other, exp(-0.5e0 * pow((a.x - b.x) / {SIGMA}, 2)) AS g FROM t a, t b WHERE abs(a.x - b.x) <= 4.0e0 * {SIGMA}),
h AS (SELECT epoch_id, other, g / sum(g) OVER (PARTITION BY epoch_id) AS g FROM q)
SELECT h.epoch_id, n, m, {rr('sum(g * c)')} AS c, {rr('sum(g * s)', 8)} AS s FROM h JOIN s ON s.epoch_id = h.other GROUP BY h.epoch_id, n, m""")
def _(spark, sf):
    return rounded(rounded(timeseries.gaussian_in_time(*months(spark, sf), 0.2), 6, "c"), 8, "s")


@query("kernel_report", f"""WITH {MONTHS}, t AS (SELECT DISTINCT epoch_id, date_diff('second', TIMESTAMP '1970-01-01', ts) * 1.0e0 AS x FROM s),
q AS (SELECT a.epoch_id, exp(-0.5e0 * pow((a.x - b.x) / {SIGMA}, 2)) AS g FROM t a, t b WHERE abs(a.x - b.x) <= 4.0e0 * {SIGMA}) SELECT epoch_id, {rr('sum(g) * sum(g) / sum(g * g)')} AS effective FROM q GROUP BY epoch_id""")
def _(spark, sf):
    return rounded(timeseries.kernel_report(months(spark, sf)[1], 0.2), 6, "effective")


@query("basin_average", f"""WITH {SCATTER} SELECT r_name AS basin, 0 AS epoch_id, {rr(f'sum({FOUR_PI} / n * value) / sum({FOUR_PI} / n)')} AS mean, {rr(f'sum({FOUR_PI} / n)')} AS area, count(*) AS n_points
FROM p JOIN nation ON n_nationkey = nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def _(spark, sf):
    nations = carriers.table(spark, sf, "nation").join(carriers.table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    p = weights.uniform(carriers.scatter(spark, sf)).join(nations.select(F.col("n_nationkey").alias("nation"), F.col("r_name").alias("basin")), "nation")
    return rounded(timeseries.basin_average(p.withColumn("epoch_id", F.lit(0))), 6, "mean", "area")


@query("outliers_mad", f"""WITH {DAYS}, a AS (SELECT median(value) AS m FROM d), b AS (SELECT median(abs(value - m)) AS q FROM d, a)
SELECT epoch_id, {rr('0.6745e0 * (value - m) / q')} AS z, abs(0.6745e0 * (value - m) / q) > 1.5e0 AS outlier FROM d, a, b""")
def _(spark, sf):
    return timeseries.outliers(carriers.days(spark, sf), most=1.5).select("epoch_id", r("z").alias("z"), "outlier")


@query("cell_trends", f"""WITH {YEARS}, t AS (SELECT epoch_id, CAST(lat * 0 + (lat + 85.0e0) / 10.0e0 * 36 + lon / 10.0e0 AS BIGINT) AS point_id, value, date_diff('second', TIMESTAMP '1970-01-01', make_timestamp(CAST(epoch_id AS BIGINT), 7, 1, 0, 0, 0.0)) * 1.0e0 AS sec FROM g),
y AS (SELECT *, (sec - (SELECT (min(sec) + max(sec)) / 2.0e0 FROM t)) / {86400.0 * 365.25!r}e0 AS x, (SELECT count(DISTINCT epoch_id) FROM t) AS years FROM t),
f AS (SELECT point_id, count(*) AS n_used, any_value(years) AS years, regr_intercept(value, x) AS a, regr_slope(value, x) AS b FROM y GROUP BY point_id)
SELECT point_id, unnest(['const', 'trend']) AS term, unnest([CASE WHEN n_used = years THEN {rr('a', 5)} END, CASE WHEN n_used = years THEN {rr('b', 5)} END]) AS value, n_used FROM f""")
def _(spark, sf):
    y = carriers.yearly_cells(spark, sf)
    epochs = y.select("epoch_id").distinct().withColumn("ts", F.make_date("epoch_id", F.lit(7), F.lit(1)).cast("timestamp_ntz"))
    return rounded(timeseries.cell_fits(y, epochs, 1), 5, "value").select("point_id", "term", "value", "n_used")


@query("epoch_stats", f"WITH {YEARS} SELECT epoch_id, count(*) AS n, {rr('min(value)')} AS low, {rr('max(value)')} AS high, {rr('sqrt(avg(value * value))')} AS rms FROM g GROUP BY epoch_id")
def _(spark, sf):
    y = carriers.yearly_cells(spark, sf).groupBy("epoch_id")
    return y.agg(F.count("*").alias("n"), r(F.min("value")).alias("low"), r(F.max("value")).alias("high"), r(F.sqrt(F.avg(F.col("value") * F.col("value")))).alias("rms"))


@query("window_quadrature", f"""WITH e AS (SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, value, degrees(asin(1.0e0 - 2.0e0 * (user_id % 997 + 0.5e0) / 997.0e0)) AS lat, degrees(({TURN} * (user_id % 997)) % {TWO_PI}) % 360.0e0 AS lon FROM events),
b AS ({low('e', 'start, value')}) SELECT start, n, m, {rr(f'sum(value * bc) / {FOUR_PI}')} AS c, {rr(f'sum(value * bs) / {FOUR_PI}')} AS s FROM b GROUP BY start, n, m""")
def _(spark, sf):
    e = carriers.table(spark, sf, "events").select("ts", "value", (F.col("user_id") % 997).alias("u"))
    e = geo.fibonacci(e, "u", 997).withColumn("w", F.lit(1.0)).withColumn("start", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return rounded(stream.low_degrees(e, ["start"]), 6, "c", "s")


@query("window_stream", ORACLES["window_quadrature"])
def _(spark, sf):
    """The same windows by a stream over the table and the kernel of any degree."""
    kind = carriers.table(spark, sf, "events").schema
    e = spark.readStream.schema(kind).parquet(f"{sf}/events.parque[t]")  # a pattern: the table may be one file
    e = e.select("ts", "value", (F.col("user_id") % 997).alias("u"))
    e = geo.fibonacci(e, "u", 997).withColumn("w", F.lit(1.0)).withColumn("ts", F.col("ts").cast("timestamp_ntz").cast("timestamp"))
    out = stream.drained(spark, stream.windowed_degrees(e, 2, 86_400, "0 seconds"))
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), 6, "c", "s")
