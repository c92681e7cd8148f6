"""How many points lie within a radius of each place, without a row for each pair of places.

Places in the order of a curve through the unit cube are cut into tiles of bounded size, each kept as one row, and a tile's
places into leaves of at most LEAF. A tile or a leaf wholly within the radius of another counts by its number of points;
single places are compared only where a leaf lies across the edge of a leaf's caps. So the work for a place grows with
the edge of its cap, about as the square root of the number of places, and not with their number within.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators import hull
from orbweave.sources.storage import stored

#: Tiles that the places are cut into, as long as a tile has from FEW to MANY places.
TILES, FEW, MANY = 256, 1024, 32768
#: Tiles in a row of the curve that a task looks at together when it cuts them.
RUN = 8
#: Tiles that meet another in one group, at most.
NEAR = 32
#: Places of a leaf, at most, and places at a leaf's edge that are compared with it in one go.
LEAF, PIECE = 32, 8192
#: Slack of angles (radians) and cosines: what is nearer to the radius is looked at more closely.
ANGLE, COSINE = 1e-7, 1e-12
_TILE = "x double, y double, z double, reach double, places long, points long, la binary, lo binary, n binary"
_COUNT = "la double, lo double, n long"


def _along_curve() -> list[dict[str, Column]]:
    """Steps of columns to ``_code``, the place of la and lo on a Z curve of 21 bits an axis."""
    la, lo = F.radians("la"), F.radians("lo")
    axes = {"_x": F.cos(la) * F.cos(lo), "_y": F.cos(la) * F.sin(lo), "_z": F.sin(la)}
    steps = [{k: F.floor((v + 1.0) * float((1 << 20) - 1)).cast("long") for k, v in axes.items()}]
    for by, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        steps.append({k: F.col(k).bitwiseOR(F.shiftleft(k, by)).bitwiseAND(F.lit(mask)) for k in axes})
    return [*steps, {"_code": F.col("_x").bitwiseOR(F.shiftleft("_y", 1)).bitwiseOR(F.shiftleft("_z", 2))}]


def _cuts(m: int, parts: int) -> np.ndarray:
    return np.arange(parts + 1) * m // parts


def _halved(x: np.ndarray, parts: int) -> np.ndarray:
    """An order of x in which ``_cuts`` into parts gives compact ones: halves along the widest axis, again and again."""
    cuts, order = _cuts(len(x), parts), np.arange(len(x))
    todo = [(0, parts)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        k, here = (i + j) // 2, order[cuts[i] : cuts[j]]
        at = x[here]
        order[cuts[i] : cuts[j]] = here[np.argpartition(at[:, np.argmax(np.ptp(at, axis=0))], cuts[k] - cuts[i])]
        todo += [(i, k), (k, j)]
    return order


def _leaves(m: int) -> int:
    return -(-m // LEAF)


def _ball(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit centres of sets of vectors (sets x vectors x 3) and the largest angles to them."""
    centre = x.mean(1)
    length = np.linalg.norm(centre, axis=1, keepdims=True)
    centre = np.where(length > 1e-6, centre / np.maximum(length, 1e-6), x[:, 0])
    return centre, np.arccos(np.clip(np.einsum("svk,sk->sv", x, centre), -1.0, 1.0)).max(1)


def _tiles_of(la: np.ndarray, lo: np.ndarray, n: np.ndarray, many: int) -> dict[str, list]:
    parts = -(-len(la) // many)
    order = _halved(hull.unit(la, lo), parts)
    cuts, rows = _cuts(len(la), parts), []
    for a, b in zip(cuts[:-1], cuts[1:]):
        here = order[a:b]
        here = here[_halved(hull.unit(la[here], lo[here]), _leaves(len(here)))]
        centre, reach = _ball(hull.unit(la[here], lo[here])[None])
        n_here = n[here]
        rows.append((*map(float, centre[0]), float(reach[0]), len(here), int(n_here.sum()), la[here].tobytes(), lo[here].tobytes(), b"" if (n_here == 1).all() else n_here.tobytes()))
    return {c.split(" ")[0]: list(v) for c, v in zip(_TILE.split(", "), zip(*rows))}


def _cut(many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def tiles() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            out = _tiles_of(*(t[c].to_numpy() for c in ("la", "lo", "n")), many)
            types = {"double": pa.float64(), "long": pa.int64(), "binary": pa.binary()}
            return pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, types[t]) for c, t in (x.split(" ") for x in _TILE.split(", "))]))

        for b in batches:
            while b.num_rows:
                part = b.slice(0, RUN * many - rows)
                held.append(part)
                rows += part.num_rows
                b = b.slice(part.num_rows)
                if rows == RUN * many:
                    yield tiles()
                    held, rows = [], 0
        if rows:
            yield tiles()

    return run


class _Leafy:
    """Places of tiles in leaves: x (3 x leaves x LEAF, NaN beyond a leaf's places), n (0 there), la and lo."""

    def __init__(self, la: np.ndarray, lo: np.ndarray, n: np.ndarray, cuts: np.ndarray):
        at = cuts[:-1, None] + np.arange(LEAF)
        real = at < cuts[1:, None]
        at = np.where(real, at, cuts[:-1, None])
        self.la, self.lo = la[at], lo[at]
        x = hull.unit(la, lo)[at]
        self.centre, self.reach = _ball(x)
        self.n = np.where(real, n[at], 0).astype(float)
        self.points = self.n.sum(1)
        self.single = bool((n == 1).all())
        self.x = np.ascontiguousarray(np.where(real[:, :, None], x, np.nan).transpose(2, 0, 1))

    @classmethod
    def of(cls, tiles: list[dict]) -> _Leafy:
        la, lo = (np.concatenate([np.frombuffer(t[c]) for t in tiles]) for c in ("la", "lo"))
        n = np.concatenate([np.frombuffer(t["n"], np.int64) if t["n"] else np.ones(t["places"], np.int64) for t in tiles])
        cuts, start = [np.zeros(1, np.int64)], 0
        for t in tiles:
            cuts.append(start + _cuts(t["places"], _leaves(t["places"]))[1:])
            start += t["places"]
        return cls(la, lo, n, np.concatenate(cuts))


def _within(la: np.ndarray, lo: np.ndarray, la2: np.ndarray, lo2: np.ndarray, least: float) -> np.ndarray:
    a, b = np.radians(la), np.radians(la2)
    cosine = np.sin(a) * np.sin(b) + np.cos(a) * np.cos(b) * np.cos(np.radians(lo) - np.radians(lo2))
    return (cosine >= least) | ((la == la2) & (lo == lo2))


def _leaf_counts(la: np.ndarray, lo: np.ndarray, others: _Leafy, least: float) -> np.ndarray:
    """How many points of ``others`` each of the places of a leaf has within the radius of this cosine."""
    x = hull.unit(la, lo)
    centre, reach = (v[0] for v in _ball(x[None]))
    radius, reach = np.arccos(np.clip(least, -1.0, 1.0)), reach + ANGLE
    away = np.arccos(np.clip(others.centre @ centre, -1.0, 1.0))
    all_ = away + others.reach <= radius - reach
    some = np.flatnonzero((away - others.reach <= radius + reach) & ~all_)
    counts = np.full(len(la), others.points[all_].sum())
    if not len(some):
        return counts
    y, n, la2, lo2 = others.x[:, some].reshape(3, -1), others.n[some].ravel(), others.la[some].ravel(), others.lo[some].ravel()
    toward = centre @ y
    inner = np.cos(radius - reach) if radius > reach else 2.0
    outer = np.cos(radius + reach) if radius + reach < np.pi else -2.0
    counts += n[toward >= inner].sum()
    edge = np.flatnonzero((toward >= outer) & (toward < inner))
    for at in (edge[i : i + PIECE] for i in range(0, len(edge), PIECE)):
        cosine = x @ y[:, at]
        sure = cosine >= least + COSINE
        counts += [np.count_nonzero(row) for row in sure] if others.single else sure @ n[at]
        open_ = cosine >= least - COSINE
        if np.count_nonzero(open_) > np.count_nonzero(sure):
            i, k = np.nonzero(open_ & ~sure)
            k = at[k]
            yes = _within(la[i], lo[i], la2[k], lo2[k], least)
            counts += np.bincount(i[yes], n[k[yes]], len(la))
    return counts


def _met(least: float):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        head, near = next(r for r in rows if r["head"]), [r for r in rows if not r["head"]]
        la, lo = np.frombuffer(head["la"]), np.frombuffer(head["lo"])
        counts = np.full(len(la), float(head["base"]))
        if near:
            others, cuts = _Leafy.of(near), _cuts(len(la), _leaves(len(la)))
            for a, b in zip(cuts[:-1], cuts[1:]):
                counts[a:b] += _leaf_counts(la[a:b], lo[a:b], others, least)
        return pa.table({"la": la, "lo": lo, "n": counts.astype(np.int64)})

    return run


def counts(spots: DataFrame, radius_deg: float) -> DataFrame:
    """la, lo, n: for each place of spots (la, lo, n: points there) the points within the radius, its own among them."""
    least = float(np.cos(np.radians(radius_deg)))
    m = spots.count()
    many = min(MANY, max(FEW, -(-m // TILES)))
    finite = F.abs("la") < float("inf")
    coded = reduce(DataFrame.withColumns, _along_curve(), spots.where(finite).select("la", "lo", F.col("n").cast("long").alias("n")))
    curve = coded.repartitionByRange(max(1, -(-m // (RUN * many))), "_code", "la", "lo").sortWithinPartitions("_code", "la", "lo")
    tiles = stored(curve.select("la", "lo", "n").mapInArrow(_cut(many), _TILE).withColumn("tile", F.monotonically_increasing_id()), "tiles")

    # Rows without places, TILES of them until tiles have MANY places: every two of them are compared.
    ball = lambda k: tiles.select(*[F.col(c).alias(f"{c}{k}") for c in ("tile", "x", "y", "z", "reach", "points")])
    away = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("x1") * F.col("x2") + F.col("y1") * F.col("y2") + F.col("z1") * F.col("z2"))))
    radius = float(np.arccos(np.clip(least, -1.0, 1.0)))
    reach = F.col("reach1") + F.col("reach2") + F.lit(ANGLE)
    pairs = ball(1).crossJoin(F.broadcast(ball(2))).where(away <= F.lit(radius) + reach).select("tile1", "tile2", "points2", (away <= F.lit(radius) - reach).alias("all"))
    pairs = stored(pairs, "tile-pairs")
    part = F.floor((F.row_number().over(Window.partitionBy("tile1").orderBy("tile2")) - 1) / NEAR).cast("int")
    near = pairs.where(~F.col("all")).select("tile1", part.alias("part"), F.col("tile2").alias("tile"), F.lit(False).alias("head"), F.lit(0).cast("long").alias("base"))
    heads = pairs.groupBy("tile1").agg(F.sum(F.when(F.col("all"), F.col("points2")).otherwise(0)).alias("base"), F.count_if(~F.col("all")).alias("k"))
    last = F.greatest(F.lit(0), F.ceil(F.col("k") / NEAR) - 1).cast("int")
    heads = heads.select("tile1", F.explode(F.sequence(F.lit(0), last)).alias("part"), F.col("tile1").alias("tile"), F.lit(True).alias("head"), "base")
    heads = heads.withColumn("base", F.when(F.col("part") == 0, F.col("base")).otherwise(0))
    met = near.unionByName(heads).join(tiles.select("tile", "places", "la", "lo", "n"), "tile")
    found = met.groupBy("tile1", "part").applyInArrow(_met(least), _COUNT)
    return found.unionByName(spots.where(~finite).select("la", "lo", "n")).groupBy("la", "lo").agg(F.sum("n").alias("n"))
