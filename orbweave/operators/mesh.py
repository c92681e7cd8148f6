"""Voronoi and Delaunay areas of any number of places, from hulls of tiles.

A tile is a box of the sphere with the places in it and those around it. A facet of the tile's own hull is one of the
whole hull if its circumscribed cap lies where the tile knows all places, and a place whose facets all are so has its
areas. The others, and the neighbours they have in their tiles, meet again in tiles of twice the size, until one tile
holds all that are left: a place that is done is on no facet with places that are not, save as such a neighbour, so what
is left has the same facets among itself as within the whole. Groups are bounded by the tile at each size; the edge of a
region and lone places are few.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators import hull
from orbweave.operators.places import box_for, boxes
from orbweave.sources.storage import discard, stored

#: Places of a tile on average, and at most, at the start; the part of a tile's size that it knows around its places.
MANY, CROWD, REACH = 128, 512, 0.35
DONE, OPEN, BESIDE = 0, 1, 2
_ROW = "la double, lo double, kind int, voronoi double, delaunay double"


def _tile(reach: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf["mine"].to_numpy()
        x = hull.unit(pdf["la"].to_numpy(), pdf["lo"].to_numpy())
        whole = reach >= 180.0
        if not whole:
            centre = x[mine].mean(0)
            if np.linalg.norm(centre) > 1e-6:
                off = hull.angle(x, centre / np.linalg.norm(centre))
                near = off <= off[mine].max() + np.radians(reach)
                pdf, x, mine = pdf[near], x[near], mine[near]
        t = hull.facets(hull.stirred(x)) if len(x) >= 4 else None
        if t is None:
            if whole:
                raise ValueError("the points lie in one plane; they have no hull")
            kind = np.where(mine, OPEN, BESIDE)
            return pd.DataFrame({"la": pdf["la"], "lo": pdf["lo"], "kind": kind.astype(np.int32), "voronoi": 0.0, "delaunay": 0.0})
        centre = hull.centres(x, t)
        wide = np.zeros(len(t), bool) if whole else 2 * hull.angle(x[t[:, 0]], centre) > np.radians(reach) * (1 - 1e-9)
        open_ = np.zeros(len(x), bool)
        open_[t[wide].ravel()] = True
        open_ &= mine
        beside = np.zeros(len(x), bool)
        beside[t[open_[t].any(1)].ravel()] = True
        kind = np.where(open_, OPEN, np.where(mine, DONE, BESIDE))
        out = pd.DataFrame({"la": pdf["la"].to_numpy(), "lo": pdf["lo"].to_numpy(), "kind": kind.astype(np.int32), "voronoi": hull.voronoi_of(x, t), "delaunay": hull.delaunay_of(x, t)})
        again = out[beside & (kind == DONE)].assign(kind=np.int32(BESIDE))  # done, and still needed by its neighbour
        return pd.concat([out[mine | beside], again])

    return run


def areas(spots: DataFrame) -> DataFrame:
    """la, lo, voronoi, delaunay of each place of spots (la, lo)."""
    m = spots.count()
    left = spots.select("la", "lo", F.lit(True).alias("open"))
    box, found, held = 180.0 if m <= CROWD else box_for(spots, MANY, CROWD), [], []
    while True:
        own, near = boxes(box)
        tiles = own(left.where("open")).select("i", "j").distinct()
        rows = near(own(left).withColumnsRenamed({"i": "oi", "j": "oj"})).join(tiles, ["i", "j"], "left_semi")
        rows = rows.select("i", "j", "la", "lo", (F.col("open") & (F.col("oi") == F.col("i")) & (F.col("oj") == F.col("j"))).alias("mine"))
        out = stored(rows.groupBy("i", "j").applyInPandas(_tile(180.0 if box >= 180.0 else REACH * box), _ROW), "tiles")
        discard(*held)
        found.append(out.where(F.col("kind") == DONE).select("la", "lo", "voronoi", "delaunay"))
        if box >= 180.0 or not out.where(F.col("kind") == OPEN).take(1):
            return reduce(DataFrame.unionByName, found)
        left = stored(out.where(F.col("kind") != DONE).groupBy("la", "lo").agg(F.max(F.col("kind") == OPEN).alias("open")), "open-places")
        box, held = min(180.0, box * 2.0), [left]
