"""Vector features: kinds from tags, geometry of nodes, ways and relations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tag keys in order of preference, and the kinds that count.
TAG_KEYS = ("aeroway", "disused:aeroway", "abandoned:aeroway")
KINDS = ("aerodrome", "runway", "taxiway", "apron")


def tag_kind(tags: Column, keys: tuple[str, ...] = TAG_KEYS, kinds: tuple[str, ...] = KINDS) -> Column:
    """The first tag with a kind that counts; a life-cycle prefix stays before the kind. Null where none does."""
    out = []
    for key in keys:
        kind = F.try_element_at(tags, F.lit(key))
        prefix = key.rpartition(":")[0]
        out.append(F.when(kind.isin(*kinds), F.concat(F.lit(f"{prefix}:" if prefix else ""), kind)))
    return F.coalesce(*out)


def shape_of(kind: Column, points: Column) -> Column:
    """'point', 'polygon' (a closed way of four points or more), 'line' or null (too few points)."""
    n = F.size(points)
    closed = F.element_at(points, 1) == F.element_at(points, -1)
    return F.when((kind == "node") & (n == 1), "point").when((kind == "way") & (n >= 4) & closed, "polygon").when((kind == "way") & (n >= 2), "line")


RINGS = "feature string, shape string, points array<struct<lat:double,lon:double>>"


def assemble(members: DataFrame) -> DataFrame:
    """(feature, shape, points): rings and left-over lines of relations from member ways (feature, way, points), joined at their ends.

    A relation has few members; each is one group.
    """

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = [[(p["lat"], p["lon"]) for p in pts] for pts in pdf.sort_values("way")["points"] if pts is not None and len(pts) >= 2]
        out = []
        while lines:
            line = lines.pop(0)
            grew = True
            while grew and line[0] != line[-1]:
                grew = False
                for i, other in enumerate(lines):
                    # at the tail, then at the head
                    if other[0] == line[-1]:
                        line = line + other[1:]
                    elif other[-1] == line[-1]:
                        line = line + other[-2::-1]
                    elif other[-1] == line[0]:
                        line = other[:-1] + line
                    elif other[0] == line[0]:
                        line = other[:0:-1] + line
                    else:
                        continue
                    lines.pop(i)
                    grew = True
                    break
            ring = line[0] == line[-1] and len(line) >= 4
            out.append((pdf["feature"].iloc[0], "polygon" if ring else "line", [{"lat": a, "lon": b} for a, b in line]))
        return pd.DataFrame(out, columns=["feature", "shape", "points"])

    return members.groupBy("feature").applyInPandas(chain, RINGS)


def blobs(cells: DataFrame, least: int = 2, most: int | None = None, aspect: float | None = None, solidity: float = 0.0) -> DataFrame:
    """(blob, n, height, width, solidity) of 4-connected cells (row, col), of least to most cells; solidity: share of the box.

    aspect: the longer side by the shorter one at most; solidity: the least.
    """
    from isohyet.operators.entity import components

    c = cells.select("row", "col").distinct().withColumn("id", F.col("row").cast("long") * (1 << 31) + F.col("col"))
    step = lambda dr, dc: c.select(F.col("id").alias("a"), (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col")).join(c.select("row", "col", F.col("id").alias("b")), ["row", "col"]).select("a", "b")
    of = components(step(1, 0).union(step(0, 1)))
    sides = of.join(c, of["node"] == c["id"]).groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), (F.max("row") - F.min("row") + 1).alias("height"), (F.max("col") - F.min("col") + 1).alias("width")
    )
    long, short = F.greatest("height", "width"), F.least("height", "width")
    fits = (F.col("n") >= least) & (F.col("n") / (F.col("height") * F.col("width")) >= solidity)
    if most is not None:
        fits = fits & (F.col("n") <= most)
    if aspect is not None:
        fits = fits & (long <= aspect * short)
    return sides.where(fits).select(F.col("component").alias("blob"), "n", "height", "width", (F.col("n") / (F.col("height") * F.col("width"))).alias("solidity"))
