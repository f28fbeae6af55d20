"""Section images in atlas space: triangulated warps, distances between sections, thickness."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cortexloom.functions.geometry import atlas_coordinates, barycentric, inside
from cortexloom.operators.delaunay import triangulate
from cortexloom.plans.scratch import Scratch


def marker_points(sections: DataFrame) -> DataFrame:
    """(section, i, tx, ty, sx, sy): markers (target, source), and four corners 10% beyond the image."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    corner = lambda fx, fy: F.array(w * fx, h * fy, w * fx, h * fy)
    corners = F.array(*[corner(fx, fy) for fx, fy in ((-0.1, -0.1), (1.1, -0.1), (-0.1, 1.1), (1.1, 1.1))])
    rows = sections.select("section", F.posexplode(F.concat(corners, F.coalesce("markers", F.array().cast("array<array<double>>")))).alias("i", "m"))
    return rows.select("section", "i", *[F.col("m")[k].alias(c) for k, c in enumerate(("tx", "ty", "sx", "sy"))])


def delaunay_triangles(points: DataFrame) -> DataFrame:
    """(section, i, j, k) with i < j < k: triangles of source points that tile their hull, none with a point inside its circle.

    Sections are dealt out whole and come one after the other in Arrow batches; the points of one (its markers and corners) are
    triangulated one after the other with exact predicates. Points without a position are left out; see ``delaunay.triangulate``
    for points on a circle, a line, or twice.
    """

    def run(batches):
        held = []  # rows of the last section, which may go on in the next batch
        for batch in itertools.chain(batches, [None]):
            rows = [*held, batch] if batch is not None else held
            if not rows:
                continue
            t = pa.Table.from_batches(rows).combine_chunks()
            same = t["section"].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(same)) + 1).tolist()]
            if batch is not None:
                held = t.slice(cuts[-1]).to_batches()
            else:
                cuts.append(len(t))
            xy = np.stack([t[c].to_numpy() for c in ("sx", "sy")], axis=1).astype(float)
            there = ~np.isnan(xy).any(axis=1)
            found = [np.zeros((0, 3), int)]
            for start, end in itertools.pairwise(cuts):
                at = start + np.flatnonzero(there[start:end])
                found.append(at[np.array(triangulate(xy[at]), int).reshape(-1, 3)])
            rows = np.concatenate(found)
            yield from t.select(["section"]).take(rows[:, 0]).append_column("i", t["i"].take(rows[:, 0])).append_column("j", t["i"].take(rows[:, 1])).append_column("k", t["i"].take(rows[:, 2])).to_batches()

    kind, spark = dict(points.dtypes), points.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # else few bytes, which are much work, go to few tasks
    dealt = points.select("section", "i", "sx", "sy").repartition(n, "section").sortWithinPartitions("section", "i")
    return dealt.mapInArrow(run, f"section {kind['section']}, i {kind['i']}, j {kind['i']}, k {kind['i']}")


def _corners(tri: DataFrame, points: DataFrame, forward: bool) -> DataFrame:
    """Triangles with the columns a, b, c of the side that is tested (f) and of the side that is mapped to (t)."""
    f, t = (("t", "s") if forward else ("s", "t"))
    out = tri
    for name, idx in (("a", "i"), ("b", "j"), ("c", "k")):
        out = out.join(points.select("section", F.col("i").alias(idx), *[F.col(f"{side}{ax}").alias(f"{name}{kind}{ax}") for kind, side in (("f", f), ("t", t)) for ax in "xy"]).hint("merge"), ["section", idx])
    return out


def triangle_of(pixels: DataFrame, tri: DataFrame, points: DataFrame, tile: float = 64.0, forward: bool = False) -> DataFrame:
    """``pixels`` (section, px, py, ...) with nx, ny: mapped through the first triangle that holds them.

    Triangles are exploded to the tiles of their bounding box, so a pixel meets only the triangles
    near it. Without ``forward`` source positions map to target ones. Pixels in no triangle are dropped.
    Points, pixels and tiles are many rows a section, which estimates from the sections' size leave out: their joins are
    merged, never broadcast.
    """
    full = _corners(tri, points, forward)
    least = lambda ax, g: F.floor(g(*[f"{n}f{ax}" for n in "abc"]) / tile).cast("int")
    tiles = full.withColumn("tx_", F.explode(F.sequence(least("x", F.least), least("x", F.greatest)))).withColumn("ty_", F.explode(F.sequence(least("y", F.least), least("y", F.greatest))))
    px = pixels.withColumn("tx_", F.floor(F.col("px") / tile).cast("int")).withColumn("ty_", F.floor(F.col("py") / tile).cast("int"))
    joined = px.join(tiles.hint("merge"), ["section", "tx_", "ty_"])
    c = F.col
    u, v = barycentric(c("px"), c("py"), c("afx"), c("afy"), c("bfx"), c("bfy"), c("cfx"), c("cfy"))
    hit = joined.withColumn("u", u).withColumn("v", v).where(inside(c("u"), c("v")))
    nx = c("atx") + (c("btx") - c("atx")) * c("u") + (c("ctx") - c("atx")) * c("v")
    ny = c("aty") + (c("bty") - c("aty")) * c("u") + (c("cty") - c("aty")) * c("v")
    one = hit.groupBy("section", "px", "py").agg(F.min(F.struct("i", "j", "k", nx.alias("nx"), ny.alias("ny"))).alias("m"))
    return one.select("section", "px", "py", F.col("m.nx").alias("nx"), F.col("m.ny").alias("ny"))


def section_pixels(sections: DataFrame) -> DataFrame:
    """(section, width, px, py); a table of few splits is dealt out first, since a section is many pixels."""
    cores = sections.sparkSession.sparkContext.defaultParallelism
    if sections.rdd.getNumPartitions() < cores:
        sections = sections.repartition(cores, "section")
    x, y = F.explode(F.sequence(F.lit(0), F.col("width") - 1)), F.explode(F.sequence(F.lit(0), F.col("height") - 1))
    return sections.select("section", "height", "width", x.alias("px")).select("section", "width", "px", y.alias("py"))


def warp_section_pixels(sections: DataFrame, tile: float = 64.0) -> DataFrame:
    """(section, px, py, xa, ya, za): atlas position in um of every pixel, warped by its section's markers."""
    points = marker_points(sections)
    mapped = triangle_of(section_pixels(sections).select("section", "px", "py"), delaunay_triangles(points), points, tile)
    both = mapped.join(sections.select("section", "width", "height", "anchoring").hint("merge"), "section")
    xyz = atlas_coordinates(F.col("nx"), F.col("ny"), F.col("width"), F.col("height"), F.col("anchoring"))
    return both.select("section", "px", "py", *[c.alias(n) for c, n in zip(xyz, ("xa", "ya", "za"))])


def has_next_section(sections: DataFrame) -> DataFrame:
    """(section, has_next)."""
    nxt = sections.select((F.col("section") - 1).alias("section"), F.lit(True).alias("n")).distinct()
    return sections.select("section").join(nxt, "section", "left").select("section", F.coalesce("n", F.lit(False)).alias("has_next"))


def nearest_pixel_in_next_section(warped: DataFrame, widths: DataFrame, every: int = 100, grid_um: float = 50.0, max_rounds: int = 40) -> DataFrame:
    """(section, px, py, distance, dx): for every ``every``-th pixel the nearest one of the next section in the (za, ya) plane.

    Both sides meet in cells of a grid and their eight neighbours; a best distance within the cell
    size is final, all others try again with cells twice as large, so the answer is exact. Ties go
    to the first pixel in row order.
    """
    scratch = Scratch(warped.sparkSession, "nearest")
    px = scratch.save(warped.join(widths.select("section", "width").hint("merge"), "section").withColumn("at", F.col("py") * F.col("width") + F.col("px")), "px")
    following = px.select((F.col("section") - 1).alias("section"), F.col("at").alias("at2"), F.col("xa").alias("xa2"), F.col("ya").alias("ya2"), F.col("za").alias("za2"))
    left = px.where(F.col("at") % every == 0).join(following.select("section").distinct().hint("merge"), "section", "left_semi")
    done, g = None, grid_um
    for _ in range(max_rounds):
        cell = lambda c, g=g: F.floor(F.col(c) / g)
        around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        a = left.withColumn("o", around).withColumn("cz", cell("za") + F.col("o.i")).withColumn("cy", cell("ya") + F.col("o.j"))
        b = following.withColumn("cz", cell("za2")).withColumn("cy", cell("ya2"))
        d = F.sqrt(F.pow(F.col("za") - F.col("za2"), F.lit(2.0)) + F.pow(F.col("ya") - F.col("ya2"), F.lit(2.0)))
        best = a.join(b.hint("merge"), ["section", "cz", "cy"]).withColumn("d", d).groupBy("section", "px", "py").agg(F.min(F.struct("d", "at2", (F.col("xa2") - F.col("xa")).alias("dx"))).alias("m"))
        found = scratch.save(best.where(F.col("m.d") <= g).select("section", "px", "py", F.col("m.d").alias("distance"), F.col("m.dx").alias("dx")), "found")
        done = found if done is None else done.unionByName(found)
        left = scratch.save(left.join(found.hint("merge"), ["section", "px", "py"], "left_anti"), "left")
        if left.isEmpty():
            return done
        g *= 2
    raise RuntimeError("sections lie too far apart for the grid")


def section_thickness(nearest: DataFrame, sections: DataFrame, share: float = 0.2) -> DataFrame:
    """(section, um): mean x difference over the nearest ``share`` of the sampled pixels; the median of the others without a next section."""
    w = Window.partitionBy("section")
    rank = F.row_number().over(w.orderBy("distance", "py", "px"))
    some = nearest.withColumn("r", rank).withColumn("n", F.count("*").over(w)).where(F.col("r") <= F.floor(F.col("n") * share))
    own = some.groupBy("section").agg(F.avg("dx").alias("um"))
    other = own.agg(F.median("um").alias("m"))
    return sections.select("section").join(own, "section", "left").crossJoin(F.broadcast(other)).select("section", F.coalesce("um", "m").alias("um"))  # one row
