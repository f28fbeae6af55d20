"""Voxel volumes, atlas structures and region tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cortexloom.functions.geometry import voxel_index
from cortexloom.operators import blocks

# Structures that their descendants are reported as.
GROUPS = ("HY", "CB", "MY", "P", "fiber tracts", "STR", "IPN", "BLA", "PAL", "HPF", "SCm", "SCs", "IC", "LGd", "LGv", "root", "SSp", "MOB", "AOB")
OLFACTORY = ("MOB", "AOB")
XYZ = ["x", "y", "z"]


def rollup_acronym(structures: DataFrame, groups: tuple[str, ...] = GROUPS, levels: int = 5) -> DataFrame:
    """(id, area): the reporting name of every structure.

    A layer (its acronym ends in a digit, 6a or 6b) counts as its parent. The nearest of up to
    ``levels`` ancestors that is in ``groups`` gives the name, else the structure itself; MOB and
    AOB are OB. The table has one row a structure, so it is joined as a broadcast by callers.
    """
    names = structures.select(F.col("id").alias("pid"), F.col("acronym").alias("name"), "structure_id_path")
    layer = F.col("acronym").rlike(r"(\d|6[ab])$") & (F.size("structure_id_path") > 1)
    start = structures.select("id", F.when(layer, F.get("structure_id_path", F.size("structure_id_path") - 2)).otherwise(F.col("id")).alias("pid"))
    own = start.join(names, "pid").select("id", F.col("name").alias("own"), F.posexplode_outer(F.slice(F.reverse("structure_id_path"), 2, levels)).alias("up", "anc"))
    above = own.join(structures.select(F.col("id").alias("anc"), F.col("acronym").alias("above")), "anc", "left")
    near = F.min_by("above", F.when(F.col("above").isin(list(groups)), F.col("up")))
    area = above.groupBy("id", "own").agg(F.coalesce(near, F.col("own")).alias("area"))
    return area.select("id", F.when(F.col("area").isin(list(OLFACTORY)), "OB").otherwise(F.col("area")).alias("area"))


def label_structures(voxels: DataFrame, annotation: DataFrame) -> DataFrame:
    """(label, structure_id, n): voxels of each structure in each label."""
    return voxels.join(annotation, XYZ).groupBy("label", "structure_id").agg(F.count("*").alias("n"))


def roi_region_table(voxels: DataFrame, annotation: DataFrame, structures: DataFrame, nontarget: list[int], voxel_um: float = 25.0) -> DataFrame:
    """(roi, structure_id, n, volume_um3): counts by target structure; the volume is of all the ROI's voxels."""
    n = label_structures(voxels, annotation)
    all_ = voxels.groupBy(F.col("label").alias("roi")).agg((F.count("*") * float(voxel_um**3)).alias("volume_um3"))
    bad = F.arrays_overlap("structure_id_path", F.array(*[F.lit(i) for i in nontarget])) if nontarget else F.lit(False)
    target = structures.where(~bad).select(F.col("id").alias("structure_id"))
    kept = n.join(target, "structure_id").select(F.col("label").alias("roi"), "structure_id", "n")
    return kept.join(all_, "roi")


def roi_areas(regions: DataFrame, areas: DataFrame, contra: list[int]) -> DataFrame:
    """(roi, area, n, fraction, volume_um3): region counts by reporting name, ``Contra-`` in front for contralateral ROIs."""
    named = regions.where("structure_id > 0").join(F.broadcast(areas), F.col("structure_id") == F.col("id"))  # a row a structure
    area = F.when(F.col("roi").isin(contra), F.concat(F.lit("Contra-"), F.col("area"))).otherwise(F.col("area"))
    n = named.groupBy("roi", area.alias("area")).agg(F.sum("n").alias("n"), F.first("volume_um3").alias("volume_um3"))
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("roi")))


def roi_main_region(roi_area: DataFrame) -> DataFrame:
    """(roi, regions, breakdown, main, main_fraction, vol_in_atlas); largest first, ties by name."""
    item = F.struct((-F.col("fraction")).alias("f"), F.col("area").alias("a"))
    rows = roi_area.groupBy("roi").agg(F.sort_array(F.collect_list(item)).alias("items"), F.sum("n").alias("vol_in_atlas"))
    return rows.select(
        "roi",
        F.transform("items", lambda x: x["a"]).alias("regions"),
        F.transform("items", lambda x: -x["f"]).alias("breakdown"),
        F.col("items")[0]["a"].alias("main"),
        (-F.col("items")[0]["f"]).alias("main_fraction"),
        "vol_in_atlas",
    )


def area_volumes(roi_area: DataFrame, threshold: float = 0.1, dropped: tuple[str, ...] = ("fiber tracts", "root"), main_only: bool = False) -> DataFrame:
    """(roi, area, vol): volume of each area in each ROI, all contralateral areas as ``Contra``.

    Cells below ``threshold`` of the ROI's total are 0 (absent); ``main_only`` keeps the largest
    cells instead, ties included.
    """
    area = F.when(F.contains("area", F.lit("Contra")), "Contra").otherwise(F.col("area"))
    vol = roi_area.groupBy("roi", area.alias("area")).agg(F.sum(F.col("fraction") * F.col("volume_um3")).alias("vol")).where(~F.col("area").isin(list(dropped)))
    w = Window.partitionBy("roi")
    keep = F.col("vol") == F.max("vol").over(w) if main_only else F.col("vol") >= threshold * F.sum("vol").over(w) - F.lit(1e-6)
    return vol.withColumn("_k", keep).where("_k and vol > 0").drop("_k")


def rois_with_area(roi_main: DataFrame, area: str = "AUDp") -> DataFrame:
    return roi_main.where(F.array_contains("regions", area)).select("roi")


def adjacent_labels(voxels: DataFrame, only: list[int] | None = None) -> DataFrame:
    """(label, neighbour): labels one voxel apart along an axis, found in dense blocks."""
    kind = dict(voxels.dtypes)["label"]
    pairs = blocks.per_block(voxels, blocks.label_pairs, "label bigint, neighbour bigint").distinct()
    found = pairs.select(F.col("label").cast(kind).alias("label"), F.col("neighbour").cast(kind).alias("neighbour"))
    return found.where(F.col("neighbour").isin(only)) if only else found


def hemisphere_filter(voxels: DataFrame, depth: int) -> DataFrame:
    """Each label's voxels on its majority side of the middle z index; on a tie both sides go. Sides are counted before voxels are kept, so a label of any size is no one task's."""
    left = F.col("z") < depth // 2
    sides = voxels.groupBy(F.col("label").alias("_of")).agg(F.count_if(left).alias("_l"), F.count_if(~left).alias("_r")).where("_l <> _r")
    keep = F.broadcast(sides.select("_of", (F.col("_l") > F.col("_r")).alias("_side")))  # a row a label: the tubes of a brain
    return voxels.join(keep, (F.col("label") == F.col("_of")) & (left == F.col("_side"))).select(voxels.columns)


def fill_label_holes(voxels: DataFrame, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Binary closing of each label by a 2x2x2 block: empty voxels are filled, the smallest label first. Closed in dense blocks."""
    kind = dict(voxels.dtypes)
    new = blocks.per_block(voxels, blocks.closed_holes, "x int, y int, z int, label bigint").select(*[F.col(c).cast(kind[c]).alias(c) for c in (*XYZ, "label")])
    if shape:
        new = new.where(" and ".join(f"{a} between 0 and {s - 1}" for a, s in zip(XYZ, shape)))
    return voxels.select(*XYZ, "label").unionByName(new)


def area_centroids(annotation: DataFrame, structures: DataFrame) -> DataFrame:
    """(structure_id, x, y, z): mean voxel of every structure with its descendants; sums are taken by structure before the path is exploded."""
    own = annotation.groupBy("structure_id").agg(F.count("*").alias("n"), *[F.sum(a).alias(a) for a in XYZ])
    up = own.join(structures.select(F.col("id").alias("structure_id"), "structure_id_path"), "structure_id").select(F.explode("structure_id_path").alias("structure_id"), "n", *XYZ)
    return up.groupBy("structure_id").agg(*[(F.sum(a) / F.sum("n")).alias(a) for a in XYZ])


def centroid_distance(centroids: DataFrame, source: int, voxel_um: float = 25.0) -> DataFrame:
    """(structure_id, distance_um) to the centroid of ``source``."""
    to = centroids.where(F.col("structure_id") == source).select(*[F.col(a).alias(f"s{a}") for a in XYZ])
    square = sum((F.pow(F.col(a) - F.col(f"s{a}"), F.lit(2.0)) for a in XYZ), F.lit(0.0))
    return centroids.crossJoin(F.broadcast(to)).select("structure_id", (F.sqrt(square) * voxel_um).alias("distance_um"))  # one row


def common_areas(areas: DataFrame, n_mice: int, structures: DataFrame | None = None, cortex: int | None = None) -> DataFrame:
    """(area): areas that all mice have; with ``cortex`` only those below it and Contra, never OB."""
    both = areas.groupBy("area").agg(F.count_distinct("mouse").alias("n")).where(F.col("n") == n_mice).select("area")
    if structures is None or cortex is None:
        return both
    inside = structures.where(F.array_contains("structure_id_path", cortex)).select(F.col("acronym").alias("area")).union(structures.sparkSession.createDataFrame([("Contra",)], "area string"))
    return both.join(F.broadcast(inside), "area", "left_semi").where("area <> 'OB'")


def density_by_sample(voxels: DataFrame, density: DataFrame, injections: dict[int, float]) -> DataFrame:
    """(label, experiment_id, density): summed tracing density over the injection's volume; and the mean as experiment -1."""
    total = voxels.join(density, XYZ).groupBy("label", "experiment_id").agg(F.sum("value").alias("s"))
    volume = F.create_map(*[F.lit(x) for kv in injections.items() for x in kv])
    per = total.select("label", "experiment_id", (F.col("s") / F.try_element_at(volume, F.col("experiment_id"))).alias("density"))
    mean = per.groupBy("label").agg((F.sum("density") / len(injections)).alias("density")).select("label", F.lit(-1).cast("bigint").alias("experiment_id"), "density")
    return per.unionByName(mean)


def rasterise_rois(mask_px: DataFrame, thickness: DataFrame, annotation: DataFrame, shape: tuple[int, int, int], resolution: float = 25.0, combine: dict[int, list[int]] | None = None) -> DataFrame:
    """(x, y, z, label): mask pixels with atlas coordinates, as thick as their section, inside the brain.

    ``mask_px``: section, tube, xa, ya, za; ``thickness``: section, um. One label a voxel: the one
    of the last section, then of the last tube.
    """
    head = {t: h for h, ts in (combine or {}).items() for t in ts}
    label = F.col("tube")
    if head:
        label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in head.items() for x in kv]), label), label)
    k = thickness.select("section", voxel_index(F.col("um"), resolution).alias("k")).where("k >= 1")
    index = lambda c: voxel_index(F.col(c), resolution)
    px = mask_px.join(k, "section").select("section", "tube", label.alias("label"), index("xa").alias("x"), index("ya").alias("y"), index("za").alias("z"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("dx"))
    px = px.withColumn("x", F.col("x") + F.col("dx")).where(" and ".join(f"{a} between 1 and {s - 1}" for a, s in zip(XYZ, shape)))
    one = px.groupBy(*XYZ).agg(F.max_by("label", F.struct("section", "tube")).alias("label"))
    return one.join(annotation.where("structure_id <> 0").select(*XYZ), XYZ)


def rename_areas(c: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), c)
