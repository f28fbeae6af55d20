"""From barcode x sample to barcode x area."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cortexloom.operators import fit, matrix
from cortexloom.operators.params import AreaParams


def target_rois(roi_main: DataFrame, cortical: list[int], patterns: tuple[str, ...]) -> DataFrame:
    """(sample): subcortical target ROIs, by parts of their regions' names."""
    hit = F.exists("regions", lambda r: F.exists(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(r, p)))
    return roi_main.where(hit & ~F.col("roi").isin(cortical)).select(F.col("roi").alias("sample"))


def classify_projection_type(bc: DataFrame, targets: DataFrame) -> DataFrame:
    """(barcode, kind): CT_PT if the barcode has counts in a target, else IT."""
    hit = bc.join(targets.withColumn("t", F.lit(True)), "sample", "left").groupBy("barcode").agg(F.sum(F.when(F.col("t"), F.col("value")).otherwise(0.0)).alias("s"))
    return hit.select("barcode", F.when(F.col("s") > 0, "CT_PT").otherwise("IT").alias("kind"))


def exclude_mixed(area_vol: DataFrame, visual: tuple[str, ...], source: str, fraction: float) -> DataFrame:
    """Without the ROIs that have a visual area and more than ``fraction`` of ``source``."""
    w = Window.partitionBy("roi")
    share = F.sum(F.when(F.col("area") == source, F.col("vol")).otherwise(0.0)).over(w) / F.sum("vol").over(w)
    seen = F.max(F.col("area").isin(list(visual)) & (F.col("vol") > 0)).over(w)
    return area_vol.withColumn("_m", seen & (share > fraction)).where("not _m").drop("_m")


def weights(area_vol: DataFrame) -> DataFrame:
    """(sample, area, w): an area's share of its ROI, over the area's volume in all ROIs."""
    row, col = Window.partitionBy("roi"), Window.partitionBy("area")
    w = F.col("vol") / F.sum("vol").over(row) / F.sum("vol").over(col)
    return area_vol.select(F.col("roi").alias("sample"), "area", w.alias("w"))


def area_projection(bc: DataFrame, w: DataFrame) -> DataFrame:
    """(barcode, area, strength): sum over samples of value x weight."""
    return bc.join(w, "sample").groupBy("barcode", "area").agg(F.sum(F.col("value") * F.col("w")).alias("strength"))


def projection(bc: DataFrame, area_vol: DataFrame, roi_main: DataFrame, cortical: list[int] | None, p: AreaParams = AreaParams(), only: str | None = None, remove_mixed: bool = False, n_areas: int | None = None, classify_after_cut: bool = False) -> DataFrame:
    """(barcode, area, strength), scaled by row or binary.

    ``only``: IT or CT_PT barcodes. They are told apart on the full matrix, before it is cut to
    cortical samples; ``classify_after_cut`` does it the other way round. Binary results come
    from the unscaled strengths.
    """
    vol = exclude_mixed(area_vol, p.visual, p.source_area, p.mixed_fraction) if remove_mixed else area_vol
    cut = matrix.keep_samples(bc, cortical) if cortical else bc
    if only:
        kinds = classify_projection_type(cut if classify_after_cut else bc, target_rois(roi_main, cortical or [], p.subcortical))
        cut = cut.join(kinds.where(F.col("kind") == only).select("barcode"), "barcode", "left_semi")
    cut = matrix.drop_empty_barcodes(cut)
    if cortical:
        vol = vol.where(F.col("roi").isin(cortical))
    got = area_projection(cut, weights(vol)).where("strength <> 0")
    if p.binary:
        return got.withColumn("strength", F.lit(1))
    count = n_areas if n_areas is not None else got.select("area").distinct().count()
    return matrix.scale_rows(got, count, p.scale, "strength")


def _profiles(bc: DataFrame, samples: list[int]) -> DataFrame:
    """(barcode, y): each barcode's values over ``samples``, absent ones as 0; barcodes without any of them are not there."""
    profile = F.transform(F.array(*[F.lit(s) for s in samples]).cast("array<int>"), lambda s: F.coalesce(F.try_element_at("cells", s), F.lit(0.0)))
    cells = bc.where(F.col("sample").isin(samples) & (F.col("value") != 0)).select("barcode", F.col("sample").cast("int").alias("sample"), F.col("value").cast("double").alias("value"))
    return cells.groupBy("barcode").agg(F.map_from_entries(F.collect_list(F.struct("sample", "value"))).alias("cells")).select("barcode", profile.alias("y"))


def homog_across_area(bc: DataFrame, area_vol: DataFrame, alpha: float = 1.0, binary: bool = False, c: float = 1.0, signed: bool = False) -> DataFrame:
    """(barcode, area, coefficient): each barcode's sample profile fitted on the sample x area volumes, without an intercept.

    A non-negative Lasso of the profile over its sum, or an L1 logistic regression of presence, whose negative
    coefficients become 0 and whose rows are scaled to 0..1 (not with ``signed``). Every fit is certified by its duality gap;
    one that stays open is an ArithmeticError. Zero coefficients have no row. The design (samples x
    areas of one brain) is small and goes to the tasks; barcodes are fitted in Arrow batches.
    """
    vol = area_vol.toPandas().pivot(index="roi", columns="area", values="vol").fillna(0.0).sort_index()
    vol = vol[sorted(vol.columns)]
    samples, areas, design = [int(s) for s in vol.index], list(vol.columns), vol.to_numpy(float)
    kind = dict(bc.dtypes)["barcode"]

    def run(batches):
        for pdf in batches:
            y = np.array(pdf["y"].tolist(), float).reshape(len(pdf), len(samples))
            if binary:
                w = fit.l1_logistic(y > 0, design, c)
                if not signed:
                    w = np.maximum(0.0, w)
                    low = w.min(axis=1, keepdims=True, initial=np.inf)
                    span = w.max(axis=1, keepdims=True, initial=0.0) - low
                    w = np.divide(w - low, span, out=np.zeros_like(w), where=span > 0)
            else:
                w = fit.nonnegative_lasso(y / np.maximum(y.sum(axis=1, keepdims=True), 1e-300), design, alpha)
            b, a = np.nonzero(w)
            yield pd.DataFrame({"barcode": pdf["barcode"].to_numpy()[b], "area": np.array(areas, object)[a] if areas else [], "coefficient": w[b, a]})

    return _profiles(bc, samples).mapInPandas(run, f"barcode {kind}, area string, coefficient double")


def fit_conditions(bc: DataFrame, area_vol: DataFrame, coefficients: DataFrame, alpha: float = 1.0, binary: bool = False, c: float = 1.0, tol: float = 1e-6) -> DataFrame:
    """(barcode, worst, optimal): how far the given coefficients are from the optimality conditions of ``homog_across_area``, in shares of the penalty.

    A coefficient that is not 0 must have the loss' slope at minus the penalty (times its sign), one that is 0 must
    have it between (for the Lasso: above minus the penalty). A relational check that knows nothing of the solver.
    """
    vol = area_vol.select(F.col("roi").cast("int").alias("sample"), "area", "vol")
    samples = [r[0] for r in vol.select("sample").distinct().orderBy("sample").collect()]  # of one brain
    fitted = coefficients.join(F.broadcast(vol), "area").groupBy("barcode", "sample").agg(F.sum(F.col("vol") * F.col("coefficient")).alias("u"))
    rows = _profiles(bc, samples).withColumn("total", F.aggregate("y", F.lit(0.0), lambda a, x: a + x))
    cell = F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in samples]).alias("sample"), F.col("y").alias("y")))
    cells = rows.select("barcode", "total", cell.alias("e")).select("barcode", "total", F.col("e.sample").alias("sample"), F.col("e.y").alias("y"))
    cells = cells.join(fitted, ["barcode", "sample"], "left").withColumn("u", F.coalesce("u", F.lit(0.0)))
    present = (F.col("y") > 0).cast("double")
    slope = 1 / (1 + F.exp(-F.col("u"))) - present if binary else (F.col("u") - F.col("y") / F.col("total")) / len(samples)
    penalty = 1 / c if binary else alpha
    g = cells.withColumn("v", slope).join(F.broadcast(vol), "sample").groupBy("barcode", "area").agg(F.sum(F.col("v") * F.col("vol")).alias("g"))
    g = g.join(coefficients, ["barcode", "area"], "left").withColumn("w", F.coalesce("coefficient", F.lit(0.0)))
    zero = F.greatest(F.lit(0.0), F.abs("g") - penalty) if binary else F.greatest(F.lit(0.0), -F.col("g") - penalty)
    off = F.when(F.col("w") == 0, zero).otherwise(F.abs(F.col("g") + F.signum("w") * penalty)) + F.when(F.lit(not binary) & (F.col("w") < 0), F.lit(float("inf"))).otherwise(0.0)
    worst = g.groupBy("barcode").agg((F.max(off) / penalty).alias("worst"))
    return worst.withColumn("optimal", F.col("worst") <= tol)


def select_visual_areas(projection: DataFrame, token: str = "VIS", dropped: tuple[str, ...] = ("VISC",)) -> DataFrame:
    """The projections (barcode, area, strength) to areas whose name holds ``token``, without those in ``dropped``; rows of zeros go."""
    return projection.where(F.contains("area", F.lit(token)) & ~F.col("area").isin(*dropped) & (F.col("strength") != 0))
