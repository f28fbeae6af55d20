"""Matrix quality, atlas tables, projections and null populations: registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cortexloom.functions import geometry, sequences
from cortexloom.operators import areas, atlas, matrix, null, sections, stats
from cortexloom.operators.params import AREA_NAMES, AreaParams
from cortexloom.sources import fixtures
from cortexloom.sources.fixtures import duck

CORTICAL, CONTROLS, SOURCES, CONTRA = list(range(1, 9)), [12], [1, 2, 3], [4, 5]
GROUPS, NONTARGET = ("AFRICA", "ASIA"), [1003]
P = AreaParams(source_area="ASIA", subcortical=("INDIA", "KENYA", "PERU", "AMERICA"), visual=("CHINA", "EUROPE", "AMERICA"), mixed_fraction=0.3)
R9 = lambda c: F.round(c, 9).alias(c)


def _m(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.matrix(spark, d)


def _spikes(spark, d):
    return _m(spark, d).where("barcode % 20 = 0")


def _tubes(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/nation.parquet").selectExpr("CAST(n_nationkey AS int) AS sample", "CAST((n_nationkey * 7) % 11 AS int) AS tube").where("sample between 1 and 11")


def _adjacent(spark, d):
    return atlas.adjacent_labels(fixtures.voxels(spark, d))


def _areas(spark, d):
    return atlas.rollup_acronym(fixtures.structures(spark, d), GROUPS)


def _regions(spark, d):
    return atlas.roi_region_table(fixtures.voxels(spark, d), fixtures.annotation(spark, d), fixtures.structures(spark, d), NONTARGET)


def _roi_areas(spark, d):
    return atlas.roi_areas(_regions(spark, d), _areas(spark, d), CONTRA)


def _vol(spark, d, main_only=False):
    return atlas.area_volumes(_roi_areas(spark, d), P.area_threshold, main_only=main_only)


def _main(spark, d):
    return atlas.roi_main_region(_roi_areas(spark, d))


def _projected(spark, d, main_only=False, **more):
    return areas.projection(_m(spark, d), _vol(spark, d, main_only), _main(spark, d), CORTICAL, more.pop("p", P), **more)


def _binary(spark, d):
    p = AreaParams(**{**P.__dict__, "binary": True})
    return _projected(spark, d, p=p).withColumn("mouse", F.col("barcode") % 3)


def _area_samples(spark, d):
    w = areas.weights(_vol(spark, d).where(F.col("roi").isin(CORTICAL))).select("sample", "area")
    return w.withColumn("mouse", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(3)])))


def _brains(spark, d):
    """Presence of up to some thousand barcodes a mouse: those that pass the soma filter, by mouse."""
    return matrix.filter_soma(_m(spark, d)).where(F.col("sample").isin(CORTICAL)).withColumn("mouse", F.col("barcode") % 3)


def _density(spark, d):
    return spark.sql("SELECT l_linenumber % 3 + 100L AS experiment_id, CAST(1 + l_partkey % 12 AS int) x, CAST(1 + l_suppkey % 10 AS int) y, CAST(1 + l_orderkey % 16 AS int) z, sum(l_quantity) AS value FROM {l} GROUP BY ALL", l=spark.read.parquet(f"{d}/lineitem.parquet"))


def _warped(spark, d):
    return sections.warp_section_pixels(fixtures.sections(spark, d), tile=4.0)


def _nearest(spark, d):
    s = fixtures.sections(spark, d)
    return sections.nearest_pixel_in_next_section(_warped(spark, d), s, every=10, grid_um=40.0)


def q_filter_total_counts(s, d):
    return matrix.filter_total_counts(_m(s, d), 600)


def q_zero_low_counts(s, d):
    return matrix.zero_low_counts(_m(s, d), 20)


def q_filter_min_samples(s, d):
    return matrix.filter_min_samples(_m(s, d), 5)


def q_highest_second(s, d):
    return matrix.highest_second(_m(s, d))


def q_filter_soma(s, d):
    return matrix.filter_soma(_m(s, d))


def q_argmax_sample(s, d):
    return matrix.argmax_sample(_m(s, d))


def q_filter_source_region(s, d):
    return matrix.filter_source_region(_m(s, d), SOURCES)


def q_drop_source_samples(s, d):
    return matrix.drop_empty_barcodes(matrix.drop_samples(_m(s, d), SOURCES))


def q_select_cortical(s, d):
    return matrix.keep_samples(_m(s, d), CORTICAL)


def q_spike_factor(s, d):
    return matrix.spike_factor(_spikes(s, d)).select("sample", "total", R9("factor"))


def q_spike_normalise(s, d):
    return matrix.spike_normalise(_m(s, d).where("barcode % 20 <> 0"), _spikes(s, d)).select("barcode", "sample", R9("value"))


def q_negative_control(s, d):
    return matrix.negative_control(_m(s, d), CONTROLS)


def q_rank_abundance(s, d):
    return matrix.rank_abundance(_m(s, d))


def q_rename_tubes(s, d):
    return matrix.rename_tubes(_m(s, d), _tubes(s, d), {1: [1, 2], 5: [6]}, [9])


def q_adjacent_samples(s, d):
    return _adjacent(s, d)


def q_zero_adjacent_to_soma(s, d):
    return matrix.zero_adjacent_to_soma(_m(s, d), _adjacent(s, d))


def q_prefix_barcodes(s, d):
    return matrix.prefix_barcodes(_m(s, d), F.concat(F.lit("mouse"), (F.col("barcode") % 3).cast("string")))


def q_barcode_max(s, d):
    return matrix.barcode_max(_m(s, d).withColumn("mouse", F.col("barcode") % 3))


def q_scale_by_second_unique(s, d):
    return matrix.scale_by_second_unique(_m(s, d)).select("barcode", "sample", R9("value"))


def q_binarise(s, d):
    return matrix.binarise(_m(s, d))


def q_column_shuffle(s, d):
    return matrix.column_shuffle(_m(s, d), list(range(1, 13)), 7)


def q_rollup_acronym(s, d):
    return _areas(s, d)


def q_roi_region_table(s, d):
    return _regions(s, d)


def q_roi_areas(s, d):
    return _roi_areas(s, d).select("roi", "area", "n", R9("fraction"))


def q_roi_main_region(s, d):
    return _main(s, d).select("roi", F.array_join("regions", ",").alias("regions"), "main", R9("main_fraction"), "vol_in_atlas")


def q_area_volumes(s, d):
    return _vol(s, d).select("roi", "area", F.round("vol", 3).alias("vol"))


def q_area_volumes_as_main(s, d):
    return _vol(s, d, True).select("roi", "area", F.round("vol", 3).alias("vol"))


def q_rois_with_area(s, d):
    return atlas.rois_with_area(_main(s, d), "ASIA")


def q_hemisphere_filter(s, d):
    return atlas.hemisphere_filter(fixtures.voxels(s, d), 17)


def q_fill_label_holes(s, d):
    return atlas.fill_label_holes(fixtures.voxels(s, d))


def q_area_centroid_distance(s, d):
    c = atlas.area_centroids(fixtures.annotation(s, d), fixtures.structures(s, d))
    return atlas.centroid_distance(c, 2003).select("structure_id", F.round("distance_um", 6).alias("distance_um"))


def q_common_areas(s, d):
    a = _binary(s, d).select("mouse", "area").distinct()
    return atlas.common_areas(a, 3)


def q_density_by_sample(s, d):
    return atlas.density_by_sample(fixtures.voxels(s, d), _density(s, d), {100: 2.0, 101: 3.0, 102: 4.0}).select("label", "experiment_id", F.round("density", 6).alias("density"))


def q_classify_projection_type(s, d):
    return areas.classify_projection_type(_m(s, d), areas.target_rois(_main(s, d), CORTICAL, P.subcortical))


def q_rename_areas(s, d):
    return _areas(s, d).select("id", atlas.rename_areas(F.col("area"), {**AREA_NAMES, "ASIA": "AS", "root": "R"}).alias("area"))


def q_homog_across_cubelet(s, d):
    return _projected(s, d, only="IT").select("barcode", "area", R9("strength"))


def q_homog_across_cubelet_minmax(s, d):
    return _projected(s, d, only="CT_PT", remove_mixed=True, p=AreaParams(**{**P.__dict__, "scale": "minmax"})).select("barcode", "area", R9("strength"))


def q_area_is_main(s, d):
    return _projected(s, d, True, p=AreaParams(**{**P.__dict__, "scale": "minmax"})).select("barcode", "area", R9("strength"))


def _cortical(s, d):
    return matrix.keep_samples(_m(s, d), CORTICAL), _vol(s, d).where(F.col("roi").isin(CORTICAL))


def q_homog_across_area(s, d):
    return areas.homog_across_area(*_cortical(s, d))


def q_homog_across_area_binary(s, d):
    return areas.homog_across_area(*_cortical(s, d), binary=True)


def q_homog_across_area_conditions(s, d):
    """Whether each barcode's coefficients are optimal; worked out from the coefficients by joins."""
    bc, vol = _cortical(s, d)
    return areas.fit_conditions(bc, vol, areas.homog_across_area(bc, vol)).select("barcode", "optimal")


def q_homog_across_area_binary_conditions(s, d):
    bc, vol = _cortical(s, d)
    return areas.fit_conditions(bc, vol, areas.homog_across_area(bc, vol, binary=True, signed=True), binary=True).select("barcode", "optimal")


def q_co_projection(s, d):
    return stats.co_projection(stats.co_occurrence(_binary(s, d)))


def q_neurons_per_area(s, d):
    return stats.neurons_per_area(stats.co_occurrence(_binary(s, d)))


def q_conditional_probability(s, d):
    return stats.conditional_probability(stats.co_occurrence(_binary(s, d), ["mouse"]), ["mouse"]).select("mouse", "area_a", "area_b", R9("p"))


def q_cosine_similarity(s, d):
    return stats.cosine_similarity(stats.conditional_probability(stats.co_occurrence(_binary(s, d)))).select("area_a", "area_b", F.round("cosine", 8).alias("cosine"))


def q_projection_summary(s, d):
    p = _projected(s, d).withColumn("mouse", F.col("barcode") % 3)
    totals = _m(s, d).select("barcode").distinct().groupBy((F.col("barcode") % 3).alias("mouse")).agg(F.count("*").alias("n_all"))
    return stats.projection_summary(p, totals).select("mouse", "area", R9("frequency"), F.round("mean_strength", 8).alias("mean_strength"))


def q_curveball_shuffle(s, d):
    return null.curveball_shuffle(_brains(s, d), 4)


def q_curveball_margins(s, d):
    """Present cells of every barcode and of every sample in the shuffled populations: those of the real one."""
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(name).cast("bigint").alias("key"))
    cells = null.curveball_shuffle(_brains(s, d), 4).select("mouse", "replicate", F.explode(F.array(side("barcode"), side("sample"))).alias("x"))
    return cells.groupBy("mouse", "replicate", "x.side", "x.key").agg(F.count("*").alias("n"))


def q_null_statistics(s, d):
    common = atlas.common_areas(_area_samples(s, d).select("mouse", "area").distinct(), 3)
    return null.generate_null(_brains(s, d), _area_samples(s, d), common, replicates=8).withColumn("value", F.round("value", 8))


def q_null_statistics_by_mouse(s, d):
    common = atlas.common_areas(_area_samples(s, d).select("mouse", "area").distinct(), 3)
    return null.generate_null(_brains(s, d), _area_samples(s, d), common, replicates=8, by_mouse=True).withColumn("value", F.round("value", 8))


def q_delaunay_triangles(s, d):
    return sections.delaunay_triangles(sections.marker_points(fixtures.sections(s, d)))


def q_warp_section_pixels(s, d):
    return _warped(s, d).select("section", "px", "py", *[F.round(c, 4).alias(c) for c in ("xa", "ya", "za")])


def q_has_next_section(s, d):
    return sections.has_next_section(fixtures.sections(s, d))


def q_nearest_pixel(s, d):
    return _nearest(s, d).select("section", "px", "py", F.round("distance", 4).alias("distance"))


def q_section_thickness(s, d):
    return sections.section_thickness(_nearest(s, d), fixtures.sections(s, d)).select("section", F.round("um", 3).alias("um"))


def q_rasterise_rois(s, d):
    w = _warped(s, d).withColumn("tube", F.col("section") % 9)
    px = w.select("section", "tube", (F.col("xa") / 50).alias("xa"), (F.abs("ya") / 25).alias("ya"), (F.abs("za") / 25).alias("za"))
    thick = fixtures.sections(s, d).select("section", (25.0 * (F.col("section") % 4)).alias("um"))
    return atlas.rasterise_rois(px, thick, fixtures.annotation(s, d), (12, 400, 400), combine={1: [2, 3]})


def q_select_visual_areas(s, d):
    return areas.select_visual_areas(_projected(s, d), "I", ("INDIA",)).select("barcode", "area", R9("strength"))


def q_warp_forward(s, d):
    """Atlas side to section side: the same triangles, mapped the other way."""
    sec = fixtures.sections(s, d)
    points = sections.marker_points(sec)
    px = sections.section_pixels(sec).select("section", "px", "py")
    mapped = sections.triangle_of(px, sections.delaunay_triangles(points), points, tile=4.0, forward=True)
    return mapped.select("section", "px", "py", F.round("nx", 6).alias("nx"), F.round("ny", 6).alias("ny"))


def q_section_names(s, d):
    name = F.concat(F.lit("corrected_BC"), "section", F.lit(".csv"))
    return fixtures.sections(s, d).select("section", sequences.section_label(F.col("section")).alias("label"), sequences.sample_number(name).alias("sample"))


def q_section_voxels(s, d):
    return _warped(s, d).select("section", "px", "py", *[geometry.voxel_index(F.round(f"{c}a", 4)).alias(c) for c in "xyz"])


def q_distance_decay(s, d):
    c = atlas.centroid_distance(atlas.area_centroids(fixtures.annotation(s, d), fixtures.structures(s, d)), 2003)
    return c.select("structure_id", F.round(geometry.exponential_decay(F.col("distance_um"), 2.0, 0.01), 9).alias("decay"))


def q_pair_labels(s, d):
    return q_cosine_similarity(s, d).select(sequences.pair_label(F.col("area_a"), F.col("area_b")).alias("pair"), "cosine")


def q_list_literals(s, d):
    written = s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.concat(F.lit("['"), "n_name", F.lit("', 'all']")).alias("written"))
    return written.select("n_nationkey", F.explode(sequences.list_literal(F.col("written"))).alias("name"))


_M = f"WITH m AS ({duck(fixtures.MATRIX_SQL)})"
_SP = f"""{_M}, sp AS (SELECT * FROM m WHERE barcode % 20 = 0), tot AS (SELECT sample, sum(value) AS total FROM sp GROUP BY 1 HAVING sum(value) >= 10),
fac AS (SELECT sample, total, total / (SELECT median(total) FROM tot WHERE total > 10) AS factor FROM tot)"""
_TOP = f"{_M}, r AS (SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY value DESC, sample) AS k FROM m), am AS (SELECT barcode, sample FROM r WHERE k = 1), hs AS (SELECT barcode, max(value) FILTER (k = 1) AS highest, coalesce(max(value) FILTER (k = 2), 0) AS second FROM r GROUP BY 1)"
_V = f"vox AS ({duck(fixtures.VOXELS_SQL)}), ann AS (SELECT x, y, z, 2000 + (x * 5 + y * 3 + z + label) % 25 AS structure_id FROM vox), st AS ({duck(fixtures.STRUCTURES_SQL)})"
_ADJ = f"adj AS (SELECT DISTINCT a.label, b.label AS neighbour FROM vox a JOIN vox b ON abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 AND a.label <> b.label)"
_GR = ", ".join(f"'{g}'" for g in GROUPS)
_ROLL = f"""{_V},
s1 AS (SELECT id, CASE WHEN regexp_matches(acronym, '(\\d|6[ab])$') AND len(structure_id_path) > 1 THEN structure_id_path[len(structure_id_path) - 1] ELSE id END AS pid FROM st),
s2 AS (SELECT s1.id, p.acronym AS own, list_reverse(p.structure_id_path)[2:6] AS up FROM s1 JOIN st p ON p.id = pid),
s3 AS (SELECT s2.id, own, k, a.acronym FROM s2 LEFT JOIN range(1, 6) AS t(k) ON k <= len(up) LEFT JOIN st a ON a.id = up[k]),
areas AS (SELECT id, CASE WHEN area IN ('MOB', 'AOB') THEN 'OB' ELSE area END AS area FROM (SELECT id, coalesce(arg_min(acronym, k) FILTER (acronym IN ({_GR})), any_value(own)) AS area FROM s3 GROUP BY id))"""
_REG = f"""{_ROLL},
n AS (SELECT label AS roi, structure_id, count(*) AS n FROM vox JOIN ann USING (x, y, z) GROUP BY ALL),
vol AS (SELECT label AS roi, count(*) * 15625.0::DOUBLE AS volume_um3 FROM vox GROUP BY 1),
reg AS (SELECT roi, structure_id, n, volume_um3 FROM n JOIN vol USING (roi) JOIN st ON id = structure_id WHERE NOT list_contains(structure_id_path, 1003))"""
_RA = f"""{_REG},
ra0 AS (SELECT roi, CASE WHEN roi IN (4, 5) THEN 'Contra-' || area ELSE area END AS area, CAST(sum(n) AS BIGINT) AS n, any_value(volume_um3) AS v FROM reg JOIN areas ON structure_id = id GROUP BY 1, 2),
ra AS (SELECT roi, area, n, v, n / sum(n) OVER (PARTITION BY roi) AS fraction FROM ra0)"""
_AV0 = f"""{_RA},
av0 AS (SELECT roi, CASE WHEN contains(area, 'Contra') THEN 'Contra' ELSE area END AS area, sum(fraction * v) AS vol FROM ra GROUP BY 1, 2),
av1 AS (SELECT * FROM av0 WHERE area NOT IN ('fiber tracts', 'root'))"""
_AVT = f"{_AV0}, av AS (SELECT roi, area, vol FROM (SELECT *, sum(vol) OVER (PARTITION BY roi) AS t FROM av1) WHERE vol >= 0.1 * t - 1e-6 AND vol > 0)"
_AVM = f"{_AV0}, av AS (SELECT roi, area, vol FROM (SELECT *, max(vol) OVER (PARTITION BY roi) AS t FROM av1) WHERE vol = t AND vol > 0)"
_PAT = " OR ".join(f"contains(area, '{p}')" for p in P.subcortical)


def _proj(av: str, only: str = "", mixed: bool = False, scale: str = "range") -> str:
    """CTEs ending in ``pr``(barcode, area, raw, strength)."""
    vis = ", ".join(f"'{v}'" for v in P.visual)
    mix = f"SELECT roi, area, vol FROM (SELECT *, sum(CASE WHEN area = 'ASIA' THEN vol ELSE 0 END) OVER w / sum(vol) OVER w AS sh, bool_or(area IN ({vis})) OVER w AS seen FROM av WINDOW w AS (PARTITION BY roi)) WHERE NOT (seen AND sh > 0.3)" if mixed else "SELECT * FROM av"
    test = {"": "", "IT": "AND barcode IN (SELECT barcode FROM kinds WHERE s = 0)", "CT_PT": "AND barcode IN (SELECT barcode FROM kinds WHERE s > 0)"}[only]
    top = "raw - lo" if scale == "minmax" else "raw"
    return f"""WITH m AS ({duck(fixtures.MATRIX_SQL)}), {av},
tr AS (SELECT DISTINCT roi FROM ra WHERE ({_PAT}) AND roi > 8),
kinds AS (SELECT barcode, sum(CASE WHEN sample IN (SELECT roi FROM tr) THEN value ELSE 0 END) AS s FROM m GROUP BY 1),
v1 AS ({mix}),
v2 AS (SELECT * FROM v1 WHERE roi BETWEEN 1 AND 8),
w AS (SELECT roi AS sample, area, vol / sum(vol) OVER (PARTITION BY roi) / sum(vol) OVER (PARTITION BY area) AS w FROM v2),
p0 AS (SELECT barcode, area, sum(value * w) AS raw FROM m JOIN w USING (sample) WHERE value <> 0 {test} GROUP BY 1, 2),
p1 AS (SELECT *, max(raw) OVER b AS hi, CASE WHEN count(*) OVER b < (SELECT count(DISTINCT area) FROM p0) THEN least(min(raw) OVER b, 0) ELSE min(raw) OVER b END AS lo FROM p0 WINDOW b AS (PARTITION BY barcode)),
pr AS (SELECT barcode, area, raw, coalesce(({top}) / nullif(hi - lo, 0), 0) AS strength FROM p1)"""


_CO = f"{_proj(_AVT)}, c AS (SELECT a.area AS area_a, b.area AS area_b, count(*) AS n FROM pr a JOIN pr b USING (barcode) GROUP BY 1, 2), pb AS (SELECT c.area_a, c.area_b, c.n / o.n AS p FROM c JOIN c o ON o.area_a = c.area_a AND o.area_b = c.area_a)"
_PRIME = null.PRIME


def _mixed(x: str) -> str:
    """The operator's mixing step on a name or expression below the prime."""
    return f"(({x} * {x} % {_PRIME}) * ({x} * {x} % {_PRIME}) % {_PRIME} * {x} + {null.PLUS}) % {_PRIME}"


_HASH = f"CAST('0x' || substr(md5({{}}), 1, 13) AS BIGINT) % {_PRIME}"


def _superstep(t: int) -> str:
    """CTEs from t{t} to t{t + 1}(mouse, replicate, barcode, k): pairs of neighbours in the hashed order deal what they do not share."""
    by = "mouse, replicate, cell, pair"
    return f"""
h{t} AS (SELECT mouse, replicate, barcode, code, n, (code + {_HASH.format(f"'1|' || mouse || '|' || replicate || '|{t}'")}) % {_PRIME} AS x FROM bar JOIN cnt USING (mouse), reps),
g{t} AS (SELECT * EXCLUDE (x), {_mixed("x")} AS x FROM h{t}),
o{t} AS (SELECT * EXCLUDE (x), {_mixed("x")} AS place FROM g{t}),
r{t} AS (SELECT *, row_number() OVER (PARTITION BY mouse, replicate, cell ORDER BY place, code, barcode) - 1 AS rk FROM (SELECT *, place // ({_PRIME} // greatest(1, n // {null.CELL}) + 1) AS cell FROM o{t})),
q{t} AS MATERIALIZED (SELECT mouse, replicate, barcode, cell, pair, rk % 2 AS side, first_value(place) OVER (PARTITION BY {by} ORDER BY rk) AS p0, count(*) OVER (PARTITION BY {by}) AS size FROM (SELECT *, rk // 2 AS pair FROM r{t})),
x{t} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {by}, k) AS seen, {_mixed("p0")} AS y FROM t{t} JOIN q{t} USING (mouse, replicate, barcode)),
y{t} AS (SELECT *, (y + k) % {_PRIME} AS z FROM x{t} WHERE size = 2 AND seen = 1),
z{t} AS (SELECT *, {_mixed("z")} AS deal FROM y{t}),
l{t} AS (SELECT {by}, k, CASE WHEN row_number() OVER (PARTITION BY {by} ORDER BY deal2, k) <= count(*) FILTER (side = 0) OVER (PARTITION BY {by}) THEN 0 ELSE 1 END AS side FROM (SELECT *, {_mixed("deal")} AS deal2 FROM z{t})),
t{t + 1} AS MATERIALIZED (SELECT mouse, replicate, barcode, k FROM x{t} WHERE size = 1 OR seen = 2 UNION ALL SELECT mouse, replicate, barcode, k FROM l{t} JOIN q{t} USING (mouse, replicate, cell, pair, side))"""


def _shuffled(top: str, replicates: int) -> str:
    """CTEs ending in ``shuf``(mouse, replicate, barcode, sample), after ``r`` and ``hs`` of the matrix."""
    return f"""{top}, br AS (SELECT barcode % 3 AS mouse, barcode, sample FROM m WHERE barcode IN (SELECT barcode FROM hs WHERE second >= 10 AND log10(highest / second) > log10(5.0)) AND sample <= 8 AND value <> 0),
bar AS MATERIALIZED (SELECT mouse, barcode, {_HASH.format("CAST(barcode AS VARCHAR)")} AS code FROM (SELECT DISTINCT mouse, barcode FROM br)),
cnt AS (SELECT mouse, count(*) AS n FROM bar GROUP BY 1),
smp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY mouse ORDER BY sample) AS k FROM (SELECT DISTINCT mouse, sample FROM br)),
reps AS (SELECT range AS replicate FROM range({replicates})),
t0 AS MATERIALIZED (SELECT mouse, replicate, barcode, k FROM br JOIN smp USING (mouse, sample), reps),
{",".join(_superstep(t) for t in range(null.STEPS))},
shuf AS MATERIALIZED (SELECT mouse, replicate, barcode, sample FROM t{null.STEPS} JOIN smp USING (mouse, k))"""


def _null_sql(mouse: str) -> str:
    """Statistics of the shuffled populations; ``mouse``: what the mice are summed to."""
    return f"""{_shuffled(f"{_proj(_AVT)}, rr AS (SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY value DESC, sample) AS k FROM m), hs AS (SELECT barcode, max(value) FILTER (k = 1) AS highest, coalesce(max(value) FILTER (k = 2), 0) AS second FROM rr GROUP BY 1)", 8)},
ba AS (SELECT DISTINCT mouse, replicate, barcode, area FROM shuf JOIN w USING (sample)),
c AS MATERIALIZED (SELECT {mouse} AS mouse, replicate, a.area AS area_a, b.area AS area_b, CAST(count(*) AS DOUBLE) AS n FROM ba a JOIN ba b USING (mouse, replicate, barcode) GROUP BY 1, 2, 3, 4),
pb AS MATERIALIZED (SELECT c.mouse, c.replicate, c.area_a, c.area_b, c.n / o.n AS p FROM c JOIN c o ON o.mouse = c.mouse AND o.replicate = c.replicate AND o.area_a = c.area_a AND o.area_b = c.area_a),
ar AS (SELECT DISTINCT mouse, replicate, area_a AS a FROM pb),
pp AS (SELECT x.mouse, x.replicate, x.a AS a, y.a AS b FROM ar x JOIN ar y ON x.mouse = y.mouse AND x.replicate = y.replicate AND x.a < y.a),
v AS (SELECT pp.*, k.a AS k, coalesce(p.p, 0) AS p, coalesce(q.p, 0) AS q FROM pp JOIN ar k ON k.mouse = pp.mouse AND k.replicate = pp.replicate AND k.a <> pp.a AND k.a <> pp.b
  LEFT JOIN pb p ON p.mouse = pp.mouse AND p.replicate = pp.replicate AND p.area_a = pp.a AND p.area_b = k.a LEFT JOIN pb q ON q.mouse = pp.mouse AND q.replicate = pp.replicate AND q.area_a = pp.b AND q.area_b = k.a),
co AS (SELECT mouse, replicate, a, b, coalesce(sum(p * q) / nullif(sqrt(sum(p * p)) * sqrt(sum(q * q)), 0), 0) AS c FROM v GROUP BY 1, 2, 3, 4)
SELECT mouse, replicate, 'co_projection' AS stat, area_a, area_b, n AS value FROM c WHERE area_a < area_b
UNION ALL SELECT mouse, replicate, 'neurons', area_a, area_b, n FROM c WHERE area_a = area_b
UNION ALL SELECT mouse, replicate, 'conditional_probability', area_a, area_b, round(p, 8) FROM pb WHERE area_a <> area_b
UNION ALL SELECT pp.mouse, pp.replicate, 'cosine', pp.a, pp.b, round(coalesce(co.c, 0), 8) FROM pp LEFT JOIN co USING (mouse, replicate, a, b)"""


_SEC = f"""sec AS ({duck(fixtures.SECTIONS_SQL)}),
pts AS (SELECT section, 0 AS i, -0.1 * width AS tx, -0.1 * height AS ty, -0.1 * width AS sx, -0.1 * height AS sy FROM sec
  UNION ALL SELECT section, 1, 1.1 * width, -0.1 * height, 1.1 * width, -0.1 * height FROM sec UNION ALL SELECT section, 2, -0.1 * width, 1.1 * height, -0.1 * width, 1.1 * height FROM sec
  UNION ALL SELECT section, 3, 1.1 * width, 1.1 * height, 1.1 * width, 1.1 * height FROM sec
  UNION ALL SELECT section, 3 + k, markers[k][1], markers[k][2], markers[k][3], markers[k][4] FROM sec, range(1, 5) AS t(k)),
pd AS (SELECT section, CAST(i AS INTEGER) AS i, CAST(tx AS DOUBLE) AS tx, CAST(ty AS DOUBLE) AS ty, CAST(sx AS DOUBLE) AS sx, CAST(sy AS DOUBLE) AS sy FROM pts),
tr0 AS (SELECT a.section, a.i, b.i AS j, c.i AS k, a.sx ix, a.sy iy, b.sx jx, b.sy jy, c.sx kx, c.sy ky FROM pd a JOIN pd b ON a.section = b.section AND a.i < b.i JOIN pd c ON a.section = c.section AND b.i < c.i),
tr1 AS (SELECT *, (jx - ix) * (ky - iy) - (kx - ix) * (jy - iy) AS det FROM tr0),
tri AS (SELECT section, i, j, k FROM tr1 t WHERE abs(det) > 1e-9 AND NOT EXISTS (SELECT 1 FROM (SELECT section AS ps, i AS p, sx AS px, sy AS py FROM pd) q WHERE ps = t.section AND p <> i AND p <> j AND p <> k
  AND (((ix-px)*(ix-px)+(iy-py)*(iy-py)) * ((jx-px)*(ky-py)-(kx-px)*(jy-py)) - ((jx-px)*(jx-px)+(jy-py)*(jy-py)) * ((ix-px)*(ky-py)-(kx-px)*(iy-py)) + ((kx-px)*(kx-px)+(ky-py)*(ky-py)) * ((ix-px)*(jy-py)-(jx-px)*(iy-py))) * sign(det) > 1e-7))"""
_WARP = f"""{_SEC},
px AS (SELECT section, width, height, anchoring, CAST(x AS INTEGER) AS px, CAST(y AS INTEGER) AS py FROM sec, range(12) AS a(x), range(9) AS b(y)),
full_ AS (SELECT t.*, a.sx asx, a.sy asy, b.sx bsx, b.sy bsy, c.sx csx, c.sy csy, a.tx atx, a.ty aty, b.tx btx, b.ty bty, c.tx ctx, c.ty cty FROM tri t
  JOIN pd a ON a.section = t.section AND a.i = t.i JOIN pd b ON b.section = t.section AND b.i = t.j JOIN pd c ON c.section = t.section AND c.i = t.k),
uv AS (SELECT px.*, i, j, k, ((px - asx) * (csy - asy) - (csx - asx) * (py - asy)) / ((bsx - asx) * (csy - asy) - (csx - asx) * (bsy - asy)) AS u,
  ((bsx - asx) * (py - asy) - (px - asx) * (bsy - asy)) / ((bsx - asx) * (csy - asy) - (csx - asx) * (bsy - asy)) AS v, atx, aty, btx, bty, ctx, cty FROM px JOIN full_ USING (section)),
hit AS (SELECT *, row_number() OVER (PARTITION BY section, px, py ORDER BY i, j, k) AS nth FROM uv WHERE u >= -1e-9 AND v >= -1e-9 AND u + v <= 1 + 1e-9),
nw AS (SELECT *, (atx + (btx - atx) * u + (ctx - atx) * v) / (width - 1) AS fx, (aty + (bty - aty) * u + (cty - aty) * v) / (height - 1) AS fy FROM hit WHERE nth = 1),
warp AS (SELECT section, px, py, 13175 - 25 * (fx * anchoring[5] + fy * anchoring[8] + anchoring[2]) AS xa, 7975 - 25 * (fx * anchoring[6] + fy * anchoring[9] + anchoring[3]) AS ya, 25 * (fx * anchoring[4] + fy * anchoring[7] + anchoring[1]) AS za FROM nw),
near0 AS (SELECT a.section, a.px, a.py, sqrt(pow(a.za - b.za, 2.0) + pow(a.ya - b.ya, 2.0)) AS distance, b.xa - a.xa AS dx, b.py * 12 + b.px AS at2 FROM warp a JOIN warp b ON b.section = a.section + 1 WHERE (a.py * 12 + a.px) % 10 = 0),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section, px, py ORDER BY distance, at2) AS nth FROM near0) WHERE nth = 1)"""

# the same with source and target of the triangles exchanged
_FORWARD = f"""WITH {_SEC},
px AS (SELECT section, CAST(x AS INTEGER) AS px, CAST(y AS INTEGER) AS py FROM sec, range(12) AS a(x), range(9) AS b(y)),
full_ AS (SELECT t.*, a.tx ax, a.ty ay, b.tx bx, b.ty by_, c.tx cx, c.ty cy, a.sx ox, a.sy oy, b.sx o2x, b.sy o2y, c.sx o3x, c.sy o3y FROM tri t
  JOIN pd a ON a.section = t.section AND a.i = t.i JOIN pd b ON b.section = t.section AND b.i = t.j JOIN pd c ON c.section = t.section AND c.i = t.k),
uv AS (SELECT px.*, i, j, k, ox, oy, o2x, o2y, o3x, o3y, ((px - ax) * (cy - ay) - (cx - ax) * (py - ay)) / nullif((bx - ax) * (cy - ay) - (cx - ax) * (by_ - ay), 0) AS u,
  ((bx - ax) * (py - ay) - (px - ax) * (by_ - ay)) / nullif((bx - ax) * (cy - ay) - (cx - ax) * (by_ - ay), 0) AS v FROM px JOIN full_ USING (section)),
hit AS (SELECT *, row_number() OVER (PARTITION BY section, px, py ORDER BY i, j, k) AS nth FROM uv WHERE u >= -1e-9 AND v >= -1e-9 AND u + v <= 1 + 1e-9)
SELECT section, px, py, round(ox + (o2x - ox) * u + (o3x - ox) * v, 6) AS nx, round(oy + (o2y - oy) * u + (o3y - oy) * v, 6) AS ny FROM hit WHERE nth = 1"""

SQL = {
    "filter_total_counts": f"{_M} SELECT * FROM m WHERE barcode IN (SELECT barcode FROM m GROUP BY 1 HAVING sum(value) >= 600)",
    "zero_low_counts": f"{_M} SELECT * FROM m WHERE NOT (value = floor(value) AND value BETWEEN 1 AND 19)",
    "filter_min_samples": f"{_M} SELECT * FROM m WHERE barcode IN (SELECT barcode FROM m WHERE value <> 0 GROUP BY 1 HAVING count(*) > 5)",
    "highest_second": f"{_TOP} SELECT * FROM hs",
    "filter_soma": f"{_TOP} SELECT * FROM m WHERE barcode IN (SELECT barcode FROM hs WHERE second >= 10 AND log10(highest / second) > log10(5.0))",
    "argmax_sample": f"{_TOP} SELECT * FROM am",
    "filter_source_region": f"{_TOP} SELECT * FROM m WHERE barcode IN (SELECT barcode FROM am WHERE sample IN (1, 2, 3))",
    "drop_source_samples": f"{_M} SELECT * FROM m WHERE sample NOT IN (1, 2, 3) AND value <> 0",
    "select_cortical": f"{_M} SELECT * FROM m WHERE sample BETWEEN 1 AND 8",
    "spike_factor": f"{_SP} SELECT sample, total, round(factor, 9) AS factor FROM fac",
    "spike_normalise": f"{_SP} SELECT barcode, sample, round(value / factor, 9) AS value FROM m JOIN fac USING (sample) WHERE barcode % 20 <> 0",
    "negative_control": f"{_M} SELECT value, count(*) AS n FROM m WHERE sample = 12 AND value > 0 GROUP BY 1",
    **{f"homog_across_area{kind}_conditions": f"{_M} SELECT DISTINCT barcode, true AS optimal FROM m WHERE sample <= 8" for kind in ("", "_binary")},
    "rank_abundance": f"{_M} SELECT barcode, sum(value) AS total, row_number() OVER (ORDER BY sum(value) DESC, barcode) AS rank FROM m GROUP BY 1",
    "rename_tubes": f"{_M} SELECT barcode, sample, sum(value) AS value FROM (SELECT barcode, CAST(CASE tube WHEN 2 THEN 1 WHEN 6 THEN 5 ELSE tube END AS INTEGER) AS sample, value FROM m JOIN (SELECT n_nationkey AS s, (n_nationkey * 7) % 11 AS tube FROM nation WHERE n_nationkey BETWEEN 1 AND 11) ON s = sample WHERE tube <> 0) WHERE sample <> 9 GROUP BY 1, 2",
    "adjacent_samples": f"WITH {_V}, {_ADJ} SELECT * FROM adj",
    "zero_adjacent_to_soma": f"{_TOP}, {_V}, {_ADJ} SELECT m.* FROM m ANTI JOIN (SELECT am.barcode, neighbour AS sample FROM am JOIN adj ON label = sample) z USING (barcode, sample)",
    "prefix_barcodes": f"{_M} SELECT 'mouse' || (barcode % 3) || '_' || barcode AS barcode, sample, value FROM m",
    "barcode_max": f"{_M} SELECT barcode % 3 AS mouse, barcode, max(value) AS max FROM m GROUP BY 1, 2",
    "scale_by_second_unique": f"{_M}, d AS (SELECT barcode, list_reverse_sort(list_distinct(list_append(list(value), 0.0)))[2] AS s FROM m GROUP BY 1) SELECT barcode, sample, round(value / nullif(s, 0), 9) AS value FROM m JOIN d USING (barcode)",
    "binarise": f"{_M} SELECT barcode, sample, CAST(value <> 0 AS INTEGER) AS value FROM m",
    "column_shuffle": f"{_M}, g AS (SELECT barcode, CAST(s AS INTEGER) AS sample, coalesce(value, 0) AS value FROM (SELECT DISTINCT barcode FROM m) b CROSS JOIN range(1, 13) AS t(s) LEFT JOIN m USING (barcode) WHERE m.sample = s OR m.sample IS NULL), f AS (SELECT b.barcode, CAST(s AS INTEGER) AS sample, coalesce(m.value, 0) AS value FROM (SELECT DISTINCT barcode FROM m) b CROSS JOIN range(1, 13) AS t(s) LEFT JOIN m ON m.barcode = b.barcode AND m.sample = s), r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY barcode) AS i, row_number() OVER (PARTITION BY sample ORDER BY md5('7|0|' || sample || '|' || barcode), barcode) AS j FROM f) SELECT a.barcode, a.sample, b.value FROM r a JOIN r b ON a.sample = b.sample AND a.i = b.j WHERE b.value <> 0",
    "rollup_acronym": f"WITH {_ROLL} SELECT * FROM areas",
    "roi_region_table": f"WITH {_REG} SELECT * FROM reg",
    "roi_areas": f"WITH {_RA} SELECT roi, area, n, round(fraction, 9) AS fraction FROM ra",
    "roi_main_region": f"WITH {_RA} SELECT roi, string_agg(area, ',' ORDER BY fraction DESC, area) AS regions, first(area ORDER BY fraction DESC, area) AS main, round(max(fraction), 9) AS main_fraction, CAST(sum(n) AS BIGINT) AS vol_in_atlas FROM ra GROUP BY roi",
    "area_volumes": f"WITH {_AVT} SELECT roi, area, round(vol, 3) AS vol FROM av",
    "area_volumes_as_main": f"WITH {_AVM} SELECT roi, area, round(vol, 3) AS vol FROM av",
    "rois_with_area": f"WITH {_RA} SELECT DISTINCT roi FROM ra WHERE area = 'ASIA'",
    "hemisphere_filter": f"WITH {_V}, c AS (SELECT label, count(*) FILTER (z < 8) AS l, count(*) FILTER (z >= 8) AS r FROM vox GROUP BY 1) SELECT vox.* FROM vox JOIN c USING (label) WHERE (z < 8 AND l > r) OR (z >= 8 AND r > l)",
    "fill_label_holes": f"WITH {_V}, o AS (SELECT a, b, c FROM range(2) AS p(a), range(2) AS q(b), range(2) AS r(c)), g AS (SELECT DISTINCT label, x + a AS x, y + b AS y, z + c AS z FROM vox, o), e AS (SELECT label, x - a AS x, y - b AS y, z - c AS z FROM g, o GROUP BY ALL HAVING count(*) = 8) SELECT x, y, z, label FROM vox UNION ALL SELECT CAST(x AS INTEGER), CAST(y AS INTEGER), CAST(z AS INTEGER), min(label) FROM e WHERE NOT EXISTS (SELECT 1 FROM vox v WHERE v.x = e.x AND v.y = e.y AND v.z = e.z) GROUP BY 1, 2, 3",
    "area_centroid_distance": f"WITH {_V}, u AS (SELECT unnest(structure_id_path) AS structure_id, x, y, z FROM ann JOIN st ON id = structure_id), c AS (SELECT structure_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM u GROUP BY 1) SELECT c.structure_id, round(sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2) + pow(c.z - s.z, 2)) * 25, 6) AS distance_um FROM c, (SELECT * FROM c WHERE structure_id = 2003) s",
    "common_areas": f"{_proj(_AVT)} SELECT area FROM (SELECT DISTINCT barcode % 3 AS mouse, area FROM pr) GROUP BY area HAVING count(*) = 3",
    "density_by_sample": f"WITH {_V}, d AS (SELECT l_linenumber % 3 + 100 AS experiment_id, 1 + l_partkey % 12 AS x, 1 + l_suppkey % 10 AS y, 1 + l_orderkey % 16 AS z, l_quantity AS value FROM lineitem), t AS (SELECT label, CAST(experiment_id AS BIGINT) AS experiment_id, sum(value) / (experiment_id - 98) AS density FROM vox JOIN d USING (x, y, z) GROUP BY label, experiment_id) SELECT label, experiment_id, round(density, 6) AS density FROM t UNION ALL SELECT label, -1, round(sum(density) / 3, 6) FROM t GROUP BY label",
    "classify_projection_type": f"{_proj(_AVT)} SELECT barcode, CASE WHEN s > 0 THEN 'CT_PT' ELSE 'IT' END AS kind FROM kinds",
    "rename_areas": f"WITH {_ROLL} SELECT id, CASE area WHEN 'ASIA' THEN 'AS' WHEN 'root' THEN 'R' ELSE area END AS area FROM areas",
    "homog_across_cubelet": f"{_proj(_AVT, 'IT')} SELECT barcode, area, round(strength, 9) AS strength FROM pr",
    "homog_across_cubelet_minmax": f"{_proj(_AVT, 'CT_PT', True, 'minmax')} SELECT barcode, area, round(strength, 9) AS strength FROM pr",
    "area_is_main": f"{_proj(_AVM, '', False, 'minmax')} SELECT barcode, area, round(strength, 9) AS strength FROM pr",
    "co_projection": f"{_CO} SELECT * FROM c WHERE area_a < area_b",
    "neurons_per_area": f"{_CO} SELECT area_a AS area, n FROM c WHERE area_a = area_b",
    "conditional_probability": f"{_proj(_AVT)}, c AS (SELECT a.barcode % 3 AS mouse, a.area AS area_a, b.area AS area_b, count(*) AS n FROM pr a JOIN pr b USING (barcode) GROUP BY 1, 2, 3) SELECT c.mouse, c.area_a, c.area_b, round(c.n / o.n, 9) AS p FROM c JOIN c o ON o.mouse = c.mouse AND o.area_a = c.area_a AND o.area_b = c.area_a",
    "cosine_similarity": f"{_CO}, ar AS (SELECT DISTINCT area_a AS a FROM pb), pa AS (SELECT x.a AS a, y.a AS b FROM ar x, ar y WHERE x.a < y.a), v AS (SELECT pa.a, pa.b, k.a AS k, coalesce(p.p, 0) AS p, coalesce(q.p, 0) AS q FROM pa JOIN ar k ON k.a <> pa.a AND k.a <> pa.b LEFT JOIN pb p ON p.area_a = pa.a AND p.area_b = k.a LEFT JOIN pb q ON q.area_a = pa.b AND q.area_b = k.a) SELECT pa.a AS area_a, pa.b AS area_b, round(coalesce(s.c, 0), 8) AS cosine FROM pa LEFT JOIN (SELECT a, b, sum(p * q) / nullif(sqrt(sum(p * p)) * sqrt(sum(q * q)), 0) AS c FROM v GROUP BY 1, 2) s USING (a, b)",
    "projection_summary": f"{_proj(_AVT)}, t AS (SELECT barcode % 3 AS mouse, count(DISTINCT barcode) AS n_all FROM m GROUP BY 1) SELECT mouse, area, round(count(*) FILTER (strength > 0) / any_value(n_all), 9) AS frequency, round(avg(strength) FILTER (strength > 0), 8) AS mean_strength FROM (SELECT barcode % 3 AS mouse, area, strength FROM pr) JOIN t USING (mouse) GROUP BY 1, 2",
    "delaunay_triangles": f"WITH {_SEC} SELECT * FROM tri",
    "warp_section_pixels": f"WITH {_WARP} SELECT section, px, py, round(xa, 4) AS xa, round(ya, 4) AS ya, round(za, 4) AS za FROM warp",
    "has_next_section": f"WITH {_SEC} SELECT section, EXISTS (SELECT 1 FROM sec s WHERE s.section = sec.section + 1) AS has_next FROM sec",
    "nearest_pixel": f"WITH {_WARP} SELECT section, px, py, round(distance, 4) AS distance FROM near",
    "section_thickness": f"WITH {_WARP}, t AS (SELECT section, avg(dx) AS um FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY distance, py, px) AS r, count(*) OVER (PARTITION BY section) AS n FROM near) WHERE r <= floor(n * 0.2) GROUP BY 1) SELECT section, round(coalesce(um, (SELECT median(um) FROM t)), 3) AS um FROM sec LEFT JOIN t USING (section)",
    "rasterise_rois": f"WITH {_WARP}, {_V}, ix AS (SELECT section, section % 9 AS tube, CAST(round_even(xa / 50 / 25.0, 0) AS INTEGER) AS x, CAST(round_even(abs(ya) / 25 / 25.0, 0) AS INTEGER) AS y, CAST(round_even(abs(za) / 25 / 25.0, 0) AS INTEGER) AS z FROM warp), ex AS (SELECT section, tube, CASE WHEN tube IN (2, 3) THEN 1 ELSE tube END AS label, CAST(x + k AS INTEGER) AS x, y, z FROM ix, range(3) AS r(k) WHERE k < section % 4), one AS (SELECT x, y, z, arg_max(label, {{'s': section, 't': tube}}) AS label FROM ex WHERE x BETWEEN 1 AND 11 AND y BETWEEN 1 AND 399 AND z BETWEEN 1 AND 399 GROUP BY 1, 2, 3) SELECT one.x, one.y, one.z, CAST(one.label AS INTEGER) AS label FROM one JOIN ann USING (x, y, z)",
    "select_visual_areas": f"{_proj(_AVT)} SELECT barcode, area, round(strength, 9) AS strength FROM pr WHERE contains(area, 'I') AND area <> 'INDIA' AND strength <> 0",
    "warp_forward": _FORWARD,
    "section_names": f"WITH {_SEC} SELECT section, lpad(CAST(section AS VARCHAR), CAST(greatest(3, length(CAST(section AS VARCHAR))) AS INTEGER), '0') AS label, section AS sample FROM sec",
    "section_voxels": f"WITH {_WARP} SELECT section, px, py, CAST(round_even(round(xa, 4) / 25, 0) AS INTEGER) AS x, CAST(round_even(round(ya, 4) / 25, 0) AS INTEGER) AS y, CAST(round_even(round(za, 4) / 25, 0) AS INTEGER) AS z FROM warp",
    "list_literals": "SELECT n_nationkey, unnest(list_value(n_name, 'all')) AS name FROM nation",
    "curveball_shuffle": f"{_shuffled(_TOP, 4)} SELECT mouse, replicate, barcode, sample FROM shuf",
    "null_statistics": _null_sql("'all'"),
    "null_statistics_by_mouse": _null_sql("CAST(mouse AS VARCHAR)"),
    "curveball_margins": f"{_TOP}, b AS (SELECT barcode % 3 AS mouse, barcode, sample FROM m WHERE barcode IN (SELECT barcode FROM hs WHERE second >= 10 AND log10(highest / second) > log10(5.0)) AND sample <= 8 AND value <> 0), x AS (SELECT mouse, 'barcode' AS side, CAST(barcode AS BIGINT) AS key FROM b UNION ALL SELECT mouse, 'sample', CAST(sample AS BIGINT) FROM b) SELECT mouse, replicate, side, key, count(*) AS n FROM x, range(4) AS r(replicate) GROUP BY 1, 2, 3, 4",
}
SQL["distance_decay"] = f"SELECT structure_id, round(2.0 * exp(-0.01 * d), 9) AS decay FROM ({SQL['area_centroid_distance'].replace(', 6) AS distance_um', ', 12) AS d')})"
SQL["pair_labels"] = f"SELECT area_a || ', ' || area_b AS pair, cosine FROM ({SQL['cosine_similarity']})"
NO_SQL = ["homog_across_area", "homog_across_area_binary"]
QUERIES = {name: globals()[f"q_{name}"] for name in [*SQL, *NO_SQL]}
