"""Hand cases, properties and equivalences of the sequencing, atlas and null operators."""

import collections
import concurrent.futures
import gzip
import itertools
import json
import struct
import subprocess
import sys
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cortexloom.functions import sequences
from cortexloom.operators import areas, atlas, blocks, cluster, components, delaunay, fit, matrix, molecules, null, ranks, reads, sections, stats
from cortexloom.operators.params import MoleculeParams, ReadParams
from cortexloom.plans import brain, sequencing
from cortexloom.sources import fastq, fixtures, sinks
from cortexloom.streaming import ingest


def clusters(spark, counts, length):
    df = spark.createDataFrame([("s", q, n) for q, n in counts.items()], "sample string, seq string, n bigint")
    return {r["seq"]: r["head"] for r in cluster.directional_clusters(df, ["sample"], length).collect()}


@pytest.mark.parametrize(
    ("counts", "heads"),
    [
        ({"AAA": 9, "AAT": 5, "ATT": 3}, {"AAA": "AAA", "AAT": "AAA", "ATT": "AAA"}),
        ({"AAA": 8, "AAT": 5}, {"AAA": "AAA", "AAT": "AAT"}),
        ({"AAA": 1, "AAT": 1}, {"AAA": "AAA", "AAT": "AAA"}),
    ],
)
def test_directional_hand_cases(spark, counts, heads):
    assert clusters(spark, counts, 3) == heads


def test_directional_clusters_equal_greedy(spark):
    rng = np.random.default_rng(3)
    want, rows = {}, []
    for g in range(25):
        seqs = {"".join(rng.choice(list("ACGT"), 4)) for _ in range(20)}
        counts = {s: int(rng.choice([1, 1, 1, 2, 3, 5, 9, 20])) for s in sorted(seqs)}
        order = sorted(counts, key=lambda s: (-counts[s], s))
        edge = lambda a, b: sum(x != y for x, y in zip(a, b)) == 1 and counts[a] >= 2 * counts[b] - 1
        head = {}
        for s in order:  # take everything reachable that is not yet taken
            if s not in head:
                head[s], todo = s, [s]
                while todo:
                    a = todo.pop()
                    for b in order:
                        if b not in head and edge(a, b):
                            head[b] = s
                            todo.append(b)
        want |= {(g, s): h for s, h in head.items()}
        rows += [(g, s, n) for s, n in counts.items()]
    df = spark.createDataFrame(rows, "sample int, seq string, n bigint")
    got = {(r["sample"], r["seq"]): r["head"] for r in cluster.directional_clusters(df, ["sample"], 4).collect()}
    assert got == want
    heads = {h for h in got.values()}
    assert all(got[(g, h)] == h for (g, _), h in got.items()) and heads


def test_components_on_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(7, 7), (None, 3), (5, 1), (5, 1)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[k] == 1 for k in range(1, 40)) and len(got) == 61 + 39
    assert components.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_best_tag_ties_and_limits(spark):
    tags = [("a", "AAAA"), ("b", "AATT"), ("c", "TTTT")]
    df = spark.createDataFrame([("AAAT",), ("TTTT",), ("GGGG",), ("AAAN",), ("AAA",)], "tag string")
    got = {r["tag"]: r["s"] for r in df.select("tag", reads.best_tag(F.col("tag"), tags, 2).alias("s")).collect()}
    assert got == {"AAAT": "a", "TTTT": "c", "GGGG": None, "AAAN": "a", "AAA": None}


def test_template_switch_at_the_threshold(spark):
    rows = [(1, "N1", "U")] * 80 + [(2, "N2", "U")] * 10 + [(1, "N1", "V")] * 81 + [(2, "N2", "V")] * 10 + [(2, "N1", "W")] * 3
    df = spark.createDataFrame(rows, "sample int, corrected_neuron string, corrected_umi string")
    kept = molecules.resolve_template_switch(df, molecules.umi_switch_summary(df), 8.0)
    assert {(r["sample"], r["corrected_neuron"], r["corrected_umi"]): r["count"] for r in kept.groupBy("sample", "corrected_neuron", "corrected_umi").count().collect()} == {(1, "N1", "V"): 81, (2, "N1", "W"): 3}


def test_classify_may_overlap(spark):
    df = spark.createDataFrame([("A" * 24 + "ATCAGTCA",), ("A" * 30 + "CT",), ("A" * 32,)], "neuron string")
    p = MoleculeParams()
    assert sorted(r["kind"] for r in reads.classify(df, p.spike_pattern, p.neuron_pattern).collect()) == ["neuron", "spike"]
    assert reads.classify(df, "^A", "^A").count() == 6


def test_crop_none_keeps_the_mate(spark):
    df = spark.createDataFrame([("A" * 37 + "GCGGC" + "TT", "C" * 40)], "r1 string, r2 string")
    p = ReadParams(r1_crop=None, r2_crop=(0, 10))
    assert reads.crop_concat(reads.filter_consensus(df, p), p).first()["full_read"] == "A" * 37 + "GCGGCTT" + "C" * 10


def test_paired_fastq(spark, tmp_path):
    def put(name, seqs):
        with gzip.open(tmp_path / name, "wt") as f:
            for i, s in enumerate(seqs):
                f.write(f"@r{i}\n{s}\n+\n@{'I' * (len(s) - 1)}\n")  # a quality line may begin with @

    put("run1_R1_001.fastq.gz", [f"A{i}" for i in range(50)])
    put("run1_R2_001.fastq.gz", [f"C{i}" for i in range(48)])
    put("run2_R1_001.fastq.gz", ["G"])
    got = fastq.read_paired_fastq(spark, str(tmp_path), "run1")
    assert sorted((r["read_no"], r["r1"], r["r2"]) for r in got.collect()) == [(i, f"A{i}", f"C{i}") for i in range(48)]
    with pytest.raises(ValueError, match="R2"):
        fastq.read_paired_fastq(spark, str(tmp_path), ["run1", "run2"])


def test_other_sources(spark, tmp_path):
    (tmp_path / "tags.txt").write_text("BC1\tAAAA\nBC2\tCCCC\n")
    assert fastq.read_tags(spark, str(tmp_path / "tags.txt")) == [("BC1", "AAAA"), ("BC2", "CCCC")]
    (tmp_path / "rois.csv").write_text("roi,volume_um3,regions,breakdown\n1,10.0,\"['A', 'B']\",\"[0.75, 0.25]\"\n")
    assert sorted(tuple(r) for r in fastq.read_roi_regions(spark, str(tmp_path / "rois.csv")).collect()) == [(1, 10.0, "A", 0.75), (1, 10.0, "B", 0.25)]
    (tmp_path / "s.json").write_text(json.dumps({"slices": [{"filename": "b_s012.jpg", "anchoring": list(range(9)), "markers": [[1, 2, 3, 4]], "height": 5, "width": 6}]}))
    r = fastq.read_sections(spark, str(tmp_path / "s.json")).first()
    assert (r["name"], r["section"], r["anchoring"][8], r["markers"], r["height"]) == ("b_s012", 12, 8.0, [[1.0, 2.0, 3.0, 4.0]], 5)
    for n in (3, 11):
        (tmp_path / f"template_switching_chunk_{n}.csv").write_text("umi,total\nAC,5\n")
    assert sorted(r["chunk"] for r in fastq.read_switch_chunks(spark, str(tmp_path)).collect()) == [3, 11]


def grey_tiff(rows):
    """An uncompressed 8-bit TIFF."""
    h, w = len(rows), len(rows[0])
    tags = [(256, 4, w), (257, 4, h), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, h * w)]
    data = b"".join(bytes(r) for r in rows) + b"\0" * (h * w % 2)
    entries = b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<I", v) if k == 4 else struct.pack("<HH", v, 0)) for t, k, v in tags)
    return struct.pack("<2sHI", b"II", 42, 8 + len(data)) + data + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)


def grey_png(rows):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + chunk(b"IEND", b"")


def test_masks_as_tiff_and_png(spark, tmp_path):
    rows = [[0, 255, 0], [7, 0, 0]]
    (tmp_path / "s012_TUBE5.tif").write_bytes(grey_tiff(rows))
    (tmp_path / "s003_TUBE41.png").write_bytes(grey_png(rows))
    got = sorted(map(tuple, fastq.read_mask_pixels(spark, str(tmp_path)).select("section", "tube", "px", "py").collect()))
    assert got == [(3, 41, 0, 1), (3, 41, 1, 0), (12, 5, 0, 1), (12, 5, 1, 0)]


def test_voxels_and_tubes(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3, 0), (1, 2, 4, 9)], "x int, y int, z int, label int").write.parquet(str(tmp_path / "v"))
    assert [tuple(r) for r in fastq.read_voxels(spark, str(tmp_path / "v")).collect()] == [(1, 2, 4, 9)]
    (tmp_path / "tubes.csv").write_text("sample,tube\n1,7\n2,0\n")
    assert sorted(map(tuple, fastq.read_tube_map(spark, str(tmp_path / "tubes.csv")).collect())) == [(1, 7), (2, 0)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "sample int, corrected_neuron string")
    at = str(tmp_path / "corrected")
    sinks.write_corrected(rows, at)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_corrected(rows, at)
    sinks.write_corrected(rows.where("sample = 2").withColumn("corrected_neuron", F.lit("c")), at, overwrite=True)
    assert sorted((r["sample"], r["corrected_neuron"]) for r in fastq.read_corrected(spark, at).collect()) == [(1, "a"), (2, "c")]
    stat = spark.createDataFrame([("x", 1.0)], "stat string, value double")
    for run in (1, 2, 2):
        sinks.write_null_stats(stat, str(tmp_path / "null"), run)
    assert spark.read.parquet(str(tmp_path / "null")).count() == 2
    assert sinks.write_reused(stat, str(tmp_path / "r")).count() == sinks.write_reused(stat.limit(0), str(tmp_path / "r"), overwrite=False).count() == 1
    assert sinks.combine_mice({"m1": stat, "m2": stat}).select("mouse").distinct().count() == 2


def test_rank_abundance_is_global(spark):
    rows = [(i, 1, float(v)) for i, v in enumerate([5, 5, 900, 0.5, 70, 70.5, 1e6])]
    got = [r["barcode"] for r in matrix.rank_abundance(spark.createDataFrame(rows, "barcode int, sample int, value double")).orderBy("rank").collect()]
    assert got == [6, 2, 5, 4, 0, 1, 3]


def test_ranks_in_bounded_splits(spark):
    """One total has nearly all barcodes, and one sample all cells: no split holds much more than it should."""
    rows = [(i, 1, 7.0 if i % 50 else float(i)) for i in range(20000)]
    bc = spark.createDataFrame(rows, "barcode int, sample int, value double")
    got = [r["barcode"] for r in matrix.rank_abundance(bc, split_rows=1000).orderBy("rank").collect()]
    assert got == [b for b, _, _ in sorted(rows, key=lambda r: (-r[2], r[0]))]
    counted = ranks.ranked(bc, ["sample"], ["barcode"], split_rows=1000)
    assert [tuple(r) for r in counted.select("barcode", "rank").orderBy("rank").collect()] == [(i, i + 1) for i in range(20000)]
    splits = spark.read.parquet(counted.inputFiles()[0].rsplit("/", 1)[0]).groupBy("_split").count()
    assert splits.count() == 20 and splits.agg(F.max("count")).first()[0] < 2000
    groups = spark.createDataFrame([(k, i) for k in ("a", "b", None) for i in range(30)], "k string, v int")
    assert all(r["rank"] == r["v"] + 1 for r in ranks.ranked(groups, ["k"], ["v"], split_rows=7).collect())
    assert ranks.ranked(groups.limit(0), ["k"], ["v"]).count() == 0
    one, all_ = matrix.column_shuffle(bc, [1, 2], 3, split_rows=1000), matrix.column_shuffle(bc, [1, 2], 3)
    assert sorted(one.collect()) == sorted(all_.collect()) and one.count() == 19999


def test_two_best_neurons_of_a_common_umi(spark):
    rng = np.random.default_rng(8)
    reads_ = [(int(s), f"N{n:04d}", u) for u in ("U", "V") for n in range(300) for s in rng.integers(1, 4, int(rng.integers(1, 6)))] + [(2, "N9999", "W")]
    df = spark.createDataFrame(reads_, "sample int, corrected_neuron string, corrected_umi string")
    for salts in (1, 16, 1024):
        for r in molecules.umi_switch_summary(df, salts).collect():
            mine = [x for x in reads_ if x[2] == r["umi"]]
            by = sorted(collections.Counter(x[1] for x in mine).items(), key=lambda kv: (-kv[1], kv[0]))
            at = sorted(collections.Counter(x[0] for x in mine if x[1] == by[0][0]).items(), key=lambda kv: (-kv[1], kv[0]))
            want = (len(mine), len(by), by[0][1], by[1][1] if len(by) > 1 else 0, by[0][0] + r["umi"], at[0][0])
            assert tuple(r[c] for c in ("total", "different_neurons", "first_abundant", "second_abundant", "sequence_of_1st", "sample_of_1st")) == want
    assert "Window" not in molecules.umi_switch_summary(df)._jdf.queryExecution().toString()


def test_collated_tables_get_names_of_their_own(spark, tmp_path):
    stat = spark.createDataFrame([("x", 1.0)], "stat string, value double")

    def run(k):
        stat.withColumn("job", F.lit(k)).write.parquet(str(tmp_path / f"parts{k}" / "cosine_1"))
        stat.withColumn("job", F.lit(k)).write.parquet(str(tmp_path / f"parts{k}" / "cosine_2"))
        return sinks.collate_null_stats(spark, str(tmp_path / f"parts{k}"), str(tmp_path / "all"), "cosine", overwrite=False)

    with concurrent.futures.ThreadPoolExecutor(4) as pool:
        paths = list(pool.map(run, range(4)))
    assert sorted(p.rsplit("/", 1)[1] for p in paths) == ["cosine_collated", "cosine_collated_2", "cosine_collated_3", "cosine_collated_4"]
    for k, p in enumerate(paths):
        assert [r["job"] for r in spark.read.parquet(p).collect()] == [k, k] and not list((tmp_path / f"parts{k}").glob("cosine*"))
    stat.write.parquet(str(tmp_path / "again" / "cosine_9"))
    assert sinks.collate_null_stats(spark, str(tmp_path / "again"), str(tmp_path / "all"), "cosine").endswith("/cosine_collated")
    assert spark.read.parquet(str(tmp_path / "all" / "cosine_collated")).count() == 1
    assert sinks.collate_null_stats(spark, str(tmp_path / "again"), str(tmp_path / "all"), "cosine") is None


def test_dense_matrices(spark, tmp_path):
    bc = spark.createDataFrame([("a", 1, 5.0), ("a", 3, 2.0), ("b", 1, 4.0), ("b", 4, 0.0)], "barcode string, sample int, value double")
    sinks.write_dense_matrices(bc, [1], str(tmp_path / "m"))
    full, left = spark.read.parquet(str(tmp_path / "m" / "with_source")), spark.read.parquet(str(tmp_path / "m" / "without_source"))
    assert full.columns == ["barcode", "s1", "s3"] and sorted(map(tuple, full.collect())) == [("a", 5.0, 2.0), ("b", 4.0, 0.0)]
    assert left.columns == ["barcode", "s3"] and sorted(map(tuple, left.collect())) == [("a", 2.0), ("b", 0.0)]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_dense_matrices(bc, [1], str(tmp_path / "m"))


def test_scratch_is_gone_after_the_session(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from cortexloom.plans.scratch import Scratch
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
x = Scratch(s, "job")
assert x.save(s.range(5)).count() == 5
print("SEEN", len(list(__import__("pathlib").Path("{tmp_path}").glob("job-*/*"))))
s.stop()
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "SEEN 1" in done.stdout, done.stderr[-2000:]
    for _ in range(50):  # the JVM ends a little later
        if not list(tmp_path.glob("job-*")):
            break
        time.sleep(0.2)
    assert not list(tmp_path.glob("job-*"))


def test_matrix_edges(spark):
    m = spark.createDataFrame([("a", 1, 8.0), ("a", 2, 8.0), ("b", 1, 3.0), ("c", 1, 1.0), ("c", 2, 2.0)], "barcode string, sample int, value double")
    assert {r["barcode"]: (r["highest"], r["second"]) for r in matrix.highest_second(m).collect()} == {"a": (8.0, 8.0), "b": (3.0, 0.0), "c": (2.0, 1.0)}
    assert {r["barcode"]: r["sample"] for r in matrix.argmax_sample(m).collect()} == {"a": 1, "b": 1, "c": 2}
    assert matrix.filter_min_samples(m, 2).count() == 0
    assert sorted(r["value"] for r in matrix.zero_low_counts(m, 2).collect()) == [2.0, 3.0, 8.0, 8.0]
    assert {(r["barcode"], r["sample"]): r["value"] for r in matrix.scale_by_second_unique(m).collect()} == {("a", 1): None, ("a", 2): None, ("b", 1): None, ("c", 1): 1.0, ("c", 2): 2.0}
    assert {(r["barcode"], r["sample"]): r["value"] for r in matrix.scale_rows(m, 2).collect()} == {("a", 1): 0.0, ("a", 2): 0.0, ("b", 1): 1.0, ("c", 1): 1.0, ("c", 2): 2.0}
    assert matrix.failed_samples(m, [1, 2, 3]) == [3]


def test_column_shuffle_keeps_columns(spark):
    m = fixtures.matrix(spark, "/root/testdata/sf0.001")
    s = matrix.column_shuffle(m, list(range(1, 13)), 3)
    cells = lambda df: sorted((r["sample"], r["value"]) for r in df.collect())
    assert cells(s) == cells(m) and sorted(s.collect()) != sorted(m.select(s.columns).collect())


def test_rollup_cases(spark):
    rows = [(997, "root", [997]), (1, "HPF", [997, 1]), (2, "CA", [997, 1, 2]), (3, "CA1", [997, 1, 2, 3]), (4, "VIS", [997, 4]), (5, "VIS6a", [997, 4, 5]), (6, "MOB", [997, 6]), (7, "X", [997, 7])]
    df = spark.createDataFrame(rows, "id int, acronym string, structure_id_path array<int>")
    got = {r["id"]: r["area"] for r in atlas.rollup_acronym(df, ("HPF", "MOB")).collect()}
    assert got == {997: "root", 1: "HPF", 2: "HPF", 3: "HPF", 4: "VIS", 5: "VIS", 6: "OB", 7: "X"}


def test_area_threshold_keeps_equal_shares(spark):
    df = spark.createDataFrame([(1, "A", 0.9, 100.0), (1, "B", 0.1, 100.0), (2, "Contra-A", 0.5, 10.0), (2, "Contra-B", 0.5, 10.0), (3, "root", 1.0, 5.0)], "roi int, area string, fraction double, volume_um3 double")
    assert sorted((r["roi"], r["area"], r["vol"]) for r in atlas.area_volumes(df).collect()) == [(1, "A", 90.0), (1, "B", 10.0), (2, "Contra", 10.0)]
    assert sorted((r["roi"], r["area"]) for r in atlas.area_volumes(df, main_only=True).collect()) == [(1, "A"), (2, "Contra")]


def test_closing_contains_its_input(spark):
    block = list(itertools.product((0, 1), (0, 1), (0, 1))) + [(x + 3, y, z) for x, y, z in itertools.product((0, 1), (0, 1), (0, 1))]
    v = spark.createDataFrame([(x, y, z, 1) for x, y, z in block], "x int, y int, z int, label int")
    filled = {(r["x"], r["y"], r["z"]) for r in atlas.fill_label_holes(v).collect()}
    assert set(block) <= filled and {(2, y, z) for y in (0, 1) for z in (0, 1)} <= filled


def test_blocks_against_single_voxels(spark):
    """Neighbours and closings across the edges of cubes, negative positions included, against sets of voxels."""
    rng = np.random.default_rng(6)
    cells = {tuple(int(x) for x in rng.integers(-3, 7, 3)): int(rng.integers(1, 5)) for _ in range(700)}
    v = spark.createDataFrame([(*p, k) for p, k in cells.items()], "x int, y int, z int, label int")
    near = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    want = {(a, b) for p, a in cells.items() for d in near for s in (-1, 1) if (b := cells.get(tuple(i + s * j for i, j in zip(p, d)), a)) != a}
    cube = list(itertools.product((0, 1), repeat=3))
    filled = dict(cells)
    for k in range(1, 5):
        mine = {p for p, l in cells.items() if l == k}
        grown = {tuple(map(sum, zip(p, o))) for p in mine for o in cube}
        for p in grown | {tuple(i - 1 for i in p) for p in grown}:
            if p not in filled and all(tuple(map(sum, zip(p, o))) in grown for o in cube):
                filled[p] = k
    for side in (4, 32):
        rows = blocks.per_block(v, blocks.label_pairs, "label bigint, neighbour bigint", side).distinct().collect()
        assert {tuple(r) for r in rows} == want
        new = blocks.per_block(v, blocks.closed_holes, "x int, y int, z int, label bigint", side).collect()
        assert {tuple(r)[:3]: r["label"] for r in new} == {p: k for p, k in filled.items() if p not in cells} and len(new) == len(filled) - len(cells)
    assert {(r["x"], r["y"], r["z"]): r["label"] for r in atlas.fill_label_holes(v).collect()} == filled
    assert atlas.adjacent_labels(v.limit(0)).count() == atlas.fill_label_holes(v.limit(0)).count() == 0


def test_triangles_tile_the_rectangle(spark):
    rng = np.random.default_rng(9)
    corners = [(-1.0, -1.0), (6.0, -1.0), (-1.0, 6.0), (6.0, 6.0)]
    for kind in range(30):  # random points, and grids, where many lie on one circle or line, with repeats
        xy = np.array(corners + [tuple(p) for p in (rng.random((12, 2)) * 5 if kind % 2 else rng.integers(0, 5, (12, 2)).astype(float))])
        total = 0.0
        for i, j, k in delaunay.triangulate(xy):
            a, b, c = xy[i], xy[j], xy[k]
            det = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
            total += abs(det) / 2
            for p in xy:
                u, w, q = a - p, b - p, c - p
                circle = (u @ u) * (w[0] * q[1] - w[1] * q[0]) + (w @ w) * (q[0] * u[1] - q[1] * u[0]) + (q @ q) * (u[0] * w[1] - u[1] * w[0])
                assert circle * np.sign(det) < 1e-9
        assert abs(total - 49) < 1e-9
    assert len(delaunay.triangulate(np.vstack([corners, rng.random((2000, 2)) * 5]))) == 4002
    assert delaunay.triangulate(np.zeros((4, 2))) == delaunay.triangulate(np.array([[0.0, 0], [1, 1], [3, 3]])) == []
    df = spark.createDataFrame([(s, i, x, y) for s in (1, 2) for i, (x, y) in enumerate([*corners, (2.0, 2.0), (None, 1.0)])], "section int, i int, sx double, sy double")
    assert sorted(map(tuple, sections.delaunay_triangles(df).collect())) == [(s, *t) for s in (1, 2) for t in ((0, 1, 4), (0, 2, 4), (1, 3, 4), (2, 3, 4))]


def test_trades_keep_margins():
    rng = np.random.default_rng(0)
    for shape in ((40, 7), (301, 30), (1, 5), (2, 3)):
        m = rng.random(shape) < 0.3
        code = rng.integers(0, null.PRIME, shape[0])
        now = m
        for step in range(10):
            now = null.traded(now, code, null.step_key(5, "a", 0, step), shape[0])
        assert (now.sum(0) == m.sum(0)).all() and (now.sum(1) == m.sum(1)).all()
        assert shape[0] < 3 or (now != m).any()


def sequential_curveball(m, rng, trades):
    """The plain chain: two random lists of the shorter side keep what they share and deal the rest anew."""
    flip = m.shape[0] > m.shape[1]
    rows = [set(np.flatnonzero(r)) for r in (m.T if flip else m)]
    for _ in range(trades * len(rows)):
        i, j = rng.choice(len(rows), 2, replace=False)
        shared, loose = rows[i] & rows[j], rng.permutation(sorted(rows[i] ^ rows[j])).tolist()
        n = len(rows[i]) - len(shared)
        rows[i], rows[j] = shared | set(loose[:n]), shared | set(loose[n:])
    out = np.zeros((m.T if flip else m).shape, bool)
    for i, r in enumerate(rows):
        out[i, list(r)] = True
    return out.T if flip else out


def test_populations_are_distributed_as_the_sequential_chains():
    rng = np.random.default_rng(11)
    m = np.zeros((60, 6), bool)
    m[:30, :3] = rng.random((30, 3)) < 0.7  # two blocks, which a shuffle must mix
    m[30:, 3:] = rng.random((30, 3)) < 0.5
    code, n, ours, plain = rng.integers(0, null.PRIME, 60), 1500, [], []
    for r in range(n):
        now = m
        for step in range(null.STEPS):
            now = null.traded(now, code, null.step_key(1, 0, r, step), 60)
        ours.append(now.T.astype(int) @ now)
        other = sequential_curveball(m, rng, 5)
        plain.append(other.T.astype(int) @ other)
    ours, plain = np.array(ours, float), np.array(plain, float)
    off = ~np.eye(6, dtype=bool)
    error = np.sqrt(ours.var(0) / n + plain.var(0) / n)
    assert (np.abs(ours.mean(0) - plain.mean(0))[off] < 4.5 * error[off]).all()
    ratio = ours.var(0)[off] / plain.var(0)[off]
    assert (0.8 < ratio).all() and (ratio < 1.25).all()


def test_fits_meet_their_conditions():
    rng = np.random.default_rng(1)
    for n, k, scale in ((8, 4, 50.0), (8, 25, 2e7), (40, 12, 1e5), (5, 1, 1.0)):
        a = rng.random((n, k)) * (rng.random((n, k)) < 0.5) * scale
        if k > 3:
            a[:, 1] = a[:, 0]  # equal areas
        y = rng.random((30, n)) * (rng.random((30, n)) < 0.4)
        y[0] = 0
        y /= np.maximum(y.sum(axis=1, keepdims=True), 1e-300)
        w = fit.nonnegative_lasso(y, a, 0.01)
        grad = ((w @ a.T - y) @ a / n + 0.01) / 0.01
        assert (w >= 0).all() and (np.abs(grad[w > 0]) < 1e-5).all() and (grad[w == 0] > -1e-5).all()
        present = y > 0
        w = fit.l1_logistic(present, a, 1.0)
        with np.errstate(over="ignore"):
            grad = (1 / (1 + np.exp(-w @ a.T)) - present) @ a
        assert (np.abs(grad + np.sign(w))[w != 0] < 1e-4).all() and (np.abs(grad[w == 0]) < 1 + 1e-4).all()


def test_logistic_fit_has_no_intercept(spark):
    """All samples present: with an intercept no area would be needed; without one the only area gets a positive coefficient that solves n a p(-w a) = 1."""
    bc = spark.createDataFrame([("b", s, 3.0) for s in (1, 2, 3)], "barcode string, sample int, value double")
    vol = spark.createDataFrame([(s, "A", 10.0) for s in (1, 2, 3)], "roi int, area string, vol double")
    (r,) = areas.homog_across_area(bc, vol, binary=True, signed=True).collect()
    assert abs(r["coefficient"] - np.log(29) / 10) < 1e-9
    assert [tuple(x) for x in areas.homog_across_area(bc, vol.unionAll(spark.createDataFrame([(1, "B", 0.0)], vol.schema)), binary=True).collect()] == [("b", "A", 1.0)]


def test_open_fits_are_an_error():
    with pytest.raises(ArithmeticError, match="open"):
        fit.nonnegative(np.ones((3, 2)), np.array([[0.0, 1.0, 1.0]]), 1e-3, fit.Logistic, steps=1)


def test_conditions_tell_wrong_coefficients(spark):
    bc = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 1.0), ("b", 2, 2.0)], "barcode string, sample int, value double")
    vol = spark.createDataFrame([(1, "A", 4.0), (2, "A", 1.0), (2, "B", 3.0)], "roi int, area string, vol double")
    w = areas.homog_across_area(bc, vol, alpha=0.05)
    assert {r["barcode"]: r["optimal"] for r in areas.fit_conditions(bc, vol, w, 0.05).collect()} == {"a": True, "b": True}
    wrong = w.withColumn("coefficient", F.col("coefficient") * F.when(F.col("barcode") == "a", 1.01).otherwise(1.0))
    assert {r["barcode"]: r["optimal"] for r in areas.fit_conditions(bc, vol, wrong, 0.05).collect()} == {"a": False, "b": True}
    assert not any(r["optimal"] for r in areas.fit_conditions(bc, vol, w.limit(0), 0.05).collect())


def test_statistics_bounds(spark):
    p = spark.createDataFrame([(b, a, 1) for b in range(12) for a in "ABC" if (b + ord(a)) % (ord(a) - 63)], "barcode int, area string, strength int")
    c = stats.co_occurrence(p)
    probs = stats.conditional_probability(c)
    assert all(r["p"] == 1 for r in probs.where("area_a = area_b").collect())
    assert all(0 <= r["cosine"] <= 1 + 1e-12 for r in stats.cosine_similarity(probs).collect())
    alone = spark.createDataFrame([("A", "A", 1.0), ("B", "B", 1.0)], "area_a string, area_b string, p double")
    assert stats.cosine_similarity(alone).first()["cosine"] == 0


def test_null_counts_equal_statistics_of_the_shuffles(spark):
    sf = "/root/testdata/sf0.001"
    bc, links = brain._brains(spark, sf), brain._area_samples(spark, sf)
    shuffled = null.curveball_shuffle(bc, 2)
    p = shuffled.join(links, ["mouse", "sample"]).select("mouse", "replicate", "barcode", "area").distinct().withColumn("strength", F.lit(1))
    direct = {tuple(r) for r in stats.co_occurrence(p, ["mouse", "replicate"]).select("mouse", "replicate", "area_a", "area_b", "n").collect()}
    for bucket in (10**9, 128):  # whole brains in a task, and brains dealt to buckets at every superstep
        got = null.shuffled_counts(bc, links, 2, bucket=bucket).select("mouse", "replicate", "area_a", "area_b", "n").collect()
        assert {tuple(r) for r in got} == direct
    assert sorted(null.curveball_shuffle(bc, 2, bucket=128).collect()) == sorted(shuffled.collect())


def test_large_brains_leave_no_block(spark):
    rng = np.random.default_rng(4)
    cells = [(m, f"b{m}_{i}", int(s), 1.0) for m in ("x", "y") for i in range(400) for s in rng.choice(8, int(rng.integers(1, 5)), replace=False)]
    bc = spark.createDataFrame(cells, "mouse string, barcode string, sample int, value double")
    links = spark.createDataFrame([(m, s, f"a{s % 3}", 1.0) for m in ("x", "y") for s in range(8)], "mouse string, sample int, area string, weight double")
    got = null.curveball_shuffle(bc, 2, bucket=128).collect()
    for r in range(2):
        mine = [x for x in got if x["replicate"] == r]
        assert len(mine) == len({(x["mouse"], x["barcode"], x["sample"]) for x in mine}) == len(cells)
        for key in (lambda x: (x["mouse"], x["barcode"]), lambda x: (x["mouse"], x["sample"])):
            want = collections.Counter(key(dict(zip(("mouse", "barcode", "sample"), c))) for c in cells)
            assert collections.Counter(map(key, mine)) == want
        assert {(x["mouse"], x["barcode"], x["sample"]) for x in mine} != {c[:3] for c in cells}
    n = {(x["mouse"], x["replicate"], x["area_a"]): x["n"] for x in null.shuffled_counts(bc, links, 2, bucket=128).where("area_a = area_b").collect()}
    direct = {k: len({x["barcode"] for x in got if (x["mouse"], x["replicate"], f"a{x['sample'] % 3}") == k}) for k in n}
    assert n == direct and len(n) == 12
    assert null.curveball_shuffle(bc, 0).count() == null.curveball_shuffle(bc.limit(0), 2).count() == 0


def test_ledger_goes_on_where_it_was_cut_off(spark, tmp_path, monkeypatch):
    sf = "/root/testdata/sf0.001"
    bc, links = brain._brains(spark, sf), brain._area_samples(spark, sf)
    common = links.select("area").distinct()
    run = lambda: null.generate_null(bc, links, common, replicates=7, ledger=str(tmp_path / "book"), range_size=3)
    real, made = null.shuffled_counts, []

    def dies(bc, links, span, *more, **named):
        made.append(span)
        if span == (3, 6) and made.count(span) == 1:  # the executors of the second range are lost while it is written
            fail = F.udf(lambda x: 1 // 0, "bigint")
            return real(bc, links, span, *more, **named).withColumn("n", fail("n"))
        return real(bc, links, span, *more, **named)

    monkeypatch.setattr(null, "shuffled_counts", dies)
    with pytest.raises(Exception, match="(?i)division"):
        run()
    first = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "book").rglob("part-*") if "000000000-" in str(f)}
    assert first and made == [(0, 3), (3, 6)]
    got = run()
    assert made == [(0, 3), (3, 6), (3, 6), (6, 7)]
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "book").rglob("part-*") if "000000000-" in str(f)} == first
    assert sorted(got.collect(), key=repr) == sorted(null.generate_null(bc, links, common, replicates=7).collect(), key=repr)
    run()
    assert len(made) == 5  # the run without a ledger above, and nothing again


def test_entropy_and_at(spark):
    df = spark.createDataFrame([("ACGT",), ("AAAA",), ("AATT",)], "s string")
    got = {r["s"]: (r["e"], r["a"]) for r in df.select("s", sequences.shannon_entropy(F.col("s")).alias("e"), sequences.at_content(F.col("s")).alias("a")).collect()}
    assert got == {"ACGT": (2.0, 0.5), "AAAA": (0.0, 1.0), "AATT": (1.0, 1.0)}


def test_stream_equals_batch(spark, sf, tmp_path):
    raw = fixtures.reads(spark, sf).withColumn("acq_id", F.lit("a")).select("acq_id", "read_no", "r1", "r2")
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.demultiplex_stream(ingest.stream_reads(spark, str(tmp_path / "in"), 1), fixtures.whitelist())
    ingest.append_corrected_input(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    cols = ["read_no", "sample", "neuron", "umi"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(cols).collect())
    assert got == sorted(tuple(r) for r in sequencing.q_demultiplex(spark, sf).select(cols).collect())


def test_streamed_counts_equal_batch(spark, sf, tmp_path):
    raw = fixtures.reads(spark, sf).withColumn("acq_id", F.lit("a")).select("acq_id", "read_no", "r1", "r2")
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        stream = ingest.demultiplex_stream(ingest.stream_reads(spark, str(tmp_path / "in"), 1), fixtures.whitelist())
        ingest.append_molecule_counts(stream, str(tmp_path / "counts"), str(tmp_path / "cp")).awaitTermination()
    cols = ["sample", "neuron", "umi", "n"]
    want = sequencing.q_demultiplex(spark, sf).groupBy("sample", "neuron", "umi").agg(F.count("*").alias("n"))
    assert len(list((tmp_path / "counts").glob("batch=*"))) == 3
    assert sorted(map(tuple, ingest.molecule_counts_so_far(spark, str(tmp_path / "counts")).select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_exploded_keys_are_never_broadcast(spark, tmp_path):
    """A key table is many rows a node, which the size of the nodes' file does not show."""
    spark.createDataFrame([("a", "s", "ACGT", 5), ("b", "s", "ACGA", 2), ("c", "t", "ACGA", 2)], "id string, scope_key string, seq string, n bigint").write.parquet(str(tmp_path / "nodes"))
    edges = cluster.hamming1_edges(spark.read.parquet(str(tmp_path / "nodes")), 4)
    assert [tuple(r) for r in edges.collect()] == [("a", "b", 2)]
    plan = edges._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_mates_of_shared_read_numbers_stay_together(spark, tmp_path):
    pairs = [(i % 3, f"A{i * 7919 % 1000:03d}", f"C{i:03d}") for i in range(600)]
    df = spark.createDataFrame(pairs, "read_no bigint, r1 string, r2 string").repartition(5, "r2")
    sinks.write_paired_fastq(df, str(tmp_path), "run")
    got = [(r["r1"], r["r2"]) for r in fastq.read_paired_fastq(spark, str(tmp_path), "run").collect()]
    assert sorted(got) == sorted(p[1:] for p in pairs)


def test_fastq_in_numbered_parts(spark, tmp_path):
    pairs = [(i % 200, "ACGT"[i % 4] * (1 + i % 9), f"C{i:03d}") for i in range(700)]
    df = spark.createDataFrame(pairs, "read_no bigint, r1 string, r2 string").repartition(5, "r2")
    sinks.write_paired_fastq(df, str(tmp_path), "run", file_reads=100)
    names = sorted(f.name for f in tmp_path.glob("run_*.gz"))
    assert names[0] == "run_R1_00001.fastq.gz" and 10 <= len(names) <= 14 and len({n.replace("R2", "R1") for n in names}) * 2 == len(names)
    lines = [line for n in names if "R1" in n for line in gzip.open(tmp_path / n, "rt").read().split("\n")[:-1]]
    assert lines[::4] == [f"@run:{i}" for i in sorted(p[0] for p in pairs)] and set(lines[2::4]) == {"+"} and all(map(str.__eq__, map("I".__mul__, map(len, lines[1::4])), lines[3::4]))
    got = fastq.read_paired_fastq(spark, str(tmp_path), "run").collect()
    assert sorted((r["r1"], r["r2"]) for r in got) == sorted(p[1:] for p in pairs)
    assert len({r["read_no"] for r in got}) == 700
    (tmp_path / names[-1]).rename(tmp_path / "elsewhere")
    with pytest.raises(ValueError, match="no other mate"):
        fastq.read_paired_fastq(spark, str(tmp_path), "run")
    sinks.write_paired_fastq(df.limit(0), str(tmp_path), "none")
    assert fastq.read_paired_fastq(spark, str(tmp_path), "none").count() == 0
    (tmp_path / "two_R1.fastq.gz").touch(), (tmp_path / "twofold_R1.fastq.gz").touch()
    with pytest.raises(ValueError, match="2 files with R1"):
        fastq.read_paired_fastq(spark, str(tmp_path), "two")


def test_sections_are_triangulated_across_batches(spark):
    corners = [(0.0, 0.0), (4.0, 0.0), (0.0, 3.0), (4.0, 3.0), (1.0, 1.0)]
    rows = [(s, i, *(xy if s % 3 or i < 4 else (None, None))) for s in range(200) for i, xy in enumerate(corners)] + [(None, i, *xy) for i, xy in enumerate(corners[:3])]
    df = spark.createDataFrame(rows, "section int, i int, sx double, sy double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sections.delaunay_triangles(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {s: delaunay.triangulate(np.array(corners[: 5 if s % 3 else 4])) for s in range(200)} | {None: [(0, 1, 2)]}
    assert sorted(map(tuple, got), key=repr) == sorted(((s, *t) for s, ts in want.items() for t in ts), key=repr)


def test_pixels_tiles_and_points_are_never_broadcast(spark, sf):
    """One supplier row, of a few bytes, is 108 pixels and about 100 tiles of triangles."""
    for name in ("warp_section_pixels", "warp_forward", "section_voxels"):
        plan = brain.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_cells_of_pixels_are_never_broadcast(spark, sf, monkeypatch):
    """A searched pixel is nine cells, and the pixels' compressed file is smaller than its rows."""
    plans, save = [], sections.Scratch.save
    monkeypatch.setattr(sections.Scratch, "save", lambda self, df, name="t", **o: plans.append((name, df._jdf.queryExecution().toString())) or save(self, df, name, **o))
    brain.QUERIES["nearest_pixel"](spark, sf).count()
    assert {n for n, _ in plans} == {"px", "found", "left"}
    assert all("SortMergeJoin" in p and "Broadcast" not in p for _, p in plans)
