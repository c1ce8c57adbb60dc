"""Voxels, streamlines, contracts and intake on small literals."""

import hashlib
import hmac

import numpy as np
import pytest
from pyspark.sql import functions as F

from netcohort import session
from netcohort.operators import tracks as T
from netcohort.operators import voxels as V
from netcohort.session import cut
from netcohort.sources import contracts as C
from netcohort.sources import intake as I


def brute_hit(a, b, cell):
    d = b - a
    near, far = 0.0, 1.0
    for i in range(3):
        if abs(d[i]) < 1e-12:
            if abs(a[i] - cell[i]) > 0.5:
                return False
            continue
        t = sorted(((cell[i] - 0.5 - a[i]) / d[i], (cell[i] + 0.5 - a[i]) / d[i]))
        near, far = max(near, t[0]), min(far, t[1])
    return near <= far


def test_segments_against_boxes(spark):
    rng = np.random.default_rng(482)
    mask = np.argwhere(rng.random((6, 6, 6)) < 0.15)
    a = rng.uniform(0, 5, (120, 3))
    b = a + rng.uniform(-0.9, 0.9, (120, 3)) * (rng.random((120, 3)) > 0.2)
    want = {k for k in range(120) if any(brute_hit(a[k], b[k], c) for c in mask)}
    p = spark.createDataFrame([(k, s, *map(float, v[k])) for k in range(120) for s, v in enumerate((a, b))], "track int, seq int, x double, y double, z double")
    m = spark.createDataFrame([tuple(map(int, c)) for c in mask], "x int, y int, z int")
    assert {r.track for r in T.crossing_tracks(p, m, (6, 6, 6)).collect()} == want


def test_endpoint_sums(spark):
    a = spark.createDataFrame([(1, 2, 2.0), (2, 1, 3.0), (1, 1, 7.0), (0, 2, 11.0)], "a int, b int, w double").withColumn("s", F.lit("a"))
    assert [(r.i, r.j, r.w) for r in T.build_connectome(a, ["s"]).collect()] == [(1, 2, 5.0)]
    audit = T.matrix_weight_audit(T.build_connectome(a, ["s"]), a, ["s"]).first()
    assert audit.passed and audit.discarded_tracks == 2


def test_parcel_distance_on_anisotropic_grid(spark):
    atlas = spark.createDataFrame([("a", 1, 1, 1, 7), ("a", 1, 2, 3, 9)], "image_id string, x int, y int, z int, label int")
    mask = spark.createDataFrame([("a", 1, 4, 1)], "image_id string, x int, y int, z int")
    aff = [2.0, 0, 0, 0, 0, 3.0, 0, 0, 0, 0, 4.0, 0, 0, 0, 0, 1]
    d = {r.label: r.distance_mm for r in V.parcel_distance(atlas, mask, aff).collect()}
    assert np.isclose(d[7], 9) and np.isclose(d[9], 10)


def test_components_of_many_voxels_are_dealt_by_rows(spark, monkeypatch):
    rng = np.random.default_rng(7)
    cells = {tuple(map(int, c)) for c in rng.integers(0, 70, (3000, 3))}
    m = spark.createDataFrame([("a", *c) for c in cells], "image_id string, x int, y int, z int")
    whole = {tuple(r) for r in V.label_components(m, (70, 70, 70), 26).collect()}
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    assert session.dealt(m, 3000, "x").rdd.getNumPartitions() == 30 and session.dealt(m, 100, "x") is m
    parts = V.label_components(m, (70, 70, 70), 26)
    assert {tuple(r) for r in parts.collect()} == whole
    root = {c: c for c in cells}

    def top(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    near = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    for c in cells:
        for d in near:
            o = tuple(a + b for a, b in zip(c, d, strict=True))
            if o in cells:
                root[top(o)] = top(c)
    names = {}
    for c in cells:
        names.setdefault(top(c), []).append(c[0] + 70 * (c[1] + 70 * c[2]))
    assert whole == {("a", *c, min(names[top(c)])) for c in cells}


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dice_of_many_voxels_is_dealt_by_cubes(spark, monkeypatch):
    rng = np.random.default_rng(19)
    masks = {n: {tuple(map(int, c)) for c in rng.integers(-9, 9, (k, 3))} for n, k in (("a", 3000), ("b", 2000), ("c", 1))}
    m = spark.createDataFrame([(n, *c) for n, cells in masks.items() for c in cells], "image_id string, x int, y int, z int")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("a", "none")], "a string, b string")
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    d = V.dice(pairs, m)
    want = {(a, b): 2 * len(masks[a] & masks[b]) / (len(masks[a]) + len(masks[b])) for a, b in (("a", "b"), ("b", "a"), ("a", "c"))}
    assert {(r.a, r.b): r.dice for r in d.collect()} == want
    assert "REPARTITION_BY_NUM" in planned(d) and "SortMergeJoin" in planned(d)


def test_mask_repair_of_many_voxels_is_one_dealt_pass(spark, monkeypatch):
    rng = np.random.default_rng(6)
    sets = [{("a", *map(int, c)) for c in rng.integers(0, 9, (k, 3))} for k in (400, 300, 200)]
    frames = [spark.createDataFrame(sorted(x), "image_id string, x int, y int, z int") for x in sets]
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    r = V.mask_repair(frames[0], frames[1].unionByName(frames[1]), frames[2])
    assert sorted(map(tuple, r.collect())) == sorted((sets[0] | sets[1]) - sets[2])
    assert "REPARTITION_BY_NUM" in planned(r) and "Join" not in planned(r)


def test_fill_holes_closes_a_shell(spark):
    cells = [("a", x, y, z) for x in range(1, 4) for y in range(1, 4) for z in range(1, 4) if (x, y, z) != (2, 2, 2)]
    m = spark.createDataFrame(cells, "image_id string, x int, y int, z int")
    assert V.fill_holes(m, (6, 6, 6)).count() == 27


def test_shaft_axis_and_length(spark):
    line = [("a", 3, 3, z) for z in range(12)] + [("a", 9, 9, 0), ("a", 9, 9, 1)]
    ct = cut(spark.createDataFrame(line, "image_id string, x int, y int, z int").withColumn("v", F.lit(2500.0)))
    aff = [2.0, 0, 0, 0, 0, 2.0, 0, 0, 0, 0, 2.0, 0, 0, 0, 0, 1]
    r = V.shaft_candidates(ct, ct, (12, 12, 12), aff, 2000.0).collect()
    assert len({x.root for x in r}) == 1 and np.isclose(r[0].length_mm, 22) and all(np.isclose(x.px, 6) for x in r)


def test_keyed_code_is_hmac(spark):
    d = spark.createDataFrame([("1.2.3",), ("é",)], "v string").select("v", I.keyed_code(F.col("v"), b"salt").alias("c"))
    for r in d.collect():
        assert r.c == hmac.new(b"salt", r.v.encode(), hashlib.sha256).hexdigest()[:20]


def test_shells_follow_the_running_mean(spark):
    b = [0.0, 10.0] + [990.0, 1000.0, 1080.0, 1140.0, 2000.0, 2000.0]
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate(b)], "acquisition int, vol int, b double")
    assert [(r.b, r.directions) for r in I.shell_cluster(d).orderBy("shell").collect()] == [(1023.3, 3), (1140.0, 1), (2000.0, 2)]


def test_refusals(spark, tmp_path):
    empty = spark.createDataFrame([], "a int")
    with pytest.raises(C.ContractError):
        C.write_results(empty, str(tmp_path / "x"))
    one = spark.createDataFrame([(1, 2.0)], "k int, v double")
    C.write_results(one, str(tmp_path / "y"))
    with pytest.raises(Exception):
        C.write_results(one, str(tmp_path / "y"))
    with pytest.raises(C.ContractError):
        C.replay_diff_table(one, one, ["k"], ["v"], atol=1e-3)
    assert C.replay_diff_table(one, one, ["k"], ["v"]).first().passed
    assert not C.replay_diff_table(one, one.union(one), ["k"], ["v"]).first().passed


def test_few_segments_are_dealt_over_all_cores(spark):
    from netcohort.operators import voxels as V

    affine = [2.0, 0, 0, 0, 0, 2.0, 0, 0, 0, 0, 2.0, 0, 0, 0, 0, 1.0]
    ends = [("n0", p, 2.0 * (p % 8), 4.0, 0.0, 2.0 * (p % 8) + 3, 6.0, 20.0) for p in range(40)]
    one = spark.createDataFrame(ends, "image_id string, path int, ax double, ay double, az double, bx double, by double, bz double").coalesce(1)
    tube = V.tube_mask(one, (16, 16, 16), affine, 2.5)
    assert tube.count() == tube.distinct().count() and tube.select("path").distinct().count() == 40
    plan = tube._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "REPARTITION_BY_NUM" in plan
    ball = one.selectExpr("image_id", "path AS ord", "path AS label", "ax AS px", "ay AS py", "az AS pz")
    hit = V._ball(ball, (16, 16, 16), affine, F.lit(3.5), ["image_id", "ord", "label"])
    assert hit.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 8


def test_segments_are_cut_only_where_points_do_not_decide(spark, monkeypatch):
    cells, plain = [], T.segment_cells
    monkeypatch.setattr(T, "segment_cells", lambda p, *a, **k: cells.append(p) or plain(p, *a, **k))
    rows = [(0, 0, 1.0, 1.0, 1.0), (0, 1, 1.2, 1.0, 1.0), (1, 0, 4.0, 4.0, 4.0), (1, 1, 6.0, 4.0, 4.0), (2, 0, 1.0, 1.0, 1.0), (3, 0, 7.0, 7.0, 7.0), (3, 1, 7.2, 7.0, 7.0), (4, 0, 3.0, 0.5, 1.0), (4, 1, 3.2, 0.5, 1.0)]
    p = spark.createDataFrame(rows, "track int, seq int, x double, y double, z double")
    mask = spark.createDataFrame([(1, 1, 1), (5, 4, 4), (3, 0, 1)], "x int, y int, z int")
    assert {r.track for r in T.crossing_tracks(p, mask, (8, 8, 8)).collect()} == {0, 1, 4}
    assert {r.track for r in cells[0].select("track").distinct().collect()} == {1, 2, 3, 4}
    assert {r.track for r in plain(p, (8, 8, 8), crossing=True).select("track").distinct().collect()} == {1, 4}
