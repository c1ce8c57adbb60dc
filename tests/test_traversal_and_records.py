"""Grid traversal, nearest voxels, JSON pairs and lineage against brute force."""

import hashlib
import json

import numpy as np
import pytest

from netcohort import session
from netcohort.operators import tracks as T
from netcohort.operators import voxels as V
from netcohort.sources import contracts as C


def touched(a, b, cell):
    """Closed unit box around the cell meets the segment."""
    near, far = 0.0, 1.0
    for p, q, c in zip(a, b, cell):
        d = q - p
        if abs(d) < 1e-12:
            if not c - 0.5 <= p <= c + 0.5:
                return False
            continue
        t = sorted(((c - 0.5 - p) / d, (c + 0.5 - p) / d))
        near, far = max(near, t[0]), min(far, t[1])
    return near <= far


def test_traversal_meets_every_touched_cell(spark):
    """Oblique, axis-parallel, diagonal and zero-length segments, some far beyond the grid."""
    rng = np.random.default_rng(4)
    shape = (6, 5, 7)
    ends = [(rng.uniform(-9, 15, 3), rng.uniform(-9, 15, 3)) for _ in range(40)]
    ends += [(np.array(a, float), np.array(b, float)) for a, b in (
        ((0, 0, 0), (4, 4, 4)), ((-0.5, 1, 1), (5.5, 1, 1)), ((0.5, 0.5, 0.5), (4.5, 0.5, 0.5)), ((2, 2, 2), (2, 2, 2)), ((0.5, 0.5, 3.5), (0.5, 4.5, 3.5)), ((100, 2, 2), (-100, 2, 2)), ((20, 20, 20), (30, 25, 28)),
    )]
    rows = [(k, s, *map(float, p)) for k, pair in enumerate(ends) for s, p in enumerate(pair)]
    points = spark.createDataFrame(rows, "track int, seq int, x double, y double, z double")
    got = {}
    for r in T.segment_cells(points, shape).collect():
        got.setdefault(r.track, set()).add((r.x, r.y, r.z))
    grid = [(x, y, z) for x in range(shape[0]) for y in range(shape[1]) for z in range(shape[2])]
    for k, (a, b) in enumerate(ends):
        want = {c for c in grid if touched(a, b, c)}
        assert want <= got.get(k, set()), k
        assert len(got.get(k, ())) <= 8 * (3 + sum(n + 1 for n in shape))
    assert len(got[45]) <= 4 * shape[0]  # a straight line offers a line of cells, not a box
    mask = [(1, 1, 1), (4, 2, 2), (0, 4, 6)]
    hit = {r.track for r in T.crossing_tracks(points, spark.createDataFrame(mask, "x int, y int, z int"), shape).collect()}
    assert hit == {k for k, (a, b) in enumerate(ends) if any(touched(a, b, c) for c in mask)}


def test_gaps_in_a_track_are_refused(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 2, 1.0, 0.0, 0.0)], "track int, seq int, x double, y double, z double")
    mask = spark.createDataFrame([(0, 0, 0)], "x int, y int, z int")
    with pytest.raises(ValueError, match="track 1"):
        T.crossing_tracks(points, mask, (3, 3, 3))


def test_parcel_distance_equals_all_pairs(spark):
    rng = np.random.default_rng(6)
    affine = [[2.0, 0.3, 0.0, 5.0], [0.0, 3.0, 0.2, -7.0], [0.1, 0.0, 4.0, 1.0], [0, 0, 0, 1]]
    atlas = [("a", *map(int, rng.integers(0, 40, 3)), int(rng.integers(1, 9))) for _ in range(60)] + [("none", 1, 1, 1, 1)]
    mask = [("a", *map(int, rng.integers(100, 104, 3))) for _ in range(5)] + [("a", 3, 3, 3)]
    got = {(r.image_id, r.label): r.distance_mm for r in V.parcel_distance(
        spark.createDataFrame(atlas, "image_id string, x int, y int, z int, label int"), spark.createDataFrame(mask, "image_id string, x int, y int, z int"), [v for row in affine for v in row]).collect()}
    m = np.array(affine)[:3]
    w = lambda p: m[:, :3] @ np.asarray(p, float) + m[:, 3]
    for label in {r[4] for r in atlas if r[0] == "a"}:
        centre = w(np.mean([r[1:4] for r in atlas if r[0] == "a" and r[4] == label], axis=0))
        assert np.isclose(got["a", label], min(np.linalg.norm(w(v[1:]) - centre) for v in mask))
    assert ("none", 1) not in got


def test_json_pairs_count_every_way_to_differ(spark):
    one = {"n": 1, "deep": [[1, 2], [], [[3.5]]], "text": "[1]", "none": None, "shape": [1, 2], "close": 1.0, "empty": []}
    two = {"n": 1, "deep": [[1, 2], [], [[3.5]]], "text": "[1]", "none": None, "shape": [1], "close": 1.0 + 1e-6, "empty": []}
    docs = [spark.createDataFrame([("d", json.dumps(x))], "doc string, json string") for x in (one, two)]
    paths = spark.createDataFrame([(k, "$." + k, "$." + k) for k in one] + [("gone", "$.x", "$.x")], "pair string, actual string, expected string")
    got = {r.pair: r for r in C.replay_diff_values(*docs, paths).collect()}
    assert got["n"].passed and got["n"].compared_values == 1
    assert got["deep"].passed and got["deep"].compared_values == 3 and got["deep"].empty == 1
    assert not got["text"].passed and not got["none"].passed and not got["gone"].passed
    assert got["shape"].unpaired == 1 and got["shape"].compared_values == 1 and not got["shape"].passed
    assert got["close"].outside_tolerance == 1 and np.isclose(got["close"].max_absolute_error, 1e-6)
    assert got["empty"].compared_values == 0 and got["empty"].empty == 1


def test_json_elements_are_dealt_by_rows_and_met_once(spark, monkeypatch):
    docs = [[(k, json.dumps({"a": [k, [k + shift, []], 2], "b": k})) for k in range(100)] for shift in (0, 1)]
    one, two = (spark.createDataFrame(d, "doc int, json string") for d in docs)
    paths = spark.createDataFrame([("a", "$.a", "$.a"), ("b", "$.b", "$.a")], "pair string, actual string, expected string")
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    d = C.replay_diff_values(one, two, paths)
    got = {(r.doc, r.pair): (r.compared_values, r.max_absolute_error, r.unpaired, r.outside_tolerance, r.empty) for r in d.collect()}
    assert got == {(k, p): (3, 1.0, 0, 1, 1) if p == "a" else (0, None, 5, 0, 0) for k in range(100) for p in "ab"}
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Join" not in plan
    with pytest.raises(Exception, match="twice on one side"):
        C.replay_diff_values(one.unionByName(one), two, paths).collect()


def test_lineage_is_append_only(spark, tmp_path):
    files = spark.createDataFrame([("p", "h")], "path string, sha256 string")
    rows = lambda run, a: C.lineage(run, "study", files, files, {"alpha": a}, "completed")
    path = str(tmp_path / "lineage")
    C.append_lineage(rows("r1", "1"), path, "r1")
    C.append_lineage(rows("02", "2"), path, "02")
    with pytest.raises(Exception, match="(?i)exist"):
        C.append_lineage(rows("r1", "3"), path, "r1")
    with pytest.raises(C.ContractError):
        C.append_lineage(rows("r3", "3"), path, "r4")
    rows("half", "9").write.parquet(f"{path}/rows/run=half")  # never committed
    got = {(r.run, r.role, r.params["alpha"]) for r in C.read_lineage(spark, path).collect()}
    assert got == {("r1", "input", "1"), ("r1", "output", "1"), ("02", "input", "2"), ("02", "output", "2")}


def test_large_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "PIECE", 1000)
    for name, n in {"a b%20.bin": 0, "ünï.bin": 999, "at.bin": 1000, "over #1.bin": 1001, "deep/large 50%.bin": 34_567}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(np.random.default_rng(n).bytes(n))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        got = C.content_hash(spark, str(tmp_path), stream_above=1000).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    want = sorted((p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.rglob("*.bin") if p.stat().st_size)
    assert sorted((x["size"], x["sha256"]) for x in got) == want and len({x["path"] for x in got}) == 4


def test_a_file_that_changes_while_it_is_hashed_is_refused(tmp_path):
    (tmp_path / "x.bin").write_bytes(b"12345")
    with pytest.raises(OSError, match="5 bytes read of 6"):
        C._stream_digest(f"file:{tmp_path}/x.bin", 6)


def test_holes_are_what_the_border_does_not_reach(spark):
    """Random masks, a closed shell, a shell with one hole in its wall and a shell at the border."""
    r, n = np.random.default_rng(3), 9
    shell = np.zeros((n, n, n), bool)
    shell[2:7, 2:7, 2:7] = True
    shell[3:6, 3:6, 3:6] = False
    pierced = shell.copy()
    pierced[4, 4, 2] = False
    edge = np.zeros((n, n, n), bool)
    edge[:4, :4, :4] = True
    edge[:3, :3, :3] = False
    images = [r.random((n, n, n)) < p for p in (0.5, 0.7, 0.85)] + [shell, pierced, edge]
    rows = [(f"i{k}", *map(int, at)) for k, m in enumerate(images) for at in np.argwhere(m)]
    got = {tuple(x) for x in V.fill_holes(spark.createDataFrame(rows, "image_id string, x int, y int, z int"), (n, n, n)).select("image_id", "x", "y", "z").collect()}
    want = set(rows)
    for k, m in enumerate(images):
        seen = {tuple(map(int, p)) for p in np.argwhere(~m) if 0 in p or n - 1 in p}
        todo = list(seen)
        while todo:
            p = todo.pop()
            for axis in range(3):
                for d in (-1, 1):
                    q = tuple(c + d * (i == axis) for i, c in enumerate(p))
                    if all(0 <= c < n for c in q) and not m[q] and q not in seen:
                        seen.add(q)
                        todo.append(q)
        want |= {(f"i{k}", *map(int, p)) for p in np.argwhere(~m) if tuple(map(int, p)) not in seen}
    assert got == want and ("i3", 4, 4, 4) in got and ("i4", 4, 4, 4) not in got and ("i5", 1, 1, 1) not in got
