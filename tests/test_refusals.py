"""Guards refuse instead of dropping rows, and whole-range operators against brute force."""

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from netcohort.operators import embedding, geometry, graphs, inference, similarity, tracks, voxels
from netcohort.sources import contracts

REFUSED = Exception


def test_sign_flip_refuses_seventeen_pairs(spark):
    rows = [("a", i, float(i)) for i in range(17)]
    with pytest.raises(REFUSED, match="3..16"):
        inference.paired_signflip(spark.createDataFrame(rows, "key string, subject int, d double"), ["key"]).collect()


def test_matrix_test_refuses_nine_subjects(spark):
    rows = [("a", i, j, float(i * j), float(i + j)) for i, j in itertools.combinations(range(9), 2)]
    with pytest.raises(REFUSED, match="3..8"):
        inference.mantel(spark.createDataFrame(rows, "key string, i int, j int, a double, b double"), ["key"], "a", "b").collect()


def test_pooling_refuses_undefined_cohorts(spark):
    df = spark.createDataFrame([("m", 1.0, 9), ("m", 0.5, 9)], "metric string, r double, n int")
    with pytest.raises(REFUSED, match="pooling"):
        inference.fisher_pool(df, ["metric"], 1).collect()


def test_a_short_session_is_refused_and_listed(spark):
    edges = spark.createDataFrame([("s", 0, 1, 1.0), ("s", 1, 2, 2.0), ("s", 0, 2, 0.0)], "subject string, i int, j int, w double")
    with pytest.raises(REFUSED, match="too few positive pairs"):
        graphs.fixed_cost(edges, ["subject"], 20, (0.05,)).collect()
    assert graphs.cost_violations(edges, ["subject"], 20, (0.05,)).count() == 1


def test_an_isolated_node_is_refused(spark):
    nodes = [(i, "L", "cortex", "N", f"n{i}") for i in range(16)]
    n = spark.createDataFrame(nodes, "idx int, hemi string, tissue string, network string, name string")
    r = random.Random(1)
    rows = [("s", v, i, j, r.random() + 0.1) for v in (0, 1) for i, j in itertools.combinations(range(15), 2)]
    edges = spark.createDataFrame(rows, "subject string, visit int, i int, j int, w double")
    with pytest.raises(REFUSED, match="isolated"):
        embedding.cohort_embeddings(edges, n, spark.createDataFrame([("s",)], "subject string"), "common")


def test_small_weights_stay_in_the_held_out_mean(spark):
    edges = spark.createDataFrame([(s, 0, 1, 1e-10) for s in "abc"], "subject string, i int, j int, w double")
    got = embedding.loso_mean(edges, spark.createDataFrame([(s,) for s in "abc"], "subject string")).collect()
    assert len(got) == 3 and all(x.w == pytest.approx(1e-10) for x in got)


def test_four_visits_are_refused_by_the_identification_null(spark):
    rows = [(s, v, t, (v + 1) % 4, True) for s, t in (("a", "b"), ("b", "c"), ("c", "a")) for v in range(4)]
    near = spark.createDataFrame(rows, "subject string, visit int, near_subject string, near_visit int, hit boolean")
    with pytest.raises(ValueError, match="visits 0, 1 and 2"):
        similarity.identification_null(near)


def test_an_unmapped_node_is_refused(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "i int, j int, w double")
    with pytest.raises(REFUSED, match="mapping"):
        contracts.reindex(edges, spark.createDataFrame([(0, 5), (1, 4)], "old int, new int")).collect()


def test_an_unsettled_centre_is_refused(spark):
    r = random.Random(2)
    pts = spark.createDataFrame([("a", *[r.random() for _ in range(4)]) for _ in range(9)], "k string, g1 double, g2 double, g3 double, g4 double")
    with pytest.raises(ValueError, match="settled"):
        geometry.geometric_median(pts, ["k"], max_rounds=1)


def test_segments_of_any_length_meet_the_mask(spark, monkeypatch):
    monkeypatch.setattr(tracks, "BLOCK", 3)
    r = random.Random(7)
    shape = (9, 9, 9)
    mask = {(r.randrange(9), r.randrange(9), r.randrange(9)) for _ in range(20)}
    lines = {t: [[r.uniform(-2, 10) for _ in range(3)] for _ in range(r.randint(2, 8))] for t in range(120)}
    lines[120] = [[0.0, 2.0, 2.0], [4.0, 2.0, 2.0]]
    mask.add((2, 2, 2))

    def meets(a, b, cell):
        near, far = 0.0, 1.0
        for x, y, c in zip(a, b, cell, strict=True):
            d = y - x
            if abs(d) < 1e-12:
                if not c - 0.5 <= x <= c + 0.5:
                    return False
                continue
            t = sorted(((c - 0.5 - x) / d, (c + 0.5 - x) / d))
            near, far = max(near, t[0]), min(far, t[1])
        return near <= far

    want = {t for t, p in lines.items() if any(meets(a, b, c) for a, b in zip(p, p[1:], strict=False) for c in mask)}
    pts = spark.createDataFrame([(t, i, *p) for t, line in lines.items() for i, p in enumerate(line)], "track int, seq long, x double, y double, z double")
    m = spark.createDataFrame(sorted(mask), "x int, y int, z int")
    assert {x.track for x in tracks.crossing_tracks(pts, m, shape).collect()} == want and 120 in want
    with pytest.raises(ValueError, match="more than two cells"):
        tracks.crossing_tracks(pts, m, shape, strict=True)


@pytest.mark.parametrize("connectivity", [6, 26])
def test_components_across_blocks(spark, monkeypatch, connectivity):
    monkeypatch.setattr(voxels, "BLOCK", 4)
    r = random.Random(connectivity)
    cells = {(r.randrange(11), r.randrange(10), r.randrange(9)) for _ in range(260)}
    steps = [s for s in itertools.product((-1, 0, 1), repeat=3) if any(s) and (connectivity == 26 or sum(map(abs, s)) == 1)]
    shape, root = (11, 10, 9), {}
    number = lambda c: c[0] + shape[0] * (c[1] + shape[1] * c[2])
    for c in sorted(cells, key=number):
        if c not in root:
            queue = deque([c])
            root[c] = number(c)
            while queue:
                x = queue.popleft()
                for s in steps:
                    y = tuple(a + b for a, b in zip(x, s, strict=True))
                    if y in cells and y not in root:
                        root[y] = number(c)
                        queue.append(y)
    mask = spark.createDataFrame([("i", *c) for c in cells], "image_id string, x int, y int, z int")
    got = {(x.x, x.y, x.z): x.root for x in voxels.label_components(mask, shape, connectivity).collect()}
    assert got == root


def test_hop_counts_equal_a_search_from_every_node(spark):
    r = random.Random(9)
    n = 90  # more than one word of bits
    pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(100)}
    want = {}
    for s in range(n):
        seen, queue = {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            for a, b in pairs:
                for u, v in ((a, b), (b, a)):
                    if u == x and v not in seen:
                        seen[v] = seen[x] + 1
                        queue.append(v)
        for d in seen.values():
            if d:
                want[(s, d)] = want.get((s, d), 0) + 1
    edges = spark.createDataFrame([("g", i, j) for i, j in pairs], "g string, i int, j int")
    nodes = spark.range(n).select(F.lit("g").alias("g"), F.col("id").cast("int").alias("node"))
    got = {(x.node, x.d): x.pairs for x in graphs.hop_counts(edges, ["g"], nodes).collect()}
    assert got == want


def test_images_without_white_matter_are_refused(spark):
    rows = [("a", 0, [0.2, 0.0, 0.3, 0.0, 0.1]), ("a", 1, [1.0, 0.0, 0.0, 0.0, 0.0]), ("b", 0, [0.5, 0.5, -0.1, 0.0, 0.0]), ("b", 1, [0.0] * 5)]
    d = spark.createDataFrame(rows, "image_id string, x int, f array<double>")
    assert voxels.normalize_five_tissue(d.filter("image_id = 'a'")).count() == 2
    assert [r[0] for r in voxels.without_white_matter(d).collect()] == ["b"]
    for act in (lambda t: t.count(), lambda t: t.select("f").collect()):
        with pytest.raises(REFUSED, match="no white matter: b"):
            act(voxels.normalize_five_tissue(d))


def test_another_number_of_shafts_is_refused(spark):
    ct = spark.createDataFrame([("one",), ("two",), ("none",)], "image_id string")
    found = spark.createDataFrame([("one", 1, 0), ("one", 1, 1), ("two", 1, 0), ("two", 7, 0)], "image_id string, root long, bin int")
    got = {tuple(r) for r in voxels.ambiguous_shafts(found, ct, 1).collect()}
    assert got == {("two", 2), ("none", 0)}
    with pytest.raises(REFUSED, match="other than 1 candidate"):
        voxels.expected_shafts(found, ct, 1).count()
    one = voxels.expected_shafts(found.filter("image_id = 'one'"), ct.filter("image_id = 'one'"), 1)
    assert one.count() == 2 and one.columns == found.columns
