"""Independent enumeration, known constants and invariance."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from netcohort.operators import embedding as E
from netcohort.operators import geometry as M
from netcohort.operators import inference as P
from netcohort.session import cut


def ranks(x):
    x = np.asarray(x)
    r = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    r = r - r.mean()
    return r / np.linalg.norm(r)


def test_exact_family_with_ties(spark):
    x = np.array([[1, 2, 2, 4, 5], [3, 1, 4, 1, 5]], float)
    y = np.array([2, 1, 4, 4, 5], float)
    f = spark.createDataFrame([(f"S{s}", f"m{k}", float(x[k, s])) for k in range(2) for s in range(5)], "subject string, metric string, x double")
    o = spark.createDataFrame([("e", f"S{s}", float(y[s])) for s in range(5)], "endpoint string, subject string, y double")
    got = {r.metric: r for r in P.exact_family(f, o, ["metric"]).collect()}
    perms = list(itertools.permutations(range(5)))
    null = np.array([[ranks(y)[list(p)] @ ranks(v) for v in x] for p in perms])
    for k in range(2):
        rho = ranks(x[k]) @ ranks(y)
        r = got[f"m{k}"]
        assert np.isclose(r.rho, rho)
        assert np.isclose(r.p_exact, (abs(null[:, k]) >= abs(rho) - 1e-12).mean())
        assert np.isclose(r.p_maxT, (abs(null).max(1) >= abs(rho) - 1e-12).mean())


def test_critical_values(spark):
    r = {x.n: x for x in P.rank_critical_values(spark, [3, 6]).collect()}
    both = spark.createDataFrame([(3,), (3,), (1,), (9,)], "n int")
    got = {x.n: x for x in P.size_critical_values(both, draws=2000).collect()}
    assert set(got) == {3, 9} and got[3] == r[3] and got[9].null_draws == 2000
    t = spark.createDataFrame([("a", 6, -186 / 210), ("b", 6, 0.88), ("c", 3, 1.0)], "k string, n int, rho double")
    assert {x.k: x.beyond for x in P.beyond_critical(t).collect()} == {"a": True, "b": False, "c": False}
    assert r[6].critical_absolute_numerator == 186 and r[6].denominator == 210 and np.isclose(r[6].achieved_null_probability, 24 / 720)
    assert r[3].critical_absolute_numerator == 25


def test_normal_tail_of_the_pooled_coefficient(spark):
    d = spark.createDataFrame([("m", 0.5, 10), ("m", 0.7, 20)], "metric string, r double, n int")
    r = P.fisher_pool(d, ["metric"], 3).first()
    z = (7 * np.arctanh(0.5) + 17 * np.arctanh(0.7)) / 24
    from math import erfc, sqrt

    assert np.isclose(r.r, np.tanh(z)) and np.isclose(r.p_two, erfc(z * sqrt(24) / sqrt(2)))


def points(spark, seed=4):
    rng = np.random.default_rng(seed)
    g = rng.normal(size=(2, 40, 4))
    rows = [("S0", v, p, "L" if p % 2 else "R", "AB"[(p // 2) % 2], *map(float, g[v, p])) for v in range(2) for p in range(40)]
    return g, spark.createDataFrame(rows, "subject string, visit int, parcel int, hemi string, network string, g1 double, g2 double, g3 double, g4 double")


def test_geometric_median_minimises_distance(spark):
    g, d = points(spark)
    r = M.geometric_median(d, ["visit"]).orderBy("visit").collect()
    for v, row in enumerate(r):
        m = np.array([row.m_g1, row.m_g2, row.m_g3, row.m_g4])
        u = (m - g[v]) / np.linalg.norm(m - g[v], axis=1)[:, None]
        assert np.linalg.norm(u.sum(0)) < 1e-6
    # a point that outweighs the rest is itself the answer
    heavy = spark.createDataFrame([("k", 0.0, 0.0, 0.0, 0.0)] * 3 + [("k", 1.0, 0.0, 0.0, 0.0), ("k", 0.0, 2.0, 0.0, 0.0)], "k string, g1 double, g2 double, g3 double, g4 double")
    h = M.geometric_median(heavy, ["k"]).first()
    assert np.allclose([h.m_g1, h.m_g2, h.m_g3, h.m_g4], 0)


def test_metrics_do_not_change_under_rotation(spark):
    g, d = points(spark)
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(4, 4)))[0]
    cols = ["g1", "g2", "g3", "g4"]
    turned = d.select("subject", "visit", "parcel", "hemi", "network", *[sum((F.col(c) * float(q[i, k]) for i, c in enumerate(cols)), F.lit(3.0)).alias(cols[k]) for k in range(4)])
    pick = lambda x: {(r.visit, r.network, r.metric): r.value for r in M.session_metrics(x, ["subject", "visit"]).filter("metric like 'ecc%' or metric like 'dispersion_4d%'").collect()}
    a, b = pick(d), pick(turned)
    assert a.keys() == b.keys() and np.allclose([a[k] for k in a], [b[k] for k in a])


def test_kendall_matches_pair_counting(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 12, 60), rng.integers(0, 9, 60)
    d = cut(spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double"))
    s = nx = ny = 0
    for i, j in itertools.combinations(range(60), 2):
        s += np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
        nx += x[i] != x[j]
        ny += y[i] != y[j]
    for block in (65536, 7):
        assert np.isclose(M.kendall_tau(d, ["k"], "x", "y", block).first().tau, s / np.sqrt(float(nx) * ny))


def test_block_solver_agrees_with_a_dense_one(spark):
    """Groups of several sizes, smaller than the block and larger, in one plan."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for hemi, n in (("L", 9), ("R", 14), ("S", 24)):
        w = np.triu(rng.uniform(0.1, 4, (n, n)), 1)
        rows += [(hemi, int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))]
        m = w + w.T
        kept = np.zeros((n, n))
        for i in range(n):
            best = sorted(range(n), key=lambda j: (-m[i, j], j))[:6]
            kept[i, best] = m[i, best]
        unit = kept / np.linalg.norm(kept, axis=1, keepdims=True)
        k = 1 - np.arccos(np.clip(unit @ unit.T, -1, 1)) / np.pi
        np.fill_diagonal(k, 1)
        a = k.sum(1) ** -0.05
        k = k * a[:, None] * a[None]
        s = k.sum(1) ** -0.5
        want[hemi] = np.linalg.eigvalsh(k * s[:, None] * s[None])[::-1][:4]
    e = spark.createDataFrame(rows, "hemi string, i int, j int, w double")
    k = cut(E.normalized_angle(E.row_sparsify(e, ["hemi"], F.lit(6)), ["hemi"]))
    s = cut(E.diffusion_scale(k, ["hemi"], F.lit(0.05)))
    got = E.top_eigen(k, s, ["hemi"], 3)
    for r in E.residual(got, k, s, ["hemi"], 3).collect():
        assert r.residual < 1e-9 and r.overlap < 1e-9
    for r in got.select("hemi", "l").distinct().collect():
        assert np.allclose(r.l, want[r.hemi], atol=1e-8)
    with pytest.raises(Exception, match="settle"):
        E.top_eigen(k, s, ["hemi"], 3, tolerance=0.0, rounds=1)
    with pytest.raises(Exception, match="too few nodes"):
        E.top_eigen(k, s, ["hemi"], 9)


def test_packed_similarity_equals_pairwise_correlation(spark, monkeypatch):
    from netcohort.operators import similarity as Y

    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, 700)) + 1e6
    here = rng.random((5, 700)) > 0.1
    rows = [(f"s{i // 2}", i % 2, f"f{j}", float(x[i, j])) for i in range(5) for j in range(700) if here[i, j]]
    f = spark.createDataFrame(rows, "subject string, visit int, feature string, x double").repartition(5)
    monkeypatch.setattr(Y, "PACK", 64)
    got = {((r.subject, r.visit), (r.subject2, r.visit2)): r.r for r in Y.similarity(f).collect()}
    assert len(got) == 20
    for a in range(5):
        for b in range(5):
            if a != b:
                both = here[a] & here[b]
                assert np.isclose(got[(f"s{a // 2}", a % 2), (f"s{b // 2}", b % 2)], np.corrcoef(x[a, both], x[b, both])[0, 1], atol=1e-9)
    sparse = spark.createDataFrame([(r[0], r[1], r[2], r[3] - 1e6) for r in rows], f.schema)
    zeros = np.where(here, x - 1e6, 0)
    whole = {((r.subject, r.visit), (r.subject2, r.visit2)): r.r for r in Y.similarity(sparse, features_in_all=spark.range(1).select(F.lit(1000.0))).collect()}
    padded = np.pad(zeros, ((0, 0), (0, 300)))
    assert np.isclose(whole[("s0", 0), ("s2", 0)], np.corrcoef(padded[0], padded[4])[0, 1])


def test_zones_of_one_parcel_give_no_row(spark):
    from netcohort.plans import cohorts as H

    rows = [(f"S{s}", v, p, *(float((s * 7 + v + p * a) % 5 + s) for a in (1, 2, 3, 4))) for s in range(3) for v in (0, 1) for p in range(3)]
    c = spark.createDataFrame(rows, "subject string, visit int, parcel int, g1 double, g2 double, g3 double, g4 double")
    far = spark.createDataFrame([(0, 10.0), (1, 40.0), (2, 90.0)], "parcel int, distance double")
    assert H.distance_bins_identification(c, far, 3, 1).count() == 0
    near = spark.createDataFrame([(0, 10.0), (1, 20.0), (2, 90.0)], "parcel int, distance double")
    got = H.distance_bins_identification(c, near, 3, 1).collect()
    assert [(x.zone, x.n_parcels) for x in got] == [("near", 2)]


def test_constant_sessions_have_no_correlation(spark):
    from netcohort.operators import similarity as Y

    rows = [(s, v, f"f{j}", 4.0 if s == "S1" else float((j * 7 + v * 3 + ord(s[1])) % 5)) for s in ("S0", "S1", "S2") for v in (0, 1) for j in range(12)]
    f = spark.createDataFrame(rows, "subject string, visit int, feature string, x double")
    sim = Y.similarity(f)
    got = {(r.subject, r.visit, r.subject2, r.visit2): r.r for r in sim.collect()}
    assert np.isnan(got["S0", 0, "S1", 0]) and np.isnan(got["S1", 0, "S1", 1]) and not np.isnan(got["S0", 0, "S2", 0])
    near = {(r.subject, r.visit): r for r in Y.nearest(sim, other_visits=True).collect()}
    assert (near["S1", 0].near_subject, near["S1", 0].near_visit, near["S1", 0].tied) == ("S0", 1, True)
    assert (near["S0", 0].near_subject, near["S0", 0].near_visit) == ("S1", 1) and np.isnan(near["S0", 0].other_mean)
    assert np.isnan(Y.cross_visit_identification(f).first().margin)


def test_random_subsets_equal_similarity_of_each_set(spark):
    from netcohort.operators import similarity as Y

    rng = np.random.default_rng(5)
    rows = [(f"S{s}", v, p, *map(float, rng.normal(size=4))) for s in range(3) for v in (0, 1) for p in range(60) if rng.random() > 0.05]
    c = spark.createDataFrame(rows, "subject string, visit int, parcel int, g1 double, g2 double, g3 double, g4 double").repartition(3)
    sizes = spark.createDataFrame([("near", 12), ("far", 40)], "zone string, n long")
    seen = []
    plain, Y.coordinate_features = Y.coordinate_features, lambda *a, **k: seen.append(1) or plain(*a, **k)
    try:
        got = {(r.zone, r.draw): r.correct for r in Y.random_subset_identification(c, sizes, 8, 3).collect()}
    finally:
        Y.coordinate_features = plain
    assert not seen, "features of parcels times draws are written"
    order = {}
    for r in spark.createDataFrame([(p, d) for p in range(60) for d in range(8)], "parcel int, draw int").withColumn("h", F.xxhash64(F.lit(3), "draw", "parcel")).collect():
        order.setdefault(r.draw, []).append((r.h, r.parcel))
    for zone, n in (("near", 12), ("far", 40)):
        for d in range(8):
            chosen = [p for _, p in sorted(order[d])[:n]]
            near = Y.nearest(Y.similarity(plain(c.filter(F.col("parcel").isin(chosen)))))
            assert got[zone, d] == near.filter("hit").count()


def test_displacement_queries_build_coordinates_once(spark, monkeypatch):
    from netcohort.catalog import QUERIES, study_queries

    built, plain = [], study_queries.coords
    monkeypatch.setattr(study_queries, "coords", lambda t: built.append(1) or plain(t))
    for name in ("P35_noise_outcome_screen", "P35_noise_ratio", "P35_noise_signflip", "P36_false_displacement", "P36_simulation_error", "P36_ratio_per_subject"):
        built.clear()
        QUERIES[name](spark, "/root/testdata/sf0.001")
        assert len(built) == 1, name


def test_concordance_null_writes_no_row_of_draws_times_parcels(spark):
    from pyspark.sql import Window as W

    from netcohort.operators import similarity as Y

    rng = np.random.default_rng(11)
    sizes = {("a", "L"): 30, ("b", "L"): 30, ("c", "L"): 27, ("a", "R"): 12, ("b", "R"): 12, ("c", "R"): 12}
    rows = [(s, h, 7 * p + 1, float(rng.normal()), n) for (s, h), n in sizes.items() for p in range(n)]
    m = spark.createDataFrame(rows, "subject string, hemi string, parcel long, u double, n long")
    null = Y.concordance_null(m, 120, 5)
    plan = null._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    got = {r.draw: r.value for r in null.collect()}

    place = F.row_number().over(W.partitionBy("draw", "subject", "hemi").orderBy(F.xxhash64(F.lit(5), "draw", "subject", "hemi", "parcel"), "parcel"))
    at = {}
    for r in m.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(119)))).withColumn("pos", place).collect():
        at.setdefault((r.draw, r.hemi, r.pos), []).append(r.u)
    assert sorted(got) == list(range(120))
    for d in range(120):
        s = {h: sum(x * y for (e, g, _), us in at.items() if (e, g) == (d, h) for x, y in itertools.combinations(us, 2)) for h in "LR"}
        assert got[d] == pytest.approx((s["L"] * 30 + s["R"] * 12) / 42 / 3, abs=1e-9)


def test_coordinates_of_one_network_move_no_other_line_items(spark):
    from netcohort.catalog.fixtures import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    one = t.of_network("Vis").coords()
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, t.coords().filter("network = 'Vis'").collect()))
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :]
    assert any("Filter" in line and "l_suppkey" in line and "Vis" in line for line in below.splitlines())  # under the joins, at the scan


def test_noise_queries_take_one_network(spark, monkeypatch):
    from netcohort.catalog import QUERIES, study_queries

    asked, plain = [], study_queries.coords
    monkeypatch.setattr(study_queries, "coords", lambda t: asked.append(getattr(t, "network", None)) or plain(t))
    for name in ("P35_noise_outcome_screen", "P35_noise_ratio", "P35_noise_signflip", "P36_false_displacement"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == ["Vis"] * 4
