"""Streamlines as point tables ``track, seq, x, y, z`` and their weighted graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.expr import finite, norm
from ..session import cut
from .voxels import XYZ


#: Points of a track that one window orders.
BLOCK = 4096


def segments(points: DataFrame) -> DataFrame:
    """Consecutive point pairs ``track, seq, ax..az, bx..bz``.

    A window inside each block of ``seq`` meets the next point; only the last point
    of a block looks for its successor by a join, so a long track splits freely.
    """
    block = F.floor(F.col("seq") / BLOCK)
    p = points.select("track", "seq", *XYZ, block.alias("_block"))
    nxt = F.lead(F.struct("seq", *XYZ)).over(W.partitionBy("track", "_block").orderBy("seq"))
    inside = p.withColumn("_n", nxt)
    both = lambda d: d.select("track", "seq", *[F.col(c).alias("a" + c) for c in XYZ], *[F.col(f"_n.{c}").alias("b" + c) for c in XYZ])
    within = both(inside.filter(F.col("_n.seq") == F.col("seq") + 1))
    last = p.filter(F.col("seq") % BLOCK == BLOCK - 1).select("track", "seq", *XYZ)
    first = points.filter(F.col("seq") % BLOCK == 0).select("track", (F.col("seq") - 1).alias("seq"), F.struct(*XYZ).alias("_n"))
    return within.unionByName(both(last.join(first, ["track", "seq"])))


def sampling_gate(points: DataFrame, shape, voxel_mm=(1.0, 1.0, 1.0), slack: float = 1e-4) -> DataFrame:
    """Per track: point count, longest segment in mm, and each refusal as a flag.

    Points are in voxel coordinates.
    """
    ok = finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))
    out = F.lit(False)
    for c, n in zip(XYZ, shape):
        out = out | (F.col(c) < -0.5) | (F.col(c) > n - 0.5)
    p = points.groupBy("track").agg(F.count(F.lit(1)).alias("points"), F.count_if(~ok).alias("bad"), F.count_if(out).alias("outside"))
    ln = norm([(F.col("b" + c) - F.col("a" + c)) * float(m) for c, m in zip(XYZ, voxel_mm)])
    s = segments(points).groupBy("track").agg(F.max(ln).alias("max_segment_mm"))
    limit = min(voxel_mm) / 2
    return p.join(s, "track", "left").select(
        "track", "points", "max_segment_mm", ((F.col("points") < 2) | (F.col("bad") > 0)).alias("invalid"),
        (F.coalesce("max_segment_mm", F.lit(0.0)) > limit + slack).alias("sparse"), (F.col("outside") > 0).alias("leaves_grid"),
    )


def segment_cells(points: DataFrame, shape, crossing: bool = False) -> DataFrame:
    """Each segment with the voxel cells it passes, in parametric steps, and a sparse flag.

    A step ends where the segment crosses a plane between cells; at each such point, and
    at both ends, all cells whose closed box holds the point are offered.  Only planes of
    the grid count, so cells grow with the length of a segment inside the grid.  With
    ``crossing`` only segments that touch more than one cell are kept.
    """
    s = segments(points)
    place = lambda c, p: F.col(p + c) + 0.5
    if crossing:
        more = F.lit(False)
        for c in XYZ:
            more = more | (F.floor(F.greatest(place(c, "a"), place(c, "b")) + 1e-8) != F.floor(F.least(place(c, "a"), place(c, "b")) - 1e-8))
        s = s.filter(more)
    wide, steps = F.lit(False), [F.array(F.lit(0.0), F.lit(1.0))]
    for c, n in zip(XYZ, shape):
        low, high = F.least(place(c, "a"), place(c, "b")), F.greatest(place(c, "a"), place(c, "b"))
        wide = wide | (F.floor(high) - F.floor(low - 1e-8) > 1)
        first, last = F.greatest(F.ceil(low - 1e-8), F.lit(0)).cast("int"), F.least(F.floor(high + 1e-8), F.lit(n)).cast("int")
        length = F.col("b" + c) - F.col("a" + c)
        at = F.transform(F.sequence(first, last), lambda k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k - place(c, "a")) / length)))
        steps.append(F.when((F.abs(length) >= 1e-12) & (first <= last), at).otherwise(F.array().cast("array<double>")))

    def cells(t):
        around = []
        for c, n in zip(XYZ, shape):
            p = place(c, "a") + t * (F.col("b" + c) - F.col("a" + c))
            both = F.array_distinct(F.array(F.floor(p - 1e-8).cast("int"), F.floor(p + 1e-8).cast("int")))
            around.append(F.filter(both, lambda k: (k >= 0) & (k < n)))
        line = lambda x, y: F.transform(around[2], lambda z: F.struct(x.alias("x"), y.alias("y"), z.alias("z")))
        return F.flatten(F.transform(around[0], lambda x: F.flatten(F.transform(around[1], lambda y: line(x, y)))))

    met = F.array_distinct(F.flatten(F.transform(F.array_distinct(F.flatten(F.array(*steps))), cells)))
    return s.withColumn("too_sparse", wide).withColumn("_met", met).select(*s.columns, "too_sparse", F.inline("_met"))


def _slab_hit():
    """Closed box of half width one half around the cell meets the segment."""
    near, far, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for c in XYZ:
        a, d, cell = F.col("a" + c), F.col("b" + c) - F.col("a" + c), F.col(c)
        zero = F.abs(d) < 1e-12
        t1, t2 = (cell - 0.5 - a) / d, (cell + 0.5 - a) / d
        near = F.greatest(near, F.when(~zero, F.least(t1, t2)))
        far = F.least(far, F.when(~zero, F.greatest(t1, t2)))
        outside = outside | (zero & ((a < cell - 0.5) | (a > cell + 0.5)))
    return ~outside & (near <= far)


def crossing_tracks(points: DataFrame, mask: DataFrame, shape, strict: bool = False) -> DataFrame:
    """Tracks with a segment that meets any closed mask voxel: ``track``.

    A track of two points or more with a point inside a closed mask voxel is hit: those
    need no segment.  Of the other tracks a segment that stays within one cell cannot hit;
    for the rest the predicate becomes an equi-join on the cell, then the slab test.
    Segments of any length are tested in full; strict mode refuses those that
    span more than two cells along an axis.  Tracks whose points are not numbered
    without gaps are refused, since a segment would be lost there.
    """
    require_gapless(points)
    if strict:
        require_dense(points)
    pack = lambda c: (c["x"] + shape[0] * (c["y"] + shape[1] * c["z"].cast("long"))).alias("_cell")
    solid = cut(mask.select(pack({c: F.col(c) for c in XYZ})).distinct())
    on_grid = F.lit(True)
    for c, n in zip(XYZ, shape):
        on_grid = on_grid & (F.col(c) + 0.5 >= 0) & (F.col(c) + 0.5 < n)
    at = points.filter(on_grid).select("track", pack({c: F.floor(F.col(c) + 0.5) for c in XYZ}))
    several = points.groupBy("track").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    inside = cut(at.join(solid, "_cell", "left_semi").select("track").distinct().join(several, "track", "left_semi").select("track"))
    rest = cut(points.join(inside, "track", "left_anti"))
    s = segment_cells(rest, shape, crossing=True).drop("too_sparse")
    met = s.withColumn("_cell", pack({c: F.col(c) for c in XYZ})).join(solid, "_cell").filter(_slab_hit()).select("track").distinct()
    return inside.unionByName(met)


def gapped_tracks(points: DataFrame) -> DataFrame:
    """Tracks whose ``seq`` leaves out or repeats a number."""
    n = points.groupBy("track").agg(F.count(F.lit(1)).alias("c"), F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count_if(F.col("seq").isNull()).alias("none"))
    return n.filter("none > 0 OR hi - lo + 1 <> c").select("track")


def require_gapless(points: DataFrame) -> None:
    """Refuse points whose numbers leave gaps."""
    first = gapped_tracks(points).take(1)
    if first:
        raise ValueError(f"the points of track {first[0].track} are not numbered without gaps")


def require_dense(points: DataFrame) -> None:
    """Refuse tracks whose sampling is too sparse for the mask's voxels."""
    first = too_sparse_tracks(points).take(1)
    if first:
        raise ValueError(f"track {first[0].track} has a segment that spans more than two cells")


def too_sparse_tracks(points: DataFrame) -> DataFrame:
    """Tracks with a segment that spans more than two cells along an axis."""
    s = segments(points)
    wide = F.lit(False)
    for c in XYZ:
        wide = wide | (F.floor(F.greatest("a" + c, "b" + c) + 0.5) - F.floor(F.least("a" + c, "b" + c) + 0.5 - 1e-8) > 1)
    return s.filter(wide).select("track").distinct()


def segment_exclude(points: DataFrame, mask: DataFrame, shape, strict: bool = False) -> DataFrame:
    """Points of the tracks that never touch the mask."""
    return points.join(crossing_tracks(points, mask, shape, strict), "track", "left_anti")


def exclusion_audit(before: DataFrame, retained: DataFrame, mask: DataFrame, shape) -> DataFrame:
    """Counts in, removed and kept, and hits found again on the kept tracks."""
    one = lambda d: d.withColumn("_1", F.lit(1))
    n_in = before.agg(F.countDistinct("track").alias("input_streamlines"))
    kept = retained.agg(F.countDistinct("track").alias("retained_streamlines"))
    hits = crossing_tracks(retained, mask, shape).agg(F.count(F.lit(1)).alias("mask_intersections"))
    j = one(n_in).join(one(kept), "_1").join(one(hits), "_1").drop("_1")
    return j.withColumn("additional_removed", F.col("input_streamlines") - F.col("retained_streamlines")).withColumn(
        "accepted", (F.col("retained_streamlines") > 0) & (F.col("mask_intersections") == 0)
    )


def weights_audit(weights: DataFrame, retained: DataFrame, mu: DataFrame) -> DataFrame:
    """Weight count against retained tracks, value checks, sum, zeros and the one mu."""
    one = lambda d: d.withColumn("_1", F.lit(1))
    w = weights.agg(
        F.count(F.lit(1)).alias("weight_count"), F.sum("w").alias("weight_sum"), F.count_if(F.col("w") == 0).alias("zero_weights"),
        F.count_if(~finite(F.col("w")) | (F.col("w") < 0)).alias("bad_weights"),
    )
    r = retained.agg(F.countDistinct("track").alias("retained"))
    m = mu.agg(F.count(F.lit(1)).alias("mu_rows"), F.max("mu").alias("mu"))
    j = one(w).join(one(r), "_1").join(one(m), "_1").drop("_1")
    return j.withColumn(
        "accepted",
        (F.col("weight_count") == F.col("retained")) & (F.col("bad_weights") == 0) & (F.col("weight_sum") > 0) & (F.col("mu_rows") == 1) & (F.col("mu") > 0),
    )


def build_connectome(assignments: DataFrame, keys: list[str]) -> DataFrame:
    """Undirected weight sums over assigned, distinct labels."""
    return (
        assignments.filter("a > 0 and b > 0 and a <> b")
        .groupBy(*keys, F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.sum("w").alias("w"))
    )


def matrix_weight_audit(matrix: DataFrame, assignments: DataFrame, keys: list[str], rtol: float = 1e-5, atol: float = 1e-7) -> DataFrame:
    """Matrix against an independent endpoint sum, with used and discarded counts."""
    used = F.expr("a > 0 and b > 0 and a <> b")
    k = [*keys, "i", "j"]
    again = assignments.filter(used).select(*keys, F.sort_array(F.array("a", "b")).alias("e"), "w").groupBy(
        *keys, F.get("e", F.lit(0)).alias("i"), F.get("e", F.lit(1)).alias("j")
    ).agg(F.sum("w").alias("expected"))
    j = matrix.join(again, k, "full")
    x, e = F.coalesce("w", F.lit(0.0)), F.coalesce("expected", F.lit(0.0))
    cmp = j.groupBy(*keys).agg(
        F.max(F.abs(x - e)).alias("max_absolute_error"), F.bool_and(F.abs(x - e) <= atol + rtol * F.abs(e)).alias("passed"),
        F.sum(x).alias("matrix_upper_triangle_sum"),
    )
    tot = assignments.groupBy(*keys).agg(
        F.count_if(used).alias("assigned_nonself_tracks"), F.count_if(~used).alias("discarded_tracks"),
        F.sum(F.when(used, F.col("w")).otherwise(0.0)).alias("assigned_weight_sum"),
    )
    return tot.join(cmp, keys)


def track_ends(points: DataFrame) -> DataFrame:
    """First and last point of each track: ``track, side, x, y, z``."""
    pt = F.struct(*XYZ)
    e = points.groupBy("track").agg(F.min_by(pt, "seq").alias("a"), F.max_by(pt, "seq").alias("b"))
    return e.select("track", F.explode(F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b"))).alias("side", "p")).select("track", "side", "p.*")


def endpoint_label(points: DataFrame, atlas: DataFrame, radius: float) -> DataFrame:
    """``track, a, b``: label of the nearest atlas voxel within the radius, else 0.

    Each end offers only the cells of its own ball and meets the atlas by equality.
    """
    e = track_ends(points)
    near = e
    for c in XYZ:
        near = near.withColumn("c" + c, F.explode(F.sequence(F.ceil(F.col(c) - radius).cast("int"), F.floor(F.col(c) + radius).cast("int"))))
    d = norm([F.col("c" + c) - F.col(c) for c in XYZ])
    near = near.withColumn("d", d).filter(F.col("d") <= radius)
    lab = atlas.filter("label > 0").select(*[F.col(c).alias("c" + c) for c in XYZ], "label")
    best = near.join(lab, ["cx", "cy", "cz"]).groupBy("track", "side").agg(F.min(F.struct(F.round("d", 9).alias("d"), "label")).alias("m"))
    full = e.select("track", "side").join(best.select("track", "side", F.col("m.label").alias("label")), ["track", "side"], "left")
    v = F.coalesce("label", F.lit(0))
    return full.groupBy("track").agg(F.max(F.when(F.col("side") == "a", v)).alias("a"), F.max(F.when(F.col("side") == "b", v)).alias("b"))
