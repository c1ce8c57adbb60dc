"""Sparse images as voxel tables ``image_id, x, y, z[, v]`` on a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import order as O
from ..functions.expr import checked, det3, norm
from ..session import cut, dealt
from .iterate import connected_components, union_all

XYZ = ["x", "y", "z"]
IMG = ["image_id", *XYZ]
FACES = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def inside(shape) -> Column:
    return (F.col("x") >= 0) & (F.col("x") < shape[0]) & (F.col("y") >= 0) & (F.col("y") < shape[1]) & (F.col("z") >= 0) & (F.col("z") < shape[2])


def _offsets(steps) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for a, b, c in steps])


def world(affine, i, j, k) -> list[Column]:
    """Millimetre position of a voxel index under a row-major 4x4."""
    a = [float(v) for v in affine]
    return [a[4 * r] * i + a[4 * r + 1] * j + a[4 * r + 2] * k + F.lit(a[4 * r + 3]) for r in range(3)]


def voxel_volume(affine) -> Column:
    a = [F.lit(float(affine[4 * r + c])) for r in range(3) for c in range(3)]
    return F.abs(det3(a))


def _box(lo: list[Column], hi: list[Column], shape) -> Column:
    """All voxel indices of a clipped box, as an array of structs."""
    rng = [F.sequence(F.greatest(F.floor(lo[i]).cast("int"), F.lit(0)), F.least(F.ceil(hi[i]).cast("int"), F.lit(shape[i] - 1))) for i in range(3)]
    ok = [F.greatest(F.floor(lo[i]).cast("int"), F.lit(0)) <= F.least(F.ceil(hi[i]).cast("int"), F.lit(shape[i] - 1)) for i in range(3)]
    return rng, ok[0] & ok[1] & ok[2]


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt over all cores by ``keys`` before each becomes many: a small file is one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def tube_mask(segments: DataFrame, shape, affine, radius: float) -> DataFrame:
    """``image_id, path, x, y, z``: voxels within ``radius`` mm of a polyline.

    ``segments`` holds ``image_id, path, ax..az, bx..bz`` in millimetres.  Each
    segment offers only the voxels of its own padded bounding box.
    """
    import numpy as np

    inv = np.linalg.inv(np.array(affine, dtype=float).reshape(4, 4))
    ends = [[F.col(p + c) for c in "xyz"] for p in "ab"]
    vox = [world(inv.ravel(), *e) for e in ends]
    # a ball of the radius reaches at most |row of the inverse| * radius voxels along each axis
    pad = [float(np.linalg.norm(inv[r, :3]) * radius) for r in range(3)]
    lo = [F.least(vox[0][i], vox[1][i]) - pad[i] for i in range(3)]
    hi = [F.greatest(vox[0][i], vox[1][i]) + pad[i] for i in range(3)]
    return within_reach(segments, ["image_id", "path"], [p + c for p in "ab" for c in XYZ], lo, hi, shape, affine, _to_segment, radius).distinct()


def _to_segment(p, ends):
    """Distance of points from segments ``ax..bz``, the projection clipped to the ends."""
    import numpy as np

    a, d = ends[:3], [q - r for q, r in zip(ends[3:], ends[:3])]
    l2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    t = sum((p[i] - a[i]) * d[i] for i in range(3)) / np.where(l2 > 0, l2, 1.0)
    t = np.maximum(0.0, np.minimum(1.0, t))
    return _to_point(p, [a[i] + t * d[i] for i in range(3)])


def _to_point(p, at):
    import numpy as np

    d = [q - r for q, r in zip(p, at)]
    return np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


#: Voxels of boxes that are judged at once.
JUDGED = 1 << 19


def within_reach(rows: DataFrame, keep: list[str], place: list[str], lo: list[Column], hi: list[Column], shape, affine, distance, radius) -> DataFrame:
    """``keep, x, y, z``: voxels of each row's box that lie within ``radius`` of its ``place``.

    Rows are dealt over all cores by their planes in x; numpy judges a plane's voxels.
    """
    rng, ok = _box(lo, hi, shape)
    reach = F.col(radius) if isinstance(radius, str) else F.lit(float(radius))
    ends = [F.element_at(rng[i], at).alias(c) for i, n in ((1, "y"), (2, "z")) for at, c in ((1, f"_{n}0"), (-1, f"_{n}1"))]
    planes = spread(rows.filter(ok), *keep).select(*keep, *[F.col(c).cast("double").alias("_" + c) for c in place], reach.cast("double").alias("_reach"), *ends, F.explode(rng[0]).alias("x"))
    m = [float(v) for v in affine]

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            ny, nz = ((pdf[f"_{c}1"] - pdf[f"_{c}0"] + 1).to_numpy() for c in "yz")
            many = ny * nz
            group = (np.cumsum(many) - many) // JUDGED
            for g in np.unique(group):
                part = np.flatnonzero(group == g)
                row = np.repeat(part, many[part])
                at = np.arange(len(row)) - np.repeat(np.cumsum(many[part]) - many[part], many[part])
                take = lambda c: pdf[c].to_numpy()[row]
                x, y, z = take("x"), take("_y0") + at // nz[row], take("_z0") + at % nz[row]
                p = [m[4 * r] * x + m[4 * r + 1] * y + m[4 * r + 2] * z + m[4 * r + 3] for r in range(3)]
                near = distance(p, [take("_" + c) for c in place]) <= take("_reach")
                out = {c: pdf[c].to_numpy()[row[near]] for c in keep}
                yield pd.DataFrame({**out, "x": x[near].astype("int32"), "y": y[near].astype("int32"), "z": z[near].astype("int32")})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return planes.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", x int, y int, z int")


def unproductive_paths(tube: DataFrame, segments: DataFrame) -> DataFrame:
    """Paths that add no voxel beyond the earlier paths of their image."""
    first = tube.groupBy(*IMG).agg(F.min("path").alias("path")).groupBy("image_id", "path").agg(F.count(F.lit(1)).alias("added"))
    return segments.select("image_id", "path").distinct().join(first, ["image_id", "path"], "left_anti")


def dilate6(mask: DataFrame, shape, passes: int = 1) -> DataFrame:
    """Six-neighbour dilation clipped to the grid."""
    out = mask.select(*IMG)
    for _ in range(passes):
        o = out.select("image_id", *XYZ, F.explode(_offsets(FACES)).alias("o"))
        out = o.select("image_id", *[(F.col(c) + F.col("o.d" + c)).alias(c) for c in XYZ]).filter(inside(shape)).distinct()
    return out


def pack(shape) -> Column:
    return (F.col("x") + shape[0] * (F.col("y") + shape[1] * F.col("z").cast("long"))).alias("node")


def label_components(mask: DataFrame, shape, connectivity: int = 6, keys=("image_id",)) -> DataFrame:
    """``keys, x, y, z, root``: connected components, named by smallest packed index."""
    if connectivity == 6:
        steps = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    elif connectivity == 26:
        steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (c, b, a) > (0, 0, 0)]
    else:
        raise ValueError("connectivity is 6 or 26")
    k = list(keys)
    side = [F.floor(F.col(c) / BLOCK).cast("int").alias("_b" + c) for c in XYZ]
    kinds = {f.name: f.dataType.simpleString() for f in mask.schema}
    ddl = ", ".join(f"{c} {kinds[c]}" for c in k) + ", x int, y int, z int, node long, part long"
    m = cut(mask.select(*k, *[F.col(c).cast("int").alias(c) for c in XYZ], pack(shape)).select("*", *side))
    blocks = [*k, *["_b" + c for c in XYZ]]
    parts = cut(dealt(m, m.count(), *blocks).groupBy(*blocks).applyInPandas(_label_block(k, steps), ddl))
    # what blocks leave open: neighbours across a face of a block
    edge = F.lit(False)
    for c in XYZ:
        edge = edge | (F.col(c) % BLOCK == 0) | (F.col(c) % BLOCK == BLOCK - 1)
    rim = parts.filter(edge)
    away = F.lit(False)
    for c in XYZ:
        away = away | (F.floor((F.col(c) + F.col("o.d" + c)) / BLOCK) != F.floor(F.col(c) / BLOCK))
    moved = rim.select(*k, F.col("part").alias("i"), *XYZ, F.explode(_offsets(steps)).alias("o")).filter(away)
    moved = cut(moved.select(*k, "i", *[(F.col(c) + F.col("o.d" + c)).alias(c) for c in XYZ]))
    rows = moved.count()
    met = dealt(moved, rows, *k, *XYZ).hint("merge").join(dealt(rim.select(*k, *XYZ, F.col("part").alias("j")), rows, *k, *XYZ), [*k, *XYZ])
    edges = cut(met.filter("i <> j").select(*k, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct())
    ends = edges.select(*k, F.explode(F.array("i", "j")).alias("node")).distinct()
    comp = connected_components(ends, edges, k).select(*k, F.col("node").alias("part"), F.col("root").alias("_r"))
    return parts.join(comp, [*k, "part"], "left").select(*k, *XYZ, F.coalesce("_r", "part").alias("root"))


#: Side of the cubes that one task labels by itself.
BLOCK = 32


def _label_block(keys: list[str], steps):
    def run(pdf):
        import numpy as np

        at = pdf[list(XYZ)].to_numpy() % BLOCK
        grid = np.full((BLOCK + 2,) * 3, -1, np.int64)
        name = np.arange(len(pdf))
        order = np.argsort(pdf["node"].to_numpy(), kind="stable")  # the least node comes first and names its part
        at = at[order]
        grid[at[:, 0] + 1, at[:, 1] + 1, at[:, 2] + 1] = name
        pairs = []
        for step in steps:
            other = grid[at[:, 0] + 1 + step[0], at[:, 1] + 1 + step[1], at[:, 2] + 1 + step[2]]
            pairs.append(np.stack([name[other >= 0], other[other >= 0]]))
        a, b = np.concatenate(pairs, 1)
        root = name.copy()
        while True:  # hook the larger root of a pair to the smaller, then flatten
            x, y = root[a], root[b]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root = root[root]
        out = pdf.iloc[order][[*keys, *XYZ, "node"]].copy()
        out["part"] = out["node"].to_numpy()[root]
        return out

    return run


def mask_qc(mask: DataFrame, shape, affine) -> DataFrame:
    comp = label_components(mask, shape, 6)
    return comp.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("voxels"), (F.count(F.lit(1)) * voxel_volume(affine)).alias("volume_mm3"), F.countDistinct("root").alias("components_6_connected")
    )


def mask_union(masks: list[DataFrame]) -> DataFrame:
    if len(masks) < 2:
        raise ValueError("a union needs at least two masks")
    out = masks[0].select(*IMG)
    for m in masks[1:]:
        out = out.unionByName(m.select(*IMG))
    return out.distinct()


def mask_repair(mask: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """(mask + add) - remove, in one pass: a voxel stays if no row of it is removed."""
    tag = lambda d, out: d.select(*IMG, F.lit(out).alias("_out"))
    every = cut(union_all([tag(mask, False), tag(add, False), tag(remove, True)]))
    voxels = dealt(every, every.count(), *IMG).groupBy(*IMG).agg(F.bool_or("_out").alias("_out"))
    return voxels.filter("NOT _out").select(*IMG)


def repair_guard(mask: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """Per image: sizes and the overlaps a repair must not have."""
    tag = lambda d, c: d.select(*IMG).distinct().withColumn(c, F.lit(1))
    j = tag(mask, "m").join(tag(add, "a"), IMG, "full").join(tag(remove, "r"), IMG, "full").fillna(0, ["m", "a", "r"])
    hit = lambda c: F.count_if(F.expr(c))
    return j.groupBy("image_id").agg(
        hit("a=1").alias("added_voxels"), hit("r=1").alias("removed_voxels"), hit("a=1 and r=1").alias("add_remove_conflict"),
        hit("r=1 and m=0").alias("remove_outside"), hit("a=1 and m=1").alias("add_inside"), hit("(m=1 or a=1) and r=0").alias("result_voxels"),
    )


def binary_check(image: DataFrame) -> DataFrame:
    return image.groupBy("image_id").agg(
        F.count_if(~F.col("v").isin(0.0, 1.0)).alias("not_binary"), F.count_if(F.col("v") == 1.0).alias("ones")
    ).withColumn("valid", (F.col("not_binary") == 0) & (F.col("ones") > 0))


def hybrid_atlas(surface: DataFrame, left: DataFrame, right: DataFrame, nodes: DataFrame) -> DataFrame:
    """``image_id, x, y, z, label, claims``: cortex codes first, then the side images.

    Surface codes 1001..1200 name cortex 1..200 and 2001..2200 name 201..400.
    More than one claim on a voxel is an overlap the caller must refuse.
    """
    code = F.col("code")
    source = F.when(code.between(1001, 1200), code - 1000).when(code.between(2001, 2200), code - 1800)
    cort = surface.select(*IMG, source.alias("source_label")).filter("source_label is not null")
    n = F.broadcast(nodes.select("label", "hemi", "tissue", "source_label"))
    c = cort.join(n.filter("tissue = 'cortex'"), "source_label").select(*IMG, "label")
    deep = left.select(*IMG, F.col("code").alias("source_label"), F.lit("L").alias("hemi")).unionByName(
        right.select(*IMG, F.col("code").alias("source_label"), F.lit("R").alias("hemi"))
    )
    d = deep.join(n.filter("tissue <> 'cortex'"), ["source_label", "hemi"]).join(cort.select(*IMG), IMG, "left_anti").select(*IMG, "label")
    return c.unionByName(d).groupBy(*IMG).agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("claims"))


def refused(rows: DataFrame, violations: DataFrame, message: str) -> DataFrame:
    """``rows``; a query that reads them fails if ``violations`` names an image."""
    named = violations.groupBy("image_id").agg(F.count(F.lit(1)).cast("string").alias("_c"))  # by its count no filter moves before the violations
    said = F.concat(F.lit(message + ": "), F.col("image_id").cast("string"), F.substring("_c", 1, 0))
    stop = named.filter(F.raise_error(said).cast("boolean"))
    return rows.unionByName(stop.select("image_id"), allowMissingColumns=True)


def without_white_matter(normalized: DataFrame) -> DataFrame:
    """``image_id`` of images whose third fraction is positive nowhere."""
    return normalized.groupBy("image_id").agg(F.max(F.get("f", F.lit(2))).alias("_m")).filter("coalesce(_m, 0) <= 0").select("image_id")


def normalize_five_tissue(voxels: DataFrame) -> DataFrame:
    """Clip five fractions to [0, 1] and scale them to sum one; all-zero stays zero.

    An image without white matter, the third fraction, is refused.
    """
    clip = F.transform("f", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    d = voxels.withColumn("f", clip).withColumn("_t", F.aggregate("f", F.lit(0.0), lambda a, v: a + v))
    d = d.withColumn("f", F.when(F.col("_t") > 0, F.transform("f", lambda v: v / F.col("_t"))).otherwise(F.col("f"))).drop("_t")
    return refused(d, without_white_matter(d), "no white matter")


def argmax_tissue(voxels: DataFrame) -> DataFrame:
    """Tissue label of the first largest fraction; less than half in total is 0."""
    # Label of each of the five fractions.
    labels = F.array(*[F.lit(v) for v in (3, 3, 2, 1, 0)])
    total = F.aggregate("f", F.lit(0.0), lambda a, v: a + v)
    best = F.array_position("f", F.array_max("f")).cast("int")
    return voxels.withColumn("tissue", F.when(total < 0.5, 0).otherwise(F.element_at(labels, best)))


def rim(near: DataFrame, shape, width: int = 2) -> DataFrame:
    return dilate6(near, shape, width).join(near.select(*IMG), IMG, "left_anti")


def seeded_void(near: DataFrame, core: DataFrame, mri: DataFrame, brain: DataFrame, shape, fraction: float, minimum: int = 20) -> DataFrame:
    """Dark corridor components that touch the core.

    The threshold is ``fraction`` of the exact median signal in a two-voxel rim.
    An image with fewer than ``minimum`` rim voxels is refused.
    """
    signal = cut(mri.filter("v > 0").join(brain.select(*IMG), IMG, "left_semi").select(*IMG, "v"))
    around = cut(signal.join(rim(near, shape), IMG, "left_semi"))
    thr = O.median(around, ["image_id"], "v", "m").join(
        around.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")), "image_id"
    ).select("image_id", checked(F.col("m") * fraction, F.col("n") >= minimum, f"an image has fewer than {minimum} rim voxels").alias("thr"))
    dark = cut(mri.join(brain.select(*IMG), IMG, "left_semi").join(near.select(*IMG), IMG, "left_semi").join(thr, "image_id").filter("v < thr").select(*IMG))
    comp = cut(label_components(dark, shape, 6))
    touched = comp.join(core.select(*IMG), IMG, "left_semi").select("image_id", "root").distinct()
    return comp.join(touched, ["image_id", "root"], "left_semi").select(*IMG)


def compose_mask(core: DataFrame, near: DataFrame, ct: DataFrame, void: DataFrame, shape, threshold: float, passes: int = 1) -> DataFrame:
    """dilate(core + metal + void) with metal = corridor voxels at or above the threshold."""
    metal = ct.filter(F.col("v") >= threshold).join(near.select(*IMG), IMG, "left_semi")
    return dilate6(mask_union([core, metal, void]), shape, passes)


def sphere_edits(mask: DataFrame, edits: DataFrame, shape, affine) -> DataFrame:
    """Ordered add/erase spheres ``image_id, seq, action, px, py, pz, radius``; the last edit of a voxel wins."""
    hit = _ball(edits, shape, affine, F.col("radius"), ["image_id", "seq", "action"])
    last = hit.groupBy(*IMG).agg(F.max_by("action", "seq").alias("action"))
    kept = mask.select(*IMG).join(last, IMG, "left_anti")
    return kept.unionByName(last.filter("action = 'add'").select(*IMG))


def _ball(points: DataFrame, shape, affine, radius: Column, keep: list[str]) -> DataFrame:
    import numpy as np

    inv = np.linalg.inv(np.array(affine, dtype=float).reshape(4, 4))
    c = [F.col("p" + a) for a in XYZ]
    v = world(inv.ravel(), *c)
    reach = [float(np.linalg.norm(inv[r, :3])) for r in range(3)]
    lo, hi = [v[i] - radius * reach[i] for i in range(3)], [v[i] + radius * reach[i] for i in range(3)]
    return within_reach(points.withColumn("_radius", radius), keep, ["p" + a for a in XYZ], lo, hi, shape, affine, _to_point, "_radius")


def paint_spheres(points: DataFrame, shape, affine, radius: float = 3.5) -> DataFrame:
    """Label spheres around points ``image_id, ord, label, px, py, pz``; later paint wins."""
    hit = _ball(points, shape, affine, F.lit(radius), ["image_id", "ord", "label"])
    return hit.groupBy(*IMG).agg(F.max_by("label", "ord").alias("label"))


def fill_holes(mask: DataFrame, shape) -> DataFrame:
    """Add background that no face path connects to the border.

    Only background between two mask voxels of a line along x can be closed off; it is
    labelled, and a component that touches other background beside it is open.  Rows
    grow with these gaps, not with the grid.
    """
    solid = cut(mask.select(*IMG).distinct())
    after = F.lead("x").over(W.partitionBy("image_id", "y", "z").orderBy("x"))
    gaps = solid.withColumn("_after", after).filter("_after > x + 1")
    gaps = gaps.select("image_id", F.explode(F.expr("sequence(x + 1, _after - 1)")).alias("x"), "y", "z")
    comp = cut(label_components(gaps, shape, 6))
    step = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(z).alias("z")) for y, z in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    beside = comp.withColumn("_s", F.explode(step)).select("root", "image_id", "x", *[(F.col(c) + F.col(f"_s.{c}")).alias(c) for c in "yz"])
    known = solid.unionByName(comp.select(*IMG))
    open_roots = beside.join(known, IMG, "left_anti").select("image_id", "root").distinct()
    holes = comp.join(open_roots, ["image_id", "root"], "left_anti").select(*IMG)
    return mask.select(*IMG).unionByName(holes)


def parcel_centroids(atlas: DataFrame, affine) -> DataFrame:
    c = atlas.filter("label > 0").groupBy("image_id", "label").agg(*[F.avg(a).alias("c" + a) for a in XYZ])
    w = world(affine, F.col("cx"), F.col("cy"), F.col("cz"))
    return c.select("image_id", "label", *[w[i].alias("m" + a) for i, a in enumerate(XYZ)])


#: Edge of the first search cells in millimetres, and doublings of it.
SEARCH_MM, WIDEST = 8.0, 24


def parcel_distance(atlas: DataFrame, mask: DataFrame, affine) -> DataFrame:
    """Parcel centroid to the nearest mask voxel centre, in millimetres.

    Space is hashed into cells; a centroid meets the voxels of its cell and the 26 around
    it.  A distance within the cells' edge is settled, since nothing nearer lies
    elsewhere; the other centroids go on with cells twice as wide.  An image without mask
    voxels gives no rows.
    """
    w = world(affine, F.col("x"), F.col("y"), F.col("z"))
    voxels = cut(mask.select("image_id", *[w[i].alias("w" + a) for i, a in enumerate(XYZ)]))
    open_ = cut(parcel_centroids(atlas, affine).join(voxels.select("image_id").distinct(), "image_id", "left_semi"))
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    settled = []
    for level in range(WIDEST):
        edge = SEARCH_MM * 2**level
        cell = lambda p: [F.floor(F.col(p + a) / edge).cast("long") for a in XYZ]
        asked = open_
        for a, c in zip(XYZ, cell("m")):
            asked = asked.withColumn("_d", F.explode(around)).withColumn("_" + a, c + F.col("_d")).drop("_d")
        near = voxels.select("*", *[c.alias("_" + a) for a, c in zip(XYZ, cell("w"))])
        d = norm([F.col("w" + a) - F.col("m" + a) for a in XYZ])
        best = asked.join(near, ["image_id", *["_" + a for a in XYZ]]).groupBy("image_id", "label").agg(F.min(d).alias("distance_mm"))
        now = cut(open_.join(best, ["image_id", "label"], "left").withColumn("_done", F.coalesce(F.col("distance_mm") <= edge, F.lit(False))))
        settled.append(now.filter("_done").select("image_id", "label", "distance_mm"))
        open_ = now.filter("NOT _done").drop("distance_mm", "_done")
        if open_.isEmpty():
            return union_all(settled)
    raise RuntimeError("mask voxels lie beyond the widest search")


def dice(pairs: DataFrame, masks: DataFrame) -> DataFrame:
    """Overlap 2|a&b|/(|a|+|b|) of listed image pairs ``a, b``; an empty mask gives no row.

    The voxels of a cube of side 4 travel as the bits of one number; the cubes of listed
    pairs are dealt over tasks by their number.
    """
    cube = [F.floor(F.col(c) / 4).cast("int").alias("_" + c) for c in XYZ]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), sum((F.pmod(F.col(c), F.lit(4)) * 4**i for i, c in enumerate(XYZ)), F.lit(0)).cast("int"))
    at = ["_" + c for c in XYZ]
    cubes = cut(masks.groupBy("image_id", *cube).agg(F.bit_or(bit).alias("_bits")))
    size = cut(cubes.groupBy("image_id").agg(F.sum(F.bit_count("_bits")).alias("n"), F.count(F.lit(1)).alias("_c")))
    both = cut(pairs.join(size.select(F.col("image_id").alias("a"), F.col("n").alias("na"), F.col("_c")), "a").join(
        size.select(F.col("image_id").alias("b"), F.col("n").alias("nb")), "b"
    ))
    rows = max(both.agg(F.sum("_c")).first()[0] or 0, cubes.count())
    mine = lambda side, bits: cubes.select(F.col("image_id").alias(side), *at, F.col("_bits").alias(bits))
    left = dealt(both.select("a", "b"), rows, "a").join(dealt(mine("a", "_l"), rows, "a"), "a")
    met = dealt(left, rows, "b", *at).hint("merge").join(dealt(mine("b", "_r"), rows, "b", *at), ["b", *at])
    inter = met.groupBy("a", "b").agg(F.sum(F.bit_count(F.col("_l").bitwiseAND(F.col("_r")))).alias("i"))
    j = both.join(inter, ["a", "b"], "left").fillna(0, ["i"])
    return j.select("a", "b", (2.0 * F.col("i") / (F.col("na") + F.col("nb"))).alias("dice"))


def symmetric_mean(directed: DataFrame) -> DataFrame:
    """Mean of the two directions of each pair."""
    return directed.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.avg("dice").alias("dice"))


def label_boundary(atlas: DataFrame, shape) -> DataFrame:
    """Labelled voxels that differ from the previous voxel along any axis, wrapping at the edge."""
    a = atlas.filter("label > 0").select(*IMG, "label")
    o = a.select(*IMG, "label", F.explode(_offsets([(1, 0, 0), (0, 1, 0), (0, 0, 1)])).alias("o")).select(
        "image_id", "label", *XYZ, *[F.pmod(F.col(c) - F.col("o.d" + c), F.lit(n)).cast("int").alias("q" + c) for c, n in zip(XYZ, shape)]
    )
    prev = a.select("image_id", *[F.col(c).alias("q" + c) for c in XYZ], F.col("label").alias("other"))
    j = o.join(prev, ["image_id", "qx", "qy", "qz"], "left")
    return j.filter(F.coalesce("other", F.lit(0)) != F.col("label")).select(*IMG, "label").distinct()


def display_window(image: DataFrame, low: float, high: float, positive: bool = True) -> DataFrame:
    """Percentile window mapped to 0..255 and floored."""
    img = cut(image.select(*IMG, F.col("v").cast("double").alias("v")))
    q = O.quantiles(img.filter("v > 0") if positive else img, ["image_id"], "v", {"lo": low / 100.0, "hi": high / 100.0})
    span = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("lo")) / span))
    return img.join(q, "image_id").select(*IMG, F.floor(t * 255).cast("int").alias("shade"))


def missing_labels(atlas: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node labels absent from an image."""
    have = atlas.select("image_id", "label").distinct()
    want = have.select("image_id").distinct().withColumn("_1", F.lit(1)).join(
        F.broadcast(nodes.agg(F.collect_set("label").alias("b")).withColumn("_1", F.lit(1))), "_1"
    ).select("image_id", F.explode("b").alias("label"))
    return want.join(have, ["image_id", "label"], "left_anti")


def threshold_volume(field: DataFrame, threshold: float, affine) -> DataFrame:
    """Voxel count and volume where a V/m field reaches ``threshold`` V/mm."""
    return field.groupBy("image_id").agg(
        F.count_if(F.col("v") / 1000.0 >= threshold).alias("voxel_count"),
        (F.count_if(F.col("v") / 1000.0 >= threshold) * voxel_volume(affine)).alias("volume_mm3"),
        (F.max("v") / 1000.0).alias("max_v_per_mm"), F.count_if(F.col("v") < 0).alias("negative"),
    )


def volume_difference_percent(volumes: DataFrame) -> DataFrame:
    """100 |v2 - v1| / mean(v1, v2) for pairs ``a, b, v1, v2``."""
    return volumes.withColumn("percent", 100 * F.abs(F.col("v2") - F.col("v1")) / ((F.col("v1") + F.col("v2")) / 2))


def grid_check(grids: DataFrame, reference: DataFrame, atol: float = 1e-5) -> DataFrame:
    """Shape, affine and invertibility of every grid against the one reference row."""
    r = reference.select(F.col("shape").alias("rs"), F.col("affine").alias("ra"))
    d = grids.withColumn("_1", F.lit(1)).join(F.broadcast(r.withColumn("_1", F.lit(1))), "_1").drop("_1")
    gap = F.array_max(F.zip_with("affine", "ra", lambda a, b: F.abs(a - b)))
    det = det3([F.get("affine", F.lit(4 * i + j)) for i in range(3) for j in range(3)])
    return d.select(
        "image_id", (F.col("shape") == F.col("rs")).alias("same_shape"), (gap <= atol).alias("same_affine"), (F.abs(det) < 1e-12).alias("singular")
    )


def fingerprint(voxels: DataFrame) -> DataFrame:
    """One digest per image from its decoded values: slab lines, slabs, image.

    A digest is taken per (image, z, y) line, then per slab, then per image, so
    no task ever holds more than one line, one slab's digests or one image's.
    """
    cell = F.concat_ws(",", "x", F.col("v").cast("string"))
    line = voxels.groupBy("image_id", "z", "y").agg(F.array_sort(F.collect_list(F.struct("x", cell.alias("c")))).alias("c"))
    line = line.select("image_id", "z", "y", F.sha2(F.concat_ws(";", F.col("c.c")), 256).alias("h"))
    for axis in ("y", "z"):
        rest = ["image_id"] + (["z"] if axis == "y" else [])
        line = line.groupBy(*rest).agg(F.array_sort(F.collect_list(F.struct(axis, "h"))).alias("c")).select(
            *rest, F.sha2(F.concat_ws(";", F.transform("c", lambda e: F.concat_ws(",", e[axis].cast("string"), e["h"]))), 256).alias("h")
        )
    return line.select("image_id", F.col("h").alias("sha256"))


def ambiguous_shafts(candidates: DataFrame, ct: DataFrame, expected: int) -> DataFrame:
    """``image_id, found``: images whose number of candidates is another than expected, none included."""
    found = candidates.select("image_id", "root").distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("found"))
    every = ct.select("image_id").distinct().join(found, "image_id", "left")
    return every.select("image_id", F.coalesce("found", F.lit(0).cast("long")).alias("found")).filter(F.col("found") != expected)


def expected_shafts(candidates: DataFrame, ct: DataFrame, expected: int) -> DataFrame:
    """The candidates; an image with another number of them than expected is refused."""
    if expected not in (1, 2):
        raise ValueError("one or two shafts can be expected")
    written = cut(candidates)
    return refused(written, ambiguous_shafts(written, ct, expected), f"other than {expected} candidate shafts")


def shaft_candidates(ct: DataFrame, brain: DataFrame, shape, affine, threshold: float) -> DataFrame:
    """Elongated metal components: ``image_id, root, length_mm, elongation, bin, px, py, pz``.

    A component's axis is the leading eigenvector of its 3x3 scatter sums, found
    by repeated squaring of that small matrix on the one row of the component.
    """
    roi = dilate6(brain, shape, 2)
    metal = ct.filter(F.col("v") >= threshold).join(roi, IMG, "left_semi")
    comp = label_components(metal, shape, 26)
    w = world(affine, F.col("x"), F.col("y"), F.col("z"))
    pts = cut(comp.select("image_id", "root", *[w[i].alias("p" + a) for i, a in enumerate(XYZ)]))
    k = ["image_id", "root"]
    p = ["px", "py", "pz"]
    mean = pts.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias("m" + a) for a in p]).filter("n >= 4")
    cen = cut(pts.join(mean, k).select(*k, *p, *[(F.col(a) - F.col("m" + a)).alias("d" + a) for a in p]))
    scat = cen.groupBy(*k).agg(*[F.sum(F.col("d" + a) * F.col("d" + b)).alias(f"s{i}{j}") for i, a in enumerate(p) for j, b in enumerate(p) if i <= j])

    def axes(batches):
        import numpy as np

        for pdf in batches:
            m = np.empty((len(pdf), 3, 3))
            for i in range(3):
                for j in range(i, 3):
                    m[:, i, j] = m[:, j, i] = pdf[f"s{i}{j}"].to_numpy(float)
            val, vec = np.linalg.eigh(m)
            v = vec[:, :, 2]
            big = np.argmax(np.abs(v), axis=1)
            v = v * np.sign(v[np.arange(len(v)), big])[:, None]
            s = np.sqrt(np.maximum(val, 0))
            out = pdf[k].copy()
            out["elongation"] = s[:, 2] / np.maximum(s[:, 1], 1e-6)
            for i, a in enumerate(XYZ):
                out["a" + a] = v[:, i]
            yield out

    types = {f.name: f.dataType.simpleString() for f in scat.schema}
    ax = scat.mapInPandas(axes, ", ".join(f"{c} {types[c]}" for c in k) + ", elongation double, ax double, ay double, az double")
    along = cen.join(ax, k).withColumn("t", F.col("dpx") * F.col("ax") + F.col("dpy") * F.col("ay") + F.col("dpz") * F.col("az"))
    span = along.groupBy(*k).agg(F.min("t").alias("t0"), (F.max("t") - F.min("t")).alias("length_mm"))
    good = along.join(span, k).filter("length_mm >= 10 and elongation >= 4")
    return good.groupBy(*k, "length_mm", "elongation", F.floor((F.col("t") - F.col("t0")) / 4).alias("bin")).agg(*[F.avg(a).alias(a) for a in p])
