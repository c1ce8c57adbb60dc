"""Acquisition catalogue: header rows to series, and gradient tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def reject_rows(headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and rejected rows with a reason."""
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    bad = blank("series_uid") | blank("study_uid") | blank("sop_uid") | (F.coalesce("rows", F.lit(0)) == 0) | (F.coalesce("columns", F.lit(0)) == 0)
    return headers.filter(~bad), headers.filter(bad).withColumn("reason", F.lit("missing image or identifier fields"))


def series_rollup(headers: DataFrame, attributes: list[str]) -> DataFrame:
    """One row per series: file count, frames and the attributes of its first path."""
    return headers.groupBy("series_uid").agg(
        F.count(F.lit(1)).alias("files"), F.sum("frames").alias("frames"), F.sum("size").alias("bytes"),
        *[F.min_by(a, "path").alias(a) for a in attributes],
    )


def duplicate_instances(headers: DataFrame) -> DataFrame:
    """Every series that holds a repeated instance identifier.

    Identifiers are counted before anything is joined, so a much-copied
    instance never gathers its rows in one place.
    """
    per = headers.groupBy("sop_uid", "series_uid").agg(F.count(F.lit(1)).alias("c"))
    many = per.groupBy("sop_uid").agg(F.sum("c").alias("total")).filter("total > 1").select("sop_uid")
    return per.join(many, "sop_uid", "left_semi").groupBy("series_uid").agg(F.sum("c").alias("duplicate_rows"), F.count(F.lit(1)).alias("duplicate_instances"))


def uid_conflicts(headers: DataFrame) -> DataFrame:
    """Series identifiers used by more than one patient or study."""
    return headers.groupBy("series_uid").agg(
        F.countDistinct("patient_id").alias("patients"), F.countDistinct("study_uid").alias("studies")
    ).filter("patients > 1 or studies > 1")


def keyed_code(value: Column, salt: bytes) -> Column:
    """First 20 hex digits of HMAC-SHA256 under ``salt``; stays inside the JVM."""
    key = salt if len(salt) <= 64 else __import__("hashlib").sha256(salt).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ m for b in key).hex())) for m in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))
    return F.substring(F.sha2(F.concat(outer, first), 256), 1, 20)


def pseudonymize(headers: DataFrame, salt: bytes) -> DataFrame:
    """Series, study and patient codes; a blank patient stays null."""
    ident = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("issuer", "patient_id", "birth_date")])
    pat = F.when(F.length(F.trim(F.coalesce("patient_id", F.lit("")))) > 0, keyed_code(ident, salt))
    return headers.select(
        "path", keyed_code(F.col("series_uid"), salt).alias("series_key"), keyed_code(F.col("study_uid"), salt).alias("study_key"), pat.alias("patient_key")
    )


# Words that hint at a derived image, and at each role.
DERIVED = ("adc", "tracew", "fractional", "derived")
ROLE_TERMS = {
    "dwi": ("dwi", "diff", "dti"),
    "t1": ("t1", "mprage", "spgr"),
    "t2": ("t2", "space", "cube"),
    "reverse_b0": ("b0", "topup", "rev"),
}


def role_hints(modality: Column, text: Column) -> Column:
    """Array of role hints; derived words win, only MR rows are read."""
    low = F.lower(text)
    has = lambda terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))
    roles = F.array_compact(F.array(*[F.when(has(t), F.lit(r)) for r, t in ROLE_TERMS.items()]))
    none = F.array_except(F.array(F.lit("")), F.array(F.lit("")))
    return (
        F.when(modality == "CT", F.array(F.lit("ct"))).when(modality != "MR", none)
        .when(has(DERIVED), F.array(F.lit("derived_image_not_raw_dwi"))).otherwise(roles)
    )


def validate_selection(selection: DataFrame, series: DataFrame, required: list[str], allow_cross_study: bool = False) -> DataFrame:
    """``reason, n``: every broken selection rule with its count.

    ``selection`` is ``role, series_uid``; ``series`` carries modality, patient, study and derived flag.
    """
    j = selection.join(series, "series_uid", "left")
    want = F.when(F.col("role") == "ct", "CT").otherwise("MR")
    roles = F.array(*[F.lit(r) for r in required])
    a = j.agg(
        F.size(F.array_except(roles, F.collect_set("role"))).alias("missing_role"), (F.count("role") - F.countDistinct("role")).alias("repeated_role"),
        (F.count("series_uid") - F.countDistinct("series_uid")).alias("repeated_series"), F.count_if(F.col("modality").isNull()).alias("unknown_series"),
        F.count_if(F.col("modality") != want).alias("wrong_modality"), F.greatest(F.countDistinct("patient_id") - 1, F.lit(0)).alias("extra_patients"),
        F.count_if("derived").alias("derived_series"),
        (F.lit(0) if allow_cross_study else F.greatest(F.countDistinct("study_uid") - 1, F.lit(0))).alias("extra_studies"),
    )
    return a.select([F.col(c).cast("long").alias(c) for c in a.columns]).unpivot([], a.columns, "reason", "n").filter("n > 0")


def stat_drift(catalogue: DataFrame, now: DataFrame) -> DataFrame:
    """Files whose size or time differs from the catalogue, or that are gone."""
    n = now.select("path", F.col("size").alias("size_now"), F.col("mtime").alias("mtime_now"))
    j = catalogue.join(n, "path", "left")
    return j.filter(F.col("size_now").isNull() | (F.col("size") != F.col("size_now")) | (F.col("mtime") != F.col("mtime_now"))).select("path", F.col("size_now").isNull().alias("gone"))


# -- gradient tables ---------------------------------------------------------

# The largest baseline value and the spread of one shell.
BASELINE_MAX, SHELL_TOLERANCE = 50.0, 100.0


def shell_cluster(bvals: DataFrame, tolerance: float = SHELL_TOLERANCE) -> DataFrame:
    """``acquisition, shell, b, directions``: sorted values, a new shell past the running mean.

    Values are counted first; the fold walks one acquisition's distinct
    values, which its gradient table bounds.
    """
    v = bvals.filter(F.col("b") > BASELINE_MAX).groupBy("acquisition", "b").agg(F.count(F.lit(1)).alias("c"))
    a = v.groupBy("acquisition").agg(F.array_sort(F.collect_list(F.struct("b", "c"))).alias("l"))
    start = F.expr("cast(array() as array<struct<s:double,n:bigint>>)")

    def step(acc: Column, e: Column) -> Column:
        last = F.element_at(acc, -1)
        b, c = e["b"].cast("double"), e["c"].cast("bigint")
        fresh = F.named_struct(F.lit("s"), b * c, F.lit("n"), c)
        grown = F.named_struct(F.lit("s"), last["s"] + b * c, F.lit("n"), last["n"] + c)
        opens = (F.size(acc) == 0) | (F.abs(b - last["s"] / last["n"]) > tolerance)
        return F.when(opens, F.concat(acc, F.array(fresh))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown)))

    s = a.select("acquisition", F.posexplode(F.aggregate("l", start, step)).alias("shell", "t"))
    return s.select("acquisition", "shell", F.round(F.col("t.s") / F.col("t.n"), 1).alias("b"), F.col("t.n").alias("directions"))


def gradient_table_qc(table: DataFrame, volumes: DataFrame | None = None) -> DataFrame:
    """Per acquisition: counts, unit length, and rank of the six-column quadratic design.

    The rank comes from the 6x6 sums of each acquisition, never from its rows.
    """
    base = F.col("b") <= BASELINE_MAX
    x, y, z = F.col("gx"), F.col("gy"), F.col("gz")
    ln = F.sqrt(x * x + y * y + z * z)
    cols = [x * x, y * y, z * z, x * y, x * z, y * z]
    g = table.groupBy("acquisition").agg(
        F.count(F.lit(1)).alias("volumes"), F.count_if(base).alias("baselines"), F.count_if(~base).alias("directions"),
        F.count_if(~base & (F.abs(ln - 1) > 0.05)).alias("not_unit"),
        F.array(*[F.sum(F.when(~base, a * b).otherwise(0.0)) for a in cols for b in cols]).alias("g"),
    )

    def rank(batches):
        import numpy as np

        for pdf in batches:
            m = np.stack([np.asarray(v, float).reshape(6, 6) for v in pdf["g"]]) if len(pdf) else np.empty((0, 6, 6))
            s = np.sqrt(np.maximum(np.linalg.eigvalsh(m), 0)) if len(pdf) else np.empty((0, 6))
            out = pdf.drop(columns="g")
            out["design_rank"] = (s > s.max(axis=1, keepdims=True) * 1e-7).sum(axis=1).astype("int32")
            yield out

    t = g.schema["acquisition"].dataType.simpleString()
    r = g.mapInPandas(rank, f"acquisition {t}, volumes bigint, baselines bigint, directions bigint, not_unit bigint, design_rank int")
    return r.withColumn("accepted", (F.col("baselines") >= 1) & (F.col("directions") >= 6) & (F.col("not_unit") == 0) & (F.col("design_rank") == 6))


def select_baselines(bvals: DataFrame) -> DataFrame:
    """``acquisition, vol`` of the volumes at or below the baseline limit; an acquisition without any is refused."""
    none = without_baseline(bvals).take(1)
    if none:
        raise ValueError(f"acquisition {none[0].acquisition} has no baseline volume")
    return bvals.filter(F.col("b") <= BASELINE_MAX).select("acquisition", "vol")


def without_baseline(bvals: DataFrame) -> DataFrame:
    return bvals.groupBy("acquisition").agg(F.count_if(F.col("b") <= BASELINE_MAX).alias("n")).filter("n = 0").select("acquisition")
