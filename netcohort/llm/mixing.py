"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are first summed by the set of sources they belong to.  A small network
carries words from patterns to source quotas; a pattern's words cost nothing the
first time, more the second and most the third, so documents are repeated only
where nothing fresh is left.  Each pattern's flow then becomes whole copies of all
its documents plus a seeded choice for the rest: documents in hash order up to the
flow, then the largest that still fit, or where all of these are small more in hash
order past those that do not fit, until nothing unused fits, then one that goes over by
less than is missing.

The driver sees sums by pattern; a pattern set beyond ``MAX_PATTERNS`` is refused.
The seeded choice is one hash limit a pattern, found from sums over hash ranges, so
no source, however hot, is ordered as a whole.

Defined cases: null or empty texts have size 0 and give no words; a null source is
a source of its own, ordered last; equal rows move together; an empty table gives
no rows.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut
from .common import WORD

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Times a document may be taken, and the cost of a word by the time it is taken.
REPEATS = 3
COSTS = (0, 1, 3)
SEED = 20261130
LEAST = -(1 << 63)
#: Membership patterns the driver's network may have.
MAX_PATTERNS = 100_000
#: Hash ranges of a pattern.
RANGES = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> dict[str | None, float]:
    """Quota of each source: weighted shares of the whole, none above ``repeats`` its size."""
    ranked = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ranked)}
    most = {s: repeats * n for s, n in ranked}
    free, left, quota = set(weight), Fraction(sum(n for _, n in ranked)), {}
    while free:
        share = left / sum(weight[s] for s in free)
        full = [s for s in free if share * weight[s] > most[s]]
        for s in full or list(free):
            quota[s] = Fraction(most[s]) if full else share * weight[s]
            free.discard(s)
        left -= sum(quota[s] for s in full)
    return {s: float(q) for s, q in quota.items()}


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int], costs: tuple[int, ...] = COSTS) -> list[list[int]]:
    """Words each pattern sends to each of its members (``members[p]`` are sources).

    Successive cheapest augmenting paths.  Costs are whole numbers, so paths are
    found by widening the allowed cost; arcs are the patterns' tiers and memberships.
    """
    flow = [dict.fromkeys(m, 0) for m in members]
    givers: dict[int, list[int]] = {}
    for p, m in enumerate(members):
        for s in m:
            givers.setdefault(s, []).append(p)
    used, got = [0] * len(capacity), [0] * len(quota)

    def price(p: int) -> int | None:
        tier = used[p] // capacity[p] if capacity[p] else len(costs)
        return costs[tier] if tier < len(costs) else None

    for level in sorted(set(costs)):
        for s in range(len(quota)):
            while got[s] < quota[s]:
                # cheapest way into s: a pattern at this price, perhaps through sources that pass words on
                came: dict[int, tuple[int, int] | None] = {s: None}
                queue, end = [s], None
                while queue and end is None:
                    at = queue.pop(0)
                    for p in givers.get(at, ()):
                        cost = price(p)
                        if cost is not None and cost <= level:
                            end = (p, at)
                            break
                        for other, amount in flow[p].items():
                            if amount and other not in came:
                                came[other] = (p, at)
                                queue.append(other)
                if end is None:
                    break
                p, at = end
                tier = used[p] // capacity[p]
                amount = min(quota[s] - got[s], (tier + 1) * capacity[p] - used[p])
                path, node = [], at
                while came[node] is not None:
                    q, nearer = came[node]
                    amount = min(amount, flow[q][node])
                    path.append((q, node, nearer))
                    node = nearer
                flow[p][at] += amount
                used[p] += amount
                for q, node, nearer in path:
                    flow[q][node] -= amount
                    flow[q][nearer] += amount
                got[s] += amount
    return [[flow[p][s] for s in m] for p, m in enumerate(members)]


def mix_sources(docs: DataFrame, sources: Column, size: Column, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED, row_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``size``, ``copies`` (0 to ``REPEATS``), ``source_size``, ``target``.

    ``sources`` is the array of a document's sources.  Size and target are those of
    its first source.  The added columns replace columns of these names.
    """
    added = ("size", "copies", "source_size", "target")
    own = [c for c in docs.columns if c.lower() not in added]
    rows = cut(
        docs.select(
            F.struct(*own).alias("_row"),
            F.sort_array(F.array_distinct(F.transform(sources, lambda s: F.struct(s.isNull().alias("n"), s.cast("string").alias("s"))))).alias("_p"),
            size.cast("long").alias("_s"),
            F.xxhash64(F.lit(seed), F.coalesce(F.col(row_id).cast("long"), F.lit(-1)), size.cast("long")).alias("_h"),
        )
    )
    sums = rows.groupBy("_p").agg(F.sum("_s").alias("words")).limit(MAX_PATTERNS + 1).take(1 << 24)
    if len(sums) > MAX_PATTERNS:
        raise ValueError("more membership patterns than the network may have")
    sums.sort(key=lambda r: [(x["n"], x["s"] or "") for x in r["_p"]])
    patterns = [[x["s"] for x in r["_p"]] for r in sums]
    held: dict[str | None, int] = {}
    for p, r in zip(patterns, sums, strict=True):
        for s in p[:1]:
            held[s] = held.get(s, 0) + r["words"]
        for s in p[1:]:
            held.setdefault(s, 0)
    capacity = [r["words"] for r in sums]
    targets = source_targets(list(held.items()), weights)
    names = list(held)
    flows = min_cost_flow(capacity, [[names.index(s) for s in p] for p in patterns], [round(targets[s]) for s in names])
    plan = [(i, r["_p"], sum(f), c) for i, (r, f, c) in enumerate(zip(sums, flows, capacity, strict=True))]
    spark = docs.sparkSession
    kind = rows.select("_p").schema["_p"].dataType.simpleString()
    base = [(i, p, f // c if c else 0, f % c if c else 0, held[p[0]["s"]] if p else 0, targets[p[0]["s"]] if p else 0.0) for i, p, f, c in plan]
    wide = F.broadcast(spark.createDataFrame(base, f"_i int, _p {kind}, _base int, _rest long, source_size long, target double"))
    parted = rows.join(wide, "_p")
    units = cut(parted.filter("_rest > 0 AND _s > 0").groupBy("_i", "_h", "_s", "_rest").agg(F.sum("_s").alias("w")))
    limit, left = _hash_limits(units, {i: b[3] for i, b in enumerate(base)})
    fills, picks = _fill(units, limit, left)
    _overshoot(units, limit, left, fills, picks)
    final = F.broadcast(spark.createDataFrame([(b[0], limit.get(b[0], LEAST), fills.get(b[0], []), picks.get(b[0], [])) for b in base], f"_i int, _cut long, _fills {FILL}, _picks array<struct<h:long,s:long>>"))
    weighed = parted.join(final, "_i").withColumn("w", F.col("_s"))
    if fills:  # rows that move together are weighed together
        heavier = units.filter("w > _s").select("_i", "_h", "_s", F.col("w").alias("_all"))
        if heavier.take(1):
            weighed = weighed.join(heavier, ["_i", "_h", "_s"], "left").withColumn("w", F.coalesce("_all", "w"))
    once = (F.col("_rest") > 0) & (F.col("_s") > 0) & ((F.col("_h") <= F.col("_cut")) | _filled() | F.exists("_picks", lambda x: (x["h"] == F.col("_h")) & (x["s"] == F.col("_s"))))
    copies = F.when(F.col("_s") > 0, F.col("_base") + once.cast("int")).otherwise(0).cast("int")
    return weighed.select("_row.*", F.col("_s").alias("size"), copies.alias("copies"), "source_size", "target")


def _hash_limits(units: DataFrame, rest: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """For each pattern the largest hash up to which its units fit, and what is left."""
    span = (1 << 64) // RANGES
    lot = F.shiftrightunsigned("_h", 48)  # hash ranges in the order of the unsigned hash
    order = F.when(lot >= RANGES // 2, lot - RANGES // 2).otherwise(lot + RANGES // 2)  # signed order
    sums = units.groupBy("_i", "_rest", order.alias("_lot")).agg(F.sum("w").alias("w"))
    w = W.partitionBy("_i").orderBy("_lot")
    upto = sums.withColumn("_upto", F.sum("w").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    cross = upto.filter("_upto > _rest AND _upto - w <= _rest").select("_i", "_lot", (F.col("_upto") - F.col("w")).alias("_before"))
    inside = units.withColumn("_lot", order).join(cross, ["_i", "_lot"])
    run = F.sum("w").over(W.partitionBy("_i").orderBy("_h").rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("_before")
    fit = inside.withColumn("_run", run)
    got = cross.join(fit.filter("_run <= _rest").groupBy("_i").agg(F.max("_h").alias("_h"), F.max("_run").alias("_run")), "_i", "left").take(1 << 24)
    limit, left = {}, {}
    for r in got:
        limit[r["_i"]] = r["_h"] if r["_h"] is not None else LEAST + r["_lot"] * span - 1 if r["_lot"] else LEAST
        left[r["_i"]] = rest[r["_i"]] - (r["_run"] if r["_run"] is not None else r["_before"])
    for i, n in rest.items():
        if n and i not in limit:
            limit[i], left[i] = (1 << 63) - 1, 0
    return limit, left


#: Hash ranges of which units up to a size are taken.
FILL = "array<struct<after:long,upto:long,most:long>>"


def _filled() -> Column:
    return F.exists("_fills", lambda x: (F.col("_h") > x["after"]) & (F.col("_h") <= x["upto"]) & (F.col("w") <= x["most"]))


def _fill(units: DataFrame, limit: dict[int, int], left: dict[int, int]) -> tuple[dict[int, list], dict[int, list]]:
    """Units after each limit until nothing unused fits; ``left`` is lowered.

    A round takes the largest unit that fits if it is more than half of what is left.
    Otherwise it takes units in hash order; where they are too many, the first that does
    not fit is larger than the new rest.  Either way the rest has halved, and what was
    passed over fits no more; where all are taken, nothing is left that fits.
    """
    spark = units.sparkSession
    fills: dict[int, list[tuple[int, int, int]]] = {}
    picks: dict[int, list[tuple[int, int]]] = {}
    after, open_ = dict(limit), {i for i in left if left[i] > 0}
    while open_:
        edge = F.broadcast(spark.createDataFrame([(i, after[i], left[i]) for i in sorted(open_)], "_i int, _after long, _left long"))
        fit = units.drop("_rest").join(edge, "_i").filter("_h > _after AND w <= _left").select("_i", "_h", "_s", "w", F.col("_left").alias("_rest"))
        seen = {r["_i"]: r for r in fit.groupBy("_i").agg(F.sum("w").alias("w"), F.max(F.struct("w", "_h", "_s")).alias("m")).take(1 << 24)}
        crowded: dict[int, int] = {}
        for i, r in seen.items():
            if 2 * r["m"]["w"] > left[i]:
                picks.setdefault(i, []).append((r["m"]["_h"], r["m"]["_s"]))
                left[i] -= r["m"]["w"]
            elif r["w"] > left[i]:
                crowded[i] = left[i]
            else:
                fills.setdefault(i, []).append((after[i], (1 << 63) - 1, left[i]))
                left[i], after[i] = left[i] - r["w"], (1 << 63) - 1
        if crowded:
            upto, less = _hash_limits(fit.filter(F.col("_i").isin(list(crowded))), crowded)
            for i in crowded:
                fills.setdefault(i, []).append((after[i], upto[i], left[i]))
                after[i], left[i] = max(after[i], upto[i]), less[i]
        open_ = {i for i in seen if left[i] > 0 and after[i] < (1 << 63) - 1}
    return fills, picks


def _overshoot(units: DataFrame, limit: dict[int, int], left: dict[int, int], fills: dict[int, list], picks: dict[int, list]) -> None:
    """Take one more unit of a pattern if it goes over by less than is missing now."""
    rows = [(i, limit[i], left[i], fills.get(i, []), [h for h, _ in picks.get(i, [])]) for i in left if left[i] > 0]
    if not rows:
        return
    edge = F.broadcast(units.sparkSession.createDataFrame(rows, f"_i int, _cut long, _left long, _fills {FILL}, _done array<long>"))
    over = units.join(edge, "_i").filter("_h > _cut AND w > _left AND w < 2 * _left AND NOT array_contains(_done, _h)").filter(~_filled())
    for r in over.groupBy("_i").agg(F.min(F.struct("w", "_h", "_s")).alias("m")).take(1 << 24):
        picks.setdefault(r["_i"], []).append((r["m"]["_h"], r["m"]["_s"]))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, copies, source_size, target``, documents mixed by their one source."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_sources(sized, F.array("source"), F.col("size"), weights, seed)


def mixed_texts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, no column added."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("source").alias("_own"), word_count(F.col("text")).alias("_words"))
    taken = mix_sources(rows, F.array("_own"), F.col("_words"), weights, seed).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
