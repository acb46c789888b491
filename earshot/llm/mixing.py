"""Mixing sources to target weights by min-cost flow.

Documents are grouped by the set of sources that they belong to (their pattern). Words flow from patterns
to the sources in them, up to each source's target; the first copy of a pattern's words costs nothing and
every further copy costs one more than the copy before, so words repeat only where a target needs it. The
flow is solved on the driver over the patterns and sources that overlap (at most `max_patterns`, else ValueError); a
source all of whose documents are in no other takes its words without a search, so the number of such sources has no bound but
the driver's memory for two numbers each. Each
document then gets the copies that its pattern takes whole, and seeded documents one more: those first in
the order of a hash of their id, up to the words that are left, and the one that best fills the gap. Where that order is cut is found by sums over
65536 ranges of the hash and an exact running sum inside the one range that holds the cut.

Targets: a share of the words in all documents, dealt by weight; a target stops at `max_copies` times the
words of its source, and what is over is dealt again.

Defined cases: null and empty texts have size 0 and take 0; very long texts count whole; null is a source like others and
sorts last; documents without any source take nothing; repeated rows count and are taken each, in a fixed order; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared

_RANGES = 1 << 16


def word_count(text: str) -> Column:
    """Number of words of a text column, runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_copies: int = 2) -> dict:
    """Target words of each source: sizes in order of code points, null last, get the weights in turn."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in order if s in open_)
        over = [s for s in order if s in open_ and left * weight[s] / total > max_copies * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(max_copies * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def min_cost_flow(supply: list[int], members: list[list[int]], quota: list[int], copies: int) -> list[int]:
    """Words that each pattern sends, at least cost among the largest flows.

    supply: words in one copy of a pattern; members: its sources; quota: most words of each source. Augments
    along shortest paths; as costs depend on a pattern's copy only, these are searched copy by copy.
    """
    n, m = len(supply), len(quota)
    sent, got = [0] * n, [0] * m
    flow: list[dict[int, int]] = [{s: 0 for s in p} for p in members]
    takers: list[list[int]] = [[] for _ in range(m)]
    for p, own in enumerate(members):
        for s in own:
            takers[s].append(p)
    for copy in range(1, copies + 1):  # with paths through patterns of earlier copies, whose cost is paid
        while True:
            came: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None for p in range(n) if sent[p] < supply[p] * copy}
            queue, goal = list(came), None
            for kind, k in queue:
                nxt = [("s", s) for s in members[k]] if kind == "p" else [("p", p) for p in takers[k] if flow[p][k] > 0]
                if kind == "s" and got[k] < quota[k]:
                    goal = ("s", k)
                    break
                for x in nxt:
                    if x not in came:
                        came[x] = (kind, k)
                        queue.append(x)
            if goal is None:
                break
            path = [goal]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            amount = min(supply[path[0][1]] * copy - sent[path[0][1]], quota[goal[1]] - got[goal[1]])
            for a, b in zip(path[:-1], path[1:], strict=True):
                if a[0] == "s":
                    amount = min(amount, flow[b[1]][a[1]])
            for a, b in zip(path[:-1], path[1:], strict=True):
                if a[0] == "p":
                    flow[a[1]][b[1]] += amount
                else:
                    flow[b[1]][a[1]] -= amount
            sent[path[0][1]] += amount
            got[goal[1]] += amount
    return sent


def mix_sources(docs: DataFrame, size: Column, sources: Column, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_copies: int = 2, key: str = "doc_id", seed: int = 1, max_patterns: int = 10_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns in keep, sources (array), size, copies and taken (words) of every row of docs; sources: the array of those a row belongs to."""
    spark = docs.sparkSession
    rows = shared(docs.select(key, F.array_sort(F.array_distinct(sources)).alias("sources"), size.alias("size"), *keep), spark)
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # over what is written
    patterns = shared(rows.groupBy("sources").agg(F.sum("size").alias("words")), spark)
    if patterns.where(F.size("sources") > 1).count() > max_patterns:
        raise ValueError(f"more than {max_patterns} patterns of several sources")
    groups = patterns.collect()  # a row for each source, and those of several
    groups = sorted(((list(r["sources"] or []), int(r["words"] or 0)) for r in groups), key=lambda g: [(x is None, x or "") for x in g[0]])
    sizes: dict = {}
    for own, words in groups:
        for s in own:
            sizes[s] = sizes.get(s, 0) + words
    want = targets(sizes, weights, share, max_copies)
    names = list(sizes)
    number = {s: k for k, s in enumerate(names)}
    tied = {s for own, _ in groups if len(own) > 1 for s in own}
    sent = [min(max_copies * words, round(want[own[0]])) if own else 0 for own, words in groups]  # right where nothing overlaps
    flows = [k for k, (own, _) in enumerate(groups) if own and own[0] in tied]
    for k, f in zip(flows, min_cost_flow([groups[k][1] for k in flows], [[number[s] for s in groups[k][0]] for k in flows], [round(want[s]) for s in names], max_copies), strict=True):
        sent[k] = f
    plan = []
    for (own, words), f in zip(groups, sent, strict=True):
        whole = f // words if words else 0
        plan.append((own, whole, f - whole * words))
    plan_df = spark.createDataFrame(plan, f"sources {dict(rows.dtypes)['sources']}, whole long, rest long")
    place = F.xxhash64(F.col(key).cast("string"), F.lit(seed))
    with_plan = rows.withColumn("_h", place).withColumn("_range", F.shiftrightunsigned(F.col("_h"), 48)).join(F.broadcast(plan_df), rows["sources"].eqNullSafe(plan_df["sources"])).select(rows["*"], "_h", "_range", "whole", "rest")
    sums = with_plan.groupBy("sources", "_range").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("sources").orderBy("_range")  # at most 65536 rows for a pattern
    cuts = sums.withColumn("before", F.sum("words").over(upto) - F.col("words")).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    cut = [(r["sources"], r["_range"], r["before"]) for r in cuts.select("sources", "_range", "before").collect()]  # a row for each pattern
    cut_df = spark.createDataFrame(cut, f"sources {dict(rows.dtypes)['sources']}, cut long, before long")
    at = with_plan.alias("r").join(F.broadcast(cut_df).alias("c"), F.expr("r.sources <=> c.sources"), "left").select("r.*", "c.cut", "c.before")
    far = at.where(F.col("cut").isNull() | (F.col("_range") != F.col("cut"))).withColumn("more", (F.col("rest") > 0) & (F.col("cut").isNull() | (F.col("_range") < F.col("cut"))))
    inside = Window.partitionBy("sources").orderBy("_h", key, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = at.where(F.col("_range") == F.col("cut")).withColumn("more", F.col("before") + F.sum("size").over(inside) <= F.col("rest"))
    out = shared(far.unionByName(near), spark)
    # the words still missing go to the one document that comes closest to them
    taken = out.groupBy("sources").agg((F.max("rest") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0))).alias("gap")).where("gap > 0")
    gaps = spark.createDataFrame(taken.collect(), f"sources {dict(rows.dtypes)['sources']}, gap long")  # a row for each pattern
    near_gap = out.where(~F.col("more")).alias("r").join(F.broadcast(gaps).alias("g"), F.expr("r.sources <=> g.sources")).select("r.sources", "r._row", "r._h", F.abs(F.col("r.size") - F.col("g.gap")).alias("off"), "g.gap")
    best = near_gap.where("off < gap").groupBy("sources").agg(F.min(F.struct("off", "_h", "_row"))["_row"].alias("_row"))
    last = spark.createDataFrame([(r["_row"], True) for r in best.collect()], "_row long, last boolean")  # a row for each pattern at most
    out = out.join(F.broadcast(last), "_row", "left")
    copies = F.col("whole") + (F.col("more") | F.coalesce("last", F.lit(False))).cast("long")
    copies = F.when(F.size("sources") > 0, F.least(copies, F.lit(max_copies))).otherwise(0)
    source_info = spark.createDataFrame([(s, sizes[s], float(want[s])) for s in names], "source string, source_size long, target double")
    result = out.select(key, *keep, "sources", "size", copies.cast("long").alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))
    result.source_info = source_info  # sizes and targets of the sources, a row each
    return result
