"""Mixing of sources to target weights by weighted fair queueing.

Within a source the documents stand in a seeded random order. A copy's virtual finish time is the
number of source tokens up to its end, over all repeats so far, divided by the source's target
share; copies are merged by that time in one global order of sorted ranges, and the merge is cut where its running sum reaches the total.
Running sums are built in two levels (buckets of the random order, or ranges of the merge, then their rows), so a source
or a mix with a third of all documents is summed by many tasks.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evispark.llm.tokens import token_counts
from evispark.staging import broadcast_if_small, stage

#: About so many documents are in a bucket of the random order.
BUCKET_ROWS = 50_000
#: Repeats of a document are made in blocks of this many.
REPEAT_BLOCK = 4096
#: A table of targets is a hand-written list; more rows than this are refused.
MAX_TARGETS = 100_000


def read_targets(targets: DataFrame) -> list[dict]:
    """The targets with their share of the mix; one row per (mix_id, source), weights added up.

    Null or negative weights count as 0, a null ``max_repeats`` sets no cap, one below 1 forbids the source.
    """
    rows = targets.filter("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.sum(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("w"), F.max("max_repeats").alias("cap"), F.max(F.col("max_repeats").isNull()).alias("open"))
    rows = rows.limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    total: dict[str, float] = {}
    for r in rows:
        total[r["mix_id"]] = total.get(r["mix_id"], 0.0) + r["w"]
    return [{"mix_id": r["mix_id"], "source": r["source"], "weight": r["w"], "share": r["w"] / total[r["mix_id"]] if total[r["mix_id"]] else 0.0, "cap": None if r["open"] else max(0, r["cap"])} for r in sorted(rows, key=lambda r: (r["mix_id"], r["source"]))]


def mix_totals(targets: list[dict], sizes: dict[str, int], longest: dict[str, int], budget: int | None = None) -> tuple[dict[str, int], dict[tuple[str, str], tuple[int, float]]]:
    """(mix_id -> tokens the mix is cut at, (mix_id, source) -> (tokens of it that can come before the cut, its share among the sources that can give any)).

    Without a ``budget`` the total is the largest at which no source runs out of allowed repeats, so that
    the shares are exact (where nothing is capped, the size of the sources once). With one, a source
    that runs out leaves its part to the others. What can come before the cut is bounded by one longest document a source. Exact in rational arithmetic.
    """
    totals, out = {}, {}
    for mix in sorted({t["mix_id"] for t in targets}):
        able = [t for t in targets if t["mix_id"] == mix and t["weight"] > 0 and sizes.get(t["source"], 0) > 0 and t["cap"] != 0]
        weights = sum(Fraction(t["weight"]) for t in able)
        part = {t["source"]: Fraction(t["weight"]) / weights for t in able}
        room = {t["source"]: None if t["cap"] is None else sizes[t["source"]] * t["cap"] for t in able}
        ends = sorted(Fraction(room[s]) / part[s] for s in part if room[s] is not None)
        given = lambda v, part=part, room=room: sum(part[s] * v if room[s] is None else min(part[s] * v, room[s]) for s in part)

        def at(tokens: Fraction, part=part, room=room, ends=ends, given=given) -> Fraction:  # where the sources together have given so much: piecewise linear
            low = max([Fraction(0), *(v for v in ends if given(v) <= tokens)])
            slope = sum(part[s] for s in part if room[s] is None or Fraction(room[s]) / part[s] > low)
            return low + (tokens - given(low)) / slope if slope else low

        if not part:
            continue
        total = Fraction(budget) if budget is not None else ends[0] if ends else Fraction(sum(sizes[s] for s in part))
        last = at(total + sum(longest[s] for s in part))
        totals[mix] = int(total)
        for s in part:
            out[mix, s] = (int(min(part[s] * last, room[s] if room[s] is not None else part[s] * last)), float(part[s]))
    return totals, out


def sized_documents(docs: DataFrame, targets: DataFrame, vocabulary: bytes | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of targeted sources, staged."""
    named = broadcast_if_small(targets.select("source").filter("source is not null").distinct())
    picked = docs.select("doc_id", "source", "text").join(named, "source", "left_semi")
    keyed = picked.select(F.struct("doc_id", "source").alias("k"), "text")
    return stage(token_counts(keyed, "k", vocabulary=vocabulary).select("k.doc_id", "k.source", "n_tokens"), "sizes")


def mix_sources(sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The chosen copies, in order of virtual finish time within each mix, up to its total (``budget`` tokens where one is given).

    (mix_id, doc_id, source, repeat_no, n_tokens, virtual_finish). Documents without tokens, without a
    source or of a source without a target are never chosen; ``repeat_no`` runs from 1 and stays
    within ``max_repeats``. Ties go by source and doc_id.
    """
    spark, sized = sized.sparkSession, sized.select("doc_id", "source", "n_tokens")
    wanted = read_targets(targets)
    known = sized.filter("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("longest"), F.count("*").alias("rows")).join(broadcast_if_small(targets.select("source").distinct()), "source", "left_semi").collect()  # at most one row a target
    sizes = {r["source"]: r["n"] for r in known}
    totals, limits = mix_totals(wanted, sizes, {r["source"]: r["longest"] for r in known}, budget)
    buckets = max(1, -(-sum(r["rows"] for r in known) // bucket_rows))
    schema = "mix_id string, source string, tokens_limit bigint, share double, source_tokens bigint"
    limit_rows = spark.createDataFrame([(m, s, n, p, sizes[s]) for (m, s), (n, p) in limits.items()], schema)

    order = F.xxhash64(F.lit(seed), "doc_id")
    rows = sized.filter("n_tokens > 0").withColumn("h", order).withColumn("bucket", F.floor((F.shiftright("h", 32) + F.lit(2**31)) / F.lit(2**32 // buckets + 1)).cast("int"))
    before = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))  # a row per bucket
    within = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("within", within).join(before.select("source", "bucket", "before"), ["source", "bucket"])
    rows = rows.withColumn("cum", F.col("within") + F.coalesce("before", F.lit(0)))

    copies = rows.join(broadcast_if_small(limit_rows, MAX_TARGETS), "source").filter("cum <= tokens_limit").withColumn("repeats", F.expr("(tokens_limit - cum) div source_tokens + 1"))
    copies = copies.withColumn("first", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("repeats"), F.lit(REPEAT_BLOCK).cast("bigint"))))
    copies = copies.withColumn("repeat_no", F.explode(F.sequence("first", F.least(F.col("first") + REPEAT_BLOCK - 1, F.col("repeats")))))
    copies = copies.withColumn("virtual_finish", ((F.col("repeat_no") - 1) * F.col("source_tokens") + F.col("cum")) / F.col("share"))
    copies = copies.select("mix_id", "doc_id", "source", F.col("repeat_no").cast("int").alias("repeat_no"), "n_tokens", "virtual_finish")
    return _merged(copies, spark.createDataFrame(list(totals.items()), "mix_id string, total bigint"))


def _merged(copies: DataFrame, totals: DataFrame) -> DataFrame:
    """The merge of ``copies`` in one global order, each mix cut where its running sum reaches its total (mix_id, total).

    The order is that of sorted ranges. Sums of ranges are added up first, a row per range and mix; then each range adds up its own rows.
    """
    order = ["mix_id", "virtual_finish", "source", "doc_id", "repeat_no"]
    ranges = stage(copies.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "merge")
    before = ranges.groupBy("mix_id", "part").agg(F.sum("n_tokens").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("mix_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.sum("n_tokens").over(Window.partitionBy("part", "mix_id").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0))
    rows = ranges.withColumn("own", own).join(F.broadcast(before), ["mix_id", "part"]).join(F.broadcast(totals), "mix_id")
    return rows.filter(F.col("own") + F.col("before") <= F.col("total")).select(*copies.columns).orderBy(*order)


def mix_shares(sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0) -> DataFrame:
    """One row per (mix_id, source) of the targets: target and reached share, tokens, copies, most repeats.

    A source that gives nothing (no documents, weight 0) has its row with 0 tokens.
    """
    wanted = sized.sparkSession.createDataFrame([(t["mix_id"], t["source"], t["share"], t["cap"]) for t in read_targets(targets)], "mix_id string, source string, target_share double, max_repeats int")
    got = mix_sources(sized, targets, budget, seed).groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_copies"), F.countDistinct("doc_id").alias("n_docs"), F.max("repeat_no").alias("most_repeats"))
    rows = wanted.join(got, ["mix_id", "source"], "left").na.fill(0, ["n_tokens", "n_copies", "n_docs", "most_repeats"])
    return rows.withColumn("reached_share", F.round(F.try_divide(F.col("n_tokens"), F.sum("n_tokens").over(Window.partitionBy("mix_id"))), 9))


def mix_checks(sized: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """(mix_id, within_caps, within_total, shares_kept, in_order) of each mix that has any copy: what holds for every mixture.

    No copy beyond its cap; no more tokens than the budget; where no budget is given, each source within one longest document of its share of what came out; and
    virtual finish times that rise from copy to copy of a document.
    """
    rows = stage(mix_sources(sized, targets, budget), "mixture")
    t = sized.sparkSession.createDataFrame([(t["mix_id"], t["source"], t["weight"], t["cap"]) for t in read_targets(targets)], "mix_id string, source string, weight double, cap int")
    longest = sized.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    per = rows.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("n"), F.max("repeat_no").alias("most"), F.min(F.col("virtual_finish") > 0).alias("after")).join(t, ["mix_id", "source"], "left").join(longest, "source")
    w = Window.partitionBy("mix_id")
    per = per.withColumn("off", F.abs(F.col("n") - F.sum("n").over(w) * F.col("weight") / F.sum("weight").over(w))).withColumn("slack", F.sum("longest").over(w)).withColumn("total", F.sum("n").over(w))
    kept = (F.col("off") <= F.col("slack")) if budget is None else F.lit(True)
    steps = rows.groupBy("mix_id", "doc_id").agg(F.max(F.struct("repeat_no", "virtual_finish"))["virtual_finish"].alias("last"), F.max("virtual_finish").alias("top"), F.count("*").alias("k"), F.max("repeat_no").alias("r"))
    orders = steps.groupBy("mix_id").agg(F.min((F.col("last") == F.col("top")) & (F.col("k") == F.col("r"))).alias("in_order"))
    out = per.groupBy("mix_id").agg(F.min(F.coalesce(F.col("most") <= F.col("cap"), F.lit(True))).alias("within_caps"), F.min(F.col("total") <= (F.lit(budget) if budget is not None else F.col("total"))).alias("within_total"), F.min(kept).alias("shares_kept"))
    return out.join(orders, "mix_id")
