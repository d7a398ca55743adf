"""References to records that do not exist.

Keys are hashed to 64 bits and the hash space is cut into equal ranges. Each range keeps its parents
as a sorted array; reference batches of the same range are probed by binary search and confirmed
on the key itself, so two keys with one hash do no harm. Only misses leave the probe.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.staging import shuffle_partitions, stage, strip_blanks

PARENTS_PER_RANGE = 200_000
REFERENCES_PER_TASK = 500_000
_OUT = "ref_table string, record_id string, claim_id string, reason string, record_at timestamp_ntz"
_OUT_ARROW = pa.schema([(c, pa.string()) for c in ("ref_table", "record_id", "claim_id", "reason")] + [("record_at", pa.timestamp("us"))])


def reference_rows(records: DataFrame, ref_table: str, id_col: str) -> DataFrame:
    """(ref_table, record_id, claim_id, record_at): each reference of each record once.

    References are stripped and lower-cased; null and empty lists and elements are none. A record that
    was delivered more than once counts from its earliest ``ingested_at``.
    """
    refs = F.transform("supporting_claim_ids", lambda x: F.lower(strip_blanks(x)))
    return (
        records.select(F.lit(ref_table).alias("ref_table"), F.col(id_col).alias("record_id"), F.col("ingested_at").cast("timestamp_ntz").alias("record_at"), F.explode(F.array_distinct(refs)).alias("claim_id"))
        .filter("record_id is not null and claim_id <> ''")
        .groupBy("ref_table", "record_id", "claim_id")
        .agg(F.min("record_at").alias("record_at"))
    )


def parent_rows(claims: DataFrame) -> DataFrame:
    """(claim_id, arrived_at, deleted_at): earliest arrival and deletion over all rows of a key."""
    return (
        claims.filter("claim_id is not null")
        .groupBy("claim_id")
        .agg(F.min(F.col("ingested_at").cast("timestamp_ntz")).alias("arrived_at"), F.min(F.col("deleted_at").cast("timestamp_ntz")).alias("deleted_at"))
    )


def _probe(parents: pa.Table, refs: pa.Table) -> pa.Table:
    n = refs.num_rows
    hit = np.full(n, -1, dtype=np.int64)
    if parents.num_rows and n:
        parents = parents.sort_by("h")
        ph, rh = parents["h"].to_numpy(), refs["h"].to_numpy()
        pid, rid = parents["claim_id"].combine_chunks(), refs["claim_id"].combine_chunks()
        at, todo = np.searchsorted(ph, rh, "left"), np.arange(n)
        while todo.size:  # one turn, and another only for keys that share a hash
            todo = todo[(at[todo] < ph.size)]
            todo = todo[ph[at[todo]] == rh[todo]]
            if not todo.size:
                break
            same = pc.equal(pid.take(pa.array(at[todo])), rid.take(pa.array(todo))).to_numpy(zero_copy_only=False)
            hit[todo[same]] = at[todo[same]]
            todo = todo[~same]
            at[todo] += 1
    found = pa.array(np.where(hit < 0, 0, hit), mask=hit < 0)
    null = pa.nulls(n, pa.timestamp("us"))
    arrived, deleted = (parents[c].combine_chunks().take(found) if parents.num_rows else null for c in ("arrived_at", "deleted_at"))
    seen = refs["record_at"].combine_chunks()
    gone, late = pc.fill_null(pc.less_equal(deleted, seen), False), pc.fill_null(pc.greater(arrived, seen), False)
    reason = pc.if_else(pa.array(hit < 0), "missing", pc.if_else(gone, "deleted", pc.if_else(late, "late", pa.scalar(None, pa.string()))))
    out = pa.table([refs["ref_table"], refs["record_id"], refs["claim_id"], reason, seen], schema=_OUT_ARROW)
    return out.filter(pc.is_valid(reason))


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References without a usable parent: (ref_table, record_id, claim_id, reason, record_at).

    ``refs`` is :func:`reference_rows` (or a union of several), ``parents`` is :func:`parent_rows`.
    ``reason`` is ``missing`` (no such key), else ``deleted`` (at or before the record came), else
    ``late`` (came after the record). A null time never makes a case. Ranges that many references
    point to are split into salted copies, each with the range's parents, so one key that a third of
    all records name is probed by several tasks.
    """
    spark = refs.sparkSession
    refs, parents = stage(refs, "refs"), stage(parents, "parents")
    n_ranges = max(shuffle_partitions(spark), -(-parents.count() // PARENTS_PER_RANGE))
    width = 2**32 // n_ranges + 1
    rng = F.floor((F.shiftright("h", 32) + F.lit(2**31)) / F.lit(width)).cast("int").alias("rng")  # equal ranges of the upper half
    refs = refs.withColumn("h", F.xxhash64("claim_id")).select("*", rng)
    parents = parents.withColumn("h", F.xxhash64("claim_id")).select("*", rng)
    # at most (references / REFERENCES_PER_TASK) ranges can be this full
    hot = {r["rng"]: -(-r["n"] // REFERENCES_PER_TASK) for r in refs.groupBy("rng").agg(F.count("*").alias("n")).filter(F.col("n") > REFERENCES_PER_TASK).collect()}
    if hot:
        parts = F.coalesce(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv])[F.col("rng")], F.lit(1))
        refs = refs.withColumn("salt", F.pmod(F.xxhash64("record_id"), parts).cast("int"))
        parents = parents.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    else:
        refs, parents = refs.withColumn("salt", F.lit(0)), parents.withColumn("salt", F.lit(0))
    return parents.groupBy("rng", "salt").cogroup(refs.groupBy("rng", "salt")).applyInArrow(_probe, _OUT)


def orphans_by_month(orphans: DataFrame) -> DataFrame:
    """(ref_table, month, reason, n_orphans) with month as ``yyyy-MM`` of the record's arrival, null if unknown."""
    return orphans.groupBy("ref_table", F.date_format("record_at", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("n_orphans"))
