from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from evispark.operators import references as R

CLAIMS = "claim_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz, h int, rng int"
RECORDS = "synthesis_id string, supporting_claim_ids array<string>, ingested_at timestamp_ntz, claim_id string, salt int"
T = [dt(2024, 1, d) for d in range(1, 10)]


def orphans(spark, claims, records):
    refs = R.reference_rows(spark.createDataFrame(records, RECORDS), "syntheses", "synthesis_id")
    return {(r.record_id, r.claim_id): r.reason for r in R.orphan_references(refs, R.parent_rows(spark.createDataFrame(claims, CLAIMS))).collect()}


def test_reasons(spark):
    claims = [("a", T[0], None, 1, 1), ("a", T[5], T[3], 1, 1), ("b", T[6], None, 1, 1), ("c", None, None, None, None), (None, T[0], None, 1, 1)]
    records = [("s1", [" A\n", "b", "zz", None, "", "  ", "zz"], T[4], "x", 0), ("s2", ["a"], T[2], None, None), ("s3", None, T[2], None, 1), ("s4", [], T[2], None, 1), ("s5", ["a", "q"], None, None, 1), (None, ["q"], T[1], None, 1), ("s6", ["b"], T[6], None, 1), ("s7", ["a"], T[3], None, 1), ("s1", ["zz"], T[8], None, 1), ("s8", ["c"], T[0], None, 1)]
    assert orphans(spark, claims, records) == {("s1", "a"): "deleted", ("s1", "b"): "late", ("s1", "zz"): "missing", ("s5", "q"): "missing", ("s7", "a"): "deleted"}


def test_empty_tables(spark):
    assert orphans(spark, [], []) == {}
    assert orphans(spark, [], [("s", ["a"], T[0], None, 1)]) == {("s", "a"): "missing"}
    assert orphans(spark, [("a", T[0], None, 1, 1)], []) == {}


def test_hot_key_is_salted(spark, monkeypatch):
    monkeypatch.setattr(R, "REFERENCES_PER_TASK", 10)
    records = spark.range(200).select(F.col("id").cast("string").alias("synthesis_id"), F.array(F.lit("hot"), F.lit("gone")).alias("supporting_claim_ids"), F.lit(T[4]).cast("timestamp_ntz").alias("ingested_at"))
    claims = spark.createDataFrame([("hot", T[0], None, 1, 1)], CLAIMS)
    out = R.orphan_references(R.reference_rows(records, "syntheses", "synthesis_id"), R.parent_rows(claims))
    assert out.count() == 200 and {r.claim_id for r in out.collect()} == {"gone"}


@pytest.mark.parametrize("shift", [0, 1])
def test_keys_that_share_a_hash(spark, shift):
    import pyarrow as pa

    ts = pa.timestamp("us")
    parents = pa.table({"h": pa.array([7, 7, 9]), "claim_id": ["x", "y", "z"], "arrived_at": pa.array([T[0]] * 3, ts), "deleted_at": pa.nulls(3, ts)})
    refs = pa.table({"h": pa.array([7, 7, 7, 8]), "ref_table": ["r"] * 4, "record_id": ["1", "2", "3", "4"], "claim_id": ["y", "x", "w", "z"], "record_at": pa.array([T[1 + shift]] * 4, ts)})
    assert R._probe(parents, refs)["record_id"].to_pylist() == ["3", "4"]
