"""Search keys and the way of a pair from its hit to its place."""

import datetime as dt

from pyspark.sql import functions as F

from tallybridge.catalog import matching as queries
from tallybridge.operators import matching as mt

D = dt.date


def _messages(spark):
    rows = [("A", 1, D(2026, 7, 1), "Your receipt from Acme", None, None), ("B", 1, D(2026, 7, 1), "", "x@e.d.c.b.a", "e.d.c.b.a"), ("C", 1, D(2026, 7, 1), "", "x@b.a", "b.a")]
    df = spark.createDataFrame(rows, "message_id string, mailbox int, day date, subject string, from_addr string, from_domain string")
    return df.withColumn("mentions", F.array().cast("array<struct<value:decimal(18,2),currency:string>>"))


def test_a_message_without_sender_is_found_by_its_subject(spark):
    got = mt.message_blocks(_messages(spark), ["receipt from acme"], ["receipt"]).collect()
    assert {(r.field, r.key) for r in got if r.message_id == "A"} == {
        ("subject", "receipt from acme"), ("merchant", "YOUR"), ("merchant", "RECEIPT"), ("merchant", "FROM"), ("merchant", "ACME")}
    domains = {m: sorted(r.key for r in got if r.message_id == m and r.field == "vendor") for m in "BC"}
    assert domains == {"B": ["a", "b.a", "c.b.a", "d.c.b.a", "e.d.c.b.a", "x@e.d.c.b.a"], "C": ["a", "b.a", "x@b.a"]}


def test_scored_pairs_are_not_shuffled_again_to_be_ranked(spark):
    # As for tables that are too large to be shipped.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = queries.ranked(spark, "/root/testdata/sf0.001")
        plan = ranked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert exchanges and not [line for line in exchanges if "thread_id" in line or "_wants" in line]
