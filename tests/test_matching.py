"""Scoring goldens for one charge and six messages, and routing."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybridge.operators import matching as mt

D = dt.date
TERMS = {
    "receipt_terms": ["receipt", "kvitto", "invoice", "payment", "order"], "refund_terms": ["refund", "kreditnota"],
    "forward_prefixes": ["fwd:", "fw:"], "reply_prefixes": ["re:"], "own_senders": ["owner@own.example"], "forward_addresses": ["forward@inbox.example"],
}
POLICY = mt.MatchPolicy(terms=TERMS)
STOP = ["STOCKHOLM"]
M = "message_id string, thread_id string, day date, subject string, from_name string, from_addr string, value string, currency string, pdf boolean, html boolean"
MESSAGES = [
    ("C1", "t1", D(2026, 7, 10), "Your receipt from Acme", "Acme", "billing@acme.example", "320.00", "EUR", True, False),
    ("C2", "t2", D(2026, 7, 7), "Summer offers", "Acme", "news@acme.example", None, None, False, True),
    ("C3", "t3", D(2026, 6, 30), "Your receipt from Acme", "Acme", "billing@acme.example", "290.00", "EUR", True, False),
    ("C4", "t4", D(2026, 7, 11), "Payment receipt", "Acme Cloud", "billing@pay.example", "3600.00", "SEK", False, True),
    ("C5", "t5", D(2026, 7, 10), "Refund for your order", "Any", "any@any.example", None, None, False, False),
    ("C6", "t6", D(2026, 7, 10), "Fwd: Your receipt from Acme", "Owner", "owner@own.example", "320.00", "EUR", False, False),
]


@pytest.fixture(scope="module")
def scored(spark):
    rows = spark.createDataFrame(MESSAGES, M).withColumns({
        "mentions": F.when(F.col("value").isNotNull(), F.array(F.struct(F.col("value").cast("decimal(18,2)").alias("value"), "currency"))).otherwise(F.array().cast("array<struct<value:decimal(18,2),currency:string>>")),
        "from_domain": F.substring_index("from_addr", "@", -1), "reply_addr": F.lit(""), "reply_domain": F.lit(""), "to": F.lit(""),
        "row_key": F.lit("R1"), "ledger": F.lit("card"), "date": F.lit(D(2026, 7, 10)), "merchant": F.lit("ACMECLOUD STOCKHOLM"), "kind": F.lit("charge"),
        "amount_sek": F.lit(Decimal("3570.54")), "foreign_amount": F.lit(Decimal("320.00")), "foreign_currency": F.lit("EUR"), "tag": F.lit("business"),
        "vendor_key": F.lit("acme"), "vendor_name": F.lit("Acme Cloud"), "senders": F.array(F.lit("acme.example")), "sender_exact": F.array(F.lit("billing@acme.example")),
        "subject_terms": F.array(F.lit("your receipt from acme")), "decoy_senders": F.array().cast("array<string>"), "bill_currency": F.lit("EUR"), "attachments": F.lit("pdf"),
        "band_lo": F.lit(-1), "band_hi": F.lit(1), "window_from": F.lit(D(2026, 6, 30)), "window_to": F.lit(D(2026, 7, 15)),
    }).withColumn("lag_days", F.datediff("day", "date"))
    rows = mt.charge_features(mt.message_features(rows.drop("value", "currency", "pdf", "html"), POLICY), STOP)
    first = mt.score(rows)
    details = spark.createDataFrame(MESSAGES, M).select(
        "message_id", F.array().cast("array<struct<value:decimal(18,2),currency:string>>").alias("mentions"), F.col("pdf").alias("has_pdf"), F.col("html").alias("has_html"), F.array().cast("array<string>").alias("links"))
    return mt.rescore(first, details).cache()


def test_score_parts(scored):
    got = {r.message_id: r for r in scored.collect()}
    want = {
        "C1": (35, 25, 20, 10, 5, 0, 95), "C2": (0, 19, 15, 0, 0, 0, 34), "C3": (-15, 5, 20, 10, 5, 0, 25),
        "C4": (15, 25, 10, 5, 0, 0, 55), "C6": (35, 25, 0, 10, 0, -15, 55),
    }
    for key, parts in want.items():
        r = got[key]
        assert (r.s_amount, r.s_date, r.s_sender, r.s_subject, r.s_attachment, r.s_class, r.score) == parts, key
    assert got["C5"]["class"] == "refund" and got["C6"]["class"] == "forward"


def test_ranking_and_confidence(scored):
    pool = scored.filter("message_id <> 'C6'")
    got = [(r.message_id, r.rank, r.confidence) for r in mt.rank_candidates(pool, POLICY).orderBy("rank").collect()]
    assert got == [("C1", 1, "strong"), ("C4", 2, "possible")]
    best = mt.best_second(mt.rank_candidates(pool, POLICY)).collect()[0]
    assert (best.best, best.second, best.secondary) == ("C1", "C4", None)
    weak = mt.rank_candidates(scored.filter("message_id IN ('C2', 'C3')"), POLICY).collect()
    assert [(r.message_id, r.confidence) for r in weak] == [("C3", "weak")]


def test_routes(spark):
    rows = [("a", "expense", 39, "strong", None, "business"), ("b", "expense", 40, "strong", None, "business"), ("c", "expense", 39, "strong", 3, "business"),
            ("d", "card", 10, "possible", None, "business"), ("e", "card", 10, "strong", None, "needs-tag"), ("f", "card", 1, None, None, "business")]
    run = D(2026, 9, 1)
    df = spark.createDataFrame([(k, l, run - dt.timedelta(days=a), c, (run - dt.timedelta(days=s)) if s else None, t) for k, l, a, c, s, t in rows],
                               "row_key string, ledger string, date date, confidence string, sent_day date, tag string")
    for name, value in {"best": "m1", "secondary": None, "kind": "charge", "route_if_none": "none", "portal": "", "vendor_key": "v", "vendor_entity": "alfa", "entity": "alfa"}.items():
        df = df.withColumn(name, F.lit(value).cast("string"))
    df = df.withColumn("best_gap", F.lit(0))
    got = {r.row_key: r for r in mt.route(df, POLICY, F.lit(run)).collect()}
    assert [got[k].route for k in "abcdef"] == ["forward", "attach", "confirm", "pack", "none", "none"]
    assert got["a"].forward_deadline == got["a"].date + dt.timedelta(days=39)
    assert "review amount first" in got["d"].route_reason and "needs a tag" in got["e"].route_reason and "too recent" in got["f"].route_reason
    ids = {r.row_key: r.fetch_ids for r in mt.fetch_decision(mt.route(df, POLICY, F.lit(run)).withColumn("best", F.lit(7).cast("bigint")).withColumn("secondary", F.lit(None).cast("bigint")), "possible").collect()}
    assert ids["d"] == [7] and ids["a"] == []


def test_blocking_never_uses_a_product(spark):
    from tallybridge.catalog import matching as cm

    text = cm.blocked(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_related_sends(spark):
    """One send a side: same mailbox, the window at any day, the index from the best mail on."""
    best = spark.createDataFrame(
        [("a", 1, "m1", "t1", D(2026, 5, 10), "Your invoice 4711", D(2026, 5, 1), D(2026, 5, 16)), ("b", 2, "m2", "t2", D(2026, 5, 10), "Your invoice", D(2026, 5, 1), D(2026, 5, 16))],
        "row_key string, mailbox int, best string, best_thread string, best_day date, best_subject string, window_from date, window_to date",
    )
    sends = [
        ("before", 1, "x", D(2026, 5, 3), "Fwd: your invoice 4711", "me"), ("late", 1, "x", D(2026, 7, 1), "VB: Your invoice 4711", "you"),
        ("elsewhere", 3, "x", D(2026, 8, 1), "Fwd: Your invoice 4711", "me"), ("early", 1, "t1", D(2026, 4, 1), "hello", "me"),
        ("unnumbered", 2, "y", D(2026, 5, 12), "Fwd: Your invoice", "me"),
    ] + [(f"hot{i:03d}", 2, "t2", D(2026, 5, 10) + dt.timedelta(days=i % 40), "again", "me") for i in range(400)]
    got = mt.related_sends(best, spark.createDataFrame(sends, "message_id string, mailbox int, thread_id string, day date, subject string, from_addr string"), ["fwd:", "vb:"])
    assert sorted((r.row_key, r.side, r.send_id, r.send_day, r.send_from) for r in got.collect()) == [
        ("a", "index", "late", D(2026, 7, 1), "you"), ("a", "window", "before", D(2026, 5, 3), "me"),
        ("b", "index", "hot399", D(2026, 6, 18), "me"), ("b", "window", "hot366", D(2026, 5, 16), "me"),
    ]
    assert {r.row_key: (r.sent_id, r.sent_from) for r in mt.last_send(got).collect()} == {"a": ("late", "you"), "b": ("hot399", "me")}


def test_routes_with_hints(spark):
    run = D(2026, 9, 1)
    rows = [
        ("a", None, "", "Forwarded yesterday", None), ("b", D(2026, 8, 30), "other@x", "", "E1"), ("c", D(2026, 8, 30), "me@x", "see  the portal", "E1"),
        ("d", None, "", "forward", "E1"), ("e", None, "", "ready", "E1"), ("f", None, "", "attach by hand", None), ("g", None, "", "attach by hand", "E7"),
    ]
    df = spark.createDataFrame(
        [(k, run - dt.timedelta(days=45 if k in "fg" else 5), sent, frm, hint, exp) for k, sent, frm, hint, exp in rows],
        "row_key string, date date, sent_day date, sent_from string, status_hint string, expense_id string",
    )
    fixed = {"ledger": "expense", "confidence": "strong", "tag": "business", "best": "m1", "secondary": None, "kind": "charge", "route_if_none": "none", "portal": "", "vendor_key": "v", "vendor_entity": "alfa", "entity": "alfa"}
    for name, value in fixed.items():
        df = df.withColumn(name, F.lit(value).cast("string"))
    got = {r.row_key: r for r in mt.route(df.withColumn("best_gap", F.lit(0)), mt.MatchPolicy(identities={"alfa": "me@x"}), F.lit(run)).collect()}
    assert [got[k].route for k in "abcdefg"] == ["confirm"] * 3 + ["forward"] * 2 + ["attach"] * 2
    assert got["a"].route_reason == "already forwarded according to the input; confirm m1, do not forward again; input hint: Forwarded yesterday"
    assert "(that forward went from other@x, not from me@x)" in got["b"].route_reason
    assert got["c"].route_reason == "already forwarded 2026-08-30; confirm, do not forward again; input hint: see the portal"
    assert "input hint" not in got["d"].route_reason and "input hint" not in got["e"].route_reason and got["e"].forward_from == "me@x"
    assert got["f"].route_reason.startswith("attach m1; find the expense by receipt number f") and got["g"].route_reason.startswith("attach m1 on expense E7")


def test_found_pairs_are_hashed_not_sorted(spark):
    """Kinds of a pair travel as bits: no list per pair is gathered, and the kinds come out in order."""
    from tallybridge.operators import matching as m

    charges = spark.sql(
        "SELECT 'a' AS row_key, 'box' AS mailbox, DATE'2026-01-01' AS window_from, DATE'2026-01-20' AS window_to, 'X' AS merchant, 'V' AS vendor_name, "
        "array('shop.example') AS senders, array('Receipt') AS subject_terms, array() AS sender_exact, 12.00BD AS amount_sek, NULL AS foreign_amount"
    )
    mails = spark.sql(
        "SELECT 1 AS message_id, 'box' AS mailbox, DATE'2026-01-05' AS day, 'Receipt' AS subject, 'a@shop.example' AS from_addr, 'shop.example' AS from_domain, "
        "array(struct(12.00BD AS value, 'SEK' AS currency)) AS mentions"
    )
    found = m.blocked_pairs(charges, mails, [], ["receipt"], [])
    assert [tuple(r) for r in found.collect()] == [("a", 1, ["amount", "subject", "vendor"])]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "ObjectHashAggregate" not in plan
