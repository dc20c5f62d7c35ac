"""Queries over seed items and their state."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..operators import items as it
from . import bindings as b, query
from .bindings import cte, with_

CARDS = [("0115", True, None), ("0223", False, dt.date(1998, 5, 25))]
CARD_SCHEMA = "card_ending string, business boolean, personal_from date"
FAMILY = "fleet"


def seeds(spark, sf):
    """Items: one per order; documents and card rows of one family share dates and amounts by customer."""
    o = b.table(spark, sf, "orders")
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(s == "F", "document").when(s == "O", "card").otherwise("expense").alias("source"),
        F.concat(F.when(p.isin("1-URGENT", "2-HIGH"), "FLEET ").otherwise("SHOP "), p).alias("merchant"),
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date"),
        F.round(F.col("o_totalprice") / 10000).cast(MONEY).alias("amount"),
        F.when(p == "1-URGENT", "-40115").when(p == "2-HIGH", "xx 0223").when(p == "3-MEDIUM", "0223").otherwise("").alias("card"),
        F.concat(F.lit("ref"), F.col("o_custkey").cast("string")).alias("reference"),
        F.when(p == "5-LOW", "look it up").otherwise("").alias("action"),
        F.lit(None).cast("string").alias("tag"),
        F.when(p == "4-NOT SPECIFIED", "needs-receipt").otherwise("ready").alias("status"),
    )


def patches(spark, sf):
    """State patches: two per line group, some for unknown items or with values not allowed."""
    li = b.table(spark, sf, "lineitem").filter(F.col("l_linenumber") <= 2)
    f = F.col("l_returnflag")
    return li.select(
        F.when(F.col("l_quantity") >= 49, F.concat(F.lit("x"), F.col("l_orderkey").cast("string"))).otherwise(F.col("l_orderkey").cast("string")).alias("id"),
        F.when(F.col("l_quantity") < 2, "weird").when(f == "A", "business").when(f == "N", "").otherwise("personal").alias("tag"),
        F.when(F.col("l_quantity") > 47, "lost").when(f == "R", "done").when(f == "N", "blocked").otherwise("").alias("status"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("note "), f)).alias("operator_note"),
        F.col("l_shipdate").alias("updated_at"),
        F.concat_ws("-", F.lpad(F.col("l_partkey").cast("string"), 12, "0"), F.col("l_extendedprice").cast(MONEY), F.col("l_linenumber")).alias("line"),
    )


cte("seeds", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderstatus WHEN 'F' THEN 'document' WHEN 'O' THEN 'card' ELSE 'expense' END AS source,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'FLEET ' ELSE 'SHOP ' END || o_orderpriority AS merchant, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
  CAST(round(o_totalprice / 10000) AS DECIMAL(18,2)) AS amount, CASE o_orderpriority WHEN '1-URGENT' THEN '0115' WHEN '2-HIGH' THEN '0223' WHEN '3-MEDIUM' THEN '0223' ELSE '' END AS card_ending,
  'ref' || o_custkey AS reference, CASE o_orderpriority WHEN '5-LOW' THEN 'look it up' ELSE '' END AS action, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'needs-receipt' ELSE 'ready' END AS status
FROM orders""")
cte("patches", """
SELECT CASE WHEN l_quantity >= 49 THEN 'x' || l_orderkey ELSE CAST(l_orderkey AS VARCHAR) END AS id, CASE WHEN l_quantity < 2 THEN 'weird' WHEN l_returnflag = 'A' THEN 'business' WHEN l_returnflag = 'N' THEN '' ELSE 'personal' END AS tag,
  CASE WHEN l_quantity > 47 THEN 'lost' WHEN l_returnflag = 'R' THEN 'done' WHEN l_returnflag = 'N' THEN 'blocked' ELSE '' END AS status, CASE WHEN l_linestatus = 'F' THEN 'note ' || l_returnflag END AS operator_note, l_shipdate AS updated_at,
  lpad(CAST(l_partkey AS VARCHAR), 12, '0') || '-' || CAST(l_extendedprice AS DECIMAL(18,2)) || '-' || l_linenumber AS line
FROM lineitem WHERE l_linenumber <= 2""")
cte("judged", """
SELECT *, CASE WHEN id NOT IN (SELECT id FROM seeds) THEN 'unknown id' WHEN tag NOT IN ('','business','personal','needs-tag','ignore') THEN 'invalid tag' WHEN status NOT IN ('','ready','needs-receipt','blocked','pending-payout','done','ignore') THEN 'invalid status' END AS reason FROM patches""", "seeds", "patches")
cte("state", """
SELECT id, arg_max(tag, (updated_at, line)) FILTER (tag <> '') AS tag, arg_max(status, (updated_at, line)) FILTER (status <> '') AS status, arg_max(operator_note, (updated_at, line)) FILTER (operator_note IS NOT NULL) AS operator_note, max(updated_at) AS updated_at
FROM judged WHERE reason IS NULL GROUP BY id""", "judged")


def imported(spark, sf):
    empty = patches(spark, sf).select("id", "tag", "status", "operator_note", "updated_at").limit(0)
    return it.import_state(empty, patches(spark, sf), seeds(spark, sf))


@query("m5_import_state", with_("state", body="""
SELECT id, coalesce(tag, '') AS tag, coalesce(status, '') AS status, coalesce(operator_note, '') AS operator_note, 'state' AS part, count(*) AS n FROM state GROUP BY ALL
UNION ALL SELECT id, '', '', '', reason, count(*) FROM judged WHERE reason IS NOT NULL GROUP BY ALL"""))
def m5(spark, sf):
    state, skipped = imported(spark, sf)
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("tag", "status", "operator_note")]
    a = state.select("id", *blank, F.lit("state").alias("part"))
    c = skipped.select("id", *[F.lit("").alias(x) for x in ("tag", "status", "operator_note")], F.col("reason").alias("part"))
    return a.unionByName(c).groupBy("id", "tag", "status", "operator_note", "part").agg(F.count(F.lit(1)).alias("n"))


def laid(spark, sf):
    return it.overlay(seeds(spark, sf), imported(spark, sf)[0].drop("updated_at"))


cte("laid", "SELECT s.* EXCLUDE (status), coalesce(t.status, s.status) AS status, t.tag AS own_tag, t.operator_note FROM seeds s LEFT JOIN state t ON t.id = s.id", "seeds", "state")


@query("j18_overlay", with_("laid", body="SELECT id, status, own_tag AS tag, operator_note FROM laid"))
def j18(spark, sf):
    return laid(spark, sf).select("id", "status", "tag", "operator_note")


@query("s8_seed_state", with_("seeds", body="SELECT id, source, amount, status, CAST(NULL AS VARCHAR) AS tag FROM seeds"))
def s8(spark, sf):
    """With no state recorded the seeds stand alone."""
    return it.seed_state(seeds(spark, sf), None).select("id", "source", "amount", "status", "tag")


def tagged(spark, sf):
    return it.inferred_tag(laid(spark, sf), b.policy_table(spark, CARDS, CARD_SCHEMA))


def laned(spark, sf):
    return it.lane(tagged(spark, sf), FAMILY)


cte("tagged", """
SELECT *, CASE WHEN coalesce(own_tag, '') <> '' THEN own_tag WHEN status = 'ignore' THEN 'ignore' WHEN status IN ('done','pending-payout') THEN 'business' WHEN source = 'document' THEN 'business' WHEN card_ending = '0115' THEN 'business'
  WHEN card_ending = '0223' AND date >= DATE '1998-05-25' THEN 'personal' ELSE 'needs-tag' END AS tag FROM laid""", "laid")
cte("laned", """
SELECT *, CASE WHEN status = 'ignore' OR tag = 'ignore' THEN 'skip-ignore' WHEN source = 'card' AND tag = 'personal' THEN 'personal-reconcile' WHEN source = 'card' AND status IN ('done','pending-payout') THEN 'already-handled'
  WHEN source = 'card' AND tag = 'business' THEN 'external-card-fortnox' WHEN source = 'document' AND matched THEN 'document-matched' WHEN source = 'document' THEN 'document-review' ELSE 'needs-classification' END AS lane
FROM (SELECT t.*, source = 'document' AND EXISTS (SELECT 1 FROM tagged c WHERE c.source = 'card' AND contains(lower(c.merchant), 'fleet') AND c.date = t.date AND c.amount = t.amount) AS matched FROM tagged t)""", "tagged")


@query("j17_evidence_exists", with_("laned", body="SELECT id, matched FROM laned WHERE source = 'document'"))
def j17(spark, sf):
    rows = seeds(spark, sf)
    return it.evidence_exists(rows.filter("source = 'document'"), rows.filter("source = 'card'"), FAMILY).select("id", "matched")


@query("d11_lane", with_("laned", body="""
SELECT id, tag, lane, CASE WHEN lane = 'external-card-fortnox' AND status = 'ready' THEN 'add to the accountant''s pack'
  WHEN lane = 'external-card-fortnox' AND status = 'needs-receipt' THEN 'find or request the invoice: ' || coalesce(operator_note, nullif(action, ''), 'missing invoice')
  WHEN lane = 'external-card-fortnox' AND status = 'blocked' THEN 'blocked: ' || coalesce(operator_note, nullif(action, ''), 'waiting on external input')
  WHEN lane = 'personal-reconcile' THEN 'keep out of the company''s expenses' WHEN lane = 'already-handled' THEN 'keep as evidence, no new booking' WHEN lane = 'skip-ignore' THEN 'skip'
  WHEN lane = 'document-review' THEN 'no card row matches, review' WHEN lane = 'document-matched' THEN 'evidence for a card row' ELSE CASE WHEN action = '' THEN 'review and classify' ELSE action END END AS next_action
FROM laned"""))
def d11(spark, sf):
    return laned(spark, sf).select("id", "tag", "lane", "next_action")


@query("p6_search_items", with_("tagged", body="""
SELECT id, date, amount, status FROM tagged WHERE tag = 'business' AND status = 'blocked'
 AND contains(lower(concat_ws(' ', id, source, merchant, CAST(date AS VARCHAR), CAST(amount AS VARCHAR), reference, action, coalesce(operator_note, ''))), 'fleet')"""))
def p6(spark, sf):
    return it.search_items(tagged(spark, sf), tag="business", status="blocked", text="FLEET").select("id", "date", "amount", "status")


@query("a7_item_summary", with_("tagged", body="""
SELECT 'source' AS facet, source AS value, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS amount FROM tagged GROUP BY source UNION ALL SELECT 'status', status, count(*), CAST(sum(amount) AS DECIMAL(18,2)) FROM tagged GROUP BY status
UNION ALL SELECT 'tag', tag, count(*), CAST(sum(amount) AS DECIMAL(18,2)) FROM tagged GROUP BY tag UNION ALL SELECT 'all', '', count(*), CAST(sum(amount) AS DECIMAL(18,2)) FROM tagged"""))
def a7(spark, sf):
    return it.item_summary(tagged(spark, sf))


@query("a8_lane_queues", with_("laned", body="""
SELECT lane, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(s) AS DECIMAL(18,2)) AS amount, string_agg(status || ' ' || n, ', ' ORDER BY status) AS statuses FROM (SELECT lane, status, count(*) AS n, sum(amount) AS s FROM laned GROUP BY lane, status) GROUP BY lane"""))
def a8(spark, sf):
    out = it.lane_queues(laned(spark, sf))
    text = F.array_join(F.transform(F.map_entries("statuses"), lambda e: F.concat_ws(" ", e["key"], e["value"].cast("string"))), ", ")
    return out.withColumn("statuses", text)


SUBSETS = {
    "card": "source = 'card'", "business": "source = 'card' AND tag = 'business'", "business_ready": "source = 'card' AND tag = 'business' AND status = 'ready'",
    "business_missing": "source = 'card' AND tag = 'business' AND status = 'needs-receipt'", "business_blocked": "source = 'card' AND tag = 'business' AND status = 'blocked'",
    "done": "source = 'card' AND status = 'done'", "pending": "source = 'card' AND status = 'pending-payout'", "personal": "source = 'card' AND tag = 'personal'",
    "ignored": "status = 'ignore'", "matched": "lane = 'document-matched'", "unmatched": "lane = 'document-review'",
}


@query("a10_closeout_counts", with_("laned", body="SELECT " + ", ".join(
    f"count(*) FILTER ({c}) AS {n}_n, CAST(coalesce(sum(amount) FILTER ({c}), 0) AS DECIMAL(18,2)) AS {n}_sek" for n, c in SUBSETS.items()) + " FROM laned"))
def a10(spark, sf):
    return it.closeout_counts(laned(spark, sf))


@query("t3_next_actions", with_("tagged", body="""
SELECT id, date, amount, CASE WHEN tag = 'business' THEN 'business' ELSE 'personal' END AS list FROM tagged WHERE (tag = 'business' AND status NOT IN ('done','ignore','pending-payout')) OR (tag = 'personal' AND status <> 'ignore')
ORDER BY list, date DESC, id"""))
def t3(spark, sf):
    return it.next_actions(tagged(spark, sf)).select("id", "date", "amount", "list")
