"""Queries over the monthly plan: disposition, postings, numbering, status, digest, steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..operators import posting as po
from . import bindings as b, query
from .bindings import with_


@query("p2_plan_disposition", with_("disposed", body="SELECT ref, month, disposition, reason FROM disposed"))
def p2(spark, sf):
    return b.disposed(spark, sf).select("ref", "month", "disposition", "reason")


@query(
    "p3_fetch_scope",
    with_(
        "classified",
        body="""
SELECT ref, strftime(date, '%Y-%m') AS month, entity = 'alfa' AND amount > 0 AS selected,
       CASE WHEN entity <> 'alfa' THEN 'entity ' || entity WHEN amount <= 0 THEN 'refund or payment, no receipt to fetch' ELSE '' END AS skip_note
FROM classified WHERE tag = 'business' AND NOT contains(merchant, 'COLD ANVIL')""",
    ),
)
def p3(spark, sf):
    rows = po.fetch_scope(b.classified(spark, sf), b.OWN, b.POLICY.payment_phrase)
    return rows.select("ref", "month", "selected", "skip_note")


@query("j7_attach_files", with_("with_files", body="SELECT ref, receipt_file, file_match FROM with_files"))
def j7(spark, sf):
    return b.with_files(spark, sf).select("ref", "receipt_file", "file_match")


def _paid(spark, sf):
    low = b.table(spark, sf, "orders").filter(F.col("o_orderpriority") == "5-LOW")
    key = F.col("o_orderkey").cast("string")
    return low.select(F.concat(key, F.lit("-1")).alias("ref"), F.concat(F.lit("payout-"), F.col("o_custkey").cast("string")).alias("payout_id"))


@query(
    "j22_exclude_paid",
    with_(
        "disposed",
        body="""
SELECT d.ref, CASE WHEN disposition = 'planned' AND p.ref IS NOT NULL THEN 'excluded' ELSE disposition END AS disposition,
       CASE WHEN disposition = 'planned' AND p.ref IS NOT NULL THEN 'already paid payout-' || p.o_custkey ELSE reason END AS reason
FROM disposed d LEFT JOIN (SELECT o_orderkey || '-1' AS ref, o_custkey FROM orders WHERE o_orderpriority = '5-LOW') p ON p.ref = d.ref""",
    ),
)
def j22(spark, sf):
    return po.exclude_paid(b.disposed(spark, sf), _paid(spark, sf)).select("ref", "disposition", "reason")


@query(
    "d2_post_vouchers",
    with_("postings", body="SELECT month, ref, date, vat_regime, line, account, debit, credit FROM postings"),
)
def d2(spark, sf):
    return b.postings(spark, sf)


@query(
    "d2_voucher_balance",
    with_(
        "planned",
        body="SELECT month, count(*) AS vouchers, CAST(0 AS BIGINT) AS unbalanced, CAST(sum(amount) AS DECIMAL(18,2)) AS gross FROM planned GROUP BY month",
    ),
)
def d2_balance(spark, sf):
    per = b.postings(spark, sf).groupBy("month", "ref").agg(
        F.sum("debit").alias("debit"),
        F.sum("credit").alias("credit"),
        F.sum(F.when(F.col("account") == b.ACCOUNTS["liability"], F.col("credit"))).alias("gross"),
    )
    return per.groupBy("month").agg(
        F.count(F.lit(1)).alias("vouchers"),
        F.count_if(F.col("debit") != F.col("credit")).alias("unbalanced"),
        F.sum("gross").cast(MONEY).alias("gross"),
    )


@query(
    "w4_number_vouchers",
    with_(
        "planned",
        body="SELECT month, ref, date, row_number() OVER (PARTITION BY month ORDER BY date, ref) AS voucher_no FROM planned",
    ),
)
def w4(spark, sf):
    rows = b.planned(spark, sf).select("month", "ref", "date")
    return po.number_vouchers(rows).select("month", "ref", "date", "voucher_no")


STATUS_SQL = """
SELECT month, ref, date, merchant, amount, 'planned' AS disposition, '' AS reason,
  CASE WHEN receipt_file = '' AND vat_regime IN ('oss_pending','none','') THEN 'kvitto saknas; oss policy pending'
       WHEN receipt_file = '' THEN 'kvitto saknas' WHEN vat_regime IN ('oss_pending','none','') THEN 'oss policy pending' ELSE 'ok' END AS status
FROM with_files
UNION ALL SELECT month, ref, date, merchant, amount, disposition, reason, 'excluded ' || reason FROM disposed WHERE disposition = 'excluded'"""


def _status(spark, sf):
    in_scope = b.disposed(spark, sf).filter(F.col("disposition") != "out-of-scope")
    return po.plan_status(b.with_files(spark, sf, in_scope), b.regimes(spark))


@query("d3_plan_status", with_("with_files", body=f"SELECT ref, month, disposition, status FROM ({STATUS_SQL})"))
def d3(spark, sf):
    return _status(spark, sf).select("ref", "month", "disposition", "status")


SEK = "replace(replace(replace(format('{:,.2f}', CAST(amount AS DOUBLE)), ',', '~'), '.', ','), '~', ' ')"


@query(
    "d3_plan_warnings",
    with_(
        "with_files",
        body=f"""
WITH s AS ({STATUS_SQL}), w AS (SELECT *, ref || ' ' || date || ' ' || replace(merchant, '|', '/') || ' (' || {SEK} || ' SEK)' AS body FROM s)
SELECT month, ref, 'evidence-missing' AS kind, body AS text FROM w WHERE contains(status, 'kvitto saknas')
UNION ALL SELECT month, ref, 'gross-pending', body FROM w WHERE contains(status, 'oss policy pending')
UNION ALL SELECT month, ref, 'excluded', reason || ': ' || body FROM w WHERE disposition = 'excluded'""",
    ),
)
def d3_warnings(spark, sf):
    return po.plan_warnings(_status(spark, sf))


@query(
    "a9_reason_counts",
    with_(
        "disposed",
        body="SELECT month, reason, count(*) AS n FROM disposed WHERE disposition = 'excluded' GROUP BY month, reason",
    ),
)
def a9(spark, sf):
    return po.reason_counts(b.disposed(spark, sf))


@query(
    "a16_reimbursement_row",
    with_(
        "planned",
        body="SELECT month, last_day(max(date)) AS date, count(*) AS vouchers, CAST(sum(amount) AS DECIMAL(18,2)) AS amount FROM planned GROUP BY month",
    ),
)
def a16(spark, sf):
    return po.reimbursement_row(b.planned(spark, sf))


@query(
    "x23_voucher_text",
    with_(
        "planned",
        body="""
SELECT ref, left('Utlagg kort' || ' ' || rtrim(left(merchant, 99 - 11 - 2 - length(ref))) || ' ' || ref, 99) AS description,
       regexp_replace(ref, '[^A-Za-z0-9_.-]', '_', 'g') AS safe_ref
FROM planned""",
    ),
)
def x23(spark, sf):
    return po.with_voucher_text(b.planned(spark, sf), "Utlagg kort").select("ref", "description", "safe_ref")


DIGEST_SQL = """
lines AS (
  SELECT p.month, row_number() OVER (PARTITION BY p.month ORDER BY p.date, p.ref) AS n,
         sha256(concat_ws('|', p.date, p.ref, x.body, p.receipt_file)) AS h
  FROM with_files p JOIN (SELECT month, ref, string_agg(account || ':' || debit || ':' || credit, ',' ORDER BY line) AS body FROM postings GROUP BY month, ref) x
    ON x.month = p.month AND x.ref = p.ref),
l1 AS (SELECT month, (n - 1) // 4096 + 1 AS n, sha256(string_agg(h, chr(10) ORDER BY n)) AS h FROM lines GROUP BY month, (n - 1) // 4096),
l2 AS (SELECT month, (n - 1) // 4096 + 1 AS n, sha256(string_agg(h, chr(10) ORDER BY n)) AS h FROM l1 GROUP BY month, (n - 1) // 4096),
l3 AS (SELECT month, (n - 1) // 4096 + 1 AS n, sha256(string_agg(h, chr(10) ORDER BY n)) AS h FROM l2 GROUP BY month, (n - 1) // 4096),
l4 AS (SELECT month, (n - 1) // 4096 + 1 AS n, sha256(string_agg(h, chr(10) ORDER BY n)) AS h FROM l3 GROUP BY month, (n - 1) // 4096)"""


def _codes(spark, sf):
    numbered = po.number_vouchers(b.with_files(spark, sf))
    return po.batch_digest(numbered, po.post_vouchers(numbered, b.regimes(spark), b.ACCOUNTS))


@query(
    "x24_batch_digest",
    with_("with_files", "postings", body="SELECT month, batch_code FROM (WITH " + DIGEST_SQL.strip() + " SELECT month, left(h, 16) AS batch_code FROM l4)"),
)
def x24(spark, sf):
    return _codes(spark, sf)


def _done(spark, sf):
    """Steps on record for some orders; the oldest months were approved under another code."""
    orders = b.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")
    month = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM")
    steps = F.when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit("upload"), F.lit("voucher"))).otherwise(
        F.array(F.lit("upload"))
    )
    return orders.select(
        month.alias("month"),
        F.when(month < "1995-06", F.lit("stale")).otherwise(F.concat(F.lit("c"), month)).alias("batch_code"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit("-1")).alias("ref"),
        F.explode(steps).alias("step"),
    )


@query(
    "m6_remaining_steps",
    with_(
        "with_files",
        body="""
WITH done AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey || '-1' AS ref, unnest(CASE WHEN o_orderpriority = '2-HIGH' THEN ['upload','voucher'] ELSE ['upload'] END) AS step,
         CASE WHEN strftime(o_orderdate, '%Y-%m') < '1995-06' THEN 'stale' ELSE 'c' || strftime(o_orderdate, '%Y-%m') END AS batch_code
  FROM orders WHERE o_orderstatus = 'F'),
blocked AS (SELECT DISTINCT month FROM done WHERE batch_code <> 'c' || month AND month IN (SELECT month FROM with_files)),
live AS (SELECT * FROM with_files WHERE month NOT IN (SELECT month FROM blocked)),
want AS (SELECT month, ref, 'upload' AS step, 1 AS step_order FROM live WHERE receipt_file <> ''
   UNION ALL SELECT month, ref, 'voucher', 2 FROM live
   UNION ALL SELECT month, ref, 'connect', 3 FROM live WHERE receipt_file <> ''
   UNION ALL SELECT DISTINCT month, '', 'reimburse', 4 FROM live)
SELECT w.* FROM want w LEFT JOIN done d ON d.month = w.month AND d.ref = w.ref AND d.step = w.step WHERE d.ref IS NULL
UNION ALL SELECT month, '', 'blocked', 0 FROM blocked""",
    ),
)
def m6(spark, sf):
    plan = b.with_files(spark, sf).select("month", "ref", "receipt_file")
    codes = plan.select("month").distinct().withColumn("batch_code", F.concat(F.lit("c"), "month"))
    return po.remaining_steps(plan, _done(spark, sf), codes)


@query(
    "close_month",
    with_(
        "postings",
        body="""
SELECT month, account, count(*) AS lines, CAST(sum(debit) AS DECIMAL(18,2)) AS debit, CAST(sum(credit) AS DECIMAL(18,2)) AS credit
FROM postings GROUP BY month, account""",
    ),
)
def close_month(spark, sf):
    """What is booked per month and account: the flagship flow from statement rows to ledger totals."""
    return b.postings(spark, sf).groupBy("month", "account").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("debit").cast(MONEY).alias("debit"),
        F.sum("credit").cast(MONEY).alias("credit"),
    )
