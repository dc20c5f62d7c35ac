"""Queries that write a bound view the way a source keeps it, and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import MONEY, format_money
from ..functions.scale import carry_down
from ..operators import posting as po
from ..session import settle
from ..sources import files as fs, sinks
from . import bindings as b, query
from .bindings import with_
from .streams import _place


@query("s1_read_statement", """
SELECT ref, date, merchant, account, amount, '€uro' AS city, encoding FROM (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS ref, CAST(o_orderdate AS DATE) AS date, replace(upper(p_name), 'GIZMO', 'GIZMÖ') AS merchant, CASE WHEN l_quantity >= 46 THEN '-40115' ELSE '-40223' END AS account,
    CAST(CASE WHEN l_quantity >= 46 THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2)) AS amount, CASE WHEN l_returnflag = 'R' THEN 'cp1252' ELSE 'utf8' END AS encoding
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""")
def s1(spark, sf):
    line = b.table(spark, sf, "lineitem")
    orders = b.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    part = b.table(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("m"))
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    credit = F.col("l_quantity") >= 46
    text = format_money(F.col("l_extendedprice").cast(MONEY), "")
    out = rows.select(
        F.date_format("d", "MM/dd/yyyy").alias("Datum"),
        F.replace("m", F.lit("GIZMO"), F.lit("GIZMÖ")).alias("Beskrivning"),
        F.lit("MEMBER").alias("Kortmedlem"),
        F.when(credit, "-40115").otherwise("-40223").alias("Konto #"),
        F.when(credit, F.concat(F.lit("-"), text)).otherwise(text).alias("Belopp"),
        F.lit('one "quoted"\nline').alias("Adress"),
        F.when(F.col("l_returnflag") == "R", "\u0080uro").otherwise("€uro").alias("Ort"),
        F.concat(F.lit("'"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"), F.lit("'")).alias("Referens"),
        "l_returnflag",
    )
    place = _place(spark, "statement")
    for name, enc, part_rows in (("utf8", "UTF-8", out.filter("l_returnflag <> 'R'")), ("cp1252", "ISO-8859-1", out.filter("l_returnflag = 'R'"))):
        part_rows.drop("l_returnflag").write.option("header", True).option("encoding", enc).option("escape", '"').csv(f"{place}/{name}")
    read = None
    for name in ("utf8", "cp1252"):
        got = fs.read_statement(spark, f"{place}/{name}").withColumn("encoding", F.lit(name))
        read = got if read is None else read.unionByName(got)
    return read.select("ref", "date", "merchant", "account", "amount", "city", "encoding")


@query("s2_read_export_file", """
SELECT CAST(o_orderkey AS VARCHAR) AS expense_id, 'R' || o_orderkey AS receipt_no, CAST(o_orderdate AS DATE) AS date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount_sek, CASE WHEN o_orderstatus = 'O' THEN CAST(floor(o_totalprice / 10) AS DECIMAL(18,2)) END AS foreign_amount,
  o_orderpriority = '5-LOW' AS payout, o_orderstatus = 'F' AS has_receipt FROM orders""")
def s2_file(spark, sf):
    o = b.table(spark, sf, "orders")
    d = F.col("o_orderdate").cast("date")
    s = F.col("o_orderstatus")
    out = o.select(
        F.date_format(d, "dd-MM-yyyy").alias("﻿Date"), F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("Receipt"),
        F.when(F.col("o_orderpriority") == "5-LOW", "Reimbursement").otherwise("Card Purchase").alias("Expense Type"),
        F.concat(F.lit("-"), format_money(F.col("o_totalprice").cast(MONEY), "")).alias("Amount"),
        F.when(s == "O", "usd").otherwise("SEK").alias("Orig. currency"), F.floor(F.col("o_totalprice") / 10).cast("string").alias("Orig. amount"),
        F.col("o_orderpriority").alias("Source description"), F.when(s == "F", "https://x.example/r").otherwise("").alias("Receipt urls"),
        F.lit("QUEUED").alias(" Export Status"), F.col("o_orderkey").cast("string").alias("Expense ID"),
    )
    place = _place(spark, "export")
    out.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(place)
    return fs.read_expense_export(spark, place).select("expense_id", "receipt_no", "date", "amount_sek", "foreign_amount", "payout", "has_receipt")


def _layouts(spark, sf):
    """The orders in each of the seven worklist layouts, one customer priority or status per layout."""
    o = b.table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    d = F.col("o_orderdate").cast("date")
    price = F.col("o_totalprice").cast(MONEY)
    text = format_money(price, "")
    usd = F.floor(F.col("o_totalprice") / 10).cast("string")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    hexed = F.lpad(F.lower(F.hex("o_orderkey")), 16, "0")
    matching = o.filter(p == "1-URGENT").select(
        key.alias("pleo_receipt_no"), key.alias("expense_id"), d.cast("string").alias("date"), p.alias("merchant"),
        F.concat(text, F.lit(" SEK ("), usd, F.lit(" USD)")).alias("pleo_amount"), hexed.alias("gmail_message_id"), s.alias("status"), F.lit("").alias("file_to_attach"),
    )
    hand = o.filter((p == "2-HIGH") & (s == "F")).select(
        d.cast("string").alias("date"), key.alias("pleo_receipt_no"), p.alias("merchant"), price.cast("string").alias("amount_sek"), F.lit("portal").alias("route"),
        F.concat(F.lit("Gmail "), hexed, F.lit(" "), usd, F.lit(" USD exact")).alias("evidence"), F.when(F.col("o_totalprice") > 250000, "marked as personal").otherwise("").alias("action"),
    )
    profile = o.filter((p == "2-HIGH") & (s != "F")).select(
        key.alias("pleo_receipt_no"), key.alias("expense_id"), d.cast("string").alias("date"), p.alias("merchant"), F.when(s == "O", "Reimbursement").otherwise("Card Purchase").alias("type"),
        F.concat(F.lit("-"), price.cast("string")).alias("amount"), F.concat(usd, F.lit(",00")).alias("orig_amount"), F.lit("EUR").alias("orig_currency"), s.alias("export_status"),
    )
    export = o.filter(p == "3-MEDIUM").select(
        F.date_format(d, "dd-MM-yyyy").alias("Date"), key.alias("Receipt"), F.lit("Card Purchase").alias("Expense Type"), p.alias("Source description"), key.alias("Expense ID"),
        F.when(s == "F", text).otherwise(F.concat(F.lit("-"), text)).alias("Amount"), F.lit("").alias("Orig. amount"), F.lit("SEK").alias("Orig. currency"), s.alias("Export Status"),
        F.when(s == "O", "77").otherwise("").alias("Reconciled Entries"), F.lit("").alias("Personal Expense"), F.lit("").alias("Receipt urls"),
    )
    queue = o.filter((p == "4-NOT SPECIFIED") & (s == "F")).select(
        key.alias("reference"), price.cast("string").alias("amount_sek"), p.alias("merchant"), F.lit("business").alias("tag"), F.lit("0115").alias("card"), d.cast("string").alias("date"),
        F.lit("mail").alias("evidence_kind"), F.concat(F.lit("see Gmail "), hexed).alias("evidence_where"), F.lit("2001").alias("statement_period"), F.lit("").alias("foreign"),
    )
    classified = o.filter((p == "4-NOT SPECIFIED") & (s != "F")).select(
        key.alias("ref"), F.when(s == "O", -price).otherwise(price).cast("string").alias("amount"), F.when(s == "O", "personal").otherwise("business").alias("tag"), F.lit("ready").alias("pack_status"),
        F.concat(F.when(s == "P", F.lit("SHOP ")).otherwise(F.lit("BUTIK ")), p).alias("merchant"), F.lit("-40115").alias("account"), d.cast("string").alias("date"), F.lit("").alias("ext"), F.lit("charge").alias("kind"),
    )
    regression = o.filter(p == "5-LOW").select(
        F.lit("positive").alias("set"), F.lit("pleo").alias("ledger"), key.alias("row_key"), hexed.alias("expected_message_id"),
        F.concat(d.cast("string"), F.lit("; "), F.when(s == "F", F.lit("soon")).otherwise(d.cast("string"))).alias("charge_date"), p.alias("merchant"),
        F.concat(text, F.lit(";+1,50")).alias("amount_sek"), F.lit("").alias("orig_amount"), F.lit("").alias("expense_id_or_ref"),
    )
    return [matching, hand, profile, export, queue, classified, regression]


W = "row_key, ledger, source_format, date, merchant, kind, amount_sek, foreign_amount, foreign_currency, tag, known_message_id, search, skip_reason"
_T = "CAST(o_totalprice AS DECIMAL(18,2))"
_U = "CAST(floor(o_totalprice / 10) AS DECIMAL(18,2))"
_H = "lpad(lower(to_hex(o_orderkey)), 16, '0')"
_K = "CAST(o_orderkey AS VARCHAR)"
_D = "CAST(o_orderdate AS DATE)"


@query("s4_to_worklist", f"""
SELECT {_K} AS row_key, 'expense' AS ledger, 'matching' AS source_format, {_D} AS date, o_orderpriority AS merchant, 'charge' AS kind, {_T} AS amount_sek, {_U} AS foreign_amount, 'USD' AS foreign_currency, '' AS tag, {_H} AS known_message_id, true AS search, '' AS skip_reason FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT {_K}, 'expense', 'hand_list', {_D}, o_orderpriority, 'charge', {_T}, CASE WHEN floor(o_totalprice / 10) < 1000 OR true THEN {_U} END, 'USD', '', {_H}, NOT o_totalprice > 250000, CASE WHEN o_totalprice > 250000 THEN 'not searched (marked personal in the hand list)' ELSE '' END FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F'
UNION ALL SELECT {_K}, 'expense', 'profile', {_D}, o_orderpriority, 'charge', {_T}, {_U}, 'EUR', '', '', true, '' FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'P'
UNION ALL SELECT {_K}, 'expense', 'export', {_D}, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'refund' ELSE 'charge' END, {_T}, NULL, NULL, '', '', true, '' FROM orders WHERE o_orderpriority = '3-MEDIUM' AND o_orderstatus <> 'O'
UNION ALL SELECT {_K}, 'card', 'queue', {_D}, o_orderpriority, 'charge', {_T}, NULL, NULL, 'business', {_H}, true, '' FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F'
UNION ALL SELECT {_K}, 'card', 'classified', {_D}, CASE o_orderstatus WHEN 'P' THEN 'SHOP ' ELSE 'BUTIK ' END || o_orderpriority, CASE o_orderstatus WHEN 'O' THEN 'refund' ELSE 'charge' END, {_T}, NULL, NULL, CASE o_orderstatus WHEN 'O' THEN 'personal' ELSE 'business' END, '', o_orderstatus <> 'O', CASE o_orderstatus WHEN 'O' THEN 'not searched (tag personal)' ELSE '' END FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus <> 'F'
UNION ALL SELECT {_K} || '#1', 'expense', 'regression', {_D}, o_orderpriority, 'charge', {_T}, NULL, NULL, '', {_H}, true, '' FROM orders WHERE o_orderpriority = '5-LOW'
UNION ALL SELECT {_K} || '#2', 'expense', 'regression', CASE o_orderstatus WHEN 'F' THEN NULL ELSE {_D} END, o_orderpriority, 'refund', 1.50, NULL, NULL, '', {_H}, o_orderstatus <> 'F', CASE o_orderstatus WHEN 'F' THEN 'no usable charge date' ELSE '' END FROM orders WHERE o_orderpriority = '5-LOW'""")
def s4(spark, sf):
    out = None
    for layout in _layouts(spark, sf):
        got = fs.to_worklist(layout)
        out = got if out is None else out.unionByName(got)
    return out.select(*W.split(", "))


@query("s3_detect_format", """
SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'matching' WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN 'hand_list' WHEN o_orderpriority = '2-HIGH' THEN 'profile' WHEN o_orderpriority = '3-MEDIUM' THEN 'export'
  WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN 'queue' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'classified' ELSE 'regression' END AS source_format, count(*) AS n FROM orders GROUP BY 1""")
def s3(spark, sf):
    out = None
    for layout in _layouts(spark, sf):
        got = layout.groupBy(F.lit(fs.detect_format(layout.columns)).alias("source_format")).agg(F.count(F.lit(1)).alias("n"))
        out = got if out is None else out.unionByName(got)
    return out


@query("s7_read_runs", """
SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS run_at, CAST(CAST(ts AS DATE) AS VARCHAR) AS run_date, 'box' || user_id AS mailbox, 'k' || event_id AS row_key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS candidates FROM events WHERE event_type <> 'error'
UNION ALL SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S'), CAST(CAST(ts AS DATE) AS VARCHAR), 'box' || user_id, 'second', 0 FROM events WHERE event_type <> 'error'""")
def s7(spark, sf):
    e = b.table(spark, sf, "events")
    row = F.struct(F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("row_key"), F.get_json_object("props", "$.k").cast("bigint").alias("candidates"))
    other = F.struct(F.lit("second").alias("row_key"), F.lit(0).cast("bigint").alias("candidates"))
    run = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("run_at"), F.concat(F.lit("box"), F.col("user_id").cast("string")).alias("mailbox"))
    doc = F.struct(run.alias("run"), F.array(row, other).alias("rows"))
    # Some runs are files of their own, indented; the others stand in files of one per line.
    own = F.col("event_id") < 20
    body = F.when(F.col("event_type") == "error", "{ not json").when(own, F.to_json(doc, {"pretty": "true"})).otherwise(F.to_json(doc))
    place = _place(spark, "runs")
    e.select(body.alias("value"), F.when(own, F.col("event_id").cast("string")).otherwise("lines").alias("part")).write.partitionBy("part").text(place)
    return fs.read_runs(spark, place).select("run_at", "run_date", "mailbox", "row_key", "candidates")


@query("s10_carry_heading", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM conversations""")
def s10(spark, sf):
    turns = b.table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.md5("text")).alias("h"))
    return carry_down(turns, ["conv_id"], ["turn"], "h", "heading").select("conv_id", "turn", "heading")


@query("s10_parse_worklist", """
SELECT 'w' || o_custkey AS file, CAST(o_orderkey AS VARCHAR) AS pos, CASE o_orderpriority WHEN '1-URGENT' THEN NULL ELSE 1 END AS d, lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS receipt_no, 'wrong file' AS problem,
  (SELECT count(*) FROM orders h WHERE h.o_custkey = o.o_custkey AND h.o_orderpriority = '5-LOW' AND h.o_orderkey <= o.o_orderkey) AS headings,
  CAST((SELECT max(o_orderkey) FROM orders h WHERE h.o_custkey = o.o_custkey AND h.o_orderpriority = '5-LOW' AND h.o_orderkey <= o.o_orderkey) AS INTEGER) AS group_no
FROM orders o WHERE o_orderpriority <> '5-LOW' AND headings > 0""".replace("SELECT 'w' || o_custkey AS file, CAST(o_orderkey AS VARCHAR) AS pos", "SELECT file, pos, d, receipt_no, problem, group_no FROM (SELECT 'w' || o_custkey AS file, o_orderkey AS pos").replace("FROM orders o WHERE o_orderpriority <> '5-LOW' AND headings > 0", "FROM orders o WHERE o_orderpriority <> '5-LOW') WHERE headings > 0"))
def s10_worklist(spark, sf):
    o = b.table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    low = F.col("o_orderpriority") == "5-LOW"
    dated = F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("  ")))
    line = F.when(low, F.concat(key, F.lit(". heading "), key)).otherwise(
        F.concat(F.lit("- "), F.lpad(key, 7, "0"), F.lit("  "), dated, F.lit("Acme 12,00   wrong file   (QUEUED)  "))
    )
    lines = o.select(F.concat(F.lit("w"), F.col("o_custkey").cast("string")).alias("file"), F.col("o_orderkey").alias("pos"), line.alias("line"))
    out = fs.parse_worklist(lines)
    return out.select("file", "pos", F.when(F.col("date").isNotNull(), 1).alias("d"), "receipt_no", "problem", "group_no")


def _manifest(spark, sf):
    rows = b.disposed(spark, sf).filter(F.col("disposition") != "out-of-scope")
    rows = po.plan_status(b.with_files(spark, sf, rows), b.regimes(spark))
    payload = F.when(F.col("disposition") == "planned", F.concat(F.lit("vouchers/"), "ref", F.lit(".json"))).otherwise("")
    file = F.when(F.col("disposition") == "planned", F.col("receipt_file")).otherwise("")
    return rows.select("month", "ref", "date", "merchant", format_money(F.col("amount"), "").alias("amount"), file.alias("receipt_file"), payload.alias("voucher_payload"), "status")


@query("s11_write_plan", with_("with_files", body="""
SELECT 'first' AS run, count(DISTINCT month) AS months FROM disposed WHERE disposition <> 'out-of-scope'
UNION ALL SELECT 'same', 0 UNION ALL SELECT 'fewer', count(DISTINCT month) FROM disposed WHERE disposition <> 'out-of-scope' AND contains(merchant, 'RING')
UNION ALL SELECT 'rows', count(*) FROM disposed WHERE disposition <> 'out-of-scope' AND NOT contains(merchant, 'RING')"""))
def s11(spark, sf):
    """The plan written, written again unchanged, then with fewer rows: months rewritten each time."""
    plan = settle(_manifest(spark, sf))
    place = _place(spark, "plan")
    fewer = plan.filter(~F.col("merchant").contains("RING"))
    out = None
    for run, rows in (("first", plan), ("same", plan), ("fewer", fewer)):
        done = sinks.write_plan(rows, place).agg(F.count(F.lit(1)).alias("months")).select(F.lit(run).alias("run"), "months")
        out = done if out is None else out.unionByName(done)
    kept = spark.read.parquet(place).agg(F.count(F.lit(1)).alias("months")).select(F.lit("rows").alias("run"), "months")
    return out.unionByName(kept)


@query("s9_read_plans", with_("with_files", body="""
WITH m AS (SELECT month, ref, amount, receipt_file, true AS planned FROM with_files UNION ALL SELECT month, ref, amount, '', false FROM disposed WHERE disposition = 'excluded'),
x AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey || '-1' AS ref, CASE WHEN o_orderpriority <> '5-LOW' THEN 'A ' || o_orderkey END AS voucher FROM orders WHERE o_orderstatus = 'F')
SELECT m.month, count(*) FILTER (planned) AS vouchers, count(*) FILTER (planned AND receipt_file <> '') AS proofs, count(x.ref) AS uploaded, count(x.voucher) AS booked, CAST(coalesce(sum(amount) FILTER (planned), 0) AS DECIMAL(18,2)) AS total_sek
FROM m LEFT JOIN x ON x.month = m.month AND x.ref = m.ref GROUP BY m.month"""))
def s9(spark, sf):
    place = _place(spark, "plans")
    sinks.write_plan(_manifest(spark, sf), place)
    manifest = spark.read.parquet(place).withColumn("month", F.col("month").cast("string"))
    o = b.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")
    ran = o.select(
        F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM").alias("month"), F.concat(F.col("o_orderkey").cast("string"), F.lit("-1")).alias("ref"),
        F.lit("A").alias("voucher_series"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey")).alias("voucher_number"),
    )
    return fs.plan_summary(manifest, ran, ran)[0]


@query("s12_needs_tag_list", with_("classified", body="""
SELECT ref, date, merchant, replace(replace(replace(format('{:,.2f}', CAST(abs(amount) AS DOUBLE)), ',', '~'), '.', ','), '~', ' ') || ' SEK' AS amount, card, why FROM classified WHERE tag = 'needs-tag'"""))
def s12_needs(spark, sf):
    return sinks.needs_tag_list(b.classified(spark, sf))


@query("s12_missing_list", with_("expenses", body="""
SELECT date, 'R' || expense_id AS pleo_receipt_no, expense_id, merchant, amount_sek AS amount, type, export_status FROM expenses WHERE NOT has_receipt"""))
def s12_missing(spark, sf):
    return sinks.missing_list(b.expenses(spark, sf).withColumn("receipt_no", F.concat(F.lit("R"), "expense_id")))
