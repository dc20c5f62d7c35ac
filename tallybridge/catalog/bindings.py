"""Domain views over the driver's tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.money import MONEY
from ..functions.scale import spread
from ..operators import ledger as lg, posting as po

POLICY = lg.Policy(payment_phrase="COLD ANVIL", split_date=dt.date(1998, 5, 25), default_entity="alfa")
OWN = "alfa"
ACCOUNTS = {"liability": 2890, "vat": 2641, "vat_out": 2614, "vat_in": 2645}

RULES = [
    (1, "Ring works", ["RING"], "business", "alfa", "5410", "tools", "domestic25"),
    (2, "Hot metal", ["HOT PLATE", "HOT ROD"], "business", "alfa", "6540", "services", "noneu_rc"),
    (3, "Widget house", ["WIDGET"], None, "alfa", "5810", "travel", "domestic6"),
    (4, "Gear hall", ["GEAR"], "business", "beta", "5615", "lease", "domestic25_half"),
    (5, "Private anvils", ["SMALL ANVIL", "RED ANVIL"], "personal", "alfa", "", "", ""),
    (6, "Bolt shop", ["NEW BOLT", "OLD BOLT"], "business", "alfa", "6072", "meals", "domestic12"),
    (7, "Plate", ["PLATE"], "business", "alfa", "6990", "other", "none"),
    (8, "Rod", ["ROD"], "business", "alfa", "6540", "services", "eu_rc"),
    (9, "Lease", ["LARGE BOLT"], "business", "alfa", "5615", "lease", "domestic25_half"),
    (10, "Blue", ["BLUE"], "needs-tag", "alfa", "", "", "oss_pending"),
    (11, "Gizmo", ["GIZMO"], "business", "", "6990", "other", "weird"),
    (12, "Anvil", ["LARGE ANVIL"], "business", "alfa", "", "", "none"),
    (13, "Third", ["HOT BOLT"], "business", "gamma", "6990", "other", "none"),
]
RULE_SCHEMA = (
    "rule_order int, name string, patterns array<string>, tag string, entity string, bas_account string, "
    "konto_name string, vat_regime string"
)
CARDS = [
    ("-40115", "business", "business card default (post-split)", False, None, None, None, None),
    ("-40223", "personal", "personal card default (post-split)", False, None, None, None, None),
    ("-50301", None, None, True, None, "RING", dt.date(1998, 3, 2), dt.date(1998, 5, 12)),
    ("-40447", None, None, False, dt.date(1998, 5, 12), None, None, None),
]
CARD_SCHEMA = (
    "account string, default_tag string, default_why string, personal_only boolean, personal_from date, "
    "exception_merchant string, exception_from date, exception_to date"
)
# VAT regimes, their posting method and rate in percent.
REGIMES = [
    ("domestic25", "inclusive", 25),
    ("domestic12", "inclusive", 12),
    ("domestic6", "inclusive", 6),
    ("domestic25_half", "half", 25),
    ("eu_rc", "reverse", 25),
    ("noneu_rc", "reverse", 25),
    ("oss_pending", "gross", 0),
    ("none", "gross", 0),
    ("", "gross", 0),
]
REGIME_SCHEMA = "regime string, method string, rate int"


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, Decimal)):
        return str(v)
    if isinstance(v, dt.date):
        return f"DATE '{v}'"
    if isinstance(v, list):
        return "[" + ", ".join(literal(x) for x in v) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def values_sql(rows, columns: str) -> str:
    names = ", ".join(c.strip().split(" ")[0] for c in columns.split(", "))
    body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS _v({names})"


CTE: dict[str, tuple[list[str], str]] = {}


def cte(name: str, text: str, *deps: str) -> None:
    CTE[name] = (list(deps), text.strip())


def with_(*names: str, body: str) -> str:
    """``body`` preceded by the named expressions and everything they build on."""
    done: list[str] = []

    def visit(n: str) -> None:
        if n in done:
            return
        for d in CTE[n][0]:
            visit(d)
        done.append(n)

    for n in names:
        visit(n)
    head = "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in done)
    body = body.strip()
    return head + (",\n" + body[5:] if body.startswith("WITH ") else "\n" + body)


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the file once, so later readers start no job."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# --------------------------------------------------------------------------- policy tables

def policy_table(spark, rows, columns: str) -> DataFrame:
    """A small policy table as a local relation: reading it starts no job."""
    text = values_sql(rows, columns).replace("[", "array(").replace("]", ")")
    typed = [c.strip().split(" ", 1) for c in columns.split(", ")]
    return spark.sql(text).select(*[F.col(n).cast(t).alias(n) for n, t in typed])


def rules(spark):
    return policy_table(spark, RULES, RULE_SCHEMA)


def cards(spark):
    return policy_table(spark, CARDS, CARD_SCHEMA)


def regimes(spark):
    return policy_table(spark, REGIMES, REGIME_SCHEMA)


cte("rules", values_sql(RULES, RULE_SCHEMA))
cte("rule_patterns", "SELECT rule_order, upper(unnest(patterns)) AS pattern FROM rules", "rules")
cte("cards", values_sql(CARDS, CARD_SCHEMA))
cte("regimes", values_sql(REGIMES, REGIME_SCHEMA))

# --------------------------------------------------------------------------- statement charges

# Read explicitly, so that rows spread over more tasks carry no column nothing needs.
LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate",
]
STATEMENT_ORDER = ["posted", "part_key", "amount", "account"]


def charges_raw(spark, sf):
    """Statement rows with overlapping windows: a ref may occur several times."""
    line = spread(table(spark, sf, "lineitem").select(*LINE_COLUMNS))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    part = table(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("merchant"))
    account = (
        F.when(F.col("l_linenumber") == 7, "-99999")
        .when(F.col("l_returnflag") == "A", "-40115")
        .when(F.col("l_returnflag") == "N", "-40223")
        .when(F.col("l_linestatus") == "F", "-50301")
        .otherwise("-40447")
    )
    price = F.when(F.col("l_quantity") >= 46, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("ref"),
            "date",
            "merchant",
            account.alias("account"),
            price.cast(MONEY).alias("amount"),
            F.col("l_shipdate").alias("posted"),
            F.col("l_partkey").alias("part_key"),
        )
    )


cte(
    "charges_raw",
    """
SELECT l_orderkey || '-' || l_linenumber AS ref, CAST(o_orderdate AS DATE) AS date, upper(p_name) AS merchant,
       CASE WHEN l_linenumber = 7 THEN '-99999' WHEN l_returnflag = 'A' THEN '-40115'
            WHEN l_returnflag = 'N' THEN '-40223' WHEN l_linestatus = 'F' THEN '-50301' ELSE '-40447' END AS account,
       CAST(CASE WHEN l_quantity >= 46 THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2)) AS amount,
       l_shipdate AS posted, l_partkey AS part_key
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
)


def charges(spark, sf):
    deduped = lg.dedupe_statement(charges_raw(spark, sf), STATEMENT_ORDER)
    return lg.charge_kind(deduped, POLICY.payment_phrase).drop("posted", "part_key")


cte(
    "charges",
    """
SELECT ref, date, merchant, account, amount,
       CASE WHEN contains(merchant, 'COLD ANVIL') THEN 'payment' WHEN amount < 0 THEN 'refund' ELSE 'charge' END AS kind,
       right(account, 4) AS card
FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY posted, part_key, amount, account) AS rn FROM charges_raw)
WHERE rn = 1""",
    "charges_raw",
)

# --------------------------------------------------------------------------- decisions

def override_lines(spark, sf):
    labels = table(spark, sf, "labels")
    tag = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "business")
        .when(F.col("quality") == 1, "personal")
        .when(F.col("toxic") == 0, "needs-tag")
        .otherwise("maybe")
    )
    return labels.select(
        F.col("doc_id").alias("line"),
        F.concat(F.floor(F.col("doc_id") / 2).cast("string"), F.lit("-1")).alias("ref"),
        tag.alias("tag"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("note"),
    )


cte(
    "override_lines",
    """
SELECT doc_id AS line, (doc_id // 2) || '-1' AS ref,
       CASE WHEN quality = 1 AND toxic = 0 THEN 'business' WHEN quality = 1 THEN 'personal'
            WHEN toxic = 0 THEN 'needs-tag' ELSE 'maybe' END AS tag, 'doc ' || doc_id AS note
FROM labels""",
)
cte(
    "overrides",
    """
SELECT ref, arg_max(tag, line) AS tag, arg_max(note, line) AS note FROM override_lines
WHERE tag IN ('business','personal','needs-tag','skip') GROUP BY ref""",
    "override_lines",
)


def overrides(spark, sf):
    return lg.valid_overrides(override_lines(spark, sf))[0]


def prior(spark, sf):
    orders = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    tag = F.when(F.col("o_orderstatus") == "F", "business").when(F.col("o_orderstatus") == "O", "needs-tag").otherwise("")
    why = F.when(F.col("o_totalprice") > 250000, "").otherwise(F.concat(F.lit("earlier "), "o_orderpriority"))
    return orders.select(
        F.concat(F.col("o_orderkey").cast("string"), F.lit("-2")).alias("ref"), tag.alias("tag"), why.alias("why")
    )


cte(
    "prior",
    """
SELECT o_orderkey || '-2' AS ref,
       CASE o_orderstatus WHEN 'F' THEN 'business' WHEN 'O' THEN 'needs-tag' ELSE '' END AS tag,
       CASE WHEN o_totalprice > 250000 THEN '' ELSE 'earlier ' || o_orderpriority END AS why
FROM orders WHERE o_orderpriority = '1-URGENT'""",
)


def classified(spark, sf):
    return lg.classify(
        charges(spark, sf), rules(spark), overrides(spark, sf), prior(spark, sf), cards(spark), POLICY
    )


cte(
    "ruled",
    """
SELECT c.*, (SELECT min(rule_order) FROM rule_patterns p WHERE contains(c.merchant, p.pattern)) AS rule_order
FROM charges c""",
    "charges",
    "rule_patterns",
)
cte(
    "classified",
    """
SELECT c.ref, c.date, c.merchant, c.account, c.amount, c.kind, c.card,
  CASE WHEN c.kind = 'payment' THEN 'skip'
       WHEN c.amount < 0 THEN 'skip'
       WHEN o.ref IS NOT NULL THEN o.tag
       WHEN p.tag IN ('business','personal','needs-tag','skip') THEN p.tag
       WHEN c.account = '-50301' AND contains(c.merchant, 'RING') AND c.date BETWEEN DATE '1998-03-02' AND DATE '1998-05-12' THEN 'business'
       WHEN c.account = '-50301' THEN 'personal'
       WHEN c.account = '-40447' AND c.date >= DATE '1998-05-12' AND r.tag = 'business' THEN 'needs-tag'
       WHEN c.account = '-40447' AND c.date >= DATE '1998-05-12' THEN 'personal'
       WHEN r.tag IS NOT NULL THEN r.tag
       WHEN c.date < DATE '1998-05-25' THEN 'needs-tag'
       WHEN c.account = '-40115' THEN 'business'
       WHEN c.account = '-40223' THEN 'personal'
       ELSE 'needs-tag' END AS tag,
  CASE WHEN c.kind = 'payment' THEN 'payment row'
       WHEN c.amount < 0 THEN 'refund'
       WHEN o.ref IS NOT NULL THEN 'override (' || o.note || ')'
       WHEN p.tag IN ('business','personal','needs-tag','skip') THEN CASE WHEN p.why = '' THEN 'carried from prior classified ledger' ELSE p.why END
       WHEN c.account = '-50301' AND contains(c.merchant, 'RING') AND c.date BETWEEN DATE '1998-03-02' AND DATE '1998-05-12' THEN 'bounded merchant exception'
       WHEN c.account = '-50301' THEN 'personal-only card'
       WHEN c.account = '-40447' AND c.date >= DATE '1998-05-12' AND r.tag = 'business' THEN 'business-looking on a personal card'
       WHEN c.account = '-40447' AND c.date >= DATE '1998-05-12' THEN 'card personal from date'
       WHEN r.tag IS NOT NULL THEN 'merchant rule ' || r.name
       WHEN c.date < DATE '1998-05-25' THEN 'pre-split charge, unknown merchant'
       WHEN c.account = '-40115' THEN 'business card default (post-split)'
       WHEN c.account = '-40223' THEN 'personal card default (post-split)'
       ELSE 'unknown account ' || c.account END AS why,
  coalesce(nullif(r.entity, ''), 'alfa') AS entity, coalesce(r.bas_account, '') AS bas_account,
  coalesce(r.vat_regime, '') AS vat_regime, coalesce(r.konto_name, '') AS konto_name
FROM ruled c LEFT JOIN rules r USING (rule_order) LEFT JOIN overrides o ON o.ref = c.ref LEFT JOIN prior p ON p.ref = c.ref""",
    "ruled",
    "rules",
    "overrides",
    "prior",
)

# --------------------------------------------------------------------------- plan

def disposed(spark, sf):
    return po.plan_disposition(classified(spark, sf), OWN, regimes(spark))


def planned(spark, sf):
    return disposed(spark, sf).filter(F.col("disposition") == "planned")


cte(
    "disposed",
    """
SELECT c.*, strftime(c.date, '%Y-%m') AS month,
  CASE WHEN c.amount <= 0 OR c.tag NOT IN ('business','needs-tag') THEN 'out-of-scope'
       WHEN c.tag = 'needs-tag' OR c.entity <> 'alfa' OR NOT regexp_full_match(c.bas_account, '[0-9]+')
            OR c.vat_regime NOT IN (SELECT regime FROM regimes) THEN 'excluded' ELSE 'planned' END AS disposition,
  CASE WHEN c.amount <= 0 THEN 'amount not positive'
       WHEN c.tag NOT IN ('business','needs-tag') THEN 'tag ' || c.tag
       WHEN c.tag = 'needs-tag' THEN 'tag needs-tag'
       WHEN c.entity <> 'alfa' THEN 'entity ' || c.entity
       WHEN NOT regexp_full_match(c.bas_account, '[0-9]+') THEN 'bas_account saknas'
       WHEN c.vat_regime NOT IN (SELECT regime FROM regimes) THEN 'vat_regime okand ''' || c.vat_regime || ''''
       ELSE '' END AS reason
FROM classified c""",
    "classified",
    "regimes",
)
cte("planned", "SELECT * FROM disposed WHERE disposition = 'planned'", "disposed")


def evidence_files(spark, sf):
    """Names of fetched evidence files."""
    key = F.col("o_orderkey").cast("string")
    name = (
        F.when(F.col("o_orderstatus") == "F", F.concat(key, F.lit("-1_receipt.pdf")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("scan_"), key, F.lit("-2.png")))
        .otherwise(F.concat(key, F.lit("-4a.pdf")))
    )
    return table(spark, sf, "orders").select(name.alias("name"))


def evidence_map(spark, sf):
    key = F.col("o_orderkey").cast("string")
    high = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "2-HIGH")
    return high.select(
        F.concat(key, F.lit("-3")).alias("ref"), F.concat(F.lit("map/"), key, F.lit(".pdf")).alias("file")
    )


cte(
    "evidence_files",
    """
SELECT CASE o_orderstatus WHEN 'F' THEN o_orderkey || '-1_receipt.pdf' WHEN 'O' THEN 'scan_' || o_orderkey || '-2.png'
            ELSE o_orderkey || '-4a.pdf' END AS name FROM orders""",
)
cte(
    "evidence_map",
    "SELECT o_orderkey || '-3' AS ref, 'map/' || o_orderkey || '.pdf' AS file FROM orders WHERE o_orderpriority = '2-HIGH'",
)


def statement_refs(spark, sf):
    """Every ref of the statement, read from two columns of one table."""
    line = table(spark, sf, "lineitem")
    return line.select(F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("ref"))


def with_files(spark, sf, rows=None):
    return po.attach_files(
        planned(spark, sf) if rows is None else rows,
        evidence_map(spark, sf),
        evidence_files(spark, sf),
        statement_refs(spark, sf),
    )


cte(
    "with_files",
    """
SELECT p.*, coalesce(m.file, s.name, k.name, '') AS receipt_file,
  CASE WHEN m.file IS NOT NULL THEN 'map' WHEN s.name IS NOT NULL THEN 'prefix' WHEN k.name IS NOT NULL THEN 'contains' ELSE '' END AS file_match
FROM planned p LEFT JOIN evidence_map m ON m.ref = p.ref
LEFT JOIN (SELECT p.ref, min(f.name) AS name FROM planned p JOIN evidence_files f ON starts_with(f.name, p.ref) GROUP BY p.ref) s ON s.ref = p.ref
LEFT JOIN (SELECT p.ref, min(f.name) AS name FROM planned p JOIN evidence_files f ON contains(f.name, p.ref) GROUP BY p.ref) k ON k.ref = p.ref""",
    "planned",
    "evidence_map",
    "evidence_files",
)
cte(
    "postings",
    """
SELECT month, ref, date, vat_regime, line, account, CAST(debit / 100 AS DECIMAL(18,2)) AS debit, CAST(credit / 100 AS DECIMAL(18,2)) AS credit
FROM (
  SELECT month, ref, date, vat_regime, unnest([
     {'line': 1, 'account': CAST(bas_account AS INTEGER), 'debit': g - lifted, 'credit': 0},
     {'line': 2, 'account': 2641, 'debit': lifted, 'credit': 0},
     {'line': 3, 'account': 2890, 'debit': 0, 'credit': g},
     {'line': 4, 'account': 2614, 'debit': 0, 'credit': rc},
     {'line': 5, 'account': 2645, 'debit': rc, 'credit': 0}], recursive := true)
  FROM (SELECT *, CASE method WHEN 'inclusive' THEN vat WHEN 'half' THEN (vat + 1) // 2 ELSE 0 END AS lifted,
               CASE WHEN method = 'reverse' THEN (2 * g * rate + 100) // 200 ELSE 0 END AS rc
        FROM (SELECT p.*, r.method, r.rate, CAST(p.amount * 100 AS BIGINT) AS g,
                     (2 * CAST(p.amount * 100 AS BIGINT) * r.rate + 100 + r.rate) // (2 * (100 + r.rate)) AS vat
              FROM planned p JOIN regimes r ON r.regime = p.vat_regime)))
WHERE debit <> 0 OR credit <> 0""",
    "planned",
    "regimes",
)


def postings(spark, sf):
    return po.post_vouchers(planned(spark, sf), regimes(spark), ACCOUNTS)


# --------------------------------------------------------------------------- expense export

def export_rows(orders):
    """Export rows, one per order; with ``has_receipt`` where ``orders`` carries it."""
    status = (
        F.when(F.col("o_orderstatus") == "F", "EXPORTED").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("NOT_EXPORTED")
    )
    return orders.select(
        F.col("o_orderkey").cast("string").alias("expense_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM").alias("month"),
        F.col("o_custkey").cast("string").alias("owner"),
        F.col("o_orderpriority").alias("merchant"),
        F.when(F.col("o_orderpriority") == "5-LOW", "Reimbursement").otherwise("Card Purchase").alias("type"),
        F.col("o_totalprice").cast(MONEY).alias("amount_sek"),
        status.alias("export_status"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in orders.columns if c == "has_receipt"],
        (F.col("o_orderpriority") == "5-LOW").alias("payout"),
    )


def expenses(spark, sf):
    """Export rows: one per order, evidence present when the order has a line."""
    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return export_rows(orders.join(lines.withColumn("has_receipt", F.lit(True)), "o_orderkey", "left"))


cte(
    "expenses",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS expense_id, CAST(o_orderdate AS DATE) AS date, strftime(o_orderdate, '%Y-%m') AS month,
       CAST(o_custkey AS VARCHAR) AS owner, o_orderpriority AS merchant,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'Reimbursement' ELSE 'Card Purchase' END AS type,
       CAST(o_totalprice AS DECIMAL(18,2)) AS amount_sek,
       CASE o_orderstatus WHEN 'F' THEN 'EXPORTED' WHEN 'O' THEN 'QUEUED' ELSE 'NOT_EXPORTED' END AS export_status,
       o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has_receipt, o_orderpriority = '5-LOW' AS payout
FROM orders""",
)
