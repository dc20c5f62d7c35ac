"""Queries over the statement ledger: dedupe, kinds, decisions, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as lg
from . import bindings as b, query
from .bindings import with_

CHARGE_COLS = "ref, date, merchant, account, amount"
CLASSIFIED_COLS = (
    "ref, date, merchant, account, amount, kind, card, tag, why, entity, bas_account, vat_regime, konto_name"
)


@query("w1_dedupe_statement", with_("charges", body=f"SELECT {CHARGE_COLS} FROM charges"))
def w1(spark, sf):
    return lg.dedupe_statement(b.charges_raw(spark, sf), b.STATEMENT_ORDER).select(*CHARGE_COLS.split(", "))


@query(
    "p1_charge_kind",
    with_("charges", body="SELECT kind, card, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS amount FROM charges GROUP BY kind, card"),
)
def p1(spark, sf):
    return b.charges(spark, sf).groupBy("kind", "card").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(18,2)").alias("amount")
    )


def _loose(spark, sf):
    """Ledger cells as text, some without a ref and some with an unreadable amount."""
    raw = b.charges_raw(spark, sf)
    return raw.select(
        F.when(F.col("account") == "-99999", "").otherwise(F.col("ref")).alias("ref"),
        F.when(F.col("merchant").contains("GIZMO"), F.concat(F.lit("kr "), F.col("amount").cast("string")))
        .otherwise(F.col("amount").cast("string"))
        .alias("amount"),
        "merchant",
    )


LOOSE = """
SELECT CASE WHEN account = '-99999' THEN '' ELSE ref END AS ref,
       CASE WHEN contains(merchant, 'GIZMO') THEN 'kr ' || amount ELSE CAST(amount AS VARCHAR) END AS amount, merchant
FROM charges_raw"""


@query(
    "p8_validate_ledger",
    with_(
        "charges_raw",
        body=f"""
SELECT CASE WHEN ref = '' THEN 'no ref' WHEN try_cast(amount AS DECIMAL(18,2)) IS NULL THEN 'bad amount' ELSE 'good' END AS verdict,
       merchant, count(*) AS n, CAST(sum(CASE WHEN ref <> '' THEN try_cast(amount AS DECIMAL(18,2)) END) AS DECIMAL(18,2)) AS amount
FROM ({LOOSE}) GROUP BY 1, 2""",
    ),
)
def p8(spark, sf):
    good, quarantine = lg.validate_ledger(_loose(spark, sf), ["ref", "amount", "merchant"])
    rows = good.select(F.lit("good").alias("verdict"), "merchant", "amount").unionByName(
        quarantine.select(F.col("reason").alias("verdict"), "merchant", F.lit(None).cast("decimal(18,2)").alias("amount"))
    )
    return rows.groupBy("verdict", "merchant").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(18,2)").alias("amount")
    )


@query(
    "p9_valid_overrides",
    with_(
        "overrides",
        body="""
SELECT ref, tag, note, '' AS reason FROM overrides
UNION ALL SELECT ref, tag, note, 'invalid tag' FROM override_lines WHERE tag NOT IN ('business','personal','needs-tag','skip')""",
    ),
)
def p9(spark, sf):
    good, bad = lg.valid_overrides(b.override_lines(spark, sf))
    return good.withColumn("reason", F.lit("")).unionByName(bad.select("ref", "tag", "note", "reason"))


@query(
    "j1_with_decisions",
    with_(
        "charges",
        "overrides",
        "prior",
        body="""
SELECT c.ref, o.tag AS override_tag, o.note AS override_note, p.tag AS prior_tag, p.why AS prior_why
FROM charges c LEFT JOIN overrides o ON o.ref = c.ref LEFT JOIN prior p ON p.ref = c.ref""",
    ),
)
def j1(spark, sf):
    rows = lg.with_decisions(b.charges(spark, sf), b.overrides(spark, sf), b.prior(spark, sf))
    return rows.select("ref", "override_tag", "override_note", "prior_tag", "prior_why")


J2 = with_(
    "ruled",
    body="SELECT c.ref, c.merchant, r.rule_order, r.name AS rule_name, r.tag AS rule_tag FROM ruled c LEFT JOIN rules r USING (rule_order)",
)


@query("j2_match_rule", J2)
def j2(spark, sf):
    rows = lg.match_rule(b.charges(spark, sf).select("ref", "merchant"), b.rules(spark))
    return rows.select("ref", "merchant", "rule_order", "rule_name", "rule_tag")


@query("j2_match_rule_large_table", J2)
def j2_large(spark, sf):
    """The same match with a rule for every part besides, none of which fits a merchant."""
    rules = b.rules(spark)
    parts = b.table(spark, sf, "part").select(
        (F.col("p_partkey") + 1000).alias("rule_order"), F.col("p_name").alias("name"), F.array(F.concat(F.lit("~"), "p_name")).alias("patterns")
    )
    kinds = dict(rules.dtypes)
    more = parts.select(*((F.col(c) if c in parts.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in rules.columns))
    rows = lg.match_rule(b.charges(spark, sf).select("ref", "merchant"), rules.unionByName(more))
    return rows.select("ref", "merchant", "rule_order", "rule_name", "rule_tag")


@query("d1_classify", with_("classified", body=f"SELECT {CLASSIFIED_COLS} FROM classified"))
def d1(spark, sf):
    return b.classified(spark, sf).select(*CLASSIFIED_COLS.split(", "))


@query(
    "a1_tag_summary",
    with_(
        "classified",
        body="""
SELECT tag, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS amount,
       CAST(sum(CASE WHEN tag = 'business' THEN amount ELSE 0 END) AS DECIMAL(18,2)) AS business_amount
FROM classified GROUP BY tag""",
    ),
)
def a1(spark, sf):
    return lg.tag_summary(b.classified(spark, sf))


@query(
    "j13_ledger_diff",
    with_(
        "classified",
        "prior",
        body="""
SELECT coalesce(p.ref, c.ref) AS ref,
       CASE WHEN c.ref IS NULL THEN 'only-prior' WHEN p.ref IS NULL THEN 'only-new' ELSE 'tag-changed' END AS change,
       p.tag AS prior_tag, c.tag AS new_tag
FROM prior p FULL JOIN (SELECT ref, tag FROM classified WHERE tag <> 'skip') c ON c.ref = p.ref
WHERE c.ref IS NULL OR p.ref IS NULL OR p.tag IS DISTINCT FROM c.tag""",
    ),
)
def j13(spark, sf):
    return lg.ledger_diff(b.prior(spark, sf), b.classified(spark, sf).filter(F.col("tag") != "skip"))


@query(
    "u2_key_diff",
    """
SELECT CAST(o_custkey AS BIGINT) AS user_id, 'only-a' AS side FROM (SELECT DISTINCT o_custkey FROM orders)
WHERE o_custkey NOT IN (SELECT user_id FROM events)
UNION ALL SELECT user_id, 'only-b' FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT o_custkey FROM orders)""",
)
def u2(spark, sf):
    buyers = b.table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"))
    return lg.key_diff(buyers, b.table(spark, sf, "events").select("user_id"), "user_id")
