"""Queries that match charges to evidence messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..functions.scale import spread
from ..operators import matching as mt
from ..session import settle
from . import bindings as b, query
from .bindings import cte, with_

TERMS = {
    "receipt_terms": ["receipt", "kvitto", "invoice", "faktura", "payment", "betalning", "order", "subscription", "prenumeration"],
    "refund_terms": ["refund", "återbetalning", "credit note", "kreditnota"],
    "decoy_terms": ["newsletter", "unsubscribe"],
    "decoy_senders": ["ads.example"],
    "corroboration_senders": ["info@card.example"],
    "own_senders": ["owner@own.example"],
    "forward_prefixes": ["fwd:", "fw:", "vb:", "vidarebefordrat"],
    "reply_prefixes": ["re:", "sv:"],
    "forward_addresses": ["forward@inbox.example"],
    "search_words": ["receipt", "kvitto", "invoice", "faktura", "payment", "betalning"],
}
STOP = ["STOCKHOLM", "CLOUD"]
TERM_ROWS = [(name, term) for name, terms in TERMS.items() for term in terms]

VENDORS = [
    ("acme", "Acme Cloud", "alfa", ["acme.example"], ["billing@acme.example"], ["your receipt from acme"], ["promo.acme.example"], "SEK", None, None, None, None, "pdf", "none", "", [], []),
    ("beta", "Beta Pay Desk", "beta", ["pay.example"], [], ["payment receipt"], [], "EUR", -3, 2, 14, 7, None, "portal", "log in to beta", [], []),
    ("gamma", "Gamma Offers", "alfa", [], [], [], [], "SEK", None, None, None, None, "link", "ask", "", ["info@card.example", "news.example"], ["Summer offers"]),
]
VENDOR_SCHEMA = (
    "vendor_key string, vendor_name string, vendor_entity string, senders array<string>, sender_exact array<string>, "
    "subject_terms array<string>, decoy_senders array<string>, bill_currency string, band_lo int, band_hi int, "
    "before int, after int, attachments string, route_if_none string, portal string, search_from array<string>, search_subject array<string>"
)
SUBJECT_TERMS = ["your receipt from acme", "payment receipt", "summer offers"]
RUN_DATE = "DATE '2024-02-15'"


def policy(spark):
    terms: dict[str, list[str]] = {}
    for name, term in TERM_ROWS:
        terms.setdefault(name, []).append(term)
    return mt.MatchPolicy(terms=terms, identities={"alfa": "owner@own.example"})


def vendors(spark):
    return b.policy_table(spark, VENDORS, VENDOR_SCHEMA)


cte("match_vendors", b.values_sql(VENDORS, VENDOR_SCHEMA))


def worklist(spark, sf):
    """Charges to match: one per order, laid over the month the messages cover."""
    orders = spread(b.table(spark, sf, "orders"))
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    merchant = (
        F.when(p == "1-URGENT", "ACMECLOUD STOCKHOLM").when(p == "2-HIGH", "ACME SLIPS").when(p == "3-MEDIUM", "BETA TOOLS")
        .when(p == "4-NOT SPECIFIED", "GAMMA OFFERS").otherwise("SUMMER SALES AB")
    )
    vendor = F.when(p.isin("1-URGENT", "2-HIGH"), "acme").when(p == "3-MEDIUM", "beta").when(p == "4-NOT SPECIFIED", "gamma")
    sek = F.round(F.col("o_totalprice") / 10000).cast(MONEY)
    rows = orders.select(
        F.col("o_orderkey").cast("string").alias("row_key"),
        F.col("o_custkey").alias("mailbox"),
        F.when(s == "F", "expense").otherwise("card").alias("ledger"),
        F.make_date(F.lit(2024), F.lit(1), F.dayofmonth(F.col("o_orderdate").cast("date"))).alias("date"),
        merchant.alias("merchant"),
        vendor.alias("vendor_key"),
        F.when(F.col("o_totalprice") > 480000, "refund").otherwise("charge").alias("kind"),
        sek.alias("amount_sek"),
        F.when(s == "P", F.floor(F.col("o_totalprice") / 12000).cast(MONEY)).alias("foreign_amount"),
        F.when(s == "P", "EUR").alias("foreign_currency"),
        F.when(p == "5-LOW", "needs-tag").otherwise("business").alias("tag"),
        F.lit("alfa").alias("entity"),
    )
    return mt.with_vendor(rows, vendors(spark), policy(spark))


cte(
    "worklist",
    """
SELECT w.*, v.* EXCLUDE (vendor_key, band_lo, band_hi, before, after),
       coalesce(v.band_lo, CASE ledger WHEN 'expense' THEN -2 ELSE -1 END) AS band_lo, coalesce(v.band_hi, 1) AS band_hi,
       CAST(date - coalesce(v.before, 10) AS DATE) AS window_from, CAST(date + coalesce(v.after, 5) AS DATE) AS window_to
FROM (SELECT CAST(o_orderkey AS VARCHAR) AS row_key, o_custkey AS mailbox, CASE o_orderstatus WHEN 'F' THEN 'expense' ELSE 'card' END AS ledger,
   make_date(2024, 1, day(o_orderdate)) AS date,
   CASE o_orderpriority WHEN '1-URGENT' THEN 'ACMECLOUD STOCKHOLM' WHEN '2-HIGH' THEN 'ACME SLIPS' WHEN '3-MEDIUM' THEN 'BETA TOOLS' WHEN '4-NOT SPECIFIED' THEN 'GAMMA OFFERS' ELSE 'SUMMER SALES AB' END AS merchant,
   CASE o_orderpriority WHEN '1-URGENT' THEN ['ACMECLOUD'] WHEN '2-HIGH' THEN ['ACME','SLIPS'] WHEN '3-MEDIUM' THEN ['BETA','TOOLS'] WHEN '4-NOT SPECIFIED' THEN ['GAMMA','OFFERS'] ELSE ['SUMMER','SALES'] END AS tokens,
   CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'acme' WHEN o_orderpriority = '3-MEDIUM' THEN 'beta' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'gamma' END AS vendor_key,
   CASE WHEN o_totalprice > 480000 THEN 'refund' ELSE 'charge' END AS kind,
   CAST(round(o_totalprice / 10000) AS DECIMAL(18,2)) AS amount_sek,
   CASE WHEN o_orderstatus = 'P' THEN CAST(floor(o_totalprice / 12000) AS DECIMAL(18,2)) END AS foreign_amount,
   CASE WHEN o_orderstatus = 'P' THEN 'EUR' END AS foreign_currency,
   CASE WHEN o_orderpriority = '5-LOW' THEN 'needs-tag' ELSE 'business' END AS tag, 'alfa' AS entity
  FROM orders) w LEFT JOIN match_vendors v ON v.vendor_key = w.vendor_key""",
    "match_vendors",
)


def messages(spark, sf):
    """Messages: one per event, its type deciding sender, subject and the amount it mentions."""
    e = spread(b.table(spark, sf, "events"))
    k = F.get_json_object("props", "$.k").cast("int")
    t = F.col("event_type")
    rows = e.withColumn("k", k)
    body = (
        F.when(t == "purchase", F.concat(F.lit("Your receipt from Acme no "), F.col("event_id").cast("string")))
        .when(t == "view", "Summer offers on your next payment")
        .when(t == "click", "Payment receipt")
        .when(t == "signup", "Fwd: Your receipt from Acme")
        .otherwise("Refund for your order")
    )
    subject = (
        F.when(F.col("k") < 10, F.concat(F.lit("Re: "), body))
        .when(F.col("k") >= 95, F.concat(F.lit("Newsletter: "), body))
        .when(F.col("k") >= 90, F.concat(body, F.lit(" failed")))
        .otherwise(body)
    )
    name = (
        F.when(t == "purchase", "Acme Billing").when(t == "view", "Summer News").when(t == "click", "Acme Cloud via Pay")
        .when(t == "signup", "Owner").otherwise("Bank")
    )
    addr = (
        F.when((t == "purchase") & F.col("k").between(20, 40), "news@mail.acme.example")
        .when(t == "purchase", "billing@acme.example")
        .when((t == "view") & (F.col("k") >= 80), "promo@promo.acme.example")
        .when(t == "view", "news@acme.example")
        .when(t == "click", "billing@pay.example")
        .when(t == "signup", "owner@own.example")
        .when(F.col("k") >= 60, "info@card.example")
        .otherwise("noreply@bank.example")
    )
    currency = F.when(t == "click", "EUR").when(t == "view", F.lit(None)).otherwise("SEK")
    mention = F.struct(F.col("value").cast(MONEY).alias("value"), currency.alias("currency"))
    out = rows.select(
        F.col("event_id").alias("message_id"),
        F.col("user_id").alias("mailbox"),
        F.concat_ws("-", F.col("user_id"), F.floor(F.col("k") / 10)).alias("thread_id"),
        F.col("ts").cast("date").alias("day"),
        subject.alias("subject"),
        name.alias("from_name"),
        addr.alias("from_addr"),
        F.when(t == "click", "help@acme.example").otherwise("").alias("reply_addr"),
        F.when((t == "signup") & (F.col("k") < 50), "forward@inbox.example").otherwise("me@own.example").alias("to"),
        F.array(mention).alias("mentions"),
    )
    return out.withColumn("from_domain", F.substring_index("from_addr", "@", -1)).withColumn(
        "reply_domain", F.when(F.col("reply_addr") == "", "").otherwise("acme.example")
    )


def details(spark, sf):
    e = b.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    t = F.col("event_type")
    return e.select(
        F.col("event_id").alias("message_id"),
        F.array(F.struct(k.cast(MONEY).alias("value"), F.lit("SEK").alias("currency"))).alias("mentions"),
        (t == "purchase").alias("has_pdf"),
        t.isin("click", "view").alias("has_html"),
        F.array(F.concat(F.when(k.cast("int") < 50, F.lit("https://acme.example/invoice/")).otherwise(F.lit("https://x.example/")), k)).alias("links"),
    )


cte(
    "messages",
    """
SELECT event_id AS message_id, user_id AS mailbox, user_id || '-' || (k // 10) AS thread_id, CAST(ts AS DATE) AS day,
  CASE WHEN k < 10 THEN 'Re: ' || body WHEN k >= 95 THEN 'Newsletter: ' || body WHEN k >= 90 THEN body || ' failed' ELSE body END AS subject,
  CASE event_type WHEN 'purchase' THEN 'Acme Billing' WHEN 'view' THEN 'Summer News' WHEN 'click' THEN 'Acme Cloud via Pay' WHEN 'signup' THEN 'Owner' ELSE 'Bank' END AS from_name,
  CASE WHEN event_type = 'purchase' AND k BETWEEN 20 AND 40 THEN 'news@mail.acme.example' WHEN event_type = 'purchase' THEN 'billing@acme.example'
       WHEN event_type = 'view' AND k >= 80 THEN 'promo@promo.acme.example' WHEN event_type = 'view' THEN 'news@acme.example' WHEN event_type = 'click' THEN 'billing@pay.example'
       WHEN event_type = 'signup' THEN 'owner@own.example' WHEN k >= 60 THEN 'info@card.example' ELSE 'noreply@bank.example' END AS from_addr,
  CASE event_type WHEN 'click' THEN 'help@acme.example' ELSE '' END AS reply_addr,
  CASE WHEN event_type = 'signup' AND k < 50 THEN 'forward@inbox.example' ELSE 'me@own.example' END AS "to",
  CAST(value AS DECIMAL(18,2)) AS v1, CASE event_type WHEN 'click' THEN 'EUR' WHEN 'view' THEN NULL ELSE 'SEK' END AS c1,
  CAST(k AS DECIMAL(18,2)) AS v2, event_type = 'purchase' AS d_pdf, event_type IN ('click','view') AS d_html, k < 50 AS d_link,
  split_part(from_addr, '@', 2) AS from_domain, k
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
   CASE event_type WHEN 'purchase' THEN 'Your receipt from Acme no ' || event_id WHEN 'view' THEN 'Summer offers on your next payment' WHEN 'click' THEN 'Payment receipt'
        WHEN 'signup' THEN 'Fwd: Your receipt from Acme' ELSE 'Refund for your order' END AS body FROM events)""",
)

J5_SQL = """
SELECT w.row_key, m.message_id, m.day - w.date AS lag_days
FROM worklist w JOIN messages m ON m.mailbox = w.mailbox AND m.day BETWEEN w.window_from AND w.window_to"""


@query("j5_candidates", with_("worklist", "messages", body=J5_SQL.replace("m.day - w.date", "CAST(m.day - w.date AS INTEGER)")))
def j5(spark, sf):
    narrow = worklist(spark, sf).select("row_key", "mailbox", "date", "window_from", "window_to")
    return mt.candidates(narrow, messages(spark, sf).select("message_id", "mailbox", "day")).select(
        "row_key", "message_id", "lag_days"
    )


def blocked(spark, sf):
    return mt.blocked_pairs(worklist(spark, sf), messages(spark, sf), STOP, SUBJECT_TERMS, TERMS["search_words"])


cte(
    "blocked",
    """
SELECT row_key, message_id, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM (
  SELECT w.row_key, m.message_id, unnest(list_filter([
     CASE WHEN (w.vendor_key = 'acme' AND (from_domain = 'acme.example' OR ends_with(from_domain, '.acme.example'))) OR (w.vendor_key = 'beta' AND (from_domain = 'pay.example' OR ends_with(from_domain, '.pay.example')))
       OR (w.vendor_key = 'gamma' AND (from_addr = 'info@card.example' OR contains(lower(subject), 'summer offers'))) THEN 'vendor' END,
     CASE WHEN (w.vendor_key = 'acme' AND contains(lower(subject), 'your receipt from acme')) OR (w.vendor_key = 'beta' AND contains(lower(subject), 'payment receipt')) THEN 'subject' END,
     CASE WHEN (w.vendor_key IS NULL OR w.vendor_key = 'gamma') AND regexp_matches(lower(subject), 'receipt|kvitto|invoice|faktura|payment|betalning')
          AND len(list_intersect(w.tokens, string_split_regex(upper(subject), '[^A-Z0-9]+'))) > 0 THEN 'merchant' END,
     CASE WHEN (m.v1 = w.amount_sek AND w.amount_sek >= 10) OR (m.v1 = w.foreign_amount AND w.foreign_amount >= 10) THEN 'amount' END], lambda x: x IS NOT NULL)) AS kind
  FROM worklist w JOIN messages m ON m.mailbox = w.mailbox AND m.day BETWEEN w.window_from AND w.window_to)
GROUP BY row_key, message_id""",
    "worklist",
    "messages",
)


@query("j6_blocked_pairs", with_("blocked", body="SELECT row_key, message_id, kinds FROM blocked"))
def j6(spark, sf):
    return blocked(spark, sf).withColumn("kinds", F.array_join("kinds", ","))


@query(
    "j6_blocked_pairs_page",
    with_(
        "blocked",
        body="""
SELECT row_key, message_id, kind, row_number() OVER (PARTITION BY row_key, kind ORDER BY day DESC, message_id DESC) AS place
FROM (SELECT b.row_key, b.message_id, m.day, unnest(string_split(b.kinds, ',')) AS kind FROM blocked b JOIN messages m USING (message_id))""",
    ),
)
def j6_page(spark, sf):
    """The same search as result pages: every hit with its place per charge and kind, newest first."""
    return mt.paged(blocked(spark, sf), messages(spark, sf))


def pairs(spark, sf, detailed=False):
    hit = blocked(spark, sf).drop("kinds")
    charges = mt.charge_features(worklist(spark, sf).drop("mailbox"), STOP)
    mails = mt.message_features(messages(spark, sf).drop("mailbox"), policy(spark))
    return mt.facing(hit, charges, mt.read_details(mails, details(spark, sf)) if detailed else mails)


def scored(spark, sf, detailed=False):
    return mt.score(pairs(spark, sf, detailed))


def rescored(spark, sf):
    return mt.rescore(scored(spark, sf, detailed=True))


def ranked(spark, sf):
    return mt.rank_candidates(rescored(spark, sf), policy(spark))


LEVEL = """
CASE WHEN (c1 = 'SEK' AND abs(v1 - amount_sek) <= 0.01) {sek} THEN 'sek_exact'
     WHEN c1 = foreign_currency AND abs(v1 - foreign_amount) <= 0.01 THEN 'foreign_exact'
     WHEN c1 IS NULL AND (abs(v1 - amount_sek) <= 0.01 OR coalesce(abs(v1 - foreign_amount) <= 0.01, false)) THEN 'unlabelled'
     WHEN fx AND amount_sek <> 0 AND ((c1 = 'SEK' AND abs(v1 - amount_sek) <= 0.03 * amount_sek) {fx}) THEN 'sek_fx'
     WHEN class = 'receipt' AND (c1 = 'SEK' OR c1 = foreign_currency {any}) THEN 'contradiction' ELSE 'none' END"""
LEVEL_META = LEVEL.format(sek="", fx="", any="")
LEVEL_FULL = LEVEL.format(
    sek="OR abs(v2 - amount_sek) <= 0.01", fx="OR abs(v2 - amount_sek) <= 0.03 * amount_sek", any="OR true"
)
POINTS = "CASE {m} WHEN 'sek_exact' THEN 40 WHEN 'foreign_exact' THEN 35 WHEN 'unlabelled' THEN 20 WHEN 'sek_fx' THEN 15 WHEN 'contradiction' THEN -15 ELSE 0 END"

cte(
    "parts",
    f"""
SELECT *, {LEVEL_META} AS level_meta, {LEVEL_FULL} AS level_full,
  CASE WHEN gap = 0 THEN 25 ELSE greatest(5, 25 - 3 * gap) END AS s_date,
  CASE WHEN vendor_key = 'acme' AND from_addr = 'billing@acme.example' THEN 20
       WHEN (vendor_key = 'acme' AND (from_domain = 'acme.example' OR ends_with(from_domain, '.acme.example'))) OR (vendor_key = 'beta' AND from_domain = 'pay.example') THEN 15
       WHEN vendor_key = 'acme' AND reply_addr = 'help@acme.example' THEN 12
       WHEN (vendor_key = 'acme' AND regexp_matches(lower(from_name), 'acme|cloud')) OR (vendor_key = 'beta' AND regexp_matches(lower(from_name), 'beta|pay|desk')) OR (vendor_key = 'gamma' AND regexp_matches(lower(from_name), 'gamma|offers')) THEN 10
       WHEN vendor_key IS NULL AND regexp_matches(lower(from_name) || ' ' || from_domain, 'summer|sales') THEN 10 ELSE 0 END AS s_sender,
  CASE WHEN contains(subj, 'refund') AND kind <> 'refund' THEN -20 ELSE least(10,
       CASE WHEN (vendor_key = 'acme' AND contains(subj, 'your receipt from acme')) OR (vendor_key = 'beta' AND contains(subj, 'payment receipt')) OR (contains(subj, 'refund') AND kind = 'refund') THEN 10
            WHEN regexp_matches(subj, 'receipt|payment|order') THEN 5 ELSE 0 END
       + CASE WHEN len(list_filter(tokens, lambda x: contains(subj, lower(x)))) > 0 THEN 3 ELSE 0 END) END AS s_subject,
  CASE class WHEN 'forward' THEN -15 WHEN 'reply' THEN -25 ELSE 0 END + CASE WHEN contains(subj, 'failed') THEN -20 ELSE 0 END AS s_class
FROM (
  SELECT p.*, greatest(band_lo - lag_days, lag_days - band_hi, 0) AS gap, lower(subject) AS subj,
    (foreign_amount IS NOT NULL OR coalesce(bill_currency, 'SEK') <> 'SEK') AND greatest(band_lo - lag_days, lag_days - band_hi, 0) <= 5 AS fx,
    CASE WHEN from_addr = 'info@card.example' THEN 'corroboration'
         WHEN vendor_key = 'acme' AND from_domain = 'promo.acme.example' THEN 'decoy'
         WHEN contains(lower(subject), 'newsletter') THEN 'decoy'
         WHEN kind <> 'refund' AND contains(lower(subject), 'refund') THEN 'refund'
         WHEN starts_with(lower(subject), 'fwd:') OR "to" = 'forward@inbox.example' THEN 'forward'
         WHEN from_addr = 'owner@own.example' THEN 'own'
         WHEN starts_with(lower(subject), 're:') THEN 'reply' ELSE 'receipt' END AS class
  FROM (SELECT b.kinds, w.* EXCLUDE (mailbox), m.* EXCLUDE (mailbox), CAST(m.day - w.date AS INTEGER) AS lag_days
        FROM blocked b JOIN worklist w USING (row_key) JOIN messages m USING (message_id)) p)""",
    "blocked",
)
cte(
    "scored",
    f"""
SELECT *, greatest(-100, least(100, {POINTS.format(m='level_meta')} + s_date + s_sender + s_subject + s_class)) AS meta_score FROM parts""",
    "parts",
)
cte(
    "rescored",
    f"""
SELECT s.* , g.gate_rank, CASE WHEN g.gate_rank IS NULL THEN level_meta ELSE level_full END AS amount_match,
  CASE WHEN g.gate_rank IS NULL THEN 0 WHEN attachments = 'pdf' THEN CASE WHEN d_pdf THEN 5 ELSE 0 END
       WHEN attachments = 'link' THEN CASE WHEN d_link THEN 5 ELSE 0 END WHEN d_pdf THEN 5 WHEN d_html THEN 2 ELSE 0 END AS s_attachment,
  CASE WHEN g.gate_rank IS NULL THEN meta_score ELSE greatest(-100, least(100, {POINTS.format(m='level_full')} + s_date + s_sender + s_subject + s_class
     + CASE WHEN attachments = 'pdf' THEN CASE WHEN d_pdf THEN 5 ELSE 0 END WHEN attachments = 'link' THEN CASE WHEN d_link THEN 5 ELSE 0 END WHEN d_pdf THEN 5 WHEN d_html THEN 2 ELSE 0 END)) END AS score,
  g.gate_rank IS NOT NULL AND d_pdf AS has_pdf
FROM scored s LEFT JOIN (
  SELECT * FROM (SELECT row_key, message_id, row_number() OVER (PARTITION BY row_key ORDER BY meta_score DESC, day DESC, message_id) AS gate_rank
    FROM scored WHERE class NOT IN ('corroboration','decoy','own','refund') AND (s_sender > 0 OR s_subject >= 10 OR level_meta NOT IN ('none','contradiction')))
  ) g ON g.row_key = s.row_key AND g.message_id = s.message_id""",
    "scored",
)
cte(
    "ranked",
    """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY tier, score DESC, gap, day DESC, message_id) AS rank, min(tier) OVER (PARTITION BY row_key) AS lead
  FROM (SELECT *, CASE WHEN confidence IN ('strong','possible') THEN 0 WHEN confidence = 'weak' AND two THEN 1 END AS tier FROM (
    SELECT *, CASE WHEN late IN ('strong','possible') AND NOT two THEN 'weak' ELSE late END AS confidence FROM (
      SELECT *, CASE WHEN score >= 70 AND gap > 14 THEN 'possible' WHEN score >= 70 THEN 'strong' WHEN score >= 45 THEN 'possible' WHEN score >= 25 THEN 'weak' ELSE 'dropped' END AS late,
             amount_match NOT IN ('none','contradiction') OR (s_sender > 0 AND s_subject >= 5) AS two FROM (
        SELECT *, row_number() OVER (PARTITION BY row_key, thread_id ORDER BY score DESC, meta_score DESC, day DESC, message_id) AS tn, count(*) OVER (PARTITION BY row_key, thread_id) - 1 AS same_thread
        FROM rescored WHERE class NOT IN ('corroboration','decoy','own','refund')) WHERE tn = 1))) WHERE tier IS NOT NULL)
WHERE tier = lead AND rank <= CASE WHEN tier = 0 THEN 5 ELSE 2 END""",
    "rescored",
)


@query("d4_message_class", with_("parts", body="SELECT row_key, message_id, class FROM parts"))
def d4(spark, sf):
    return pairs(spark, sf).select("row_key", "message_id", mt.message_class().alias("class"))


@query("d5_amount_level", with_("parts", body="SELECT row_key, message_id, level_meta AS amount_match FROM parts"))
def d5(spark, sf):
    return scored(spark, sf).select("row_key", "message_id", "amount_match")


@query(
    "d6_score",
    with_(
        "scored",
        body=f"SELECT row_key, message_id, {POINTS.format(m='level_meta')} AS s_amount, s_date, s_sender, s_subject, s_class, meta_score AS score FROM scored",
    ),
)
def d6(spark, sf):
    return scored(spark, sf).select("row_key", "message_id", "s_amount", "s_date", "s_sender", "s_subject", "s_class", "score")


@query("d8_detail_gate", with_("rescored", body="SELECT row_key, message_id, gate_rank FROM rescored WHERE gate_rank IS NOT NULL"))
def d8(spark, sf):
    return mt.detail_gate(scored(spark, sf)).select("row_key", "message_id", F.col("gate_rank").cast("bigint").alias("gate_rank"))


@query(
    "d8_rescore",
    with_("rescored", body="SELECT row_key, message_id, amount_match, s_attachment, score, meta_score, has_pdf FROM rescored"),
)
def d8_rescore(spark, sf):
    return rescored(spark, sf).select("row_key", "message_id", "amount_match", "s_attachment", "score", "meta_score", "has_pdf")


@query(
    "d7_confidence",
    with_(
        "rescored",
        body="""
SELECT CASE WHEN late IN ('strong','possible') AND NOT two THEN 'weak' ELSE late END AS confidence, amount_match, count(*) AS n FROM (
  SELECT *, CASE WHEN score >= 70 AND gap > 14 THEN 'possible' WHEN score >= 70 THEN 'strong' WHEN score >= 45 THEN 'possible' WHEN score >= 25 THEN 'weak' ELSE 'dropped' END AS late,
    amount_match NOT IN ('none','contradiction') OR (s_sender > 0 AND s_subject >= 5) AS two FROM rescored) GROUP BY 1, 2""",
    ),
)
def d7(spark, sf):
    rows = rescored(spark, sf).withColumn("confidence", mt.confidence(policy(spark)))
    return rows.groupBy("confidence", "amount_match").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w2_rank_candidates",
    with_("ranked", body="SELECT row_key, message_id, thread_id, same_thread, score, confidence, rank FROM ranked"),
)
def w2(spark, sf):
    return ranked(spark, sf).select(
        "row_key", "message_id", "thread_id", "same_thread", "score", "confidence", F.col("rank").cast("bigint").alias("rank")
    )


@query(
    "w2_side_lists",
    with_(
        "scored",
        body="""
SELECT row_key, list, message_id, score, reason, place FROM (
  SELECT *, row_number() OVER (PARTITION BY row_key, list ORDER BY score DESC, day DESC, message_id) AS place FROM (
    SELECT row_key, message_id, meta_score AS score, day, CASE class WHEN 'corroboration' THEN 'corroboration' ELSE 'rejected' END AS list,
      CASE class WHEN 'own' THEN 'sent by the mailbox owner, not a receipt' WHEN 'refund' THEN 'refund mail, not the receipt of a charge' WHEN 'decoy' THEN 'decoy sender or subject' ELSE '' END AS reason
    FROM scored WHERE class IN ('corroboration','decoy','own','refund'))) WHERE place <= 3""",
    ),
)
def w2_sides(spark, sf):
    return mt.side_lists(scored(spark, sf)).withColumn("place", F.col("place").cast("bigint"))


cte(
    "best",
    """
SELECT row_key, max(message_id) FILTER (rank = 1) AS best, max(message_id) FILTER (rank = 2) AS second, max(confidence) FILTER (rank = 1) AS confidence,
   max(score) FILTER (rank = 1) AS best_score, count(*) AS candidates, max(thread_id) FILTER (rank = 1) AS best_thread, max(subject) FILTER (rank = 1) AS best_subject,
   max(day) FILTER (rank = 1) AS best_day, max(gap) FILTER (rank = 1) AS best_gap,
   CASE WHEN max(confidence) FILTER (rank = 1) IN ('strong','possible') AND (max(confidence) FILTER (rank = 2) = 'strong' OR (max(confidence) FILTER (rank = 2) = 'possible'
        AND bool_or(has_pdf) FILTER (rank = 2) AND NOT bool_or(has_pdf) FILTER (rank = 1))) THEN max(message_id) FILTER (rank = 2) END AS secondary
FROM ranked GROUP BY row_key""",
    "ranked",
)


def best(spark, sf):
    return mt.best_second(ranked(spark, sf))


@query(
    "w3_best_second",
    with_("best", body="SELECT row_key, best, second, confidence, best_score, candidates, secondary FROM best"),
)
def w3(spark, sf):
    return best(spark, sf).select("row_key", "best", "second", "confidence", "best_score", "candidates", "secondary")


def sends(spark, sf):
    """Mails to the receipt inbox: some of the messages, and receipts sent on days before or after they
    came, in their own mailbox or in the next one."""
    own = messages(spark, sf).filter(F.col("to") == "forward@inbox.example").select("message_id", "mailbox", "thread_id", "day", "subject", "from_addr")
    k = F.get_json_object("props", "$.k").cast("int")
    e = b.table(spark, sf, "events").filter("event_type = 'purchase'").withColumn("k", k).filter("k % 4 = 0")
    more = e.select(
        (-F.col("event_id")).alias("message_id"),
        (F.col("user_id") + F.when(F.col("k") % 8 == 0, 0).otherwise(1)).alias("mailbox"),
        F.concat(F.lit("sent-"), F.col("event_id")).alias("thread_id"),
        F.date_add(F.col("ts").cast("date"), F.col("k") % 7 - 3).alias("day"),
        F.concat(F.lit("VB: Your receipt from Acme no "), F.col("event_id").cast("string")).alias("subject"),
        F.when(F.col("k") % 3 == 0, "other@own.example").otherwise("owner@own.example").alias("from_addr"),
    )
    return own.unionByName(more)


MARKS = TERMS["forward_prefixes"] + TERMS["reply_prefixes"]
KEY_SQL = "trim(regexp_replace(lower({0}), '^((fwd:|fw:|vb:|vidarebefordrat|re:|sv:)\\s*)+', ''))"
cte(
    "sends",
    """
SELECT message_id, mailbox, thread_id, day, subject, from_addr FROM messages WHERE "to" = 'forward@inbox.example'
UNION ALL SELECT -event_id, user_id + CASE WHEN k % 8 = 0 THEN 0 ELSE 1 END, 'sent-' || event_id, CAST(CAST(ts AS DATE) + CAST(k % 7 - 3 AS INTEGER) AS DATE),
  'VB: Your receipt from Acme no ' || event_id, CASE WHEN k % 3 = 0 THEN 'other@own.example' ELSE 'owner@own.example' END
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'purchase') WHERE k % 4 = 0""",
    "messages",
)
cte(
    "related",
    f"""
SELECT row_key, best, side, arg_max(message_id, (day, message_id)) AS send_id, max(day) AS send_day, arg_max(from_addr, (day, message_id)) AS send_from
FROM (SELECT b.row_key, b.best, b.best_day, w.window_from, w.window_to, m.message_id, m.day, m.from_addr
  FROM best b JOIN worklist w ON w.row_key = b.row_key JOIN sends m ON m.mailbox = w.mailbox
   AND (m.thread_id = b.best_thread OR (regexp_matches({KEY_SQL.format('b.best_subject')}, '[0-9]{{3,}}') AND {KEY_SQL.format('b.best_subject')} = {KEY_SQL.format('m.subject')}))) AS met
  JOIN (VALUES ('index'), ('window')) AS sides(side) ON CASE side WHEN 'index' THEN day >= best_day ELSE day BETWEEN window_from AND window_to END
GROUP BY row_key, best, side""",
    "best",
    "worklist",
    "sends",
)


def related(spark, sf, found):
    windows = worklist(spark, sf).select("row_key", "mailbox", "window_from", "window_to")
    return mt.related_sends(found.join(windows, "row_key"), sends(spark, sf), MARKS)


@query("j20_related_sends", with_("related", body="SELECT row_key, best, side, send_id, send_day, send_from FROM related"))
def j20(spark, sf):
    return related(spark, sf, settle(best(spark, sf)))


HINTS = ["ready", "Forwarded 2024-01-09 by hand", "portal", "ask  the hotel", ""]


def routed(spark, sf):
    found = settle(best(spark, sf))  # one narrow row per charge, read by three joins below
    sent = mt.last_send(related(spark, sf, found))
    rows = worklist(spark, sf).join(found, "row_key", "left").join(sent, "row_key", "left")
    number = F.col("row_key").cast("bigint")
    rows = rows.withColumn("status_hint", F.element_at(F.array(*map(F.lit, HINTS)), (F.pmod(number, F.lit(len(HINTS))) + 1).cast("int")))
    rows = rows.withColumn("expense_id", F.when(number % 2 == 0, F.concat(F.lit("X"), "row_key")))
    return mt.route(rows, policy(spark), F.expr(RUN_DATE))


cte(
    "routed",
    f"""
SELECT * EXCLUDE (hint, said), CASE WHEN hint <> '' AND NOT starts_with(lower(hint), 'ready') AND lower(hint) <> route AND NOT (contains(hint, ' ') AND contains(lower(said), lower(hint)))
    THEN said || '; input hint: ' || hint ELSE said END AS route_reason
FROM (SELECT *, CASE WHEN kind = 'refund' THEN 'refund ' ELSE '' END || reason || CASE WHEN notes <> '' THEN ' (' || notes || ')' ELSE '' END AS said,
  CASE WHEN route = 'forward' THEN date + 39 END AS forward_deadline, CASE WHEN route = 'forward' THEN 'owner@own.example' END AS forward_from
FROM (
SELECT w.row_key, w.kind, w.date, w.merchant, w.amount_sek, b.confidence, b.best, b.secondary, regexp_replace(status, '\\s+', ' ', 'g') AS hint,
  CASE WHEN u AND ledger = 'expense' AND (sent_day IS NOT NULL OR told) THEN 'confirm' WHEN u AND ledger = 'expense' AND DATE '2024-02-15' - date < 40 THEN 'forward' WHEN u AND ledger = 'expense' THEN 'attach'
       WHEN u AND tag = 'business' THEN 'pack' WHEN u THEN 'none' WHEN route_if_none = 'portal' THEN 'portal' ELSE 'none' END AS route,
  CASE WHEN u AND ledger = 'expense' AND sent_day IS NOT NULL THEN 'already forwarded ' || sent_day || '; confirm, do not forward again'
       WHEN u AND ledger = 'expense' AND told THEN 'already forwarded according to the input; confirm ' || best || ', do not forward again'
       WHEN u AND ledger = 'expense' AND DATE '2024-02-15' - date < 40 THEN 'forward ' || best || ' before ' || CAST(date + 39 AS DATE)
       WHEN u AND ledger = 'expense' THEN 'attach ' || best || CASE WHEN CAST(w.row_key AS BIGINT) % 2 = 0 THEN ' on expense X' ELSE '; find the expense by receipt number ' END || w.row_key
       WHEN u AND tag = 'business' THEN 'include ' || best || CASE WHEN secondary IS NOT NULL THEN '; secondary ' || secondary ELSE '' END
       WHEN u THEN 'receipt found (' || best || ') but the row needs a tag, now ' || tag
       WHEN route_if_none = 'portal' THEN portal WHEN route_if_none = 'ask' THEN 'ask' ELSE 'no receipt mail found in the search window' END AS reason,
  concat_ws('; ', CASE WHEN vendor_entity <> 'alfa' THEN 'the vendor is listed under another entity' END,
    CASE WHEN u AND ledger = 'expense' AND sent_from <> 'owner@own.example' THEN 'that forward went from ' || sent_from || ', not from owner@own.example' END,
    CASE WHEN u AND confidence = 'possible' THEN 'review amount first' END, CASE WHEN u AND best_gap > 14 THEN 'verify the month' END) AS notes
FROM (SELECT *, {b.literal(HINTS)}[CAST(row_key AS BIGINT) % {len(HINTS)} + 1] AS status, CAST(row_key AS BIGINT) % {len(HINTS)} = 1 AS told FROM worklist) w
LEFT JOIN (SELECT *, confidence IN ('strong','possible') AS u FROM best) b ON b.row_key = w.row_key
LEFT JOIN (SELECT row_key, max(send_day) AS sent_day, arg_max(send_from, (send_day, send_id)) AS sent_from FROM related GROUP BY row_key) r ON r.row_key = w.row_key))""",
    "worklist",
    "related",
)


@query("d9_route", with_("routed", body="SELECT row_key, route, route_reason, forward_from, CAST(forward_deadline AS DATE) AS forward_deadline FROM routed"))
def d9(spark, sf):
    return routed(spark, sf).select("row_key", "route", "route_reason", "forward_from", "forward_deadline")


@query(
    "d10_fetch_decision",
    with_(
        "routed",
        body="""
SELECT row_key, CASE WHEN route = 'pack' AND confidence = 'strong' THEN concat_ws(',', best, secondary) ELSE '' END AS fetch_ids,
  CASE WHEN route = 'pack' AND confidence = 'strong' THEN '' WHEN route = 'pack' AND confidence = 'possible' THEN 'possible only, not fetched: ' || route_reason
       ELSE route || '/' || coalesce(confidence, 'none') || ': ' || route_reason END AS fetch_note
FROM routed""",
    ),
)
def d10(spark, sf):
    out = mt.fetch_decision(routed(spark, sf))
    return out.select("row_key", F.array_join(F.col("fetch_ids").cast("array<string>"), ",").alias("fetch_ids"), "fetch_note")


@query(
    "s12_worklist_table",
    with_(
        "routed",
        body=f"""
SELECT row_key, date, merchant, {"replace(replace(replace(format('{:,.2f}', CAST(amount_sek AS DOUBLE)), ',', '~'), '.', ','), '~', ' ')"} || ' SEK' AS amount, route, route_reason AS what_to_do,
       coalesce(CAST(CAST(forward_deadline AS DATE) AS VARCHAR), '') AS deadline, coalesce(confidence, 'none') AS confidence FROM routed""",
    ),
)
def s12(spark, sf):
    return mt.worklist_table(routed(spark, sf))


def truth(spark, sf):
    """Labelled charges: the newest exact receipt of the mailbox by its plain amount rule."""
    firsts = messages(spark, sf).groupBy("mailbox").agg(
        F.min("message_id").alias("expected"), F.max("message_id").alias("secondary")
    )
    rows = b.table(spark, sf, "orders").join(firsts, F.col("o_custkey") == F.col("mailbox"))
    p = F.col("o_orderpriority")
    label = (
        F.when(p == "1-URGENT", "positive").when(p == "2-HIGH", "positive_medium").when(p == "3-MEDIUM", "negative")
        .when(p == "4-NOT SPECIFIED", "forward_only").otherwise("pending")
    )
    return rows.select(F.col("o_orderkey").cast("string").alias("row_key"), label.alias("set"), "expected", "secondary")


cte(
    "truth",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS row_key, CASE o_orderpriority WHEN '1-URGENT' THEN 'positive' WHEN '2-HIGH' THEN 'positive_medium' WHEN '3-MEDIUM' THEN 'negative' WHEN '4-NOT SPECIFIED' THEN 'forward_only' ELSE 'pending' END AS set,
       expected, secondary
FROM orders JOIN (SELECT user_id, min(event_id) AS expected, max(event_id) AS secondary FROM events GROUP BY user_id) ON user_id = o_custkey""",
)
EVAL_SQL = """
SELECT t.row_key, t.set, e.rank AS expected_rank,
  CASE WHEN t.set = 'pending' THEN 'INFO' WHEN t.set = 'negative' THEN CASE WHEN l.confidence = 'strong' THEN 'FAIL' ELSE 'PASS' END
       WHEN t.set = 'forward_only' THEN CASE WHEN s.rank IS NOT NULL THEN 'PASS' ELSE 'FAIL' END
       WHEN e.rank = 1 THEN 'PASS' WHEN t.set = 'positive_medium' AND e.rank IS NOT NULL THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM truth t LEFT JOIN ranked e ON e.row_key = t.row_key AND e.message_id = t.expected
LEFT JOIN ranked s ON s.row_key = t.row_key AND s.message_id = t.secondary
LEFT JOIN ranked l ON l.row_key = t.row_key AND l.rank = 1"""


@query("d22_evaluate", with_("ranked", "truth", body=f"SELECT set, verdict, count(*) AS n, count(*) FILTER (expected_rank = 1) AS at_rank_1 FROM ({EVAL_SQL}) GROUP BY set, verdict"))
def d22(spark, sf):
    return mt.evaluation_summary(mt.evaluate(truth(spark, sf), ranked(spark, sf)))


# --------------------------------------------------------------------------- scope, runs, reuse

@query(
    "p4_search_scope",
    with_(
        "expenses",
        body="""
SELECT expense_id, CASE WHEN type <> 'Card Purchase' THEN 'not a card purchase' WHEN export_status = 'EXPORTED' AND amount_sek > 400000 THEN 'already reconciled' WHEN merchant = '1-URGENT' AND amount_sek < 100000 THEN 'marked personal'
   WHEN has_receipt THEN 'receipt present' WHEN merchant = '2-HIGH' THEN 'not searched (tag skip)' ELSE '' END AS skip_reason
FROM expenses""",
    ),
)
def p4(spark, sf):
    rows = b.expenses(spark, sf).select(
        "expense_id",
        "type",
        F.when((F.col("export_status") == "EXPORTED") & (F.col("amount_sek") > 400000), "yes").otherwise("").alias("reconciled"),
        ((F.col("merchant") == "1-URGENT") & (F.col("amount_sek") < 100000)).alias("personal"),
        "has_receipt",
        F.when(F.col("merchant") == "2-HIGH", "skip").otherwise("business").alias("tag"),
    )
    return mt.search_scope(rows).select("expense_id", "skip_reason")


def runs(spark, sf):
    """Search runs: one per event, keyed by mailbox and day, with one or two queries each."""
    e = b.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    q1 = F.struct(F.lit("vendor").alias("kind"), k.alias("hits"))
    q2 = F.struct(F.col("event_type").alias("kind"), F.lit(1).cast("bigint").alias("hits"))
    queries = (
        F.when(F.col("event_type") == "error", F.array().cast("array<struct<kind:string,hits:bigint>>"))
        .when(F.col("event_type") == "view", F.array(q1))
        .otherwise(F.array(q1, q2, q1))
    )
    return e.select(
        F.col("ts").alias("run_at"),
        F.concat(F.lit("row-"), F.col("user_id").cast("string")).alias("row_key"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("exp-"), k.cast("string"))).otherwise("").alias("expense_id"),
        queries.alias("queries"),
        k.alias("candidates"),
        F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("best"),
    )


@query(
    "a15_latest_search",
    """
WITH r AS (SELECT ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error'),
keyed AS (SELECT *, 'row-' || user_id AS key FROM r UNION ALL SELECT *, 'exp-' || k FROM r WHERE event_type = 'click')
SELECT key, ts AS run_at, CASE event_type WHEN 'view' THEN 1 ELSE 3 END AS query_count, CASE event_type WHEN 'view' THEN 'vendor' ELSE 'vendor,' || event_type END AS kinds,
       CAST(CASE event_type WHEN 'view' THEN k ELSE 2 * k + 1 END AS BIGINT) AS hits, k AS candidates, event_type = 'purchase' AS has_best
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, 'row-' || user_id DESC, k DESC) AS n FROM keyed) WHERE n = 1""",
)
def a15(spark, sf):
    return mt.latest_search(runs(spark, sf))


def _lists(spark, sf):
    e = b.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("list_id"),
        F.col("ts").alias("fetched_at"),
        F.date_sub(F.date_add(F.col("ts").cast("date"), 2), k).alias("window_end"),
        F.array(F.col("event_id"), F.col("event_id") + k).alias("ids"),
    )


@query(
    "m7_reusable",
    """
SELECT list_id, closed_days, CASE WHEN closed_days < 1 THEN age <= 21600 ELSE age <= 604800 OR closed_days > 14 END AS reuse FROM (
  SELECT event_id AS list_id, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) - 2 AS INTEGER) AS closed_days,
         epoch(date_trunc('second', TIMESTAMP '2024-01-31 00:00:00')) - epoch(date_trunc('second', ts)) AS age FROM events)""",
)
def m7(spark, sf):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return mt.reusable(_lists(spark, sf), now).select("list_id", "closed_days", "reuse")


@query(
    "m7_purge",
    """
WITH used AS (SELECT event_id AS id FROM events WHERE event_type <> 'error' UNION SELECT event_id + CAST(json_extract_string(props, '$.k') AS BIGINT) FROM events WHERE event_type <> 'error')
SELECT event_id AS message_id, CASE WHEN event_id NOT IN (SELECT id FROM used) THEN 'unreferenced' ELSE 'old extract' END AS reason
FROM events WHERE event_id NOT IN (SELECT id FROM used) OR event_type = 'view'""",
)
def m7_purge(spark, sf):
    kept = b.table(spark, sf, "events").filter(F.col("event_type") != "error")
    k = F.get_json_object("props", "$.k").cast("bigint")
    lists = kept.select(F.array(F.col("event_id"), F.col("event_id") + k).alias("ids"))
    stored = b.table(spark, sf, "events").select(
        F.col("event_id").alias("message_id"), F.when(F.col("event_type") == "view", 1).otherwise(2).alias("extract_version")
    )
    return mt.purge(stored, lists, 2).select("message_id", "reason")


@query(
    "a18_fetch_coverage",
    """
SELECT status, count(*) AS n, count(*) FILTER (files > 0) AS covered, CAST(sum(CASE WHEN status = 'fetched' THEN files ELSE 0 END) AS BIGINT) AS new_files
FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'fetched' WHEN 'O' THEN 'already' ELSE 'no-attachment' END AS status, coalesce(l.files, 0) AS files
      FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS files FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = o_orderkey) GROUP BY status""",
)
def a18(spark, sf):
    files = (
        b.table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("files"))
    )
    orders = b.table(spark, sf, "orders").join(files, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status = F.when(F.col("o_orderstatus") == "F", "fetched").when(F.col("o_orderstatus") == "O", "already").otherwise("no-attachment")
    return mt.fetch_coverage(orders.select(status.alias("status"), F.coalesce("files", F.lit(0)).alias("files")))
