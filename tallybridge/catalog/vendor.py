"""Queries over merchants and vendors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vendor as vd
from . import bindings as b, query
from .bindings import cte, with_

STOP = ["SMALL", "COLD", "STOCKHOLM"]

ALIASES = [
    (1, "ring_co", "Ring Company", ["RING"], False, None, "SEK", []),
    (2, "hot_ring", "Hot Ring", ["HOT RING", "HOT"], False, None, "EUR", []),
    (3, "plate_a", "Plate Basic", ["PLATE"], False, None, "EUR", [(22, "EUR")]),
    (4, "plate_b", "Plate Max", ["PLATE"], False, None, "EUR", [(7, "EUR"), (30, "EUR")]),
    (5, "old_rod", "Old Rod", ["OLD ROD"], True, None, "SEK", []),
    (6, "gizmo", "Gizmo Works", ["GIZMOTRON"], False, "^(COLD|NEW|LARGE) GIZ", "SEK", []),
    (7, "anvils", "Makers of Large", ["MAKERS LARGE"], False, None, "SEK", []),
    (8, "widget_other", "Widget Pay", ["WIDGET"], False, None, "SEK", []),
    (9, "bolt_x", "Bolt Red", ["BOLT STORE"], False, None, "SEK", []),
    (10, "bolt_y", "Bolt Old", ["BOLT SHOP"], False, None, "SEK", []),
]
FLAT_SCHEMA = (
    "vendor_order int, vendor_key string, name string, merchants array<string>, merchant_exact boolean, "
    "merchant_regex string, bill_currency string"
)
AMOUNT_SCHEMA = "vendor_order int, listed int, currency string"
AMOUNT_ROWS = [(r[0], a, c) for r in ALIASES for a, c in r[7]]

cte("vendors", b.values_sql([r[:7] for r in ALIASES], FLAT_SCHEMA))
cte("vendor_amounts", b.values_sql(AMOUNT_ROWS, AMOUNT_SCHEMA))


def aliases(spark):
    flat = b.policy_table(spark, [r[:7] for r in ALIASES], FLAT_SCHEMA)
    per_vendor = F.lit(None)
    for r in ALIASES:
        items = [F.struct(F.lit(a).cast("decimal(18,2)").alias("amount"), F.lit(c).alias("currency")) for a, c in r[7]]
        listed = F.array(*items) if items else F.array()
        per_vendor = F.when(F.col("vendor_order") == r[0], listed.cast("array<struct<amount:decimal(18,2),currency:string>>")).otherwise(per_vendor)
    return flat.withColumn("amounts", per_vendor)


def foreign_charges(spark, sf):
    """Charges with a foreign amount for one card, told by the number of units bought."""
    line = b.table(spark, sf, "lineitem")
    part = b.table(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("merchant"))
    foreign = F.when(F.col("l_returnflag") == "N", F.col("l_quantity").cast("decimal(18,2)"))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("ref"),
        "merchant",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount_sek"),
        foreign.alias("foreign_amount"),
        F.when(F.col("l_returnflag") == "N", F.lit("EUR")).alias("foreign_currency"),
    )


cte(
    "foreign_charges",
    """
SELECT l_orderkey || '-' || l_linenumber AS ref, upper(p_name) AS merchant, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount_sek,
       CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS DECIMAL(18,2)) END AS foreign_amount,
       CASE WHEN l_returnflag = 'N' THEN 'EUR' END AS foreign_currency
FROM lineitem JOIN part ON l_partkey = p_partkey""",
)

TOKENS_SQL = "list_distinct(list_filter(string_split_regex(upper({0}), '[^A-Z0-9]+'), lambda w: length(w) >= 4 AND NOT regexp_matches(w, '[0-9]') AND w NOT IN ('SMALL','COLD','STOCKHOLM')))"

cte(
    "vendor_tokens",
    f"""
SELECT token, min(vendor_order) AS vendor_order, min(vendor_key) AS vendor_key FROM (
  SELECT DISTINCT vendor_order, vendor_key, unnest({TOKENS_SQL.format('t')}) AS token
  FROM (SELECT vendor_order, vendor_key, unnest(list_append(merchants, name)) AS t FROM vendors))
GROUP BY token HAVING count(DISTINCT vendor_order) = 1""",
    "vendors",
)


@query("a14_distinctive_tokens", with_(
    "vendor_tokens",
    "foreign_charges",
    body="""
SELECT token, vendor_key, (SELECT count(*) FROM foreign_charges c WHERE contains(' ' || c.merchant || ' ', ' ' || t.token || ' ')) AS charges
FROM vendor_tokens t""",
))
def a14(spark, sf):
    """Each vendor's own words, with the number of charges that carry them."""
    tokens = vd.distinctive_tokens(aliases(spark), STOP)
    used = (
        foreign_charges(spark, sf)
        .select(F.explode(F.array_distinct(F.split("merchant", " "))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("charges"))
    )
    return tokens.join(used, "token", "left").select("token", "vendor_key", F.coalesce("charges", F.lit(0)).alias("charges"))


@query(
    "x19_merchant_tokens",
    with_(
        "foreign_charges",
        body="""
SELECT token, pos, count(*) AS n FROM (
  SELECT unnest(t) AS token, CAST(unnest(range(len(t))) AS INTEGER) AS pos FROM (
    SELECT list_filter(string_split(merchant, ' '), lambda w: length(w) >= 4 AND w NOT IN ('SMALL','COLD','STOCKHOLM')) AS t FROM foreign_charges))
GROUP BY token, pos""",
    ),
)
def x19(spark, sf):
    words = vd.exploded_tokens(foreign_charges(spark, sf), "ref", "merchant", STOP)
    return words.groupBy("token", "pos").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j3_resolve_vendor",
    with_(
        "vendors",
        "vendor_amounts",
        "vendor_tokens",
        "foreign_charges",
        body="""
WITH m AS (SELECT DISTINCT merchant FROM foreign_charges),
p AS (SELECT vendor_order, merchant_exact, unnest(merchants) AS pattern FROM vendors),
c AS (
  SELECT merchant, 1 AS tier, 0 AS len, '' AS rank, vendor_order FROM m JOIN p ON merchant_exact AND merchant = pattern
  UNION ALL SELECT merchant, 2, max(length(pattern)), '', vendor_order FROM m JOIN p ON NOT merchant_exact AND contains(merchant, pattern) GROUP BY merchant, vendor_order
  UNION ALL SELECT merchant, 3, 0, '', vendor_order FROM m JOIN vendors ON merchant_regex IS NOT NULL AND regexp_matches(merchant, merchant_regex, 'i')
  UNION ALL SELECT merchant, 4, 0, min(token), vendor_order FROM m JOIN vendor_tokens ON contains(' ' || merchant || ' ', ' ' || token || ' ') GROUP BY merchant, vendor_order),
best AS (SELECT *, min(tier) OVER (PARTITION BY merchant) AS t FROM c),
best2 AS (SELECT *, max(len) OVER (PARTITION BY merchant) AS l FROM best WHERE tier = t),
tied AS (SELECT merchant, tier, rank, vendor_order, row_number() OVER (PARTITION BY merchant ORDER BY rank, vendor_order) AS pos,
                count(*) OVER (PARTITION BY merchant) AS many FROM best2 WHERE len = l),
hit AS (
  SELECT f.ref, f.merchant, f.amount_sek, f.foreign_amount, t.tier, t.many, v.vendor_key, t.pos,
         EXISTS (SELECT 1 FROM vendor_amounts a WHERE a.vendor_order = t.vendor_order AND
            ((a.currency = f.foreign_currency AND abs(a.listed - f.foreign_amount) <= 0.01) OR
             (v.bill_currency = 'SEK' AND a.currency = 'SEK' AND abs(a.listed - f.amount_sek) <= 0.01))) AS listed
  FROM (SELECT DISTINCT ref, merchant, amount_sek, foreign_amount, foreign_currency FROM foreign_charges) f JOIN tied t USING (merchant) JOIN vendors v ON v.vendor_order = t.vendor_order)
SELECT f.merchant, f.amount_sek, f.ref, f.foreign_amount, h.vendor_key, h.tier AS vendor_tier, coalesce(h.many > 1 AND NOT h.any_listed, false) AS ambiguous
FROM (SELECT DISTINCT ref, merchant, amount_sek, foreign_amount FROM foreign_charges) f LEFT JOIN (
  SELECT ref, merchant, amount_sek, foreign_amount, many, tier, bool_or(listed) AS any_listed,
         arg_min(vendor_key, CASE WHEN listed THEN pos ELSE 1000 + pos END) AS vendor_key
  FROM hit GROUP BY ALL) h ON h.ref = f.ref AND h.merchant = f.merchant AND h.amount_sek = f.amount_sek AND h.foreign_amount IS NOT DISTINCT FROM f.foreign_amount""",
    ),
)
def j3(spark, sf):
    rows = foreign_charges(spark, sf).distinct()
    out = vd.resolve_vendor(rows, aliases(spark), STOP)
    return out.select("merchant", "amount_sek", "ref", "foreign_amount", "vendor_key", "vendor_tier", "ambiguous")


@query(
    "j4_canonical_vendor",
    with_(
        "vendors",
        "vendor_amounts",
        "rules",
        "foreign_charges",
        body="""
WITH f AS (SELECT DISTINCT merchant, coalesce(foreign_amount, amount_sek) AS amount, coalesce(foreign_currency, 'SEK') AS currency FROM foreign_charges),
m AS (SELECT DISTINCT merchant FROM f),
p AS (SELECT vendor_order, merchant_exact, unnest(merchants) AS pattern FROM vendors),
c AS (SELECT merchant, vendor_order, max(len) AS len FROM (
  SELECT merchant, vendor_order, length(pattern) AS len FROM m JOIN p ON (merchant_exact AND merchant = pattern) OR (NOT merchant_exact AND contains(merchant, pattern))
  UNION ALL SELECT merchant, vendor_order, length(regexp_extract(merchant, merchant_regex)) FROM m JOIN vendors ON merchant_regex IS NOT NULL AND regexp_matches(merchant, merchant_regex))
  GROUP BY merchant, vendor_order),
tied AS (SELECT * FROM (SELECT *, max(len) OVER (PARTITION BY merchant) AS l FROM c) WHERE len = l),
pick AS (
  SELECT f.merchant, f.amount, f.currency,
         arg_min(v.vendor_key, t.vendor_order + CASE WHEN EXISTS (SELECT 1 FROM vendor_amounts a WHERE a.vendor_order = t.vendor_order AND a.currency = f.currency AND abs(a.listed - f.amount) <= 0.01) THEN 0 ELSE 1000 END) AS vendor_key
  FROM f JOIN tied t USING (merchant) JOIN vendors v ON v.vendor_order = t.vendor_order GROUP BY f.merchant, f.amount, f.currency),
named AS (
  SELECT f.*, k.vendor_key, v.name, (SELECT arg_min(r.name, r.rule_order) FROM (SELECT rule_order, name, unnest(patterns) AS pt FROM rules) r WHERE contains(f.merchant, r.pt)) AS rule_name,
         list_filter(string_split(f.merchant, ' '), lambda w: w NOT IN ('SMALL','COLD','STOCKHOLM')) AS words
  FROM f LEFT JOIN pick k ON k.merchant = f.merchant AND k.amount = f.amount AND k.currency = f.currency LEFT JOIN vendors v ON v.vendor_key = k.vendor_key),
texts AS (SELECT *, array_to_string(list_transform(words, lambda w: upper(w[1]) || lower(w[2:])), ' ') AS clean FROM named)
SELECT merchant, amount, currency,
  CASE WHEN vendor_key LIKE '%\\_other' ESCAPE '\\' THEN clean WHEN vendor_key IS NOT NULL THEN name WHEN rule_name IS NOT NULL THEN rule_name ELSE clean END AS vendor,
  CASE WHEN vendor_key LIKE '%\\_other' ESCAPE '\\' THEN replace(lower(clean), ' ', '-') WHEN vendor_key IS NOT NULL THEN replace(vendor_key, '_', '-')
       WHEN rule_name IS NOT NULL THEN replace(lower(rule_name), ' ', '-') ELSE replace(lower(clean), ' ', '-') END AS vendor_slug
FROM texts""",
    ),
)
def j4(spark, sf):
    rows = foreign_charges(spark, sf).select(
        "merchant",
        F.coalesce("foreign_amount", "amount_sek").alias("amount"),
        F.coalesce("foreign_currency", F.lit("SEK")).alias("currency"),
    ).distinct()
    return vd.canonical_vendor(rows, aliases(spark), b.rules(spark), STOP)


@query(
    "x18_clean_merchants",
    """
SELECT descriptor, array_to_string(list_filter(string_split(upper(p_name), ' '), lambda w: w NOT IN ('SMALL','COLD','STOCKHOLM')), ' ') AS cleaned, count(*) AS n
FROM (SELECT p_name, CASE p_type WHEN 'ECONOMY' THEN 'PADDLE.NET* ' || upper(p_name) || ' STOCKHOLM' WHEN 'PROMO' THEN upper(p_name) || '*N61QQ6964'
       WHEN 'LARGE' THEN upper(p_name) || '.COM ' || upper(p_name) ELSE upper(p_name) || ' 8SNF1BW4CHHL' END AS descriptor FROM part)
GROUP BY ALL""",
)
def x18(spark, sf):
    name = F.upper("p_name")
    descriptor = (
        F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("PADDLE.NET* "), name, F.lit(" STOCKHOLM")))
        .when(F.col("p_type") == "PROMO", F.concat(name, F.lit("*N61QQ6964")))
        .when(F.col("p_type") == "LARGE", F.concat(name, F.lit(".COM "), name))
        .otherwise(F.concat(name, F.lit(" 8SNF1BW4CHHL")))
    )
    rows = b.table(spark, sf, "part").groupBy(descriptor.alias("descriptor")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("cleaned", vd.clean_merchant(F.col("descriptor"), STOP))


@query(
    "x21_match_senders",
    """
WITH h AS (SELECT page_id AS message_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS dom FROM pages),
e AS (SELECT * FROM (VALUES ('com', 'example.com'), ('net', 'example.net'), ('any', 'com'), ('any', 'org'), ('mail', 'post@m.ththth.example.net')) AS t(vendor_key, entry))
SELECT message_id, vendor_key, 'domain' AS how FROM h JOIN e ON NOT contains(entry, '@') AND (dom = entry OR ends_with(dom, '.' || entry)) WHERE 'post@' || dom <> entry GROUP BY ALL
UNION ALL SELECT message_id, vendor_key, 'address' FROM h JOIN e ON 'post@' || dom = entry""",
)
def x21(spark, sf):
    host = F.lower(F.regexp_extract("url", "^https?://([^/:?#]+)", 1))
    pages = b.table(spark, sf, "pages").select(F.col("page_id").alias("message_id"), F.concat(F.lit("Post <post@"), host, F.lit(">")).alias("from"))
    entries = b.policy_table(
        spark,
        [("com", "example.com"), ("net", "example.net"), ("any", "com"), ("any", "org"), ("mail", "post@m.ththth.example.net")],
        "vendor_key string, entry string",
    )
    return vd.match_senders(vd.with_address(pages, "from", "from"), entries)


@query(
    "x25_known_ids",
    """
SELECT CAST(event_id AS VARCHAR) AS ref, CAST(0 AS INTEGER) AS pos, lpad(to_hex(event_id), 16, '0') AS message_id FROM events WHERE event_type <> 'error'
UNION ALL SELECT CAST(event_id AS VARCHAR), 1, lpad(to_hex(user_id), 16, '0') FROM events WHERE event_type = 'purchase'""".replace(
        "to_hex(event_id)", "lower(to_hex(event_id))"
    ).replace("to_hex(user_id)", "lower(to_hex(user_id))"),
)
def x25(spark, sf):
    first = F.lpad(F.lower(F.hex("event_id")), 16, "0")
    second = F.lpad(F.lower(F.hex("user_id")), 16, "0")
    note = (
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("see Gmail "), first, F.lit("; also Gmail\t"), second))
        .when(F.col("event_type") == "error", F.concat(F.lit("Gmail "), first, F.lit("0")))
        .otherwise(F.concat(F.lit("confirm Gmail "), first, F.lit(".")))
    )
    rows = b.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("ref"), note.alias("note"))
    return vd.known_ids(rows, "ref", "note")
