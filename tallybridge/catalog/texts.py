"""Queries over cells, pages and documents."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.money import MONEY, format_money, parse_money
from ..functions.scale import spread
from ..operators import ledger as lg, texts as tx
from . import bindings as b, query
from .bindings import cte, with_

SV = "replace(replace(replace(format('{{:,.2f}}', CAST({0} AS DOUBLE)), ',', '~'), '.', ','), '~', '{1}')"


def sv(col: str, sep: str = " ") -> str:
    return SV.format(col, sep)


# --------------------------------------------------------------------------- money and dates

def _money_cells(spark, sf):
    """Prices printed the way each dialect prints them; some cells are no money at all."""
    orders = b.table(spark, sf, "orders")
    price = F.col("o_totalprice").cast(MONEY)
    junk = F.col("o_orderpriority") == "5-LOW"
    spaced = format_money(price, "")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(junk, F.concat(F.lit("n/a "), "o_orderpriority")).otherwise(F.concat(F.lit("−"), F.translate(spaced, " ", " "))).alias("statement"),
        F.when(junk, "1e5").otherwise(F.concat(F.lit("ca "), F.format_number(price, 2), F.lit(" SEK"))).alias("archive"),
        F.when(junk, price.cast("string")).otherwise(F.concat(F.lit("+"), F.translate(spaced, " ", "."))).alias("swedish"),
        F.when(junk, "12,34,x").otherwise(F.translate(F.format_number(price, 2), ",.", ".,")).alias("any"),
        F.when(junk, "").otherwise(F.concat(F.lit("-"), F.translate(spaced, " ", ""))).alias("export"),
    )


JUNK = "o_orderpriority = '5-LOW'"
P = "CAST(o_totalprice AS DECIMAL(18,2))"


def _money_query(dialect: str, value: str, rejected: bool = True):
    bad = f"UNION ALL SELECT o_orderkey, NULL, 'rejected' FROM orders WHERE {JUNK}" if rejected else f"UNION ALL SELECT o_orderkey, CAST(0 AS DECIMAL(18,2)), 'read' FROM orders WHERE {JUNK}"

    @query(
        f"x1_money_{dialect}",
        f"SELECT o_orderkey AS id, CAST({value} AS DECIMAL(18,2)) AS value, 'read' AS verdict FROM orders WHERE NOT ({JUNK}) {bad}",
    )
    def run(spark, sf):
        good, quarantine = tx.normalise_money(_money_cells(spark, sf).select("id", F.col(dialect).alias("value")), "value", dialect)
        return good.withColumn("verdict", F.lit("read")).unionByName(
            quarantine.select("id", F.lit(None).cast(MONEY).alias("value"), F.lit("rejected").alias("verdict"))
        )

    return run


_money_query("statement", f"-{P}")
_money_query("archive", P)
_money_query("swedish", P)
_money_query("any", P)
_money_query("export", f"-{P}", rejected=False)


@query("x2_format_money", f"SELECT o_orderkey AS id, {sv('o_totalprice')} || ' SEK' AS text, {P} AS back FROM orders")
def x2(spark, sf):
    orders = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast(MONEY).alias("amount"))
    rows = tx.format_amounts(orders, "amount", "text")
    return rows.select("id", "text", parse_money(F.col("text"), "archive").alias("back"))


@query(
    "x3_normalise_dates",
    """
SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'rejected' ELSE 'read' END AS verdict FROM orders""",
)
def x3(spark, sf):
    orders = b.table(spark, sf, "orders")
    d = F.col("o_orderdate").cast("date")
    p = F.col("o_orderpriority")
    text = (
        F.when(p == "1-URGENT", F.concat(d.cast("string"), F.lit("T10:11:12")))
        .when(p == "2-HIGH", F.date_format(d, "dd-MM-yyyy"))
        .when(p == "3-MEDIUM", F.date_format(d, "d.M.yyyy"))
        .when(p == "4-NOT SPECIFIED", F.date_format(d, "MM/dd/yyyy"))
        .otherwise(F.concat(F.lit("32-13-"), F.date_format(d, "yyyy")))
    )
    good, quarantine = tx.normalise_dates(orders.select(F.col("o_orderkey").alias("id"), text.alias("day")), "day")
    return good.withColumn("verdict", F.lit("read")).unionByName(
        quarantine.select("id", F.lit(None).cast("date").alias("day"), F.lit("rejected").alias("verdict"))
    )


@query(
    "x4_with_months",
    """
SELECT day, strftime(day, '%Y-%m') AS month, last_day(day) AS month_last_day, strftime(day + INTERVAL 1 MONTH, '%Y-%m') AS month_shifted,
       CASE WHEN last_day(day) = day THEN strftime(day, '%Y-%m') ELSE strftime(day - INTERVAL 1 MONTH, '%Y-%m') END AS last_full_month, count(*) AS n
FROM (SELECT CAST(l_shipdate AS DATE) AS day FROM lineitem) GROUP BY day""",
)
def x4(spark, sf):
    days = b.table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return tx.with_months(days, "day")


# --------------------------------------------------------------------------- text

@query(
    "x5_clean_text",
    r"""
SELECT doc_id, length(t) AS chars, md5(t) AS hash, false AS truncated FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(
     text || chr(13) || chr(10) || 'a' || chr(160) || '– b ' || chr(9) || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || 'c' || chr(8239) || 'd  ', chr(13) || chr(10), chr(10)), chr(160), ' '), chr(8239), ' '),
     '[ \t]*[–—―][ \t]*', ' - ', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS t FROM documents)""",
)
def x5(spark, sf):
    tail = "\r\na – b \t\n\n\n\n\nc d  "
    docs = spread(b.table(spark, sf, "documents")).select("doc_id", F.concat("text", F.lit(tail)).alias("text"))
    return tx.clean_texts(docs, "text").select(
        "doc_id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("hash"), "truncated"
    )


@query(
    "x6_with_stem",
    """
SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate::DATE || '-' || replace(p_name, ' ', '-') || '-' || CAST(floor(l_extendedprice) AS BIGINT) || '-' ||
       lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS stem
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
)
def x6(spark, sf):
    line = b.table(spark, sf, "lineitem")
    orders = b.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    part = b.table(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("vendor"))
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.withColumn("amount", F.col("l_extendedprice").cast(MONEY))
    return tx.with_stem(rows, "date", "vendor", "amount").select("l_orderkey", "l_linenumber", "l_partkey", "stem")


# Whole documents without a digit of their own, between facts that are known: what is found, and where,
# follows from how a text was put together.
BODY_SQL = "translate(text, '0123456789', 'abcdefghij')"


def _digitless(spark, sf):
    d = spread(b.table(spark, sf, "documents"))
    return d.select("doc_id", "n_chars", F.translate("text", "0123456789", "abcdefghij").alias("body"))


NO_MONEY = " No. 45 den 2026-01-02 A-12.50 0,00 kr 007.50\n"


@query(
    "x7_money_mentions",
    rf"""
WITH d AS (
  SELECT doc_id, 'Total: ' AS h1, format('{{:,.2f}}', n_chars + 0.5) AS m1, CAST(n_chars + 0.5 AS DECIMAL(18,2)) AS v1,
    'Summa ' AS h2, {SV.format("n_chars + 0.25", " ")} AS m2, CAST(n_chars + 0.25 AS DECIMAL(18,2)) AS v2, 'Betalt kr ' AS h3, CAST(doc_id % 900 + 1 AS VARCHAR) AS m3,
    'Ref #' || doc_id || {b.literal(NO_MONEY)} || regexp_replace({BODY_SQL}, '[\x{{034f}}\x{{200b}}\x{{200c}}\x{{200d}}\x{{00ad}}\x{{feff}}]', '', 'g') AS body, (n_chars % 77 + 1) || '.25' AS m4 FROM documents),
t AS (SELECT *, h1 || m1 || ' USD' || chr(10) AS s1, h2 || m2 || ' kr' || chr(10) AS s2, h3 || m3 || ' till DKK-konto' || chr(10) AS s3 FROM d),
w AS (SELECT *, s1 || s2 || s3 || body || chr(10) || '€' || m4 || ' and ' || m4 || ' EUR' AS t FROM t),
m AS (
  SELECT doc_id, t, 7 AS pos, 7 AS start, length(m1) + 4 AS whole, v1 AS value, 'USD' AS currency FROM w
  UNION ALL SELECT doc_id, t, length(s1) + 6, length(s1) + 6, length(m2) + 3, v2, 'SEK' FROM w
  UNION ALL SELECT doc_id, t, length(s1 || s2) + 10, length(s1 || s2) + 7, length(m3) + 3, CAST(m3 AS DECIMAL(18,2)), 'DKK' FROM w
  UNION ALL SELECT doc_id, t, length(s1 || s2 || s3 || body) + 2, length(s1 || s2 || s3 || body) + 1, length(m4) + 1, CAST(m4 AS DECIMAL(18,2)), 'EUR' FROM w)
SELECT doc_id, value, currency, CAST(pos AS INTEGER) AS pos,
  trim(regexp_replace(replace(replace(substr(t, greatest(start - 40, 0) + 1, least(start, 40) + whole + 40), chr(160), ' '), chr(8239), ' '), '[ \t\n\f\r\v]+', ' ', 'g')) AS context FROM m""",
)
def x7(spark, sf):
    """Four known sums round each whole document; natural texts are held against a plain scan in the tests."""
    n, key = F.col("n_chars"), F.col("doc_id")
    again = F.concat((n % 77 + 1).cast("string"), F.lit(".25"))
    text = F.concat(
        F.lit("Total: "), F.format_number(n + F.lit(0.5), 2), F.lit(" USD\nSumma "), F.translate(F.format_number(n + F.lit(0.25), 2), ",.", " ,"),
        F.lit(" kr\nBetalt kr "), (key % 900 + 1).cast("string"), F.lit(" till DKK-konto\nRef #"), key.cast("string"), F.lit(NO_MONEY), F.col("body"),
        F.lit("\n€"), again, F.lit(" and "), again, F.lit(" EUR"),
    )
    return tx.money_mentions(_digitless(spark, sf).select("doc_id", text.alias("text")), "doc_id", "text")


@query(
    "x8_foreign_amount",
    """
SELECT doc_id AS id, CASE lang WHEN 'es' THEN NULL ELSE CAST(n_chars AS DECIMAL(18,2)) END AS foreign_amount,
       CASE lang WHEN 'en' THEN 'USD' WHEN 'de' THEN 'EUR' WHEN 'fr' THEN 'GBP' END AS foreign_currency FROM documents""",
)
def x8(spark, sf):
    n, lang = F.col("n_chars"), F.col("lang")
    ext = (
        F.when(lang == "en", F.concat(F.lit("Foreign Spend Amount: "), F.format_number(n, 2), F.lit(" UNITED STATES DOLLAR Commission Amount: 1,00")))
        .when(lang == "de", F.concat(F.lit("paid "), n.cast("string"), F.lit(",00 EUR exact")))
        .when(lang == "fr", F.concat(F.lit("Foreign Spend Amount: "), F.translate(F.format_number(n, 2), ",.", ".,"), F.lit("  POUND STERLING")))
        .otherwise(F.concat(F.lit("Foreign Spend Amount: "), n.cast("string"), F.lit(" ELBONIAN GRUBNICK Commission")))
    )
    rows = b.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), ext.alias("ext"))
    return tx.with_foreign_amount(rows, "ext").select("id", "foreign_amount", "foreign_currency")




# Markup and, character for character, what it shows: names with and without semicolon, old names that
# begin longer words, numbers, numbers of Windows bytes, and what is no entity.
SHOWN = [
    ("K&ouml;p &aring;r &#8364;5", "K\u00f6p \u00e5r \u20ac5"), ("it&apos;s", "it's"), ("a&nbsp b", "a b"), ("&#150;&#x80;&#x9F;", "\u2013\u20ac\u0178"),
    ("&copy2026 &notin; &notit; &Notit;", "\u00a92026 \u2209 \u00acit; &Notit;"), ("&amp;lt; &ampamp; &AMP", "&lt; &amp; &"),
    ("&#xD800;&#0;&#99999999;|&#1;&#xFFFE;|", "\ufffd\ufffd\ufffd||"), ("&acE;&NotEqualTilde;", "\u223e\u0333\u2242\u0338"), ("R&D & S&;&#;&#x;", "R&D & S&;&#;&#x;"),
    ("&hellip;&#0038;&#X41&#65x", "\u2026&AAx"), ("1&frac12 &frac123;", "1\u00bd \u00bd3;"), ("<dd>x</dd><main>y</main>", "\nx\ny\n"), ("a&#8195;&#11;&ensp;b", "a b"),
]


def _html_sql() -> str:
    # The driver's pages hold these four names, all with a semicolon, and ampersands that begin none.
    entities = [("middot", 183), ("copy", 169), ("quot", 34), ("amp", 38)]
    t = r"regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for n in "script style head noscript template title svg".split():
        t = rf"regexp_replace({t}, '(?is)<{n}\b[^>]*>.*?</{n}\s*>', '', 'g')"
    blocks = "address article aside blockquote br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section summary table tbody tfoot thead tr ul"
    t = rf"regexp_replace({t}, '(?i)</?(?:{blocks.replace(' ', '|')})\b[^>]*>', chr(10), 'g')"
    t = rf"regexp_replace({t}, '(?i)</?(?:td|th)\b[^>]*>', '  ', 'g')"
    t = rf"regexp_replace({t}, '(?s)<[^>]*>', '', 'g')"
    for name, code in entities:
        t = f"replace({t}, '&{name};', chr({code}))"
    t = "concat(" + ", ".join([*(f"{b.literal(shown)}, ' '" for _, shown in SHOWN), t]) + ")"
    t = rf"regexp_replace({t}, '[ \t\r\f\v' || chr(160) || chr(8195) || chr(8194) || ']+', ' ', 'g')"
    t = rf"regexp_replace({t}, ' ?\n[ \n]*', chr(10), 'g')"
    return rf"regexp_replace({t}, '^[ \n]+|[ \n]+$', '', 'g')"


@query("x9_html_to_text", f"SELECT page_id, length(t) AS chars, md5(t) AS hash FROM (SELECT page_id, {_html_sql()} AS t FROM pages)")
def x9(spark, sf):
    """Pages headed by markup whose text is known character by character."""
    head = "".join(f"{markup} " for markup, _ in SHOWN)
    pages = spread(b.table(spark, sf, "pages")).select("page_id", F.concat(F.lit(head), "html").alias("html"))
    return tx.html_to_text(pages).select(
        "page_id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("hash")
    )


# --------------------------------------------------------------------------- proofs made from documents

def proofs(spark, sf):
    """Documents headed by the facts a receipt prints, in four layouts by language."""
    d = spread(b.table(spark, sf, "documents"))
    lang, n, key = F.col("lang"), F.col("n_chars"), F.col("doc_id").cast("string")
    charge = F.date_add(F.lit("2026-05-01").cast("date"), F.pmod(n, F.lit(28)).cast("int"))
    amount = (n + F.lit(0.5)).cast(MONEY)
    vat = F.concat(F.lit("SE"), F.lpad(key, 12, "0"))
    rows = d.select("doc_id", "lang", "text", key.alias("key"), charge.alias("charge_date"), amount.alias("amount"), vat.alias("vat"))
    money = F.col("amount")
    head = (
        F.when(
            lang == "en",
            F.concat(
                F.lit("Receipt from Acme Tools\nInvoice number: INV-"), "key", F.lit("\nOrder date: "),
                F.date_sub("charge_date", 3).cast("string"), F.lit("\nTotal: "), F.format_number(money, 2),
                F.lit(" USD\nVAT Reg # : "), "vat", F.lit("\nVAT (25%): 1.25\nBilled to: Alfa AB\n"),
            ),
        )
        .when(
            lang == "de",
            F.concat(
                F.lit("Date: Sat, Jan 24, 2026\nFrom: shop\nDate paid "), F.date_format(F.date_add("charge_date", 2), "MMMM d, yyyy"),
                F.lit("\nReceipt #R"), "key", F.lit(".\nSumma "), F.translate(F.format_number(money, 2), ",.", " ,"),
                F.lit(" kr\nMoms 25 % 2,50\nMomsreg.nummer\n"), "vat", F.lit("\nKund Beta AB\n"),
            ),
        )
        .when(
            lang == "fr",
            F.concat(
                F.lit("Beräknas levereras 2026-05-02\nFakturadatum\n"), F.date_format("charge_date", "yyyy/MM/dd"),
                F.lit("\nKvittonr "), "key", F.lit("A\nVAT ID: SE999999999901\nVAT id "), "vat",
                F.lit("\nVAT converted to SEK is: 0.75\nSold to Alfa AB\n"),
            ),
        )
        .otherwise(F.concat(F.lit("Paid "), F.date_format(F.date_sub("charge_date", 20), "d MMMM yyyy"), F.lit(" thanks\nno total\n")))
    )
    return rows.select("doc_id", "lang", "charge_date", "amount", F.concat(head, F.col("text")).alias("text"))


cte(
    "proofs",
    """
SELECT doc_id, lang, n_chars, text, CAST(DATE '2026-05-01' + CAST(n_chars % 28 AS INTEGER) AS DATE) AS charge_date, CAST(n_chars + 0.5 AS DECIMAL(18,2)) AS amount,
       'SE' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS vat FROM documents""",
)


@query(
    "x10_text_dates",
    rf"""
WITH d AS (SELECT *, CAST(DATE '2026-01-01' + CAST(n_chars % 365 AS INTEGER) AS DATE) AS day, {BODY_SQL} AS body FROM documents),
t AS (
  SELECT doc_id, day, 'Order date: ' || day || chr(10) AS s1, 'Paid ' || strftime(day, '%-d %B %Y') || ' thanks' || chr(10) AS s2, 'Due ' || strftime(day, '%d/%m/%Y') || chr(10) AS s3,
    'Ship ' || strftime(day, '%b %-d, %Y') || chr(10) || 'Not 2026-13-45' || chr(10) || body || chr(10) AS s4 FROM d),
m AS (
  SELECT doc_id, 12 AS pos, CAST(day AS VARCHAR) AS readings FROM t
  UNION ALL SELECT doc_id, length(s1) + 5, CAST(day AS VARCHAR) FROM t
  UNION ALL SELECT doc_id, length(s1 || s2) + 4, day || CASE WHEN day(day) <= 12 AND day(day) <> month(day) THEN ',' || make_date(2026, day(day), month(day)) ELSE '' END FROM t
  UNION ALL SELECT doc_id, length(s1 || s2 || s3) + 5, CAST(day AS VARCHAR) FROM t
  UNION ALL SELECT doc_id, length(s1 || s2 || s3 || s4), CAST(day AS VARCHAR) FROM t)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, readings FROM m""",
)
def x10(spark, sf):
    """Five known dates round each whole document; natural texts are held against a plain scan in the tests."""
    day = F.date_add(F.lit("2026-01-01").cast("date"), F.pmod(F.col("n_chars"), F.lit(365)).cast("int"))
    rows = _digitless(spark, sf).withColumn("day", day)
    text = F.concat(
        F.lit("Order date: "), F.col("day").cast("string"), F.lit("\nPaid "), F.date_format("day", "d MMMM yyyy"), F.lit(" thanks\nDue "), F.date_format("day", "dd/MM/yyyy"),
        F.lit("\nShip "), F.date_format("day", "MMM d, yyyy"), F.lit("\nNot 2026-13-45\n"), F.col("body"), F.lit("\n"), F.col("day").cast("string"),
    )
    found = tx.text_dates(rows.select("doc_id", text.alias("text")), "doc_id", "text")
    return found.withColumn("readings", F.array_join(F.col("readings").cast("array<string>"), ","))


@query(
    "x11_document_date",
    with_("proofs", body="""
SELECT doc_id, CAST(CASE lang WHEN 'en' THEN charge_date - 3 WHEN 'de' THEN charge_date + 2 WHEN 'fr' THEN charge_date ELSE charge_date - 20 END AS DATE) AS document_date FROM proofs"""),
)
def x11(spark, sf):
    return tx.document_date(proofs(spark, sf), "text", "charge_date").select("doc_id", "document_date")


@query(
    "x12_invoice_number",
    with_("proofs", body="SELECT doc_id, CASE lang WHEN 'en' THEN 'INV-' || doc_id WHEN 'de' THEN 'R' || doc_id WHEN 'fr' THEN doc_id || 'A' END AS invoice_number FROM proofs"),
)
def x12(spark, sf):
    return proofs(spark, sf).select("doc_id", tx.invoice_number(F.col("text")).alias("invoice_number"))


OWN_IDS = ["SE999999999901"]
COMPANIES = {"Alfa AB": "alfa", "Beta AB": "beta"}


@query(
    "x13_seller_vat_id",
    with_("proofs", body="SELECT doc_id, CASE WHEN lang <> 'es' THEN vat END AS vat_id FROM proofs"),
)
def x13(spark, sf):
    return proofs(spark, sf).select("doc_id", tx.seller_vat_id(F.col("text"), OWN_IDS, ["gamma media"]).alias("vat_id"))


@query(
    "x14_vat_amount",
    with_("proofs", body="""
SELECT doc_id, CAST(CASE WHEN lang = 'en' AND amount > 1.25 THEN 1.25 WHEN lang = 'de' AND amount > 2.5 THEN 2.5 WHEN lang = 'fr' AND amount > 0.75 THEN 0.75 END AS DECIMAL(18,2)) AS vat_sek FROM proofs"""),
)
def x14(spark, sf):
    return proofs(spark, sf).select("doc_id", tx.vat_amount(F.col("text"), F.lit("SEK"), F.col("amount")).alias("vat_sek"))


@query(
    "x15_buyer_mismatch",
    with_("proofs", body="SELECT doc_id, CASE lang WHEN 'en' THEN 'alfa' WHEN 'de' THEN 'beta' WHEN 'fr' THEN 'alfa' END AS buyer, lang = 'de' AS mismatch FROM proofs"),
)
def x15(spark, sf):
    rows = proofs(spark, sf).select("doc_id", tx.buyer_entity(F.col("text"), COMPANIES).alias("buyer"))
    return rows.withColumn("mismatch", F.coalesce(F.col("buyer") != "alfa", F.lit(False)))


@query(
    "x16_amount_in_text",
    with_("proofs", body="SELECT doc_id, lang IN ('en','de') AS printed FROM proofs"),
)
def x16(spark, sf):
    return proofs(spark, sf).select("doc_id", tx.amount_in_text(F.col("text"), F.col("amount")).alias("printed"))


@query(
    "x17_vendor_in_text",
    """
SELECT doc_id, contains(c, 'acme') AS acme, contains(c, 'retion') AS longer FROM (
  SELECT doc_id, regexp_replace(lower(strip_accents(CASE lang WHEN 'en' THEN 'Receipt from A-C-M-E Tools ' ELSE '' END || text)), '[^a-z0-9]+', '', 'g') AS c FROM documents)""",
)
def x17(spark, sf):
    head = F.when(F.col("lang") == "en", "Receipt from A-C-M-E Tools ").otherwise("")
    rows = spread(b.table(spark, sf, "documents")).select("doc_id", F.concat(head, "text").alias("text"))
    return rows.select(
        "doc_id",
        tx.vendor_in_text(F.col("text"), F.lit("Acme Cloud"), F.lit(None).cast("string")).alias("acme"),
        tx.vendor_in_text(F.col("text"), F.lit("AB Rétion"), F.lit("")).alias("longer"),
    )


@query(
    "x20_message_links",
    r"""
SELECT page_id, CAST(pos AS INTEGER) AS pos, url FROM (
  SELECT page_id, unnest(u) AS url, unnest(range(len(u))) AS pos FROM (
    SELECT page_id, list_filter(list_distinct_ordered, lambda x: NOT regexp_matches(x, '(?i)unsubscribe|w3\.org|mailto:|\.(png|gif|jpe?g|css)(\?|$)')) AS u FROM (
      SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (
        SELECT page_id, regexp_extract_all(url || ' see https://x.example/logo.png and ' || url || ' or https://x.example/unsubscribe?a=1 https://y.example/r/' || page_id || ' ' || html, 'https?://[^\s"''<>)]+') AS l FROM pages))))""",
)
def x20(spark, sf):
    text = F.concat(
        "url", F.lit(" see https://x.example/logo.png and "), "url", F.lit(" or https://x.example/unsubscribe?a=1 https://y.example/r/"),
        F.col("page_id").cast("string"), F.lit(" "), "html",
    )
    return tx.message_links(b.table(spark, sf, "pages").select("page_id", text.alias("text")), "page_id", "text")


@query(
    "x22_subject_key",
    "SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS subject_key FROM conversations",
)
def x22(spark, sf):
    marks = ["fwd:", "fw:", "vb:", "vidarebefordrat", "re:", "sv:"]
    subject = F.concat(F.when(F.col("role") == "user", "Re: Fwd:  SV:").when(F.col("role") == "assistant", "VB: ").otherwise(""), F.col("text"))
    rows = b.table(spark, sf, "conversations").select("conv_id", "turn", subject.alias("subject"))
    return tx.with_subject_key(rows, marks).select("conv_id", "turn", "subject_key")


@query(
    "u1_union_mentions",
    """
WITH p AS (SELECT user_id AS id, CAST(value AS DECIMAL(18,2)) AS value, event_type AS currency, 0 AS part, event_id AS pos FROM events WHERE event_type IN ('click','view')
 UNION ALL SELECT user_id, CAST(value AS DECIMAL(18,2)), CASE event_type WHEN 'purchase' THEN 'click' ELSE event_type END, 1, event_id FROM events WHERE event_type NOT IN ('click','view'))
SELECT id, value, currency, part, pos FROM (SELECT *, row_number() OVER (PARTITION BY id, value, currency ORDER BY part, pos) AS n FROM p) WHERE n = 1""",
)
def u1(spark, sf):
    e = b.table(spark, sf, "events")
    plain = F.col("event_type").isin("click", "view")
    cols = [F.col("user_id").alias("id"), F.col("value").cast(MONEY).alias("value")]
    pos = F.col("event_id").alias("pos")
    first = e.filter(plain).select(*cols, F.col("event_type").alias("currency"), pos)
    renamed = F.when(F.col("event_type") == "purchase", "click").otherwise(F.col("event_type"))
    then = e.filter(~plain).select(*cols, renamed.alias("currency"), pos)
    return lg.union_mentions(first, then)
