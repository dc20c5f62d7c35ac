"""Queries over the evidence archive."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..operators import archive as ar
from ..session import settle
from . import bindings as b, query
from .bindings import cte, with_
from .texts import proofs

COMPANIES = {"Alfa AB": "alfa", "Beta AB": "beta"}


def records(spark, sf):
    """Archive records: one per document, charge facts derived from its length, labels as states."""
    return record_rows(b.table(spark, sf, "documents"), b.table(spark, sf, "labels"))


def record_rows(documents, labels):
    n, key = F.col("n_chars"), F.col("doc_id").cast("string")
    rows = documents.join(labels, "doc_id", "left")
    date = F.date_add(F.lit("2026-01-01").cast("date"), F.pmod(n, F.lit(200)).cast("int"))
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    return rows.select(
        "doc_id",
        F.concat(F.lit("rec-"), F.lpad(key, 9, "0")).alias("id"),
        F.when(F.col("lang").isin("en", "de"), "alfa").otherwise("beta").alias("entity"),
        date.alias("date"),
        n.cast(MONEY).alias("amount_sek"),
        n.cast(MONEY).alias("amount"),
        F.concat(F.lit("SHOP "), F.upper("source")).alias("merchant"),
        F.when(F.col("quality").isNull(), "").otherwise(F.concat(F.lit("E"), key)).alias("expense_id"),
        F.when(F.col("lang") == "de", F.concat(F.lit("C"), n.cast("string"))).otherwise("").alias("card_ref"),
        F.when(good, "Acme").otherwise("").alias("vendor"),
        F.when(F.col("lang") == "fr", "note").otherwise("").alias("note"),
        F.when(F.col("lang") == "es", "").otherwise(F.concat(F.lit("INV-"), F.floor(n / 40).cast("string"))).alias("invoice_number"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("A "), key)).otherwise("").alias("voucher"),
        F.when(F.col("toxic") == 1, "bokfort 2026-09-01").when(good, "ej bokfort").otherwise("").alias("booking_status"),
        F.when(F.col("lang") == "en", "mail").when(F.col("lang") == "de", "portal").when(F.col("lang") == "fr", "export").otherwise("manual").alias("source_kind"),
        F.when(F.col("lang").isin("en", "de"), F.concat(F.lit("m"), key)).otherwise("").alias("source_ref"),
        F.concat(F.lit("from "), "source").alias("source_from"),
        F.when(good, "attached 2026-08-24").when(F.col("quality") == 0, "exported (QUEUED)").otherwise("").alias("status"),
        F.when(F.col("toxic") == 1, "credit-note").otherwise("receipt").alias("kind"),
        F.when(F.col("lang") == "en", "expense").when(F.col("lang") == "de", "card-0115").otherwise("pocket").alias("lane"),
        F.when(F.col("lang") == "es", "none").when(F.col("lang") == "fr", "ocr").otherwise("text").alias("text_method"),
        F.sha2("text", 256).alias("sha"),
        "text",
        "lang",
        n.alias("n_chars"),
    )


cte(
    "records",
    """
SELECT d.doc_id, 'rec-' || lpad(CAST(d.doc_id AS VARCHAR), 9, '0') AS id, CASE WHEN lang IN ('en','de') THEN 'alfa' ELSE 'beta' END AS entity,
  CAST(DATE '2026-01-01' + CAST(n_chars % 200 AS INTEGER) AS DATE) AS date, CAST(n_chars AS DECIMAL(18,2)) AS amount_sek, CAST(n_chars AS DECIMAL(18,2)) AS amount,
  'SHOP ' || upper(source) AS merchant, CASE WHEN quality IS NULL THEN '' ELSE 'E' || d.doc_id END AS expense_id,
  CASE lang WHEN 'de' THEN 'C' || n_chars ELSE '' END AS card_ref, CASE WHEN quality = 1 THEN 'Acme' ELSE '' END AS vendor,
  CASE lang WHEN 'fr' THEN 'note' ELSE '' END AS note, CASE lang WHEN 'es' THEN '' ELSE 'INV-' || (n_chars // 40) END AS invoice_number,
  CASE WHEN toxic = 1 THEN 'A ' || d.doc_id ELSE '' END AS voucher, CASE WHEN toxic = 1 THEN 'bokfort 2026-09-01' WHEN quality = 1 THEN 'ej bokfort' ELSE '' END AS booking_status,
  CASE lang WHEN 'en' THEN 'mail' WHEN 'de' THEN 'portal' WHEN 'fr' THEN 'export' ELSE 'manual' END AS source_kind,
  CASE WHEN lang IN ('en','de') THEN 'm' || d.doc_id ELSE '' END AS source_ref, 'from ' || source AS source_from,
  CASE WHEN quality = 1 THEN 'attached 2026-08-24' WHEN quality = 0 THEN 'exported (QUEUED)' ELSE '' END AS status,
  CASE WHEN toxic = 1 THEN 'credit-note' ELSE 'receipt' END AS kind, CASE lang WHEN 'en' THEN 'expense' WHEN 'de' THEN 'card-0115' ELSE 'pocket' END AS lane,
  CASE lang WHEN 'es' THEN 'none' WHEN 'fr' THEN 'ocr' ELSE 'text' END AS text_method, sha256(text) AS sha, text, lang, n_chars
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)


def _existing(spark, sf):
    """The archive before a batch: the first record of each file among English and French documents."""
    rows = records(spark, sf).filter(F.col("lang").isin("en", "fr")).drop("text")
    first = rows.groupBy("sha").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "sha"]), "doc_id").alias("_r"))
    return first.select("sha", "_r.*").withColumn("stem", F.col("id")).withColumn("number", F.lit(1).cast("bigint"))


def _archived(spark, sf):
    """The archive before a batch as records and the files they own, read once."""
    rows = settle(_existing(spark, sf))
    return rows, rows.select("sha", "id")


cte(
    "existing",
    "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY doc_id) AS n FROM records WHERE lang IN ('en','fr')) WHERE n = 1",
    "records",
)


def _incoming(spark, sf):
    """A batch: every document again, later by 30 in its booking facts; ids as the labels give them."""
    return incoming_rows(b.table(spark, sf, "documents"), b.table(spark, sf, "labels"))


def incoming_rows(documents, labels):
    rows = record_rows(documents, labels).drop("text")
    return rows.withColumn("position", F.col("doc_id")).withColumn("stem", F.concat_ws("-", F.col("date").cast("string"), "entity"))


@query("s5_file_inventory", """
SELECT doc_id || CASE WHEN lang = 'en' THEN 'a.pdf' WHEN lang = 'de' THEN '.png' ELSE '_mail.html' END AS name, CAST(doc_id AS VARCHAR) AS number,
       CASE WHEN lang = 'en' THEN 'a' ELSE '' END AS suffix, CASE lang WHEN 'en' THEN '.pdf' WHEN 'de' THEN '.png' ELSE '.html' END AS ext, sha256(text) AS sha, CAST(strlen(text) AS BIGINT) AS bytes FROM documents""")
def s5(spark, sf):
    return ar.file_inventory(_stored(spark, sf)).drop("path")


def _stored(spark, sf):
    """Stored files with names and bytes, as a directory scan would list them."""
    d = b.table(spark, sf, "documents")
    name = F.when(F.col("lang") == "en", "a.pdf").when(F.col("lang") == "de", ".png").otherwise("_mail.html")
    path = F.concat(F.lit("dir/sub/"), F.col("doc_id").cast("string"), name)
    return d.select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))


@query("j16_same_file_groups", """
WITH s AS (SELECT DISTINCT sha256(text) AS sha, CAST(doc_id AS VARCHAR) AS number FROM documents)
SELECT sha, number, numbers FROM (SELECT *, count(*) OVER (PARTITION BY sha) AS numbers FROM s) WHERE numbers > 1""")
def j16(spark, sf):
    return ar.same_file_groups(ar.file_inventory(_stored(spark, sf)).select("sha", "number"))


@query("p7_keep_attachments", """
SELECT page_id, CASE WHEN regexp_matches(lower(name), 'terms|condition|agreement') OR regexp_matches(lower(name), '(^|[^a-z])tos([^a-z]|$)') THEN 'terms or conditions file'
   WHEN (starts_with(mime, 'image/') OR regexp_matches(name, '\\.(png|jpg)$')) AND bytes < 5000 THEN 'junk image'
   WHEN NOT (starts_with(mime, 'image/') OR regexp_matches(name, '\\.(png|jpg)$')) AND mime <> 'application/pdf' AND NOT ends_with(name, '.pdf') THEN 'neither pdf nor image' ELSE '' END AS reason
FROM (SELECT page_id, CASE page_id // 50 WHEN 0 THEN 'tos.pdf' WHEN 1 THEN 'photos-' || page_id || '.pdf' WHEN 2 THEN 'scan.png' WHEN 3 THEN 'General-Terms.pdf' ELSE url END AS name,
   CASE WHEN contains(url, '.net') THEN 'application/pdf' WHEN contains(url, '.org') THEN 'image/png' ELSE '' END AS mime, length(html) AS bytes FROM pages)""")
def p7(spark, sf):
    p = b.table(spark, sf, "pages")
    block = F.floor(F.col("page_id") / 50)
    name = (
        F.when(block == 0, "tos.pdf").when(block == 1, F.concat(F.lit("photos-"), F.col("page_id").cast("string"), F.lit(".pdf")))
        .when(block == 2, "scan.png").when(block == 3, "General-Terms.pdf").otherwise(F.col("url"))
    )
    mime = F.when(F.col("url").contains(".net"), "application/pdf").when(F.col("url").contains(".org"), "image/png").otherwise("")
    rows = p.select("page_id", name.alias("name"), mime.alias("mime"), F.length("html").alias("bytes"))
    return ar.keep_attachments(rows, "name", "mime", "bytes").select("page_id", "reason")


@query("j8_missing_evidence", with_("classified", body="""
SELECT ref, merchant, amount FROM classified WHERE tag = 'business' AND ref NOT IN (SELECT o_orderkey || '-1' FROM orders WHERE o_orderstatus = 'F')"""))
def j8(spark, sf):
    files = b.evidence_files(spark, sf).select(F.regexp_extract("name", r"^([^_]+)_", 1).alias("number"))
    return ar.missing_evidence(b.classified(spark, sf), files).select("ref", "merchant", "amount")


@query("j8_orphan_files", """
SELECT o_orderkey || '-1' AS number FROM orders WHERE o_orderstatus = 'F' AND o_orderkey || '-1' NOT IN (SELECT l_orderkey || '-' || l_linenumber FROM lineitem)""")
def j8_orphans(spark, sf):
    files = b.evidence_files(spark, sf).select(F.regexp_extract("name", r"^(\d+-\d+)_", 1).alias("number")).filter("number <> ''")
    return ar.orphan_files(files, b.statement_refs(spark, sf))


def _listed(spark, sf):
    r = b.table(spark, sf, "documents")
    key = F.col("doc_id").cast("string")
    return r.select(
        F.concat(F.lit("rec-"), key).alias("id"),
        F.when(F.col("lang") == "en", F.array(F.concat(key, F.lit(".pdf")), F.concat(key, F.lit("b.pdf")))).otherwise(F.array(F.concat(key, F.lit(".pdf")))).alias("files"),
    )


def _present(spark, sf):
    r = b.table(spark, sf, "documents")
    key = F.col("doc_id").cast("string")
    ext = F.when(F.col("source") == "src1", ".png").otherwise(".pdf")
    return r.select(F.concat(key, ext).alias("name"), F.sha2("text", 256).alias("sha"))


LINK_SQL = """
WITH listed AS (SELECT 'rec-' || doc_id AS id, unnest(CASE lang WHEN 'en' THEN [doc_id || '.pdf', doc_id || 'b.pdf'] ELSE [doc_id || '.pdf'] END) AS name FROM documents),
present AS (SELECT doc_id || CASE source WHEN 'src1' THEN '.png' ELSE '.pdf' END AS name FROM documents)
SELECT name, id, 'missing' AS problem FROM listed WHERE name NOT IN (SELECT name FROM present)
UNION ALL SELECT name, NULL, 'orphan' FROM present WHERE name NOT IN (SELECT name FROM listed)"""


@query("u3_link_check", LINK_SQL)
def u3(spark, sf):
    return ar.link_check(_listed(spark, sf), _present(spark, sf))


@query(
    "f1_extract_text",
    """
SELECT doc_id, CASE WHEN lang = 'es' THEN 0 ELSE length(text) END AS chars, CASE WHEN lang = 'es' THEN 'none' ELSE 'plain' END AS method,
  CASE WHEN lang = 'es' THEN 'ValueError: not UTF-8' END AS error FROM documents""",
)
def f1(spark, sf):
    """Whole texts as bytes; those of one language are spoilt by a byte that is not UTF-8."""

    def extractor(body):
        try:
            return bytes(body).decode("utf-8"), "plain", 1
        except UnicodeDecodeError:
            raise ValueError("not UTF-8") from None

    spoilt = F.when(F.col("lang") == "es", F.lit(b"\xff")).otherwise(F.lit(b""))
    d = b.table(spark, sf, "documents").select("doc_id", F.concat(F.encode("text", "UTF-8"), spoilt).alias("content"))
    out = ar.extract_text(d, extractor, "doc_id", "content")
    return out.select("doc_id", F.length("text").cast("bigint").alias("chars"), "method", "error")


# --------------------------------------------------------------------------- identity and merge

MATCH_SQL = """
SELECT i.doc_id, CASE WHEN o.id IS NOT NULL AND NOT (o.entity = i.entity AND o.date = i.date AND o.amount_sek = i.amount_sek) THEN 'same file as ' || o.id || ' but a different charge'
     WHEN o.expense_id <> '' AND i.expense_id <> '' AND o.expense_id <> i.expense_id THEN 'same file and charge as ' || o.id || ' but another expense'
     WHEN o.card_ref <> '' AND i.card_ref <> '' AND o.card_ref <> i.card_ref THEN 'same file and charge as ' || o.id || ' but another ref' ELSE '' END AS reason,
  coalesce(o.id, least(e.id, c.id)) AS target
FROM {incoming} i LEFT JOIN {files} f ON f.sha = i.sha LEFT JOIN {archive} o ON o.id = f.id
LEFT JOIN (SELECT entity, date, amount_sek, expense_id, min(id) AS id FROM {archive} WHERE expense_id <> '' GROUP BY ALL) e ON e.entity = i.entity AND e.date = i.date AND e.amount_sek = i.amount_sek AND e.expense_id = i.expense_id
LEFT JOIN (SELECT entity, date, amount_sek, card_ref, min(id) AS id FROM {archive} WHERE card_ref <> '' GROUP BY ALL) c ON c.entity = i.entity AND c.date = i.date AND c.amount_sek = i.amount_sek AND c.card_ref = i.card_ref"""
cte("matched", MATCH_SQL.format(incoming="records", archive="existing", files="existing"), "existing")


@query("j14_match_record", with_("matched", body="""
SELECT doc_id, reason, CASE WHEN reason = '' THEN target END AS record_id, CASE WHEN reason <> '' THEN 'refused' WHEN target IS NOT NULL THEN 'merge' ELSE 'create' END AS outcome FROM matched"""))
def j14(spark, sf):
    records_, files = _archived(spark, sf)
    return ar.match_record(_incoming(spark, sf), records_, files).select("doc_id", "reason", "record_id", "outcome")


FOLD = """
  arg_min(expense_id, CASE WHEN expense_id <> '' THEN position END) FILTER (expense_id <> '') AS in_expense_id,
  arg_min(card_ref, position) FILTER (card_ref <> '') AS in_card_ref, arg_min(vendor, position) FILTER (vendor <> '') AS in_vendor,
  arg_min(note, position) FILTER (note <> '') AS in_note, arg_min(invoice_number, position) FILTER (invoice_number <> '') AS in_invoice_number,
  arg_max(voucher, position) FILTER (voucher <> '') AS in_voucher, arg_max(booking_status, position) FILTER (booking_status <> '') AS in_booking_status,
  max(position) FILTER (source_ref <> '' AND source_kind IN ('mail')) AS mail_at, max(position) FILTER ((source_ref <> '' AND source_kind = 'portal') OR source_kind = 'export') AS mid_at,
  arg_max(status, position) FILTER (starts_with(status, 'attached')) AS in_attached, arg_max(status, position) FILTER (starts_with(status, 'exported')) AS in_exported"""



def _round_sql(k: int) -> str:
    """A round of the batch: documents that match no record and have no earlier fellow open one, the others look again."""
    match = MATCH_SQL.format(incoming=f"pend{k}", archive=f"facts{k}", files=f"own{k}")
    fill = ", ".join(f"arg_min({c}, doc_id) FILTER ({c} <> '') AS in_{c}" for c in ("expense_id", "card_ref"))
    kept = ", ".join(f"CASE WHEN {c} = '' THEN coalesce(in_{c}, '') ELSE {c} END AS {c}" for c in ("expense_id", "card_ref"))
    return f"""
judged{k} AS ({match}),
live{k} AS (SELECT p.*, j.target FROM pend{k} p JOIN judged{k} j USING (doc_id) WHERE j.reason = ''),
rest{k} AS (SELECT * EXCLUDE (target) FROM live{k} WHERE target IS NULL),
lead{k} AS (SELECT r.* FROM rest{k} r WHERE NOT EXISTS (SELECT 1 FROM live{k} s WHERE s.doc_id < r.doc_id AND s.sha = r.sha)
  AND NOT EXISTS (SELECT 1 FROM live{k} s WHERE s.doc_id < r.doc_id AND s.entity = r.entity AND s.date = r.date AND s.amount_sek = r.amount_sek AND s.expense_id = r.expense_id AND s.expense_id <> '')
  AND NOT EXISTS (SELECT 1 FROM live{k} s WHERE s.doc_id < r.doc_id AND s.entity = r.entity AND s.date = r.date AND s.amount_sek = r.amount_sek AND s.card_ref = r.card_ref AND s.card_ref <> '')),
opened{k} AS (SELECT * EXCLUDE (id, n), n AS number, CASE WHEN n = 1 THEN stem ELSE stem || '-' || n END AS id FROM (
  SELECT l.*, coalesce((SELECT max(number) FROM facts{k} f WHERE f.entity = l.entity AND year(f.date) = year(l.date) AND f.stem = l.stem), 0)
    + row_number() OVER (PARTITION BY entity, year(date), stem ORDER BY doc_id) AS n FROM lead{k} l)),
merged{k} AS (SELECT * FROM live{k} WHERE target IS NOT NULL),
facts{k + 1} AS (
  SELECT id, stem, number, entity, date, amount_sek, {kept} FROM facts{k} LEFT JOIN (SELECT target AS id, {fill} FROM merged{k} GROUP BY target) USING (id)
  UNION ALL SELECT id, stem, number, entity, date, amount_sek, expense_id, card_ref FROM opened{k}),
own{k + 1} AS (SELECT sha, id FROM own{k} UNION ALL SELECT sha, arg_min(id, doc_id) FROM (SELECT sha, target AS id, doc_id FROM merged{k} UNION ALL SELECT sha, id, doc_id FROM opened{k})
  WHERE sha NOT IN (SELECT sha FROM own{k}) GROUP BY sha),
pend{k + 1} AS (SELECT * FROM rest{k} WHERE doc_id NOT IN (SELECT doc_id FROM lead{k}))"""


# Enough for the driver's tables: a test sees to it that no document is left after them.
ROUNDS = 3
UPSERT_BODY = (
    """
WITH pend0 AS (SELECT *, CAST(date AS VARCHAR) || '-' || entity AS stem FROM records),
facts0 AS (SELECT id, id AS stem, 1 AS number, entity, date, amount_sek, expense_id, card_ref FROM existing),
own0 AS (SELECT sha, id FROM existing),"""
    + ",".join(_round_sql(k) for k in range(ROUNDS))
    + ",\nopened AS ("
    + " UNION ALL ".join(f"SELECT * EXCLUDE (stem, number) FROM opened{k}" for k in range(ROUNDS))
    + "),\nmerges AS ("
    + " UNION ALL ".join(f"SELECT target AS rid, doc_id FROM merged{k}" for k in range(ROUNDS))
    + f"""),
news AS (SELECT id, count(*) AS files FROM own{ROUNDS} WHERE sha NOT IN (SELECT sha FROM existing) GROUP BY id),
folded AS (SELECT rid, """
    + FOLD
    + """ FROM (SELECT m.rid, r.*, r.doc_id AS position FROM merges m JOIN records r USING (doc_id)) GROUP BY rid),
base AS (SELECT *, false AS fresh FROM existing UNION ALL BY NAME SELECT *, true AS fresh FROM opened),
joined AS (SELECT b.*, f.* EXCLUDE (rid), CASE source_kind WHEN 'mail' THEN 3 WHEN 'portal' THEN 2 WHEN 'export' THEN 2 ELSE 1 END AS old_rank,
   coalesce(mail_at, mid_at) AS src_at, CASE WHEN mail_at IS NOT NULL THEN 3 WHEN mid_at IS NOT NULL THEN 2 END AS new_rank FROM base b LEFT JOIN folded f ON f.rid = b.id),
taken AS (SELECT j.*, s.source_kind AS s_kind, s.source_ref AS s_ref, s.source_from AS s_from, new_rank >= old_rank AND NOT (new_rank = old_rank AND s.source_ref = '' AND j.source_ref <> '') AS take
  FROM joined j LEFT JOIN records s ON s.doc_id = j.src_at),
st AS (SELECT *, CASE WHEN in_exported IS NULL THEN status WHEN starts_with(status, 'attached') THEN left(status, 19) || ' (QUEUED)' ELSE in_exported END AS st1 FROM taken),
st2 AS (SELECT *, CASE WHEN in_attached IS NULL THEN st1 WHEN contains(st1, '(') THEN left(in_attached, 19) || ' (QUEUED)' ELSE in_attached END AS st2 FROM st)
SELECT id, entity, date, amount_sek, merchant, CASE WHEN expense_id = '' THEN coalesce(in_expense_id, '') ELSE expense_id END AS expense_id, CASE WHEN card_ref = '' THEN coalesce(in_card_ref, '') ELSE card_ref END AS card_ref,
  CASE WHEN vendor = '' THEN coalesce(in_vendor, '') ELSE vendor END AS vendor, CASE WHEN note = '' THEN coalesce(in_note, '') ELSE note END AS note, CASE WHEN invoice_number = '' THEN coalesce(in_invoice_number, '') ELSE invoice_number END AS invoice_number,
  coalesce(in_voucher, voucher) AS voucher, coalesce(in_booking_status, booking_status) AS booking_status,
  CASE WHEN take THEN s_kind ELSE source_kind END AS source_kind, CASE WHEN take THEN s_ref ELSE source_ref END AS source_ref, CASE WHEN take THEN s_from ELSE source_from END AS source_from, st2 AS status,
  CASE WHEN fresh THEN 'created' WHEN (expense_id = '' AND in_expense_id IS NOT NULL) OR (card_ref = '' AND in_card_ref IS NOT NULL) OR (vendor = '' AND in_vendor IS NOT NULL) OR (note = '' AND in_note IS NOT NULL)
     OR (invoice_number = '' AND in_invoice_number IS NOT NULL) OR in_voucher <> voucher OR in_booking_status <> booking_status OR (take AND (s_kind <> source_kind OR s_ref <> source_ref OR s_from <> source_from)) OR st2 <> status
     OR id IN (SELECT id FROM news) THEN 'updated' ELSE 'unchanged' END AS outcome
FROM st2"""
)
UPSERT_SQL = with_("matched", body=UPSERT_BODY)


@query("m1_upsert_archive", UPSERT_SQL)
def m1(spark, sf):
    return ar.upsert_archive(*_archived(spark, sf), _incoming(spark, sf))[0].drop("stem", "number")


@query("m2_merge_status", """
SELECT a, b, CASE WHEN b = '' THEN a WHEN a = '' THEN b WHEN starts_with(a, 'attached') AND starts_with(b, 'exported') THEN 'attached ' || substr(a, 10, 10) || ' (' || regexp_extract(b, '\\((.*)\\)', 1) || ')'
   WHEN starts_with(b, 'attached') AND NOT contains(b, '(') AND contains(a, '(') THEN b || ' (' || regexp_extract(a, '\\((.*)\\)', 1) || ')' ELSE b END AS merged, count(*) AS n
FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'attached ' || CAST(o_orderdate AS DATE) || CASE WHEN o_orderpriority = '1-URGENT' THEN ' (EXPORTED)' ELSE '' END WHEN 'O' THEN 'exported (QUEUED)' ELSE '' END AS a,
             CASE o_orderpriority WHEN '1-URGENT' THEN 'attached ' || CAST(o_orderdate AS DATE) WHEN '2-HIGH' THEN 'exported (EXPORTED)' WHEN '3-MEDIUM' THEN 'no file' WHEN '4-NOT SPECIFIED' THEN '' ELSE 'attached 2026-01-01 (X)' END AS b FROM orders)
GROUP BY a, b""")
def m2(spark, sf):
    o = b.table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date").cast("string")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    a = (
        F.when((s == "F") & (p == "1-URGENT"), F.concat(F.lit("attached "), day, F.lit(" (EXPORTED)")))
        .when(s == "F", F.concat(F.lit("attached "), day)).when(s == "O", "exported (QUEUED)").otherwise("")
    )
    c = (
        F.when(p == "1-URGENT", F.concat(F.lit("attached "), day)).when(p == "2-HIGH", "exported (EXPORTED)").when(p == "3-MEDIUM", "no file")
        .when(p == "4-NOT SPECIFIED", "").otherwise("attached 2026-01-01 (X)")
    )
    pairs = o.select(a.alias("a"), c.alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("merged", ar.merge_status(F.col("a"), F.col("b")))


@query("m3_normalise_record", """
SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'unknown entity' WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'no merchant' ELSE '' END AS reason,
  CASE WHEN ok THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS amount_sek, CASE WHEN ok THEN CASE WHEN o_orderstatus = 'O' THEN CAST(floor(o_totalprice / 10) AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END END AS amount,
  CASE WHEN ok THEN CASE WHEN o_orderstatus = 'O' THEN 'EUR' ELSE 'SEK' END END AS currency, CASE WHEN ok THEN CASE o_orderstatus WHEN 'F' THEN 'card' WHEN 'O' THEN 'expense' ELSE 'pocket' END END AS lane,
  CASE WHEN ok THEN CASE WHEN o_orderstatus IN ('F','P') THEN 'ej bokfort' ELSE '' END END AS booking_status
FROM (SELECT *, NOT (o_orderpriority = '1-URGENT' OR (o_orderpriority = '5-LOW' AND o_orderstatus = 'P')) AS ok FROM orders)""")
def m3(spark, sf):
    o = b.table(spark, sf, "orders")
    price = F.col("o_totalprice").cast(MONEY)
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    rows = o.select(
        F.col("o_orderkey").alias("id"),
        F.when(p == "1-URGENT", "delta").otherwise("alfa").alias("entity"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when((p == "5-LOW") & (s == "P"), "  ").otherwise(p).alias("merchant"),
        F.when(s == "F", -price).otherwise(price).alias("amount_sek"),
        F.when(s == "O", F.floor(F.col("o_totalprice") / 10).cast(MONEY)).when(s == "F", F.lit(1).cast(MONEY)).alias("amount"),
        F.when(s == "O", "eur").when(s == "F", "sek").otherwise("").alias("currency"),
        F.when(s == "F", "card-0115").when(s == "O", "expense").otherwise("").alias("card"),
        F.lit("").alias("lane"), F.lit("").alias("kind"), F.lit("").alias("voucher"), F.lit("").alias("booking_status"),
    )
    good, bad = ar.normalise_record(rows, ["alfa", "beta"])
    cols = ["id", "reason", "amount_sek", "amount", "currency", "lane", "booking_status"]
    null = {c: F.lit(None).cast("string" if c in ("currency", "lane", "booking_status") else MONEY) for c in cols[2:]}
    return good.withColumn("reason", F.lit("")).select(*cols).unionByName(bad.withColumns(null).select(*cols))


def _changes(spark, sf):
    """Patch lines from labels: two lines per record at most, some not allowed."""
    l = b.table(spark, sf, "labels")
    key = F.when(F.col("toxic") == 1, "sha256").when(F.col("quality") == 1, "note").otherwise("vendor")
    value = F.when(F.col("quality") == 1, F.concat(F.lit("n"), F.col("doc_id").cast("string"))).otherwise("")
    target = F.concat(F.lit("rec-"), F.lpad(F.floor(F.col("doc_id") / 2).cast("string"), 9, "0"))
    return l.select(target.alias("id"), key.alias("key"), value.alias("value"), F.col("doc_id").alias("line"))


CHANGES_SQL = """
changes AS (SELECT 'rec-' || lpad(CAST(doc_id // 2 AS VARCHAR), 9, '0') AS id, CASE WHEN toxic = 1 THEN 'sha256' WHEN quality = 1 THEN 'note' ELSE 'vendor' END AS key,
   CASE WHEN quality = 1 THEN 'n' || doc_id ELSE '' END AS value, doc_id AS line FROM labels),
ok AS (SELECT id, arg_max(value, line) AS note FROM changes WHERE key = 'note' GROUP BY id)"""


@query("m4_patch", with_("records", body=f"""
WITH {CHANGES_SQL.strip()}
SELECT r.id, CASE WHEN ok.note IS NOT NULL THEN ok.note ELSE r.note END AS note, CASE WHEN ok.note IS NOT NULL AND ok.note <> r.note THEN 'updated' ELSE 'unchanged' END AS outcome, 0 AS line FROM records r LEFT JOIN ok ON ok.id = r.id
UNION ALL SELECT id, key, CASE WHEN id NOT IN (SELECT id FROM records) THEN 'unknown id' WHEN key = 'sha256' THEN 'not settable' ELSE 'cannot be emptied' END, line FROM changes WHERE key <> 'note'"""))
def m4(spark, sf):
    done, rejected = ar.patch(records(spark, sf).drop("text"), _changes(spark, sf))
    a = done.select("id", "note", "outcome", F.lit(0).cast("bigint").alias("line"))
    return a.unionByName(rejected.select("id", F.col("key").alias("note"), F.col("reason").alias("outcome"), "line"))


@query("j21_sync_results", with_("records", body="""
WITH pages AS (SELECT card_ref, arg_min(id, date || id) AS id, arg_min(voucher, date || id) AS voucher, arg_min(booking_status, date || id) AS booking_status FROM records WHERE card_ref <> '' GROUP BY card_ref),
steps AS (SELECT 'C' || doc_id AS ref, CASE WHEN lang = 'es' THEN NULL ELSE doc_id END AS num FROM documents)
SELECT s.ref, p.id AS record_id, 'A ' || num AS voucher, CASE WHEN num IS NOT NULL THEN 'bokfort 2026-09-01' END AS booking_status,
  CASE WHEN num IS NULL THEN 'no_voucher' WHEN p.id IS NULL THEN 'no_page' WHEN p.voucher = 'A ' || num AND p.booking_status = 'bokfort 2026-09-01' THEN 'unchanged' ELSE 'updated' END AS outcome
FROM steps s LEFT JOIN pages p ON p.card_ref = s.ref"""))
def j21(spark, sf):
    d = b.table(spark, sf, "documents")
    steps = d.select(
        F.concat(F.lit("C"), F.col("doc_id").cast("string")).alias("ref"),
        F.lit("A").alias("voucher_series"),
        F.when(F.col("lang") != "es", F.col("doc_id")).alias("voucher_number"),
        F.lit("2026-09-01").cast("date").alias("booked_on"),
    )
    return ar.sync_results(records(spark, sf).drop("text"), steps)


@query("w5_assign_ids", with_("records", body="""
SELECT doc_id, CASE WHEN n = 1 THEN stem ELSE stem || '-' || n END AS id FROM (
  SELECT doc_id, stem, row_number() OVER (PARTITION BY entity, year(date), stem ORDER BY doc_id, sha) AS n FROM (SELECT *, date || '-' || lower(entity) AS stem FROM records))"""))
def w5(spark, sf):
    rows = records(spark, sf).select("doc_id", "entity", "date", "sha", F.col("doc_id").alias("created"))
    return ar.assign_ids(rows.withColumn("stem", F.concat_ws("-", F.col("date").cast("string"), F.lower("entity")))).select("doc_id", "id")


@query("w6_arbitrate_shared", with_("records", body="""
WITH r AS (SELECT doc_id, sha, entity, CAST(date + CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS DATE) AS date, amount_sek, coalesce(quality, 0) AS hit, CASE WHEN quality IS NULL THEN 0 ELSE 5 END AS gap FROM records LEFT JOIN labels USING (doc_id)),
v AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY hit DESC, gap, doc_id) AS n, (SELECT count(DISTINCT (x.entity, x.date, x.amount_sek)) FROM r x WHERE x.sha = r.sha) AS charges FROM r)
SELECT doc_id, CASE WHEN charges < 2 THEN 'uncontested' WHEN n = 1 THEN 'owner' ELSE 'refused' END AS verdict FROM v"""))
def w6(spark, sf):
    rows = records(spark, sf).join(b.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    shifted = rows.select(
        "doc_id", "sha", "entity", F.col("doc_id").alias("position"), "amount_sek",
        F.date_add("date", F.when(F.col("quality").isNull(), 0).otherwise(1)).alias("date"),
        F.coalesce("quality", F.lit(0)).alias("amount_hit"),
        F.when(F.col("quality").isNull(), 0).otherwise(5).alias("gap"),
    )
    return ar.arbitrate_shared(shifted).select("doc_id", "verdict")


@query("w6_text_fit", with_("proofs", body="""
SELECT doc_id, CAST(CASE WHEN lang IN ('en','de') THEN 1 ELSE 0 END AS INTEGER) AS amount_hit FROM proofs"""))
def w6_fit(spark, sf):
    rows = proofs(spark, sf).withColumn("date", F.col("charge_date")).withColumn("amount_sek", F.col("amount"))
    return ar.text_fit(rows, "text").select("doc_id", "amount_hit")


DUP_SQL = """
SELECT r.id, r.invoice_number, (SELECT min(o.id) FROM records o WHERE o.invoice_number = r.invoice_number AND o.kind <> 'credit-note' AND (o.date <> r.date OR o.amount_sek <> r.amount_sek)) AS other_id
FROM records r WHERE r.invoice_number <> '' AND r.kind <> 'credit-note'"""


@query("j15_duplicate_invoices", with_("records", body=f"SELECT * FROM ({DUP_SQL}) WHERE other_id IS NOT NULL"))
def j15(spark, sf):
    return ar.duplicate_invoices(records(spark, sf).drop("text")).select("id", "invoice_number", "other_id")


def _dated(spark, sf):
    rows = records(spark, sf).join(proofs(spark, sf).select("doc_id", F.col("text").alias("_receipt"), F.col("amount").alias("_amount")), "doc_id")
    shift = F.pmod(F.col("n_chars"), F.lit(40)).cast("int") - 20
    return (
        rows.withColumn("text", F.col("_receipt")).withColumn("amount", F.col("_amount")).withColumn("amount_sek", F.col("_amount"))
        .withColumn("receipt_date", F.date_add("date", shift)).withColumn("vendor", F.lit("Acme Tools")).drop("_receipt", "_amount")
    )


@query("d17_plausibility", with_("records", body=f"""
WITH r AS (SELECT *, CAST(date + CAST(n_chars % 40 - 20 AS INTEGER) AS DATE) AS rd, CAST(20 - n_chars % 40 AS INTEGER) AS gap, n_chars + 0.5 AS total,
   contains(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '', 'g'), 'acme') OR contains(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '', 'g'), 'shop') AS named FROM records)
SELECT id, 'earlier-period' AS kind, 'receipt_date ' || rd || ' is ' || gap || ' days before the charge date ' || date AS text FROM r WHERE gap > 10
UNION ALL SELECT id, 'later-period', 'receipt_date ' || rd || ' is ' || -gap || ' days after the charge date ' || date FROM r WHERE -gap > 7
UNION ALL SELECT id, 'amount-missing', 'charge amount ' || replace(replace(replace(format('{{:,.2f}}', CAST(total AS DOUBLE)), ',', '~'), '.', ','), '~', ' ') || ' SEK not found in the receipt text' FROM r WHERE lang = 'fr'
UNION ALL SELECT id, 'vendor-missing', 'vendor Acme Tools not named in the receipt text' FROM r WHERE lang IN ('de','fr') AND NOT named AND lang <> 'de'
UNION ALL SELECT id, 'other-company', 'receipt is made out to ' || CASE lang WHEN 'de' THEN 'beta' ELSE 'alfa' END || ' but filed under ' || entity FROM r WHERE lang IN ('de','fr')
UNION ALL SELECT id, 'duplicate-invoice', 'invoice_number ' || invoice_number || ' is also on ' || other_id FROM ({DUP_SQL}) WHERE other_id IS NOT NULL"""))
def d17(spark, sf):
    return ar.plausibility(_dated(spark, sf), COMPANIES)


@query("a17_warning_kinds", with_("records", body=f"""
WITH r AS (SELECT *, CAST(20 - n_chars % 40 AS INTEGER) AS gap FROM records)
SELECT kind, count(*) AS n FROM (
  SELECT 'earlier-period' AS kind FROM r WHERE gap > 10 UNION ALL SELECT 'later-period' FROM r WHERE -gap > 7
  UNION ALL SELECT 'duplicate-invoice' FROM ({DUP_SQL}) WHERE other_id IS NOT NULL) GROUP BY kind"""))
def a17(spark, sf):
    warnings = ar.plausibility(_dated(spark, sf).withColumn("text_method", F.lit("none")), COMPANIES)
    return ar.warning_kinds(warnings)


def _lintable(spark, sf):
    r = records(spark, sf)
    key = F.col("doc_id").cast("string")
    return r.select(
        F.col("id").alias("stem"),
        F.when(F.col("lang") == "es", F.concat(F.col("id"), F.lit("x"))).otherwise(F.col("id")).alias("id"),
        "entity", F.lit("alfa").alias("folder_entity"), "date",
        F.when(F.col("lang") == "fr", 2025).otherwise(2026).alias("folder_year"),
        "merchant", "vendor", F.col("sha").alias("sha256"),
        F.array(F.concat(key, F.lit(".pdf"))).alias("files"),
        F.when(F.col("text_method") == "none", "").otherwise(F.col("text")).alias("text"),
    )


@query("d18_lint", with_("records", body="""
WITH present AS (SELECT doc_id || CASE source WHEN 'src1' THEN '.png' ELSE '.pdf' END AS name FROM documents)
SELECT 'error' AS severity, 'required' AS rule, id, 'vendor' AS text FROM records WHERE vendor = ''
UNION ALL SELECT 'error', 'id', id, id || 'x' FROM records WHERE lang = 'es'
UNION ALL SELECT 'error', 'entity', id, entity FROM records WHERE entity <> 'alfa'
UNION ALL SELECT 'error', 'year', id, CAST(date AS VARCHAR) FROM records WHERE lang = 'fr'
UNION ALL SELECT 'warning', 'no-text', id, '' FROM records WHERE text_method = 'none'
UNION ALL SELECT 'error', 'missing-file', id, doc_id || '.pdf' FROM records WHERE doc_id || '.pdf' NOT IN (SELECT name FROM present)
UNION ALL SELECT 'warning', 'orphan-file', '', name FROM present WHERE ends_with(name, '.png')
UNION ALL SELECT 'error', 'same-hash', id, first FROM (SELECT id, min(id) OVER (PARTITION BY sha) AS first FROM records) WHERE id <> first"""))
def d18(spark, sf):
    return ar.lint(_lintable(spark, sf), _present(spark, sf), ["merchant", "vendor", "entity"])


@query("d23_ingest_jobs", with_("expenses", body="""
SELECT expense_id, CASE WHEN type = 'Reimbursement' THEN 'reimbursement row, not a receipt' WHEN merchant = '2-HIGH' THEN 'tag personal' WHEN f.n IS NULL THEN 'no file' WHEN f.kept = 0 THEN 'only junk files' ELSE '' END AS skip_reason,
       coalesce(f.kept, 0) AS kept_files
FROM expenses e LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R' OR l_extendedprice >= 5000) AS kept FROM lineitem GROUP BY 1) f ON CAST(f.l_orderkey AS VARCHAR) = e.expense_id"""))
def d23(spark, sf):
    rows = b.expenses(spark, sf).select(
        "expense_id", F.col("expense_id").alias("receipt_no"), "type", "date", "amount_sek",
        F.when(F.col("merchant") == "2-HIGH", "personal").otherwise("business").alias("tag"),
    )
    files = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("number"),
        F.when(F.col("l_returnflag") == "R", "r.pdf").otherwise("i.png").alias("name"),
        F.lit("").alias("mime"), F.col("l_extendedprice").alias("bytes"),
    )
    return ar.ingest_jobs(rows, files).select("expense_id", "skip_reason", "kept_files")


@query("a5_archive_months", with_("records", body="""
SELECT strftime(date, '%Y-%m') AS month, count(*) AS pages, CAST(sum(CASE WHEN kind = 'credit-note' THEN -amount_sek ELSE amount_sek END) AS DECIMAL(18,2)) AS amount_sek,
  count(*) FILTER (lang = 'en') AS expense_lane, count(*) FILTER (lang = 'de') AS card_lane, count(*) FILTER (starts_with(status, 'attached')) AS attached, count(*) FILTER (starts_with(status, 'exported')) AS exported,
  count(*) FILTER (status = '') AS no_status, count(*) FILTER (starts_with(booking_status, 'bokfort')) AS booked, count(*) FILTER (starts_with(booking_status, 'ej')) AS open
FROM records GROUP BY 1"""))
def a5(spark, sf):
    return ar.archive_months(records(spark, sf))


@query("a5_text_methods", with_("records", body="SELECT text_method AS method, count(*) AS n FROM records GROUP BY 1"))
def a5_methods(spark, sf):
    return ar.text_methods(records(spark, sf))


@query("p5_find_records", with_("records", body="""
SELECT id, date, amount_sek, vendor FROM records WHERE entity = 'alfa' AND contains(lower(vendor || ' ' || merchant), 'src1') AND starts_with(CAST(date AS VARCHAR), '2026-03')"""))
def p5(spark, sf):
    return ar.find_records(records(spark, sf), entity="alfa", vendor="SRC1", month="2026-03").select("id", "date", "amount_sek", "vendor")
