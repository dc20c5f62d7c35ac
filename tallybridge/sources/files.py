"""Readers of statements, exports, run files, plans and worklists."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import parse_date
from ..functions.money import parse_money
from ..functions.scale import carry_down
from ..functions.text import norm_ws

# Columns of a card statement and the names they get.
STATEMENT_COLUMNS = {
    "Datum": "date_text", "Beskrivning": "merchant", "Kortmedlem": "member", "Konto #": "account",
    "Belopp": "amount_text", "Utökade specifikationer": "ext", "Visas på ditt kontoutdrag som": "statement_text",
    "Adress": "address", "Ort": "city", "Postnummer": "postcode", "Land": "country", "Referens": "ref",
}
REQUIRED_COLUMNS = ("Datum", "Beskrivning", "Konto #", "Belopp", "Referens")


# What bytes 80 to 9F mean in cp1252; latin-1 reads them as control characters.
CP1252_FROM = "".join(chr(c) for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
CP1252_TO = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def _looks(spark: SparkSession, paths) -> dict[tuple[str, str], list[str]]:
    """Statement files by encoding (the first of UTF-8, cp1252 and latin-1 that can decode them) and header.

    Files are read line by line and in splits: no character of any of the three is cut by a line
    end, so a file can be decoded when all its lines can. A line is kept only if it could be a header.
    """
    raw = F.col("value").cast("binary")
    utf8 = F.is_valid_utf8("value")
    undefined = ~utf8 & F.regexp_like(F.hex(raw), F.lit("^(?:..)*?(?:81|8D|8F|90|9D)"))
    # Within a split numbers rise line by line; a file begins in its block 0.
    top = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    named = reduce(lambda a, b: a & b, [F.col("value").contains(c) for c in REQUIRED_COLUMNS])
    could = F.when(top.isNotNull() & named, raw)
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), could.alias("head"), utf8.alias("utf8"), undefined.alias("undefined"), top.alias("top")
    )
    seen = lines.groupBy("path", "head").agg(F.min("top").alias("top"), F.bool_and("utf8").alias("utf8"), F.bool_or("undefined").alias("undefined"))
    files: dict[str, list] = {}
    for r in seen.collect():
        files.setdefault(r.path, []).append(r)
    groups: dict[tuple[str, str], list[str]] = {}
    for path, rows in files.items():
        encoding = "UTF-8" if all(r.utf8 for r in rows) else "latin-1" if any(r.undefined for r in rows) else "cp1252"
        # The path of the metadata is percent-encoded.
        file = unquote(path)
        first = min((r for r in rows if r.top is not None), key=lambda r: r.top).head
        if first is None:
            first = spark.read.text(file).select(F.col("value").cast("binary").alias("head")).first().head
        header = bytes(first).decode("utf-8" if encoding == "UTF-8" else "iso-8859-1").removeprefix("\ufeff")
        groups.setdefault((encoding, header), []).append(file)
    return groups


def read_statement(spark: SparkSession, paths) -> DataFrame:
    """Card statement files as charges, columns found by header, text decoded file by file.

    The files are looked at once to learn encoding and header; files alike in both are then read
    together by the CSV reader, so only file names and headers pass through the driver.
    """
    groups = _looks(spark, paths)
    out = None
    for (encoding, head), files in sorted(groups.items()):
        names = [c.strip().strip('"') for c in head.split(",")]
        missing = [c for c in REQUIRED_COLUMNS if c not in names]
        if missing:
            raise ValueError(f"not a card statement, missing columns: {', '.join(missing)} in {files[0]}")
        schema = ", ".join(f"`{n}` string" for n in names)
        charset = "UTF-8" if encoding == "UTF-8" else "ISO-8859-1"
        df = spark.read.csv(files, schema=schema, header=True, encoding=charset, multiLine=True, escape='"', enforceSchema=True)
        df = df.select(*[F.col(f"`{n}`") for n in names], F.col("_metadata.file_name").alias("source_file"))
        if encoding == "cp1252":
            df = df.select(*[F.translate(f"`{n}`", CP1252_FROM, CP1252_TO).alias(n) for n in names], "source_file")
        cols = [F.col(f"`{n}`").alias(a) if n in names else F.lit(None).cast("string").alias(a) for n, a in STATEMENT_COLUMNS.items()]
        part = df.select(*cols, "source_file")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no statement files")
    return out.select(
        parse_date(F.col("date_text")).alias("date"),
        norm_ws(F.col("merchant")).alias("merchant"),
        F.trim("account").alias("account"),
        "member",
        parse_money(F.col("amount_text"), "statement").alias("amount"),
        F.coalesce("ext", F.lit("")).alias("ext"),
        "statement_text",
        "city",
        "country",
        F.trim(F.regexp_replace("ref", "^'|'$", "")).alias("ref"),
        "source_file",
    )


# The columns that identify each worklist layout, in the order they are tried.
SIGNATURES = [
    ("matching", {"pleo_receipt_no", "expense_id", "pleo_amount", "gmail_message_id"}),
    ("hand_list", {"date", "pleo_receipt_no", "merchant", "amount_sek", "route", "evidence"}),
    ("profile", {"pleo_receipt_no", "expense_id", "amount", "orig_amount", "orig_currency", "export_status"}),
    ("export", {"Date", "Receipt", "Expense Type", "Source description", "Expense ID"}),
    ("queue", {"reference", "amount_sek", "evidence_kind", "statement_period"}),
    ("classified", {"ref", "amount", "tag", "pack_status"}),
    ("normalized", {"ref", "amount", "account"}),
    ("regression", {"set", "ledger", "row_key", "expected_message_id"}),
]


def detect_format(columns) -> str:
    """Layout of a worklist by its columns; an unknown header is an error."""
    have = set(columns)
    for name, needed in SIGNATURES:
        if name == "normalized" and not ({"kind", "source_file"} <= have or "dash_id" in have):
            continue
        if needed <= have:
            return name
    raise ValueError(f"unrecognised worklist header: {sorted(have)}")


WORKLIST = "row_key, ledger, source_format, expense_id, account, date, merchant, kind, amount_sek, foreign_amount, foreign_currency, tag, known_message_id, status_hint, search, skip_reason".split(", ")


def _known(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"\bGmail\s+([0-9a-f]{16})\b", 1)


def _foreign_of(text: Column) -> tuple[Column, Column]:
    """Amount and code of a trailing ``12,34 EUR`` or a free ``53,71 USD exact``."""
    pattern = r"((?<![\w.,])\d{1,3}(?: \d{3})+(?!\d)(?:[.,]\d+)?|\d[\d.,]*)\s*(EUR|USD|GBP|DKK|NOK|CHF|JPY)\b"
    amount = parse_money(F.nullif(F.regexp_extract(norm_ws(text), pattern, 1), F.lit("")), "any")
    return amount, F.nullif(F.regexp_extract(norm_ws(text), pattern, 2), F.lit(""))


def to_worklist(df: DataFrame, fmt: str | None = None, all_tags: bool = False) -> DataFrame:
    """Any of the known layouts as one worklist of charges to match."""
    fmt = fmt or detect_format(df.columns)
    none = F.lit("")
    base: dict[str, Column] = {
        "ledger": F.lit("expense"), "source_format": F.lit(fmt), "expense_id": none, "account": F.lit("expense"),
        "kind": F.lit("charge"), "foreign_amount": F.lit(None).cast("decimal(18,2)"), "foreign_currency": F.lit(None).cast("string"),
        "tag": none, "known_message_id": none, "status_hint": none, "search": F.lit(True), "skip_reason": none,
    }

    def col(name):
        return F.trim(F.coalesce(F.col(f"`{name}`").cast("string"), none))

    if fmt == "matching":
        shape = r"^([\d\s]+,\d{2}) SEK(?: \(([\d ,.]+) ([A-Z]{3})\))?$"
        text = norm_ws(F.col("pleo_amount"))
        amount, code = F.nullif(F.regexp_extract(text, shape, 2), none), F.nullif(F.regexp_extract(text, shape, 3), none)
        df = df.filter(text.rlike(shape))
        base |= {
            "row_key": col("pleo_receipt_no"), "expense_id": col("expense_id"), "date": parse_date(F.col("date")), "merchant": norm_ws(F.col("merchant")),
            "amount_sek": parse_money(F.regexp_extract(text, shape, 1), "swedish"),
            "foreign_amount": F.when(code != "SEK", parse_money(amount, "any")), "foreign_currency": F.when(code != "SEK", code),
            "known_message_id": col("gmail_message_id"), "status_hint": norm_ws(F.col("status")),
        }
    elif fmt == "hand_list":
        both = F.concat_ws(" ", norm_ws(F.col("evidence")), norm_ws(F.col("action")))
        amount, code = _foreign_of(F.concat_ws(" ", "merchant", "evidence"))
        personal = F.lower(both).rlike("marked (as )?personal")
        base |= {
            "row_key": col("pleo_receipt_no"), "date": parse_date(F.col("date")), "merchant": norm_ws(F.col("merchant")),
            "amount_sek": F.abs(F.coalesce(parse_money(F.col("amount_sek"), "swedish"), parse_money(F.col("amount_sek"), "any"))).cast("decimal(18,2)"),
            "foreign_amount": amount, "foreign_currency": code, "known_message_id": _known(F.col("evidence")), "status_hint": norm_ws(F.col("route")),
            "search": ~personal, "skip_reason": F.when(personal, "not searched (marked personal in the hand list)").otherwise(""),
        }
    elif fmt in ("profile", "export"):
        exported = fmt == "export"
        names = {"type": "Expense Type", "no": "Receipt", "id": "Expense ID", "date": "Date", "merchant": "Source description", "amount": "Amount", "oa": "Orig. amount", "oc": "Orig. currency", "status": "Export Status"} if exported else {
            "type": "type", "no": "pleo_receipt_no", "id": "expense_id", "date": "date", "merchant": "merchant", "amount": "amount", "oa": "orig_amount", "oc": "orig_currency", "status": "export_status"}
        if names["type"] in df.columns:
            df = df.filter(F.coalesce(F.nullif(col(names["type"]), none), F.lit("Card Purchase")) == "Card Purchase")
        if exported:
            df = df.filter((col("Reconciled Entries") == "") & (col("Personal Expense") != "Marked as personal") & (col("Receipt urls") == ""))
        amount = parse_money(col(names["amount"]), "swedish" if exported else "statement")
        foreign = (F.coalesce(F.nullif(col(names["oc"]), none), F.lit("SEK")) != "SEK") & (col(names["oa"]) != "")
        base |= {
            "row_key": col(names["no"]), "expense_id": col(names["id"]), "date": parse_date(col(names["date"])), "merchant": norm_ws(F.col(f"`{names['merchant']}`")),
            "kind": F.when(amount > 0, "refund").otherwise("charge"), "amount_sek": F.abs(amount).cast("decimal(18,2)"),
            "foreign_amount": F.when(foreign, F.abs(parse_money(col(names["oa"]), "swedish"))).cast("decimal(18,2)"), "foreign_currency": F.when(foreign, col(names["oc"])),
            "status_hint": norm_ws(F.col(f"`{names['status']}`")),
        }
    elif fmt in ("queue", "classified", "normalized"):
        key = "reference" if fmt == "queue" else "ref"
        value = parse_money(col("amount_sek" if fmt == "queue" else "amount"), "statement")
        merchant = norm_ws(F.col("merchant"))
        tag = col("tag") if "tag" in df.columns else none
        source = "foreign" if fmt == "queue" else "ext"
        amount, code = _foreign_of(F.col(source)) if source in df.columns else (base["foreign_amount"], base["foreign_currency"])
        hint = F.concat_ws(": ", col("evidence_kind"), col("evidence_where")) if fmt == "queue" else (norm_ws(F.col("pack_status")) if "pack_status" in df.columns else none)
        paid = F.upper(merchant).contains("BETALNING MOTTAGEN")
        if "kind" in df.columns:
            paid = paid | (col("kind") == "payment")
        df = df.filter(~paid)
        quiet = tag.isin("personal", "skip") if not all_tags else F.lit(False)
        base |= {
            "row_key": col(key), "ledger": F.lit("card"), "account": col("account") if "account" in df.columns else col("card"), "date": parse_date(col("date")), "merchant": merchant,
            "kind": F.when(value < 0, "refund").otherwise("charge"), "amount_sek": F.abs(value).cast("decimal(18,2)"), "foreign_amount": amount, "foreign_currency": code, "tag": tag,
            "known_message_id": _known(F.col("evidence_where")) if fmt == "queue" else none, "status_hint": hint,
            "search": ~quiet, "skip_reason": F.when(quiet, F.concat(F.lit("not searched (tag "), tag, F.lit(")"))).otherwise(""),
        }
    else:
        return _regression(df, base)
    return df.select(*[base[c].alias(c) for c in WORKLIST])


def _regression(df: DataFrame, base: dict) -> DataFrame:
    """Labelled rows whose cells may hold several charges separated by semicolons."""
    def cells(name):
        return F.transform(F.split(F.coalesce(F.col(name).cast("string"), F.lit("")), ";"), lambda c: F.trim(c))

    dates = cells("charge_date")
    n = F.size(dates)

    def nth(name, i):
        c = cells(name)
        return F.when(F.size(c) == n, F.try_element_at(c, i)).otherwise(F.element_at(c, 1))

    keys = cells("row_key")
    per = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(
            F.when(F.size(keys) == n, F.try_element_at(keys, i)).when(n > 1, F.concat(F.element_at(keys, 1), F.lit("#"), i.cast("string"))).otherwise(F.element_at(keys, 1)).alias("row_key"),
            F.try_element_at(dates, i).alias("day"),
            nth("merchant", i).alias("merchant"),
            nth("amount_sek", i).alias("amount"),
        ),
    )
    rows = df.withColumn("_c", F.explode(per))
    day = parse_date(F.col("_c.day"))
    amount = parse_money(F.col("_c.amount"), "swedish")
    foreign, code = _foreign_of(F.col("orig_amount"))
    skip = F.when(day.isNull(), "no usable charge date").when(amount.isNull() & foreign.isNull(), "no usable amount").otherwise("")
    base = base | {
        "row_key": F.col("_c.row_key"), "ledger": F.when(F.col("ledger").isin("amex", "dashboard", "card"), "card").otherwise("expense"), "date": day,
        "merchant": norm_ws(F.col("_c.merchant")), "kind": F.when(F.col("_c.amount").startswith("+") | F.lower(F.coalesce("orig_amount", F.lit(""))).contains("refund"), "refund").otherwise("charge"),
        "amount_sek": F.abs(amount).cast("decimal(18,2)"), "foreign_amount": foreign, "foreign_currency": code, "status_hint": F.col("set"), "search": skip == "", "skip_reason": skip,
        "known_message_id": F.regexp_extract(F.coalesce("expected_message_id", F.lit("")), "^([0-9a-f]{16})$", 1),
    }
    return rows.select(*[base[c].alias(c) for c in WORKLIST])


def read_expense_export(spark: SparkSession, path: str) -> DataFrame:
    """Expense export: every cell as text, names trimmed, then typed."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    raw = raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns])

    def col(name):
        return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit("")))

    amount = F.abs(parse_money(col("Amount"), "archive"))
    code = F.upper(col("Orig. currency"))
    foreign = F.when((code != "") & (code != "SEK"), F.abs(parse_money(col("Orig. amount"), "archive")))
    return raw.select(
        parse_date(col("Date")).alias("date"),
        col("Receipt").alias("receipt_no"),
        col("Expense ID").alias("expense_id"),
        col("Expense Type").alias("type"),
        norm_ws(F.col("`Source description`")).alias("merchant"),
        F.coalesce(amount, F.lit(0)).cast("decimal(18,2)").alias("amount_sek"),
        foreign.cast("decimal(18,2)").alias("foreign_amount"),
        F.when(foreign.isNotNull(), code).alias("foreign_currency"),
        col("Export Status").alias("export_status"),
        (col("Receipt urls") != "").alias("has_receipt"),
        ((col("Expense Type") != "") & ~F.lower(col("Expense Type")).contains("card")).alias("payout"),
    )


RUN_SCHEMA = (
    "run struct<run_date:string,run_at:string,mailbox:string>, "
    "rows array<struct<row_key:string,expense_id:string,queries:array<struct<kind:string,ids:bigint>>,candidates:bigint,best:string>>, _bad string"
)


def _run_documents(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``value`` and the parsed ``doc`` of every document: a line where any line of the file is a run, else the file."""

    def parsed(df: DataFrame) -> DataFrame:
        doc = F.from_json("value", RUN_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        return df.withColumn("doc", doc).withColumn("good", F.coalesce(F.col("doc._bad").isNull() & F.col("doc.rows").isNotNull(), F.lit(False)))

    def texts(**options) -> DataFrame:
        text = F.regexp_replace("value", "^\ufeff", "")
        return spark.read.text(path, **options).select(F.col("_metadata.file_path").alias("file"), text.alias("value"))

    lines = parsed(texts().filter(F.trim("value") != ""))
    by_line = lines.filter("good").select("file").distinct()
    whole = parsed(texts(wholetext=True).join(by_line, "file", "left_anti").filter(F.trim("value") != ""))
    # More than one document, or anything after it, would be left unread.
    alone = F.size(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")) == 1
    whole = whole.withColumn("good", F.col("good") & F.coalesce(alone, F.lit(False)))
    return lines.join(by_line, "file", "left_semi").unionByName(whole)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of enveloped run files with their run's facts, of files that are one document, indented or not, and of files of one per line."""
    good = _run_documents(spark, path).filter("good").select("doc.*")
    run_date = F.coalesce(F.nullif("run.run_date", F.lit("")), F.left("run.run_at", F.lit(10)))
    return good.select("run.run_at", run_date.alias("run_date"), "run.mailbox", F.inline("rows"))


def unreadable_runs(spark: SparkSession, path: str) -> DataFrame:
    """``file`` and ``value`` of what ``read_runs`` cannot read: lines of line-wise files, or whole files."""
    return _run_documents(spark, path).filter("NOT good").select("file", "value")


def parse_worklist(lines: DataFrame) -> DataFrame:
    """Items of free-text worklists, each under the heading above it.

    ``lines``: file, pos, line. An item needs a seven-digit number; a trailing status word goes.
    """
    line = F.rtrim("line")
    heading = F.when(line.rlike(r"^\d+\. .+$"), F.struct(F.regexp_extract(line, r"^(\d+)\. ", 1).cast("int").alias("group_no"), F.trim(F.regexp_extract(line, r"^\d+\. (.+)$", 1)).alias("heading")))
    carried = carry_down(lines.withColumn("_h", heading), ["file"], ["pos"], "_h", "_under")
    shape = r"^- (\d{7})\s+(?:(\d{4}-\d{2}-\d{2})\s+)?(.+)$"
    rest = F.trim(F.regexp_extract(line, shape, 3))
    words = F.filter(F.split(rest, r"\s{2,}"), lambda c: c != "")
    problem = F.regexp_replace(F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " "), r"\s*\((EXPORTED|QUEUED|NOT_EXPORTED)\)\s*$", "")
    items = carried.filter(line.rlike(shape) & F.col("_under").isNotNull())
    return items.select(
        "file", "pos", "_under.group_no", "_under.heading", F.regexp_extract(line, shape, 1).alias("receipt_no"),
        F.try_to_date(F.nullif(F.regexp_extract(line, shape, 2), F.lit("")), "yyyy-MM-dd").alias("date"), F.trim(problem).alias("problem"),
    )


def read_worklist_lines(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.split("value", "\r?\n").alias("_l"))
    return whole.select("file", F.posexplode("_l").alias("pos", "line"))


def plan_summary(manifest: DataFrame, executed: DataFrame, uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plans per month, plan rows) from stored manifests with what was executed and uploaded.

    A row with a payload is planned; one without carries its reason in the status.
    """
    planned = F.coalesce("voucher_payload", F.lit("")) != ""
    reason = F.coalesce(F.nullif(F.trim(F.regexp_replace("status", r"^excluded\s*", "")), F.lit("")), F.lit("utan angiven orsak"))
    amount = F.abs(parse_money(F.col("amount"), "archive"))
    vouchers = executed.filter(F.col("voucher_number").isNotNull()).select(
        "month", "ref", F.trim(F.concat_ws(" ", "voucher_series", F.col("voucher_number").cast("string"))).alias("voucher")
    )
    sent = uploads.select("month", "ref", F.lit(True).alias("uploaded")).distinct()
    rows = (
        manifest.withColumn("planned", planned)
        .withColumn("reason", F.when(~planned, reason))
        .join(vouchers, ["month", "ref"], "left")
        .join(sent, ["month", "ref"], "left")
        .withColumn("uploaded", F.coalesce("uploaded", F.lit(False)))
        .withColumn("amount_sek", amount)
    )
    plans = rows.groupBy("month").agg(
        F.count_if("planned").alias("vouchers"),
        F.count_if(F.col("planned") & (F.coalesce("receipt_file", F.lit("")) != "")).alias("proofs"),
        F.count_if("uploaded").alias("uploaded"),
        F.count("voucher").alias("booked"),
        F.coalesce(F.sum(F.when(F.col("planned"), F.col("amount_sek"))), F.lit(0)).cast("decimal(18,2)").alias("total_sek"),
    )
    return plans, rows
