"""The evidence archive: identity, merge policy, arbitration, plausibility, lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import month_of
from ..functions.money import MONEY, format_money
from ..functions.scale import exploded, first_by, number_rows
from ..session import settle
from .texts import amount_in_text, buyer_entity, dates_of, vendor_in_text

# How much each kind of source is worth when two describe one record.
SOURCE_RANK = {"mail": 3, "portal": 2, "export": 2, "paper": 2, "manual": 1}
SOURCE_COLUMNS = ["source_kind", "source_ref", "source_from"]
# Column policies on merge: ids and notes fill a blank, booking results overwrite.
FILL_COLUMNS = ["expense_id", "card_ref", "vendor", "note", "invoice_number"]
OVERWRITE_COLUMNS = ["voucher", "booking_status"]


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def source_rank(kind: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in SOURCE_RANK.items() for x in pair])
    return F.coalesce(F.element_at(ranks, F.coalesce(kind, F.lit("manual"))), F.lit(1))


# --------------------------------------------------------------------------- files

def keep_attachments(df: DataFrame, name: str, mime: str, size: str, small_image: int = 5000) -> DataFrame:
    """Verdict per attachment: terms files and tiny images are junk, only PDF and images are kept."""
    file = F.lower(F.coalesce(name, F.lit("")))
    ext = F.regexp_extract(file, r"(\.[a-z0-9]+)$", 1)
    kind = F.lower(F.coalesce(mime, F.lit("")))
    image = kind.startswith("image/") | ext.isin(".png", ".jpg", ".jpeg", ".gif", ".webp", ".tif", ".tiff", ".bmp", ".heic")
    reason = (
        F.when(file.rlike("terms|condition|agreement") | file.rlike("(^|[^a-z])tos([^a-z]|$)"), "terms or conditions file")
        .when(image & (F.col(size) < small_image), "junk image")
        .when(~image & (kind != "application/pdf") & (ext != ".pdf"), "neither pdf nor image")
    )
    return df.withColumn("reason", F.coalesce(reason, F.lit(""))).withColumn("keep", F.col("reason") == "")


def file_inventory(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Number, suffix, extension, content hash and size of evidence files, from their names and bytes."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return files.select(
        path,
        name.alias("name"),
        F.coalesce(
            F.nullif(F.regexp_extract(name, r"^(\d+)[a-z]?\.[A-Za-z0-9]+$", 1), F.lit("")),
            F.nullif(F.regexp_extract(name, r"^([^_]+)_", 1), F.lit("")),
        ).alias("number"),
        F.regexp_extract(name, r"^\d+([a-z])\.[A-Za-z0-9]+$", 1).alias("suffix"),
        F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1)).alias("ext"),
        F.sha2(content, 256).alias("sha"),
        F.length(content).cast("bigint").alias("bytes"),
    )


def same_file_groups(files: DataFrame) -> DataFrame:
    """Byte-identical files under two or more numbers; an a/b pair under one number is none.

    The numbers are counted before they are listed, and only hashes that do repeat are listed.
    """
    distinct = files.select("sha", "number").distinct()
    shared = distinct.groupBy("sha").agg(F.count(F.lit(1)).alias("numbers")).filter(F.col("numbers") > 1)
    return distinct.join(shared, "sha").select("sha", "number", "numbers")


def orphan_files(files: DataFrame, charges: DataFrame) -> DataFrame:
    return files.join(charges.select(F.col("ref").alias("number")).distinct(), "number", "left_anti")


def missing_evidence(charges: DataFrame, files: DataFrame) -> DataFrame:
    """Business charges no file is named after."""
    named = files.select(F.col("number").alias("ref")).distinct()
    return charges.filter(F.col("tag") == "business").join(named, "ref", "left_anti")


def link_check(records: DataFrame, files: DataFrame) -> DataFrame:
    """Listed files that do not exist, and files no record lists."""
    listed = records.select("id", F.explode("files").alias("name"))
    broken = listed.join(files.select("name").distinct(), "name", "left_anti").select("name", "id", F.lit("missing").alias("problem"))
    orphan = files.select("name").distinct().join(listed.select("name").distinct(), "name", "left_anti")
    return broken.unionByName(orphan.select("name", F.lit(None).cast("string").alias("id"), F.lit("orphan").alias("problem")))


def extract_text(df: DataFrame, extractor, key: str, content: str) -> DataFrame:
    """Run a pluggable text extractor over a table of files, one Arrow batch at a time.

    ``extractor`` maps bytes to (text, method, pages) and may raise; a failed file comes back with
    its error and no text, so one bad file never stops the job.
    """
    import pandas as pd

    field = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for k, body in zip(pdf[key], pdf[content]):
                try:
                    text, method, pages = extractor(body)
                    out.append((k, text, method if text else "none", pages, None))
                except Exception as exc:  # noqa: BLE001 - reported per file
                    out.append((k, "", "none", 0, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(out, columns=[key, "text", "method", "pages", "error"])

    return df.select(key, content).mapInPandas(run, f"{key} {field}, text string, method string, pages int, error string")


# --------------------------------------------------------------------------- records

def normalise_record(df: DataFrame, entities: list[str]) -> tuple[DataFrame, DataFrame]:
    """(normalised records, rejected rows with the reason): entity check, positive amounts, defaults."""
    amount = F.abs(F.col("amount_sek"))
    reason = (
        F.when(~F.coalesce(F.col("entity").isin(*entities), F.lit(False)), "unknown entity")
        .when(F.col("date").isNull(), "no date")
        .when(_blank(F.trim("merchant")), "no merchant")
        .when(F.col("amount_sek").isNull() | (amount < 0.005), "no amount")
    )
    currency = F.upper(F.coalesce(F.nullif("currency", F.lit("")), F.lit("SEK")))
    card = F.coalesce(F.nullif("card", F.lit("")), F.lit("unknown"))
    lane = F.coalesce(
        F.nullif("lane", F.lit("")),
        F.when(card == "expense", "expense").when(card.startswith("card"), "card").otherwise("pocket"),
    )
    own = F.abs(F.coalesce("amount", "amount_sek"))
    rows = df.withColumn("reason", reason)
    good = rows.filter(F.col("reason").isNull()).drop("reason").withColumns(
        {
            "amount_sek": amount.cast(MONEY),
            "amount": F.when(currency == "SEK", amount).otherwise(own).cast(MONEY),
            "currency": currency,
            "card": card,
            "lane": lane,
            "kind": F.coalesce(F.nullif("kind", F.lit("")), F.lit("receipt")),
            "booking_status": F.when(
                lane.isin("card", "pocket") & _blank(F.col("voucher")) & _blank(F.col("booking_status")), "ej bokfort"
            ).otherwise(F.col("booking_status")),
        }
    )
    return good, rows.filter(F.col("reason").isNotNull())


def stem_id(stem: Column, number: Column) -> Column:
    """The id of the record that is ``number`` of its stem."""
    return F.when(number == 1, stem).otherwise(F.concat_ws("-", stem, number))


def assign_ids(records: DataFrame) -> DataFrame:
    """Unique ids: the stem, later records of one entity and year with the same stem get -2, -3."""
    rows = records.withColumn("year", F.year("date"))
    numbered = number_rows(rows, ["entity", "year", "stem"], ["created", "sha"], "_n")
    return numbered.withColumn("id", stem_id(F.col("stem"), F.col("_n"))).drop("_n", "year")


def find_records(records: DataFrame, **criteria) -> DataFrame:
    """Records meeting every criterion: vendor as a substring, month prefix, amount to half an öre."""
    rows = records
    for key, want in criteria.items():
        if want is None or want == "":
            continue
        if key == "vendor":
            text = F.lower(F.concat_ws(" ", F.coalesce("vendor", F.lit("")), F.coalesce("merchant", F.lit(""))))
            rows = rows.filter(text.contains(str(want).lower()))
        elif key == "month":
            rows = rows.filter(F.col("date").cast("string").startswith(want))
        elif key == "amount_sek":
            rows = rows.filter(F.abs(F.col("amount_sek") - F.lit(want)) <= 0.005)
        else:
            rows = rows.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) == str(want))
    return rows.orderBy("date", "id")


CHARGE = ["entity", "date", "amount_sek"]
ID_COLUMNS = ["expense_id", "card_ref"]


def match_record(incoming: DataFrame, records: DataFrame, files: DataFrame) -> DataFrame:
    """Which record an incoming document belongs to: merge, refused with a reason, or create.

    ``files``: sha and the id of the record that owns it. A known file is the same document only
    when the charge agrees and no id disagrees; an unknown file still merges into a record of the
    same charge that shares an id.
    """
    facts = records.select("id", *CHARGE, *ID_COLUMNS)
    owner = first_by(files.select("sha", "id"), ["sha"], [F.col("id")], ["id"])
    known = owner.join(facts, "id").select("sha", F.struct("id", *CHARGE, *ID_COLUMNS).alias("_o"))
    rows = incoming.join(known, "sha", "left")
    for name in ID_COLUMNS:
        by_id = facts.filter(~_blank(F.col(name))).groupBy(*CHARGE, name).agg(F.min("id").alias(f"_by_{name}"))
        rows = rows.join(by_id, [*CHARGE, name], "left")
    same = (
        (F.col("_o.entity") == F.col("entity"))
        & (F.col("_o.date") == F.col("date"))
        & (F.abs(F.col("_o.amount_sek") - F.col("amount_sek")) <= 0.005)
    )

    def conflict(name):
        return ~_blank(F.col(f"_o.{name}")) & ~_blank(F.col(name)) & (F.col(f"_o.{name}") != F.col(name))

    refused = (
        F.when(F.col("_o").isNotNull() & ~same, F.concat(F.lit("same file as "), F.col("_o.id"), F.lit(" but a different charge")))
        .when(F.col("_o").isNotNull() & conflict("expense_id"), F.concat(F.lit("same file and charge as "), F.col("_o.id"), F.lit(" but another expense")))
        .when(F.col("_o").isNotNull() & conflict("card_ref"), F.concat(F.lit("same file and charge as "), F.col("_o.id"), F.lit(" but another ref")))
    )
    target = F.when(refused.isNull(), F.coalesce(F.col("_o.id"), F.least("_by_expense_id", "_by_card_ref")))
    return (
        rows.withColumn("reason", F.coalesce(refused, F.lit("")))
        .withColumn("record_id", target)
        .withColumn(
            "outcome", F.when(F.col("reason") != "", "refused").when(F.col("record_id").isNotNull(), "merge").otherwise("create")
        )
        .drop("_o", "_by_expense_id", "_by_card_ref")
    )


ATTACHED = r"(?i)^attached\s+(\d{4}-\d{2}-\d{2})(?:\s*\((.*)\))?\s*$"
EXPORTED = r"(?i)^exported\s*\((.*)\)\s*$"


def merge_status(old: Column, new: Column) -> Column:
    """The attach date is kept and the export state rides in parentheses, whichever comes last."""
    o, n = F.trim(F.coalesce(old, F.lit(""))), F.trim(F.coalesce(new, F.lit("")))
    old_date, old_state = F.regexp_extract(o, ATTACHED, 1), F.regexp_extract(o, ATTACHED, 2)
    new_date, new_state = F.regexp_extract(n, ATTACHED, 1), F.regexp_extract(n, ATTACHED, 2)
    state = F.when(old_state != "", old_state).otherwise(F.regexp_extract(o, EXPORTED, 1))

    def ride(date, s):
        return F.concat(F.lit("attached "), date, F.lit(" ("), F.trim(s), F.lit(")"))

    return (
        F.when(n == "", o)
        .when(o == "", n)
        .when((old_date != "") & n.rlike(EXPORTED), ride(old_date, F.regexp_extract(n, EXPORTED, 1)))
        .when((new_date != "") & (new_state == "") & (state != ""), ride(new_date, state))
        .otherwise(n)
    )


def _fold(incoming: DataFrame, key: str) -> DataFrame:
    """All incoming rows of one record as one row, by each column's policy; combines before the shuffle."""
    def first(c):
        return F.min_by(F.when(~_blank(F.col(c)), F.col(c)), F.when(~_blank(F.col(c)), F.col("position"))).alias(f"in_{c}")

    def last(c):
        return F.max_by(F.when(~_blank(F.col(c)), F.col(c)), F.when(~_blank(F.col(c)), F.col("position"))).alias(f"in_{c}")

    usable = ~_blank(F.col("source_kind")) & (~_blank(F.col("source_ref")) | (F.col("source_kind") == "export"))
    order = F.when(usable, F.struct(source_rank(F.col("source_kind")), F.col("position")))
    attached = F.regexp_extract("status", ATTACHED, 1) != ""
    exported = F.col("status").rlike(EXPORTED)
    return incoming.groupBy(key).agg(
        *[first(c) for c in FILL_COLUMNS],
        *[last(c) for c in OVERWRITE_COLUMNS],
        F.max_by(F.struct(*SOURCE_COLUMNS), order).alias("in_source"),
        F.max_by(F.when(attached, F.col("status")), F.when(attached, F.col("position"))).alias("in_attached"),
        F.max_by(F.when(exported, F.col("status")), F.when(exported, F.col("position"))).alias("in_exported"),
        F.max_by(
            F.when(~attached & ~exported & ~_blank(F.col("status")), F.col("status")),
            F.when(~attached & ~exported & ~_blank(F.col("status")), F.col("position")),
        ).alias("in_other"),
    )


RECORD_COLUMNS = [
    "id", "stem", "number", "entity", "date", "amount_sek", "merchant", *FILL_COLUMNS, *OVERWRITE_COLUMNS, *SOURCE_COLUMNS, "status",
]


def highest_numbers(records: DataFrame) -> DataFrame:
    """The highest number given per entity, year and stem."""
    return records.groupBy("entity", F.year("date").alias("year"), "stem").agg(F.max("number").alias("top"))


def number_new(new: DataFrame, highest: DataFrame) -> DataFrame:
    """``id`` and ``number`` of new records: numbers go on from the highest of the stem, by position."""
    rows = number_rows(new.withColumn("year", F.year("date")), ["entity", "year", "stem"], ["position"], "_n")
    rows = rows.join(highest, ["entity", "year", "stem"], "left").withColumn("number", F.coalesce("top", F.lit(0)) + F.col("_n"))
    return rows.withColumn("id", stem_id(F.col("stem"), F.col("number"))).drop("_n", "top", "year")


def _place_batch(incoming: DataFrame, records: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where the documents of a batch go: (merges: position, record_id; opened: position, id, number;
    refused: position, reason).

    In rounds. Documents are matched against the records there are; of those that match none, the
    ones with no earlier fellow in the round of the same file, or of the same charge and id, open
    records; the rest look again. Only keys take part, and a hot file or charge is one aggregated row.
    """
    keys = ["position", "sha", "stem", *CHARGE, *ID_COLUMNS]
    pending, known = incoming.select(*keys), files.select("sha", "id")
    facts = records.select("id", "stem", "number", *CHARGE, *ID_COLUMNS)
    merges, opened, refused = [], [], []
    while True:
        judged = settle(match_record(pending, facts, known))
        merged = judged.filter(F.col("outcome") == "merge")
        merges.append(merged.select("position", "record_id"))
        refused.append(judged.filter(F.col("outcome") == "refused").select("position", "reason"))
        rest = judged.filter(F.col("outcome") == "create").select(*keys)
        first, lead = F.lit(True), rest
        live = judged.filter(F.col("outcome") != "refused")
        for number, by in enumerate((["sha"], [*CHARGE, "expense_id"], [*CHARGE, "card_ref"])):
            named = live.filter(~_blank(F.col(by[-1])))
            lead = lead.join(named.groupBy(*by).agg(F.min("position").alias(f"_first_{number}")), by, "left")
            first = first & F.coalesce(F.col("position") == F.col(f"_first_{number}"), F.lit(True))
        new = settle(number_new(lead.filter(first).select(*keys), highest_numbers(facts)))
        opened.append(new.select("position", "id", "number"))
        pending = settle(rest.join(new.select("position"), "position", "left_anti"))
        if pending.isEmpty():
            break
        # What a merge fills in counts in the next round, and so do its files.
        filled = merged.groupBy(F.col("record_id").alias("id")).agg(
            *(F.min_by(F.when(~_blank(F.col(c)), F.col(c)), F.when(~_blank(F.col(c)), F.col("position"))).alias(f"in_{c}") for c in ID_COLUMNS)
        )
        ids = [F.when(_blank(F.col(c)), F.coalesce(f"in_{c}", c)).otherwise(F.col(c)).alias(c) for c in ID_COLUMNS]
        kept = facts.join(filled, "id", "left").select("id", "stem", "number", *CHARGE, *ids)
        facts = settle(kept.unionByName(new.select("id", "stem", "number", *CHARGE, *ID_COLUMNS)))
        known = settle(known.unionByName(_new_files(known, merged.select("sha", F.col("record_id").alias("id"), "position").unionByName(new.select("sha", "id", "position")))))

    def every(parts: list[DataFrame]) -> DataFrame:
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    return every(merges), every(opened), every(refused)


def _new_files(known: DataFrame, placed: DataFrame) -> DataFrame:
    """Files not known yet, each with the record of the first document that brought it."""
    new = placed.join(known.select("sha"), "sha", "left_anti")
    return new.groupBy("sha").agg(F.min_by("id", "position").alias("id"))


def upsert_touched(records: DataFrame, files: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records a batch touches, as they are after it, with their outcome; new files; refused rows).

    ``incoming`` carries ``position``, its order in the batch, and ``stem``. ``records`` and ``files``
    need hold no more of the archive than what the batch can meet: the records that own one of
    its files, share a charge and an id with it, or have one of its stems. All three are read several
    times and should be settled.
    """
    placed_merges, placed_new, refused = _place_batch(incoming, records, files)
    merges = settle(incoming.join(placed_merges, "position"))
    opened = incoming.drop("id", "number").join(placed_new, "position")
    new_files = settle(
        _new_files(files, merges.select("sha", F.col("record_id").alias("id"), "position").unionByName(opened.select("sha", "id", "position")))
    )
    folded = _fold(merges, "record_id").withColumnRenamed("record_id", "id")
    more = new_files.groupBy("id").agg(F.count(F.lit(1)).alias("_files"))
    met = records.select(*RECORD_COLUMNS).join(folded.select("id"), "id", "left_semi")
    base = met.withColumn("_new", F.lit(False)).unionByName(opened.select(*RECORD_COLUMNS).withColumn("_new", F.lit(True)))
    rows = base.join(folded, "id", "left").join(more, "id", "left")
    # Step by step: each reads the one before several times.
    rows = rows.withColumn("_status", merge_status(F.col("status"), F.col("in_other")))
    rows = rows.withColumn("_status", merge_status(F.col("_status"), F.col("in_exported")))
    updates: dict[str, Column] = {c: F.when(_blank(F.col(c)), F.coalesce(F.col(f"in_{c}"), F.col(c))).otherwise(F.col(c)) for c in FILL_COLUMNS}
    updates |= {c: F.coalesce(F.col(f"in_{c}"), F.col(c)) for c in OVERWRITE_COLUMNS}
    old_rank, new_rank = source_rank(F.col("source_kind")), source_rank(F.col("in_source.source_kind"))
    poorer = (new_rank == old_rank) & _blank(F.col("in_source.source_ref")) & ~_blank(F.col("source_ref"))
    take = F.col("in_source.source_kind").isNotNull() & (new_rank >= old_rank) & ~poorer
    updates |= {c: F.when(take, F.col(f"in_source.{c}")).otherwise(F.col(c)) for c in SOURCE_COLUMNS}
    rows = rows.withColumn("_status", merge_status(F.col("_status"), F.col("in_attached")))
    updates["status"] = F.col("_status")
    changed = F.col("_files").isNotNull()
    for c, new in updates.items():
        changed = changed | ~F.coalesce(F.col(c), F.lit("")).eqNullSafe(F.coalesce(new, F.lit("")))
    flagged = rows.withColumn("_changed", changed)
    fixed = [c for c in RECORD_COLUMNS if c not in updates]
    touched = flagged.select(
        *fixed,
        *[u.alias(c) for c, u in updates.items()],
        F.when(F.col("_new"), "created").when(F.col("_changed"), "updated").otherwise("unchanged").alias("outcome"),
    )
    return settle(touched.select(*RECORD_COLUMNS, "outcome")), new_files, incoming.join(refused, "position")


def upsert_archive(records: DataFrame, files: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the whole archive after a batch, with its outcome per record; all files; refused incoming rows).

    Running the same batch again changes nothing. ``archive_log`` does the same for an archive on
    disk and rewrites only what a batch touches.
    """
    touched, new_files, refused = upsert_touched(records, files, settle(incoming))
    rest = records.select(*RECORD_COLUMNS).join(touched.select("id"), "id", "left_anti").withColumn("outcome", F.lit("unchanged"))
    return rest.unionByName(touched), files.select("sha", "id").unionByName(new_files), refused


SETTABLE = {"receipt_date", "vendor", "note", "voucher", "booking_status", "status", "invoice_number", "source_kind", "card_ref"}
REQUIRED = {"vendor", "source_kind"}


def patch(records: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patched records with outcome, rejected changes with reason).

    ``changes``: id, key, value, line; the last accepted line per key wins. A required key cannot
    be emptied, an unknown or derived key cannot be set.
    """
    keyed = changes.join(records.select("id", F.lit(True).alias("_known")), "id", "left")
    reason = (
        F.when(F.col("_known").isNull(), "unknown id")
        .when(~F.col("key").isin(*SETTABLE), "not settable")
        .when(F.col("key").isin(*REQUIRED) & _blank(F.trim("value")), "cannot be emptied")
        .when((F.col("key") == "source_kind") & ~F.col("value").isin(*SOURCE_RANK), "unknown source kind")
    )
    judged = keyed.withColumn("reason", reason).drop("_known")
    accepted = judged.filter(F.col("reason").isNull()).groupBy("id", "key").agg(F.max_by("value", "line").alias("value"))
    present = [c for c in records.columns if c in SETTABLE]
    wide = accepted.groupBy("id").agg(
        *[F.max(F.when(F.col("key") == c, F.struct(F.trim("value").alias("v")))).alias(f"_{c}") for c in present]
    )
    rows = records.join(wide, "id", "left")
    changed = F.lit(False)
    values = {}
    for c in present:
        new = F.when(F.col(f"_{c}").isNotNull(), F.nullif(F.col(f"_{c}.v"), F.lit(""))).otherwise(F.col(c))
        changed = changed | ~new.eqNullSafe(F.col(c))
        values[c] = new
    out = rows.withColumn("outcome", F.when(changed, "updated").otherwise("unchanged")).withColumns(values)
    return out.drop(*[f"_{c}" for c in present]), judged.filter(F.col("reason").isNotNull())


def sync_results(archive: DataFrame, steps: DataFrame) -> DataFrame:
    """Booking results by ref carried onto records: updated, unchanged, no_page, no_voucher.

    ``steps``: ref, voucher_series, voucher_number, booked_on.
    """
    pages = archive.filter(~_blank(F.col("card_ref"))).groupBy("card_ref").agg(
        F.min_by(F.struct("id", "voucher", "booking_status"), F.struct("date", "id")).alias("_p")
    )
    voucher = F.trim(F.concat_ws(" ", "voucher_series", F.col("voucher_number").cast("string")))
    status = F.trim(F.concat_ws(" ", F.lit("bokfort"), F.col("booked_on").cast("string")))
    rows = steps.join(pages, F.col("ref") == F.col("card_ref"), "left")
    outcome = (
        F.when(F.col("voucher_number").isNull(), "no_voucher")
        .when(F.col("_p").isNull(), "no_page")
        .when(F.col("_p.voucher").eqNullSafe(voucher) & F.col("_p.booking_status").eqNullSafe(status), "unchanged")
        .otherwise("updated")
    )
    return rows.select(
        "ref",
        F.col("_p.id").alias("record_id"),
        F.when(F.col("voucher_number").isNotNull(), voucher).alias("voucher"),
        F.when(F.col("voucher_number").isNotNull(), status).alias("booking_status"),
        outcome.alias("outcome"),
    )


# --------------------------------------------------------------------------- arbitration and warnings

def text_fit(rows: DataFrame, text: str) -> DataFrame:
    """How well a document fits a charge: its amount printed, then the nearest printed date."""
    hit = amount_in_text(F.col(text), F.col("amount"), F.col("amount_sek"))
    gaps = F.flatten(
        F.transform(dates_of(F.col(text)), lambda d: F.transform(d["readings"], lambda x: F.abs(F.datediff(x, F.col("date")))))
    )
    return rows.withColumn("amount_hit", hit.cast("int")).withColumn("gap", F.coalesce(F.array_min(gaps), F.lit(1000000)))


def arbitrate_shared(rows: DataFrame) -> DataFrame:
    """Among rows sharing one file but not one charge the best text fit owns it, the rest are refused.

    ``rows``: sha, position, entity, date, amount_sek, amount_hit, gap. One aggregate per file,
    combined before the shuffle, tells both the owner and whether the charges differ.
    """
    charge = F.struct("entity", "date", "amount_sek")
    verdict = rows.groupBy("sha").agg(
        F.min_by("position", F.struct(-F.col("amount_hit"), F.col("gap"), F.col("position"))).alias("owner"),
        (F.min(charge) != F.max(charge)).alias("contested"),
    )
    joined = rows.join(verdict, "sha")
    return joined.withColumn(
        "verdict",
        F.when(~F.col("contested"), "uncontested").when(F.col("position") == F.col("owner"), "owner").otherwise("refused"),
    )


def duplicate_invoices(archive: DataFrame) -> DataFrame:
    """Records whose invoice number is also on a record of another charge; credit notes aside.

    Charges are first reduced to one row per invoice number, so a number on very many records
    never meets itself pair by pair.
    """
    rows = archive.filter(~_blank(F.col("invoice_number")) & (F.col("kind") != "credit-note"))
    charges = rows.groupBy("invoice_number", "date", "amount_sek").agg(F.min("id").alias("other_id"))
    first = Window.partitionBy("invoice_number").orderBy("other_id")
    two = (
        charges.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= 2)
        .groupBy("invoice_number")
        .agg(
            F.max(F.when(F.col("_n") == 1, F.struct("date", "amount_sek", "other_id"))).alias("_a"),
            F.max(F.when(F.col("_n") == 2, F.struct("date", "amount_sek", "other_id"))).alias("_b"),
        )
        .filter(F.col("_b").isNotNull())
    )
    own = (F.col("_a.date") == F.col("date")) & (F.col("_a.amount_sek") == F.col("amount_sek"))
    other = F.when(own, F.col("_b")).otherwise(F.col("_a"))
    return rows.join(two, "invoice_number").select(
        "id", "invoice_number", other["other_id"].alias("other_id"), other["date"].alias("other_date"), other["amount_sek"].alias("other_amount")
    )


def plausibility(records: DataFrame, companies: dict[str, str], early: int = 10, late: int = 7) -> DataFrame:
    """(id, kind, text) for every fact on a record that does not fit its charge."""
    gap = F.datediff("date", "receipt_date")
    has_text = ~_blank(F.col("text")) & (F.coalesce("text_method", F.lit("none")) != "none")
    printed = amount_in_text(F.col("text"), F.col("amount"), F.col("amount_sek"))
    buyer = buyer_entity(F.col("text"), companies)

    def warning(condition, kind, *text):
        return F.when(condition, F.struct(F.lit(kind).alias("kind"), F.concat(*text).alias("text")))

    own = F.array_compact(
        F.array(
            warning(gap > early, "earlier-period", F.lit("receipt_date "), F.col("receipt_date").cast("string"), F.lit(" is "), gap.cast("string"), F.lit(" days before the charge date "), F.col("date").cast("string")),
            warning(-gap > late, "later-period", F.lit("receipt_date "), F.col("receipt_date").cast("string"), F.lit(" is "), (-gap).cast("string"), F.lit(" days after the charge date "), F.col("date").cast("string")),
            warning(has_text & ~printed, "amount-missing", F.lit("charge amount "), format_money(F.col("amount_sek")), F.lit(" not found in the receipt text")),
            warning(has_text & ~vendor_in_text(F.col("text"), F.col("vendor"), F.col("merchant")), "vendor-missing", F.lit("vendor "), F.coalesce("vendor", "merchant"), F.lit(" not named in the receipt text")),
            warning(has_text & (buyer != F.col("entity")), "other-company", F.lit("receipt is made out to "), buyer, F.lit(" but filed under "), F.col("entity")),
        )
    )
    facts = exploded(records, ["id"], own, "_w").select("id", "_w.*")
    twins = duplicate_invoices(records).select(
        "id",
        F.lit("duplicate-invoice").alias("kind"),
        F.concat(F.lit("invoice_number "), "invoice_number", F.lit(" is also on "), "other_id").alias("text"),
    )
    return facts.unionByName(twins)


def lint(records: DataFrame, files: DataFrame, required: list[str]) -> DataFrame:
    """findings(severity, rule, id, text) over records and stored files.

    ``records``: stem, folder_entity, folder_year, files, sha256 and the required columns;
    ``files``: name, sha. Both are read once; the rules that compare rows work on narrow rows.
    """
    missing = F.array_compact(F.array(*[F.when(_blank(F.col(c).cast("string")), F.lit(c)) for c in required]))
    rows = records.withColumn("_missing", missing)

    def rule(condition, severity, name, text):
        return F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("rule"), text.alias("text")))

    own = F.array_compact(
        F.array(
            rule(F.size("_missing") > 0, "error", "required", F.array_join("_missing", ", ")),
            rule(~F.col("id").eqNullSafe(F.col("stem")), "error", "id", F.coalesce("id", F.lit(""))),
            rule(~F.col("entity").eqNullSafe(F.col("folder_entity")), "error", "entity", F.coalesce("entity", F.lit(""))),
            rule(~F.year("date").eqNullSafe(F.col("folder_year")), "error", "year", F.coalesce(F.col("date").cast("string"), F.lit(""))),
            rule(F.size(F.coalesce("files", F.array().cast("array<string>"))) == 0, "error", "files", F.lit("")),
            rule(_blank(F.col("text")), "warning", "no-text", F.lit("")),
        )
    )
    narrow = settle(rows.select(F.col("stem").alias("id"), "sha256", "files", own.alias("_own")))
    files = settle(files.select("name", "sha"))
    per_row = exploded(narrow, ["id"], F.col("_own"), "_f").select("_f.severity", "_f.rule", "id", "_f.text")
    links = link_check(narrow.select("id", "files"), files)
    broken = links.select(
        F.when(F.col("problem") == "missing", "error").otherwise("warning").alias("severity"),
        F.concat(F.col("problem"), F.lit("-file")).alias("rule"),
        F.coalesce("id", F.lit("")).alias("id"),
        F.col("name").alias("text"),
    )
    primary = narrow.select("id", "sha256", F.try_element_at("files", F.lit(1)).alias("name"))
    altered = primary.join(files.select("name", "sha"), "name").filter(~F.col("sha").eqNullSafe(F.col("sha256")))
    altered = altered.select(F.lit("error").alias("severity"), F.lit("hash").alias("rule"), "id", F.col("name").alias("text"))
    first = narrow.filter(~_blank(F.col("sha256"))).groupBy("sha256").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    twins = narrow.join(first.filter(F.col("n") > 1), "sha256").filter(F.col("id") != F.col("first"))
    twins = twins.select(F.lit("error").alias("severity"), F.lit("same-hash").alias("rule"), "id", F.col("first").alias("text"))
    return per_row.unionByName(broken).unionByName(altered).unionByName(twins)


# --------------------------------------------------------------------------- ingest and figures

def ingest_jobs(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Per source row whether it becomes an archive job, and if not why."""
    kept = keep_attachments(files, "name", "mime", "bytes")
    per = kept.groupBy("number").agg(F.count(F.lit(1)).alias("_files"), F.count_if("keep").alias("kept_files"))
    joined = rows.join(per.withColumnRenamed("number", "receipt_no"), "receipt_no", "left")
    reason = (
        F.when(F.lower("type").startswith("reimbursement"), "reimbursement row, not a receipt")
        .when(F.col("type") != "Card Purchase", F.concat(F.lit("expense type "), "type"))
        .when(F.coalesce("tag", F.lit("business")) != "business", F.concat(F.lit("tag "), "tag"))
        .when(F.col("_files").isNull(), "no file")
        .when(F.col("date").isNull() | F.col("amount_sek").isNull(), "unreadable date or amount")
        .when(F.col("kept_files") == 0, "only junk files")
    )
    return joined.withColumn("skip_reason", F.coalesce(reason, F.lit(""))).withColumn(
        "kept_files", F.coalesce("kept_files", F.lit(0))
    ).drop("_files")


def archive_months(archive: DataFrame) -> DataFrame:
    """Records, signed amount, lanes and status classes per month; credit notes count negative."""
    signed = F.when(F.col("kind") == "credit-note", -F.col("amount_sek")).otherwise(F.col("amount_sek"))
    status = F.coalesce("status", F.lit(""))
    booking = F.coalesce("booking_status", F.lit(""))
    return archive.groupBy(month_of(F.col("date")).alias("month")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(signed).cast(MONEY).alias("amount_sek"),
        F.count_if(F.col("lane") == "expense").alias("expense_lane"),
        F.count_if(F.col("lane").startswith("card")).alias("card_lane"),
        F.count_if(status.startswith("attached")).alias("attached"),
        F.count_if(status.startswith("exported")).alias("exported"),
        F.count_if(status == "").alias("no_status"),
        F.count_if(booking.startswith("bokfort")).alias("booked"),
        F.count_if(booking.startswith("ej")).alias("open"),
    )


def text_methods(archive: DataFrame) -> DataFrame:
    return archive.groupBy(F.coalesce("text_method", F.lit("none")).alias("method")).agg(F.count(F.lit(1)).alias("n"))


# Words that tell the kind of a warning from its text, in the order they are tried.
WARNING_KINDS = [
    ("is also on", "duplicate-invoice"),
    ("days before the charge date", "earlier-period"),
    ("days after the charge date", "later-period"),
    ("made out to", "other-company"),
    ("not found in the receipt text", "amount-missing"),
    ("not named in the receipt text", "vendor-missing"),
    ("not referenced", "orphan-file"),
    ("index.md", "index-stale"),
]


def warning_kind(text: Column) -> Column:
    kind = F.lit("other")
    for needle, name in reversed(WARNING_KINDS):
        kind = F.when(text.contains(needle), name).otherwise(kind)
    return kind


def warning_kinds(warnings: DataFrame) -> DataFrame:
    """Warnings per kind, most frequent first."""
    counted = warnings.groupBy(warning_kind(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "kind")
