"""Status of every row, month, source and open task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import last_full_month, month_add, month_end, month_of
from ..functions.money import MONEY
from ..functions.scale import first_by, number_rows


def _money(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)


def _count(rows: DataFrame, condition: Column | None = None) -> Column:
    """How many ledger rows, one by one or as ``ledger_facts`` holds them."""
    each = F.col("row_count") if "row_count" in rows.columns else F.lit(1)
    return F.coalesce(F.sum(each if condition is None else F.when(condition, each)), F.lit(0)).cast("bigint")


# --------------------------------------------------------------------------- expense export

def export_profile(expenses: DataFrame) -> DataFrame:
    """Counts by type, owner, export status, and missing evidence by type, in one long table."""
    facets = F.array(
        *[F.struct(F.lit(n).alias("facet"), F.col(c).cast("string").alias("value")) for n, c in (("type", "type"), ("owner", "owner"), ("export_status", "export_status"))],
        F.when(~F.col("has_receipt"), F.struct(F.lit("missing").alias("facet"), F.col("type").alias("value"))),
        F.struct(F.lit("all").alias("facet"), F.lit("").alias("value")),
    )
    long = expenses.select("date", F.explode(F.array_compact(facets)).alias("_f"))
    return long.groupBy("_f.facet", "_f.value").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def expense_months(expenses: DataFrame) -> DataFrame:
    """Monthly expense figures and a total row (month null)."""
    missing = ~F.col("has_receipt") & ~F.col("payout")
    payout = ~F.col("has_receipt") & F.col("payout")
    status = F.upper("export_status")
    return expenses.rollup("month").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("has_receipt").alias("with_receipt"),
        F.count_if(missing).alias("missing"),
        F.count_if(payout).alias("payouts"),
        _money(F.col("amount_sek")).alias("amount_sek"),
        _money(F.when(missing, F.col("amount_sek"))).alias("missing_sek"),
        _money(F.when(payout, F.col("amount_sek"))).alias("payouts_sek"),
        F.count_if(status == "EXPORTED").alias("exported"),
        F.count_if(status == "QUEUED").alias("queued"),
        F.count_if(~status.isin("EXPORTED", "QUEUED")).alias("not_exported"),
    )


def payout_gaps(expenses: DataFrame) -> DataFrame:
    """Per payout row how many entries it reconciles and how many of them the export lacks."""
    entries = expenses.filter(F.col("payout")).select(
        "expense_id", F.explode(F.array_distinct(F.transform(F.split("reconciled", ","), lambda e: F.trim(e)))).alias("entry")
    ).filter(F.col("entry") != "")
    present = expenses.select(F.col("expense_id").alias("entry"), F.lit(True).alias("_in")).distinct()
    return entries.join(present, "entry", "left").groupBy("expense_id").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("_in").isNull()).alias("absent")
    )


def missing_route(rows: DataFrame, app_word: str = "KIVRA") -> DataFrame:
    """Where a missing document is to be found, and who has to go there.

    ``rows`` carries the vendor's ``route_if_none`` and ``portal`` (null without a vendor).
    """
    fallback = F.coalesce("route_if_none", F.lit("none"))
    portal = F.nullif("portal", F.lit(""))
    route = (
        F.when(F.upper("merchant").contains(app_word), "app")
        .when(F.lower(F.coalesce("type", F.lit(""))).contains("out of pocket"), "pocket")
        .when(fallback.isin("portal", "request"), "portal")
        .when(fallback == "ask", "ask")
        .otherwise("mailbox")
    )
    hint = (
        F.when(F.col("route") == "app", "the operator downloads it in the app")
        .when(F.col("route") == "pocket", F.coalesce(portal, F.lit("attach to the expense")))
        .when(F.col("route") == "portal", F.coalesce(portal, F.lit("the vendor's portal")))
        .when(F.col("route") == "ask", F.coalesce(portal, F.lit("ask the accountant")))
        .otherwise("search the mailbox and attach")
    )
    owner = F.when(F.col("route").isin("app", "pocket"), "operator").when(F.col("route") == "ask", "accountant").otherwise("system")
    return rows.withColumn("route", route).withColumn("hint", hint).withColumn("owner", owner)


def enrich_live(live: DataFrame, export: DataFrame, attached: DataFrame) -> DataFrame:
    """The live list completed from the export by expense id, else receipt number.

    A row whose expense has since been given its document keeps its place with route ``attached``.
    """
    facts = F.struct("expense_id", "merchant", "amount_sek", "type", "export_status", "date")
    by_id = first_by(export.filter(F.col("expense_id") != ""), ["expense_id"], [F.col("receipt_no")], ["receipt_no", "merchant", "amount_sek", "type", "export_status", "date"])
    by_no = first_by(export.filter(F.col("receipt_no") != ""), ["receipt_no"], [F.col("expense_id")], ["expense_id", "merchant", "amount_sek", "type", "export_status", "date"])
    a = by_id.select(F.col("expense_id").alias("_id"), facts.alias("_a"))
    c = by_no.select(F.col("receipt_no").alias("_no"), facts.alias("_c"))
    rows = live.join(a, F.nullif("expense_id", F.lit("")) == F.col("_id"), "left").join(
        c, F.nullif("receipt_no", F.lit("")) == F.col("_no"), "left"
    )
    full = {
        name: F.coalesce(F.nullif(F.col(name), F.lit("")), F.col(f"_a.{name}"), F.col(f"_c.{name}"), F.lit(""))
        for name in ("expense_id", "merchant", "type", "export_status")
    }
    full["amount_sek"] = F.coalesce("amount_sek", "_a.amount_sek", "_c.amount_sek", F.lit(0).cast(MONEY)).cast(MONEY)
    full["date"] = F.coalesce("date", "_a.date", "_c.date")
    done = rows.withColumns(full).drop("_id", "_a", "_no", "_c")
    since = attached.select("expense_id", F.col("status").alias("attached_status"))
    out = done.join(since, "expense_id", "left")
    return out.withColumn("route", F.when(F.col("attached_status").isNotNull(), "attached").otherwise(F.col("route")))


def work_by_route(live: DataFrame) -> DataFrame:
    """Open rows per route with their owner; rows attached since are no work."""
    return live.filter(F.col("route") != "attached").groupBy("route", "owner").agg(
        F.count(F.lit(1)).alias("n"), _money(F.col("amount_sek")).alias("amount_sek")
    )


def flag_status(items: DataFrame, baseline: DataFrame, newest: DataFrame, attached: DataFrame) -> DataFrame:
    """Whether a flagged item has been dealt with, by comparing two snapshots of its files.

    ``items``: receipt_no, expense_id; snapshots: receipt_no, sha (null for a row without a file).
    The file sets are compared as order-free digests, never as lists.
    """
    def digest(snapshot, name):
        files = snapshot.select("receipt_no", "sha").distinct()
        return files.groupBy("receipt_no").agg(
            F.count("sha").alias(f"{name}_n"),
            F.coalesce(F.bit_xor(F.when(F.col("sha").isNotNull(), F.xxhash64("sha"))), F.lit(0).cast("bigint")).alias(f"{name}_x"),
            F.coalesce(F.sum(F.crc32(F.col("sha").cast("binary"))), F.lit(0)).alias(f"{name}_s"),
        )

    rows = (
        items.join(digest(baseline, "old"), "receipt_no", "left")
        .join(digest(newest, "new"), "receipt_no", "left")
        .join(attached.select("expense_id", F.lit(True).alias("_fixed")).distinct(), "expense_id", "left")
    )
    differ = ~(
        F.coalesce("old_n", F.lit(0)).eqNullSafe(F.col("new_n"))
        & F.coalesce("old_x", F.lit(0)).eqNullSafe(F.col("new_x"))
        & F.coalesce("old_s", F.lit(0)).eqNullSafe(F.col("new_s"))
    )
    status = (
        F.when(F.col("_fixed"), "refiled")
        .when(F.col("new_n").isNull(), "gone")
        .when((F.col("new_n") > 0) & differ, "refiled")
        .otherwise("open")
    )
    return rows.withColumn("status", status).drop("old_n", "old_x", "old_s", "new_n", "new_x", "new_s", "_fixed")


def apply_corrections(expenses: DataFrame, attached: DataFrame) -> DataFrame:
    """Items given their document after the export count as corrected until the next one."""
    fixed = attached.groupBy("expense_id").agg(F.max("date").alias("corrected_on"))
    rows = expenses.join(fixed, "expense_id", "left")
    return rows.withColumn("corrected", F.col("corrected_on").isNotNull()).withColumn(
        "has_receipt", F.col("has_receipt") | F.col("corrected")
    )


EXPENSE_STEPS = {
    "payout": "utbetalning, inget kvitto behövs",
    "corrected": "rättat kvitto bifogat",
    "flagged": "fel kvitto bifogat",
    "exported": "klar",
    "ok": "kvitto finns, väntar på export",
    "attached": "syns i nästa export",
    "missing": "hämta kvitto",
}


def expense_rows(export: DataFrame, live: DataFrame, flagged: DataFrame, corrected: DataFrame, archived: DataFrame) -> DataFrame:
    """Every export row and every live row the export lacks, one state and next step each."""
    problem = flagged.filter(F.col("status") == "open").groupBy("expense_id").agg(F.max("problem").alias("problem"))
    fix = corrected.groupBy("expense_id").agg(F.max("date").alias("corrected_on"))
    known = archived.groupBy("expense_id").agg(F.max("status").alias("archive_status"))
    listed = live.groupBy("expense_id").agg(F.max("hint").alias("hint"), F.max("route").alias("route"))
    rows = export.join(fix, "expense_id", "left").join(problem, "expense_id", "left").join(known, "expense_id", "left").join(listed, "expense_id", "left")
    state = (
        F.when(F.col("payout"), "payout")
        .when(F.col("corrected_on").isNotNull(), "corrected")
        .when(F.col("problem").isNotNull(), "flagged")
        .when(F.col("has_receipt") & (F.upper("export_status") == "EXPORTED"), "exported")
        .when(F.col("has_receipt"), "ok")
        .when(F.col("archive_status").isNotNull(), "attached")
        .otherwise("missing")
    )
    named = rows.withColumn("state", state)
    steps = F.element_at(F.create_map(*[F.lit(x) for p in EXPENSE_STEPS.items() for x in p]), F.col("state"))
    step = (
        F.when(F.col("state") == "flagged", F.col("problem"))
        .when(F.col("state") == "missing", F.coalesce("hint", steps))
        .otherwise(steps)
    )
    from_export = named.select(
        "expense_id", "date", "amount_sek", "state", step.alias("step"), F.lit("export").alias("source")
    )
    only_live = live.join(export.select("expense_id"), "expense_id", "left_anti")
    live_state = F.when(F.col("route") == "attached", "attached").otherwise("missing")
    from_live = only_live.select("expense_id", "date", "amount_sek", live_state.alias("state"), F.col("hint").alias("step"), F.lit("live").alias("source"))
    return from_export.unionByName(from_live)


# --------------------------------------------------------------------------- ledger

def ledger_star(
    ledger: DataFrame, plan: DataFrame, files: DataFrame, archive: DataFrame, paid: DataFrame, answers: DataFrame, searches: DataFrame
) -> DataFrame:
    """Ledger rows with plan row, file, archive record, payout, tag answer and latest search.

    Where a side holds several rows of a ref one counts, so none doubles a ledger row: of the plan the
    one that is booked and not left out, of files, records and answers the first, of payouts the
    earliest, of searches the latest. Evidence, booking, reimbursement and closing stay four separate
    columns: none is inferred from another.
    """
    plan_order = [F.col("plan_voucher").isNull(), F.col("plan_reason").isNotNull(), *(F.col(c) for c in ("plan_voucher", "plan_reason", "uploaded"))]
    sides = {
        "plan": (plan, ["uploaded", "plan_voucher", "plan_reason"], plan_order),
        "files": (files, ["file"], [F.col("file")]),
        "archive": (archive, ["id", "voucher"], [F.col("id")]),
        "paid": (paid, ["paid_on"], [F.col("paid_on")]),
        "answers": (answers, ["tag"], [F.col("tag")]),
        "searches": (searches, ["has_best", "searched_on"], [-F.datediff("searched_on", F.lit("1970-01-01")), ~F.col("has_best")]),
    }
    # All sides meet under their ref in one aggregate, so the ledger is joined once.
    rows = None
    for name, (side, keep, order) in sides.items():
        side = side.select("ref", F.struct(F.struct(*order).alias("by"), F.struct(*keep).alias("row")).alias(f"_{name}"))
        rows = side if rows is None else rows.unionByName(side, allowMissingColumns=True)
    met = rows.filter(F.col("ref").isNotNull()).groupBy("ref").agg(*[F.min_by(f"_{n}.row", f"_{n}.by").alias(f"_{n}") for n in sides])
    months = plan.groupBy("month").agg(F.max("held").alias("plan_held")).withColumn("has_plan", F.lit(True))
    rows = (
        ledger.withColumn("month", month_of(F.col("date")))
        .join(met, "ref", "left")
        .join(months, "month", "left")
        .withColumns(
            {
                "uploaded": F.col("_plan.uploaded"),
                "plan_voucher": F.col("_plan.plan_voucher"),
                "plan_reason": F.col("_plan.plan_reason"),
                "in_plan": F.col("_plan").isNotNull(),
                "evidence_file": F.col("_files.file"),
                "archive_id": F.col("_archive.id"),
                "archive_voucher": F.nullif("_archive.voucher", F.lit("")),
                "paid_on": F.col("_paid.paid_on"),
                "answer": F.col("_answers.tag"),
                "search_best": F.col("_searches.has_best"),
                "searched_on": F.col("_searches.searched_on"),
            }
        )
        .drop(*[f"_{n}" for n in sides])
    )
    voucher = F.coalesce("plan_voucher", "archive_voucher")
    return rows.withColumns(
        {
            "evidence": F.col("evidence_file").isNotNull() | F.col("archive_id").isNotNull(),
            "voucher": voucher,
            "booked": voucher.isNotNull(),
            "reimbursed": F.col("paid_on").isNotNull(),
            "answered_tag": F.when((F.col("tag") == "needs-tag") & F.col("answer").isNotNull(), F.col("answer")).otherwise(F.col("tag")),
            "has_plan": F.coalesce("has_plan", F.lit(False)),
            "planned": F.col("in_plan") & F.col("plan_reason").isNull(),
        }
    ).drop("in_plan", "plan_voucher", "archive_voucher")


LEDGER_STEPS = {
    "booked": "verifikat finns",
    "reimbursed": "ersatt, får inte ersättas igen",
    "personal": "privat köp, inget att göra",
    "skip": "betalning eller kredit, inget att göra",
    "needs-tag": "tagga företag eller privat",
    "in-expense": "hanteras bland utläggen",
    "other-entity": "hanteras utanför planen",
    "no-receipt": "sök kvitto",
    "held": "planen är på hold",
    "planned": "i plan, väntar på godkännande",
    "ready": "tas med vid nästa månadskörning",
}


def ledger_state(star: DataFrame, own_entity: str) -> DataFrame:
    """One of eleven states per ledger row and the next step."""
    tag = F.col("answered_tag")
    state = (
        F.when(F.col("booked"), "booked")
        .when(F.col("reimbursed"), "reimbursed")
        .when(tag == "personal", "personal")
        .when(tag == "skip", "skip")
        .when(tag == "needs-tag", "needs-tag")
        .when(F.col("in_expense"), "in-expense")
        .when(F.col("entity") != own_entity, "other-entity")
        .when(~F.col("evidence"), "no-receipt")
        .when(F.col("plan_held"), "held")
        .when(F.col("planned"), "planned")
        .otherwise("ready")
    )
    rows = star.withColumn("state", state)
    steps = F.element_at(F.create_map(*[F.lit(x) for p in LEDGER_STEPS.items() for x in p]), F.col("state"))
    looked = (
        F.when(F.col("search_best"), "kandidat finns, väntar på bekräftelse")
        .when(F.col("searched_on").isNotNull(), "inte i brevlådan, be leverantören om kvitto")
        .otherwise(steps)
    )
    step = F.when(F.col("state") == "no-receipt", looked).otherwise(steps)
    note = F.when(
        F.col("state").isin("planned", "held", "ready", "no-receipt") & (F.coalesce("bas_account", F.lit("")) == ""), "; konto saknas"
    ).when((F.col("state") == "reimbursed") & ~F.col("evidence"), "; kvitto saknas fortfarande")
    return rows.withColumn("step", F.concat(step, F.coalesce(note, F.lit(""))))


def business_status(star: DataFrame, own_entity: str) -> DataFrame:
    """The first fact that still blocks a business row."""
    no_account = F.coalesce("bas_account", F.lit("")) == ""
    label = (
        F.when(F.col("booked"), "booked")
        .when(F.col("entity") != own_entity, F.concat(F.lit("other entity "), "entity"))
        .when(F.col("has_plan") & ~F.col("planned"), F.concat(F.lit("outside the plan: "), F.coalesce("plan_reason", F.lit("not in the manifest"))))
        .when(no_account & F.col("evidence"), "account missing")
        .when(no_account, "evidence and account missing")
        .when(~F.col("evidence"), "evidence missing")
        .when(F.col("planned") & F.coalesce("uploaded", F.lit(False)), "planned, evidence uploaded")
        .when(F.col("planned"), "planned")
        .otherwise("evidence found, not uploaded")
    )
    return star.filter(F.col("tag") == "business").withColumn("status_label", label)


def ledger_facts(states: DataFrame, *more: str) -> DataFrame:
    """Ledger rows that agree in everything the board's figures read, as one row with their
    ``row_count``, their amount and their last days; ``more`` names further columns to keep apart.

    A month has few of them, so the figures read these instead of the ledger.
    """
    keys = ["month", "tag", "entity", "evidence", "reimbursed", "answer", "answered_tag", "state", *more]
    searched = F.col("searched_on").isNotNull().alias("_searched")
    return states.groupBy(*keys, searched).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("amount").alias("amount"), F.max("date").alias("date"), F.max("searched_on").alias("searched_on")
    ).drop("_searched")


def ledger_months(rows: DataFrame, plan_months: DataFrame, own_entity: str) -> DataFrame:
    """Monthly ledger figures over the ledger's months and the plans' months."""
    business = F.col("tag") == "business"
    per = rows.groupBy("month").agg(
        _count(rows).alias("rows"),
        _count(rows, business).alias("business"),
        _money(F.when(business, F.col("amount"))).alias("business_sek"),
        _count(rows, business & (F.col("entity") != own_entity)).alias("other_entity"),
        _count(rows, F.col("tag") == "personal").alias("personal"),
        _count(rows, F.col("tag") == "needs-tag").alias("needs_tag"),
        _count(rows, (F.col("tag") == "needs-tag") & F.col("answer").isNull()).alias("needs_tag_open"),
        _count(rows, F.col("tag") == "skip").alias("skip"),
        _count(rows, business & F.col("evidence")).alias("found"),
        _count(rows, business & ~F.col("evidence")).alias("missing"),
    )
    counts = [c for c in per.columns if c not in ("month", "business_sek")]
    both = per.join(plan_months, "month", "full_outer")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in counts} | {"business_sek": F.coalesce("business_sek", F.lit(0).cast(MONEY))}
    return both.withColumns(zeros)


def coverage(statements: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Last purchase day and the last month it closes, the next month and whether it is covered.

    The next month is the one after the last that the ledger closes (``ledger_closed``); it is
    present when the statements close it too. Without a ledger of its own the statements are the ledger. A purchase
    date proves nothing about the days after it, so ``period_proven`` stays false until a
    statement period is supplied.
    """
    last = statements.agg(F.max("date").alias("last_date")).withColumn("closed_month", last_full_month(F.col("last_date")))
    reached = F.col("closed_month") if ledger is None else ledger.agg(last_full_month(F.max("date"))).scalar()
    return last.withColumn("ledger_closed", reached).withColumn("next_month", month_add(F.col("ledger_closed"), 1)).withColumn(
        "next_present", F.col("closed_month") >= F.col("next_month")
    ).withColumn("period_proven", F.lit(False))


def months_behind(covered: DataFrame) -> DataFrame:
    """The months that the statements close and the ledger does not: a calendar from the one to the
    other, so a month without a single row is among them. Without a ledger the last one alone."""
    def first(month: Column) -> Column:
        return F.to_date(F.concat(month, F.lit("-01")))

    start = F.coalesce(F.col("next_month"), F.col("closed_month"))
    late = covered.filter(F.coalesce(F.col("ledger_closed"), F.lit("")) < F.col("closed_month"))
    days = F.explode(F.sequence(first(start), first(F.col("closed_month")), F.expr("INTERVAL 1 MONTH")))
    return late.select(days.alias("_day")).select(F.date_format("_day", "yyyy-MM").alias("month"))


def _beside(row: DataFrame, *others: DataFrame) -> DataFrame:
    """One row and the columns of other one-row frames, as scalar subqueries instead of products."""
    for other in others:
        row = row.withColumn("_beside", other.select(F.struct("*")).scalar()).select(*row.columns, "_beside.*")
    return row


def month_stage(months: DataFrame, covered: DataFrame) -> DataFrame:
    """Stage of each month: no-csv, no-plan, untagged, nothing-to-book, held, planned, partial, booked.

    A month that no statement closes is ``no-csv``, one that the ledger does not reach is ``no-plan``
    whatever else it holds.
    """
    rows = months.withColumn("covered", covered.select("closed_month").scalar()).withColumn("reached", covered.select("ledger_closed").scalar())
    has_plan = F.col("vouchers").isNotNull()
    stage = (
        F.when(F.col("covered").isNull() | (F.col("month") > F.col("covered")), "no-csv")
        .when(F.col("reached").isNull() | (F.col("month") > F.col("reached")), "no-plan")
        .when(F.col("needs_tag_open") > 0, "untagged")
        .when(~has_plan & (F.col("business") > 0), "no-plan")
        .when(~has_plan, "nothing-to-book")
        .when(F.coalesce("held", F.lit(False)) & (F.col("booked") < F.col("vouchers")), "held")
        .when(F.col("booked") <= 0, "planned")
        .when(F.col("booked") < F.col("vouchers"), "partial")
        .otherwise("booked")
    )
    return rows.withColumn("stage", stage)


def month_steps(staged: DataFrame) -> DataFrame:
    """The five steps of a month (csv, tag, evidence, plan, booked) as done, partial or todo."""
    waiting = F.col("stage") == "no-csv"
    idle = F.col("stage") == "nothing-to-book"
    tag = F.when(F.col("needs_tag_open") == 0, "done").when(F.col("needs_tag_open") < F.col("rows"), "partial").otherwise("todo")
    evidence = (
        F.when((F.col("business") > 0) & (F.col("found") >= F.col("business")), "done")
        .when(F.col("found") > 0, "partial")
        .when((F.col("business") == 0) & (tag == "done"), "done")
        .otherwise("todo")
    )
    vouchers, booked = F.coalesce("vouchers", F.lit(0)), F.coalesce("booked", F.lit(0))
    plan = F.when(vouchers > 0, "done").when(F.col("vouchers").isNotNull(), "partial").otherwise("todo")
    book = F.when((vouchers > 0) & (booked >= vouchers), "done").when(booked > 0, "partial").otherwise("todo")
    csv = F.when(waiting, F.when(F.col("rows") > 0, "partial").otherwise("todo")).otherwise("done")

    def step(n, name, state):
        return F.struct(F.lit(n).alias("step_no"), F.lit(name).alias("step"), state.alias("state"))

    later = [
        ("tag", tag), ("evidence", evidence), ("plan", F.when(idle, "done").otherwise(plan)), ("booked", F.when(idle, "done").otherwise(book)),
    ]
    steps = F.array(step(1, "csv", csv), *[step(i, n, F.when(waiting, "todo").otherwise(s)) for i, (n, s) in enumerate(later, 2)])
    return staged.select("month", F.explode(steps).alias("_s")).select("month", "_s.*")


def vendor_list(rows: DataFrame, group: str, vendor: str, position: str) -> DataFrame:
    """Vendors of a group with their counts, one row each, numbered from 1 in first-seen order."""
    counted = rows.groupBy(group, vendor).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    return number_rows(counted, [group], ["first", vendor], "place").drop("first")


def newest_first(rows: DataFrame, day: str = "date", key: str = "ref") -> DataFrame:
    return rows.orderBy(F.desc(day), F.desc(key))


# --------------------------------------------------------------------------- sources, headline, to-do

def newest_snapshot(files: DataFrame, family: str, name: str) -> DataFrame:
    """The newest file of each family: by the date in its name, an undated one by the day of its
    ``modified`` time where the listing has it; then by that time, then by its name."""
    stamp = F.coalesce(
        F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")),
        F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2})(?!\d)", 1), F.lit("")),
    )
    time = F.col("modified").cast("timestamp") if "modified" in files.columns else F.lit(None).cast("timestamp")
    dated = files.withColumn("_time", time).withColumn("stamp", F.coalesce(stamp, F.date_format("_time", "yyyy-MM-dd"), F.lit("")))
    return dated.groupBy(family).agg(F.max_by(F.struct("stamp", name), F.struct("stamp", "_time", name)).alias("_r")).select(
        family, "_r.stamp", f"_r.{name}"
    )


def freshness(sources: DataFrame, today: Column, stale_days: int = 14) -> DataFrame:
    """Age and state of each source; a statement is stale when its last closed month is behind."""
    age = F.datediff(today, "date")
    behind = F.col("statement") & (F.coalesce("closed_month", F.lit("")) < month_add(month_of(today), -1))
    state = (
        F.when(F.col("date").isNull(), "missing")
        .when(F.col("statement"), F.when(behind, "stale").otherwise("ok"))
        .when(age > stale_days, "stale")
        .otherwise("ok")
    )
    return sources.withColumn("age_days", age).withColumn("state", state)


def headline(expenses: DataFrame, ledger: DataFrame, plans: DataFrame, archive: DataFrame) -> DataFrame:
    """The figures of the status line, one row; each section is aggregated on its own."""
    e = expenses.agg(
        F.count(F.lit(1)).alias("expense_rows"),
        F.count_if("has_receipt").alias("expense_with_receipt"),
        F.count_if(~F.col("has_receipt")).alias("expense_missing"),
    )
    business = F.col("tag") == "business"
    g = ledger.agg(
        _count(ledger, business).alias("business_rows"),
        _money(F.when(business, F.col("amount"))).alias("business_sek"),
        _count(ledger, business & F.col("evidence")).alias("evidence_found"),
        _count(ledger, (F.col("tag") == "needs-tag") & F.col("answer").isNull()).alias("needs_tag_open"),
    )
    p = plans.agg(F.coalesce(F.sum("vouchers"), F.lit(0)).alias("vouchers_planned"), F.coalesce(F.sum("booked"), F.lit(0)).alias("vouchers_booked"))
    signed = F.when(F.col("kind") == "credit-note", -F.col("amount_sek")).otherwise(F.col("amount_sek"))
    a = archive.agg(F.count(F.lit(1)).alias("archive_pages"), _money(signed).alias("archive_sek"))
    return _beside(e, g, p, a)


def _task(df: DataFrame, key: Column, severity: str, owner: Column | str, count: Column, amount: Column | None, text: Column) -> DataFrame:
    return df.select(
        key.alias("key"),
        F.lit(severity).alias("severity"),
        (owner if isinstance(owner, Column) else F.lit(owner)).alias("owner"),
        count.cast("bigint").alias("count"),
        (amount if amount is not None else F.lit(None)).cast(MONEY).alias("amount_sek"),
        text.alias("detail"),
    )


def open_warnings(warnings: DataFrame, flagged: DataFrame) -> DataFrame:
    """Archive warnings not already on the worklist, neither themselves nor as the partner of a
    duplicate invoice. ``flagged``: id of records whose receipt is on the worklist."""
    partner = F.nullif(F.regexp_extract("text", r"is also on (\S+)", 1), F.lit(""))
    known = flagged.select("id").distinct()
    first = warnings.join(known, "id", "left_anti").withColumn("_partner", F.when(F.col("kind") == "duplicate-invoice", partner))
    return first.join(known.select(F.col("id").alias("_partner")), "_partner", "left_anti").drop("_partner")


def todo(
    flagged: DataFrame,
    live: DataFrame,
    states: DataFrame,
    months: DataFrame,
    sources: DataFrame,
    warnings: DataFrame,
    lint_findings: DataFrame,
    cover: DataFrame,
    own_entity: str,
    today: Column,
) -> DataFrame:
    """Every open task as one row: each rule is a small conditional aggregate over its section.

    ``states`` are the ledger's rows with their state, or the ``ledger_facts`` of these.
    """
    open_items = flagged.filter(F.col("status") == "open").groupBy("group").agg(F.count(F.lit(1)).alias("n"), _money(F.col("amount_sek")).alias("s"))
    reattach = open_items.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).filter("n > 0")
    routes = live.filter(F.col("route") != "attached").groupBy("route", "owner").agg(F.count(F.lit(1)).alias("n"), _money(F.col("amount_sek")).alias("s"))
    wanting = states.filter((F.col("answered_tag") == "business") & (F.col("entity") == own_entity) & ~F.col("evidence"))
    fetch = wanting.filter(F.col("state") == "no-receipt").agg(
        _count(states).alias("n"), _money(F.col("amount")).alias("s"), _count(states, F.col("searched_on").isNotNull()).alias("looked")
    ).filter("n > 0")
    paid = wanting.filter(F.col("state") == "reimbursed").agg(_count(states).alias("n"), _money(F.col("amount")).alias("s")).filter("n > 0")
    untagged = states.filter(F.col("state") == "needs-tag").agg(_count(states).alias("n"), _money(F.col("amount")).alias("s")).filter("n > 0")
    late = cover.filter(~F.col("next_present") & (month_end(F.col("next_month")) < today))
    unfinished = months.filter(F.col("vouchers").isNotNull() & (F.col("booked") < F.col("vouchers")))
    held, waiting = unfinished.filter(F.coalesce("held", F.lit(False))), unfinished.filter(~F.coalesce("held", F.lit(False)))
    behind = months_behind(cover)
    reached = months.filter((F.col("stage") != "no-csv") & (F.col("month") <= F.col("reached")))
    unplanned = reached.filter(F.col("vouchers").isNull() & (F.col("business") - F.col("other_entity") > 0))
    stale = sources.filter((F.col("state") == "stale") & ~F.col("statement"))
    review = warnings.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n")).filter("n > 0")
    broken = lint_findings.filter(F.col("severity") == "error").agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    n, s, none = F.col("n"), F.col("s"), F.lit(None)
    rules = [
        _task(reattach, F.lit("expense-reattach"), "crit", "operator", n, s, F.lit("attach the right document")),
        _task(routes, F.concat(F.lit("expense-missing:"), "route"), "warn", F.col("owner"), n, s, F.lit("fetch documents")),
        _task(fetch, F.lit("card-missing"), "warn", F.when(F.col("looked") < n, "system").otherwise("operator"), n, s, F.concat(F.lit("searched "), F.col("looked").cast("string"))),
        _task(paid, F.lit("card-paid-no-receipt"), "info", "operator", n, s, F.lit("already reimbursed without a document")),
        _task(late, F.concat(F.lit("card-csv:"), "next_month"), "warn", "operator", none, None, F.concat(F.lit("last purchase "), F.col("last_date").cast("string"))),
        _task(untagged, F.lit("card-tags"), "warn", "operator", n, s, F.lit("tag the rows")),
        _task(held, F.concat(F.lit("plan-held:"), "month"), "warn", "system", F.col("vouchers"), F.col("plan_sek"), F.lit("reconcile and rebuild the plan")),
        _task(waiting, F.concat(F.lit("plan-execute:"), "month"), "info", "operator", F.col("vouchers"), F.col("plan_sek"), F.concat(F.col("booked").cast("string"), F.lit(" booked"))),
        _task(unplanned, F.concat(F.lit("plan-missing:"), "month"), "info", "system", F.col("business") - F.col("other_entity"), F.col("business_sek"), F.lit("build the plan")),
        _task(behind, F.concat(F.lit("card-month-end:"), "month"), "info", "system", none, None, F.lit("run the month close")),
        _task(stale, F.concat(F.lit("source-stale:"), "source"), "info", "operator", none, None, F.concat(F.col("age_days").cast("string"), F.lit(" days old"))),
        _task(review, F.lit("archive-review"), "info", "operator", n, None, F.lit("look at the archive warnings")),
        _task(broken, F.lit("archive-errors"), "crit", "system", n, None, F.lit("errors in the archive")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


# Severities in the order they are worked.
SEVERITY_RANK = {"crit": 0, "warn": 1, "info": 2}


def order_todo(tasks: DataFrame) -> DataFrame:
    """Severity, then the larger count, then the larger amount, then the key."""
    ranks = F.create_map(*[F.lit(x) for p in SEVERITY_RANK.items() for x in p])
    rank = F.coalesce(F.element_at(ranks, F.col("severity")), F.lit(9))
    return tasks.withColumn("severity_rank", rank).orderBy(
        "severity_rank", F.desc(F.coalesce("count", F.lit(-1))), F.desc(F.coalesce("amount_sek", F.lit(0))), "key"
    )


def _chip(n: int, tone: Column, *text) -> Column:
    words = [x.cast("string") if isinstance(x, Column) else F.lit(x) for x in text]
    return F.struct(F.lit(n).alias("chip_no"), tone.alias("tone"), F.concat(*words).alias("text"))


def _warns(condition: Column) -> Column:
    return F.when(condition, "warn").otherwise("ok")


def status_chips(line: DataFrame, tasks: DataFrame) -> DataFrame:
    """Short facts with a tone (ok or warn), every figure computed from the model."""
    t = tasks.agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if(F.col("severity") == "crit").alias("crit"),
        F.count_if(F.col("key").startswith("plan-held:")).alias("held"),
    )
    row = _beside(line, t)
    chips = F.array(
        _chip(1, _warns(F.col("crit") > 0), F.col("tasks"), " open tasks"),
        _chip(2, _warns(F.col("held") > 0), F.col("held"), " plans on hold"),
        _chip(3, _warns(F.col("expense_missing") > 0), F.col("expense_missing"), " expenses without a document"),
        _chip(4, _warns(F.col("needs_tag_open") > 0), F.col("needs_tag_open"), " untagged rows"),
        _chip(5, _warns(F.col("vouchers_booked") == 0), F.col("vouchers_booked"), " vouchers booked of ", F.col("vouchers_planned")),
        _chip(6, _warns(F.col("evidence_found") < F.col("business_rows")), F.col("evidence_found"), " of ", F.col("business_rows"), " business rows with evidence"),
    )
    return row.select(F.explode(chips).alias("_c")).select("_c.*")


def source_chips(
    ledger: DataFrame, flagged: DataFrame, cover: DataFrame, sources: DataFrame, today: Column, private_accounts: list[str], export: str
) -> DataFrame:
    """The chips that tell of dates, payouts, wrong documents, the private card, the next statement and
    the export's age; a source that is not there is ``missing``. ``sources`` as ``freshness`` gives them."""
    untagged = F.col("tag") == "needs-tag"
    g = ledger.agg(
        _count(ledger, F.col("reimbursed")).alias("reimbursed"), _count(ledger, untagged).alias("untagged"),
        _count(ledger, untagged & F.col("account").isin(*private_accounts)).alias("private"),
    )
    f = flagged.agg(F.count_if(F.col("status") == "open").alias("wrong"), F.count_if(F.col("status") == "refiled").alias("refiled"))
    e = sources.filter(F.col("source") == export).agg(F.min("age_days").alias("age"), F.min("state").alias("state"))
    row = _beside(g, f, cover.select("next_month", "next_present").limit(1), e)
    aged = F.col("age").isNotNull()
    chips = F.array(
        _chip(7, F.lit("ok"), "as of ", today),
        _chip(8, _warns(F.col("reimbursed") > 0), F.col("reimbursed"), " rows already reimbursed"),
        _chip(9, _warns(F.col("wrong") > 0), F.col("wrong"), " wrong documents left, ", F.col("refiled"), " refiled"),
        _chip(10, _warns(F.col("untagged") > 0), F.col("private"), " of ", F.col("untagged"), " untagged rows on a private card"),
        _chip(11, F.when(F.col("next_present"), "ok").otherwise("missing"), "statement for ", F.coalesce("next_month", F.lit("")), F.when(F.col("next_present"), " is there").otherwise(" is missing")),
        _chip(12, F.when(aged, F.col("state")).otherwise("missing"), F.when(aged, F.concat(F.lit("export "), F.col("age").cast("string"), F.lit(" days old"))).otherwise("no export")),
    )
    return row.select(F.explode(chips).alias("_c")).select("_c.*")
