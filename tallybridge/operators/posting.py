"""Classified charges to balanced monthly vouchers."""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import month_of
from ..functions.money import MONEY, format_money, half_up
from ..functions.scale import exploded, first_by, number_rows, ordered_digest
from ..functions.text import norm_ws

GROSS = "gross"


def plan_disposition(classified: DataFrame, own_entity: str, regimes: DataFrame) -> DataFrame:
    """Every row of the month with what becomes of it: planned, excluded or out-of-scope, and why."""
    known = regimes.select(F.col("regime").alias("vat_regime"), F.lit(True).alias("_known"))
    rows = classified.join(known, "vat_regime", "left")
    entity = F.coalesce(F.nullif("entity", F.lit("")), F.lit("saknas"))
    out_of_scope = (
        F.when(F.col("amount") <= 0, "amount not positive")
        .when(~F.col("tag").isin("business", "needs-tag"), F.concat(F.lit("tag "), "tag"))
    )
    excluded = (
        F.when(F.col("tag") == "needs-tag", "tag needs-tag")
        .when(entity != own_entity, F.concat(F.lit("entity "), entity))
        .when(~F.coalesce("bas_account", F.lit("")).rlike("^[0-9]+$"), "bas_account saknas")
        .when(F.col("_known").isNull(), F.concat(F.lit("vat_regime okand '"), "vat_regime", F.lit("'")))
    )
    disposition = (
        F.when(out_of_scope.isNotNull(), "out-of-scope").when(excluded.isNotNull(), "excluded").otherwise("planned")
    )
    return (
        rows.withColumn("month", month_of(F.col("date")))
        .withColumn("disposition", disposition)
        .withColumn("reason", F.coalesce(out_of_scope, excluded, F.lit("")))
        .drop("_known")
    )


def fetch_scope(classified: DataFrame, own_entity: str, payment_phrase: str) -> DataFrame:
    """Business rows whose evidence is to be fetched, and those listed as skipped with a reason."""
    rows = classified.filter(
        (F.col("tag") == "business") & ~F.upper("merchant").contains(payment_phrase.upper())
    )
    entity = F.coalesce(F.nullif("entity", F.lit("")), F.lit(own_entity))
    note = (
        F.when(entity != own_entity, F.concat(F.lit("entity "), entity))
        .when(F.col("amount") <= 0, "refund or payment, no receipt to fetch")
        .otherwise("")
    )
    return rows.withColumn("month", month_of(F.col("date"))).withColumn("skip_note", note).withColumn(
        "selected", F.col("skip_note") == ""
    )


# Characters that a shape tells of a ref, and shapes of one length that are worth comparing with.
SHAPE_LENGTH, SHAPES = 8, 64


def _classes(text: Column) -> Column:
    """Digits as 0, letters as a; one character for one."""
    return F.translate(text, digits + ascii_letters, "0" * len(digits) + "a" * len(ascii_letters))


def _shape(classes: Column) -> Column:
    return F.regexp_replace(classes, "[^0a]", ".")


def _ref_kinds(refs: DataFrame) -> DataFrame:
    """One row: the lengths refs have and the shapes they begin with, an empty shape where a length has too many to tell anything."""
    seen = refs.select(F.length("ref").alias("n"), _classes(F.left("ref", F.lit(SHAPE_LENGTH))).alias("c")).filter("n > 0").distinct()
    # Digit, letter or other: a bounded number of shapes whatever the refs.
    shapes = seen.select("n", _shape(F.col("c")).alias("shape")).groupBy("n").agg(F.collect_set("shape").alias("shapes"))
    few = F.when(F.size("shapes") <= SHAPES, F.col("shapes")).otherwise(F.array(F.lit("")))
    return shapes.select("n", F.explode(few).alias("shape")).agg(F.sort_array(F.collect_list(F.struct("n", "shape"))).alias("_kinds"))


def _pieces(files: DataFrame, refs: DataFrame) -> DataFrame:
    """``ref``, ``inner`` and ``name``: every piece of a name that is as long as a ref and begins like one of that length."""
    # An aggregate that travels to the files as a subquery would.
    shaped = files.select("name", _shape(_classes(F.col("name"))).alias("_shape")).withColumn("_kinds", _ref_kinds(refs).scalar())
    each = shaped.select("name", "_shape", F.explode("_kinds").alias("_k")).select("name", "_shape", F.col("_k.n").alias("n"), F.col("_k.shape").alias("k"))
    end = F.length("name") - F.col("n") + 1
    first = F.expr("locate(k, _shape)")
    last = F.length("_shape") - F.length("k") - F.expr("locate(reverse(k), reverse(_shape))") + 2
    spans = each.filter((end > 0) & (first > 0)).select(
        "name", "_shape", "n", "k", first.alias("_first"), F.when(F.col("k") == "", end).otherwise(F.least(last, end)).alias("_last")
    )
    starts = F.explode(F.sequence("_first", "_last")).alias("i")
    at = spans.filter("_first <= _last").select("name", "_shape", "n", "k", starts)
    return at.filter("startswith(substring(_shape, i), k)").select(F.expr("substring(name, i, n)").alias("ref"), (F.col("i") > 1).alias("inner"), "name")


def attach_files(
    charges: DataFrame, mapping: DataFrame, files: DataFrame, ledger_refs: DataFrame | None = None
) -> DataFrame:
    """Evidence file per charge: the mapped path, else the first file starting with the ref, else
    the first file containing it.

    Names are cut into every piece a ref could be (only the lengths refs really have, and only where
    a piece begins with digits, letters and others in the places where a ref of its length does), so prefix
    and containment are one equi join; per piece only the best file is kept before the join.
    ``ledger_refs``, when given, is a cheaper frame holding at least every ref of ``charges``.
    """
    pieces = _pieces(files, charges if ledger_refs is None else ledger_refs)
    best = pieces.groupBy("ref").agg(F.min(F.struct("inner", "name")).alias("_f"))
    by_name = best.select("ref", F.col("_f.name").alias("_named"), F.col("_f.inner").alias("_inner"))
    mapped = first_by(mapping.filter(F.trim("file") != ""), ["ref"], [F.col("file")], ["file"])
    joined = charges.join(mapped.withColumnRenamed("file", "_mapped"), "ref", "left").join(by_name, "ref", "left")
    how = (
        F.when(F.col("_mapped").isNotNull(), "map")
        .when(F.col("_inner") == F.lit(False), "prefix")
        .when(F.col("_inner"), "contains")
        .otherwise("")
    )
    return (
        joined.withColumn("receipt_file", F.coalesce("_mapped", "_named", F.lit("")))
        .withColumn("file_match", how)
        .drop("_mapped", "_named", "_inner")
    )


def exclude_paid(plan: DataFrame, paid: DataFrame) -> DataFrame:
    """Planned rows already reimbursed elsewhere become excluded, with the payout as the reason."""
    hit = paid.groupBy("ref").agg(F.min("payout_id").alias("_payout"))
    rows = plan.join(hit, "ref", "left")
    taken = (F.col("disposition") == "planned") & F.col("_payout").isNotNull()
    return (
        rows.withColumn("reason", F.when(taken, F.concat(F.lit("already paid "), "_payout")).otherwise(F.col("reason")))
        .withColumn("disposition", F.when(taken, "excluded").otherwise(F.col("disposition")))
        .drop("_payout")
    )


def _share(amount: Column, rate: Column) -> Column:
    """The VAT inside a gross amount at ``rate`` percent."""
    return half_up(amount * rate / (F.lit(100) + rate))


def post_vouchers(plan: DataFrame, regimes: DataFrame, accounts: dict[str, int]) -> DataFrame:
    """Balanced postings, one row per voucher line, by VAT regime.

    ``regimes`` names for each regime its ``method`` (inclusive, half, reverse, gross) and
    ``rate``; ``accounts`` the liability, vat, vat_out and vat_in accounts. The cost line takes
    the rounding residual, so debit equals credit on every voucher.
    """
    methods = regimes.select(F.col("regime").alias("vat_regime"), "method", "rate")
    rows = plan.join(methods, "vat_regime").withColumn("gross", half_up(F.col("amount")))
    inclusive = _share(F.col("gross"), F.col("rate"))
    tax = (
        F.when(F.col("method") == "inclusive", inclusive)
        .when(F.col("method") == "half", half_up(inclusive / 2))
        .when(F.col("method") == "reverse", half_up(F.col("gross") * F.col("rate") / 100))
        .otherwise(F.lit(0).cast(MONEY))
    )
    rows = rows.withColumn("tax", tax.cast(MONEY))
    zero = F.lit(0).cast(MONEY)
    lifted = F.when(F.col("method").isin("inclusive", "half"), F.col("tax")).otherwise(zero)
    reverse = F.when(F.col("method") == "reverse", F.col("tax")).otherwise(zero)

    def line(n, account, debit, credit):
        return F.struct(
            F.lit(n).alias("line"),
            account.cast("int").alias("account"),
            debit.cast(MONEY).alias("debit"),
            credit.cast(MONEY).alias("credit"),
        )

    lines = F.array(
        line(1, F.col("bas_account"), F.col("gross") - lifted, zero),
        line(2, F.lit(accounts["vat"]), lifted, zero),
        line(3, F.lit(accounts["liability"]), zero, F.col("gross")),
        line(4, F.lit(accounts["vat_out"]), zero, reverse),
        line(5, F.lit(accounts["vat_in"]), reverse, zero),
    )
    kept = F.filter(lines, lambda x: (x["debit"] != 0) | (x["credit"] != 0))
    return exploded(rows, ["month", "ref", "date", "vat_regime"], kept, "_l").select(
        "month", "ref", "date", "vat_regime", "_l.*"
    )


def number_vouchers(plan: DataFrame) -> DataFrame:
    """Voucher number within the month by (date, ref)."""
    return number_rows(plan, ["month"], ["date", "ref"], "voucher_no")


def with_voucher_text(plan: DataFrame, prefix: str) -> DataFrame:
    """Description below 100 characters that always keeps the ref, and a file-safe ref."""
    budget = F.greatest(F.lit(99 - len(prefix) - 2) - F.length("ref"), F.lit(0))
    merchant = F.rtrim(F.left(norm_ws(F.col("merchant")), budget))
    text = F.concat_ws(" ", F.lit(prefix), F.nullif(merchant, F.lit("")), F.col("ref"))
    return plan.withColumn("description", F.left(text, F.lit(99))).withColumn(
        "safe_ref", F.regexp_replace("ref", "[^A-Za-z0-9_.-]", "_")
    )


def plan_status(rows: DataFrame, regimes: DataFrame) -> DataFrame:
    """Status text of each planned or excluded row: evidence missing, gross policy pending, ok."""
    methods = regimes.select(F.col("regime").alias("vat_regime"), F.col("method").alias("_method"))
    joined = rows.join(methods, "vat_regime", "left")
    notes = F.concat_ws(
        "; ",
        F.when(F.col("receipt_file") == "", "kvitto saknas"),
        F.when(F.col("_method") == GROSS, "oss policy pending"),
    )
    status = (
        F.when(F.col("disposition") == "excluded", F.concat(F.lit("excluded "), "reason"))
        .when(F.col("disposition") == "planned", F.coalesce(F.nullif(notes, F.lit("")), F.lit("ok")))
    )
    return joined.withColumn("status", status).drop("_method").filter(F.col("status").isNotNull())


def plan_warnings(status: DataFrame) -> DataFrame:
    """One row per warning on a plan: missing evidence, pending gross policy, exclusions."""
    who = F.concat_ws(" ", F.col("ref"), F.col("date").cast("string"), F.translate("merchant", "|", "/"))
    money = F.concat(F.lit(" ("), format_money(half_up(F.col("amount")), "SEK", keep_sign=True), F.lit(")"))
    found = F.array_compact(
        F.array(
            F.when(
                F.col("status").contains("kvitto saknas"),
                F.struct(F.lit("evidence-missing").alias("kind"), F.concat(who, money).alias("text")),
            ),
            F.when(
                F.col("status").contains("oss policy pending"),
                F.struct(F.lit("gross-pending").alias("kind"), F.concat(who, money).alias("text")),
            ),
            F.when(
                F.col("disposition") == "excluded",
                F.struct(F.lit("excluded").alias("kind"), F.concat(F.col("reason"), F.lit(": "), who, money).alias("text")),
            ),
        )
    )
    return exploded(status, ["month", "ref"], found, "_w").select("month", "ref", "_w.*")


def reason_counts(plan: DataFrame) -> DataFrame:
    """How many rows of each month are excluded, per reason."""
    return (
        plan.filter(F.col("disposition") == "excluded")
        .groupBy("month", "reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def reimbursement_row(planned: DataFrame) -> DataFrame:
    """One reimbursement per month, dated its last day."""
    return planned.groupBy("month").agg(
        F.last_day(F.max("date")).alias("date"),
        F.count(F.lit(1)).alias("vouchers"),
        F.sum(half_up(F.col("amount"))).cast(MONEY).alias("amount"),
    )


def batch_digest(numbered: DataFrame, postings: DataFrame) -> DataFrame:
    """Approval code per month: any change to a payload, a ref or its file changes it."""
    body = postings.groupBy("month", "ref").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("line", "account", "debit", "credit"))),
                lambda x: F.concat_ws(
                    ":", x["account"].cast("string"), x["debit"].cast("string"), x["credit"].cast("string")
                ),
            ),
            ",",
        ).alias("_body")
    )
    lines = numbered.join(body, ["month", "ref"]).withColumn(
        "_line", F.concat_ws("|", F.col("date").cast("string"), F.col("ref"), F.col("_body"), F.col("receipt_file"))
    )
    return ordered_digest(lines, ["month"], "voucher_no", "_line").select(
        "month", F.left("digest", F.lit(16)).alias("batch_code")
    )


STEPS = ("upload", "voucher", "connect")


def remaining_steps(plan: DataFrame, done: DataFrame, codes: DataFrame) -> DataFrame:
    """Steps of approved batches still to run, in order; recorded steps are skipped.

    ``done`` holds (month, batch_code, ref, step). Months whose recorded steps carry another
    batch code come back as one ``blocked`` row, since their payloads changed after approval.
    """
    approved = codes.select("month", "batch_code")
    mismatch = (
        done.select("month", F.col("batch_code").alias("_code")).distinct().join(approved, "month")
        .filter(F.col("_code") != F.col("batch_code")).select("month").distinct()
    )
    open_plan = plan.join(mismatch, "month", "left_anti")
    wanted = F.when(
        F.col("receipt_file") != "", F.array(*[F.lit(s) for s in STEPS])
    ).otherwise(F.array(F.lit("voucher")))
    per_row = open_plan.select("month", "ref", F.posexplode(wanted).alias("_i", "step"))
    per_row = per_row.select("month", "ref", "step")
    per_month = open_plan.select("month").distinct().select("month", F.lit("").alias("ref"), F.lit("reimburse").alias("step"))
    todo = per_row.unionByName(per_month).join(done.select("month", "ref", "step"), ["month", "ref", "step"], "left_anti")
    blocked = mismatch.select("month", F.lit("").alias("ref"), F.lit("blocked").alias("step"))
    rank = F.when(F.col("step") == "blocked", 0)
    for i, s in enumerate([*STEPS, "reimburse"], 1):
        rank = rank.when(F.col("step") == s, i)
    return todo.unionByName(blocked).withColumn("step_order", rank)
