"""Statement rows to a clean, classified ledger."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scale import containing_pairs, first_by
from ..functions.text import any_of, contains_any

VALID_TAGS = ("business", "personal", "needs-tag", "skip")


@dataclass(frozen=True)
class Policy:
    """Ledger-wide settings; per-card settings live in the ``cards`` table."""

    payment_phrase: str
    split_date: date
    default_entity: str


def dedupe_statement(charges: DataFrame, order: list[str]) -> DataFrame:
    """One row per ``ref``: the first in ``order`` over overlapping statement windows."""
    return first_by(charges, ["ref"], [F.col(c) for c in order])


def charge_kind(charges: DataFrame, payment_phrase: str) -> DataFrame:
    """``kind`` in payment, refund, charge and ``card``, the last four characters of the account."""
    kind = (
        F.when(F.upper("merchant").contains(payment_phrase.upper()), "payment")
        .when(F.col("amount") < 0, "refund")
        .otherwise("charge")
    )
    return charges.withColumn("kind", kind).withColumn("card", F.right(F.col("account"), F.lit(4)))


def validate_ledger(rows: DataFrame, required: list[str], amount: str = "amount") -> tuple[DataFrame, DataFrame]:
    """(good rows with a decimal amount, quarantined rows with the reason)."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError("not a classified ledger, missing columns: " + ", ".join(missing))
    value = F.trim(F.col(amount).cast("string")).try_cast("decimal(18,2)")
    no_ref = F.trim(F.coalesce(F.col("ref"), F.lit(""))) == ""
    reason = F.when(no_ref, "no ref").when(value.isNull(), "bad amount")
    checked = rows.withColumn("_reason", reason).withColumn("_value", value)
    good = checked.filter(F.col("_reason").isNull()).withColumn(amount, F.col("_value")).drop("_reason", "_value")
    quarantine = checked.filter(F.col("_reason").isNotNull()).withColumn("reason", F.col("_reason"))
    return good, quarantine.drop("_reason", "_value")


def valid_overrides(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one decision per ref: its last valid line, rejected lines with the reason)."""
    ref, tag = F.trim(F.coalesce("ref", F.lit(""))), F.trim(F.coalesce("tag", F.lit("")))
    read = lines.select("line", ref.alias("ref"), tag.alias("tag"), F.trim(F.coalesce("note", F.lit(""))).alias("note"))
    ok = (F.col("ref") != "") & F.col("tag").isin(*VALID_TAGS)
    last = read.filter(ok).groupBy("ref").agg(F.max_by(F.struct("tag", "note"), "line").alias("_r"))
    bad = read.filter(~ok).withColumn("reason", F.when(F.col("ref") == "", "no ref").otherwise("invalid tag"))
    return last.select("ref", "_r.*"), bad


def with_decisions(charges: DataFrame, overrides: DataFrame, prior: DataFrame) -> DataFrame:
    """Charges with their override and their earlier decision.

    A ref decided more than once before keeps its last decision by ``line``, where the prior table
    has one, else the greatest; a repeated override likewise. Rows without a ref decide nothing.
    """

    def last(rows: DataFrame, fields: list[Column]) -> DataFrame:
        order = F.struct(*([F.col("line")] if "line" in rows.columns else []), *fields)
        picked = rows.filter(F.trim("ref") != "").groupBy("ref").agg(F.max_by(F.struct(*fields), order).alias("_r"))
        return picked.select("ref", "_r.*")

    o = last(overrides, [F.col("tag").alias("override_tag"), F.col("note").alias("override_note")])
    p = last(prior, [F.trim("tag").alias("prior_tag"), F.col("why").alias("prior_why")])
    return charges.join(o, "ref", "left").join(p, "ref", "left")


def match_rule(charges: DataFrame, rules: DataFrame) -> DataFrame:
    """The first coding rule in ``rule_order`` any of whose patterns the merchant contains.

    Patterns meet the distinct merchants on shared character runs, whatever the size of the rule
    table, and the answer is joined back.
    """
    attributes = rules.select(
        "rule_order",
        F.col("name").alias("rule_name"),
        F.col("tag").alias("rule_tag"),
        F.col("entity").alias("rule_entity"),
        "bas_account",
        "konto_name",
        "vat_regime",
    )
    flat = rules.select("rule_order", F.explode("patterns").alias("pattern")).select("rule_order", F.upper("pattern").alias("pattern"))
    merchants = charges.select(F.upper("merchant").alias("_merchant")).distinct()
    first = (
        containing_pairs(merchants, "_merchant", flat.filter(F.col("pattern") != ""), "pattern")
        .groupBy("_merchant")
        .agg(F.min("rule_order").alias("rule_order"))
    )
    matched = charges.withColumn("_merchant", F.upper("merchant")).join(first, "_merchant", "left").drop("_merchant")
    return matched.join(attributes, "rule_order", "left")


def classify(
    charges: DataFrame,
    rules: DataFrame,
    overrides: DataFrame,
    prior: DataFrame,
    cards: DataFrame,
    policy: Policy,
) -> DataFrame:
    """Tag and reason by ten ordered rules, coding always from the matching merchant rule.

    ``cards`` holds one row per known account: default_tag, default_why, personal_only,
    personal_from and a bounded exception (merchant word, first and last day).
    """
    known = charges.filter(F.trim(F.coalesce("ref", F.lit(""))) != "")
    rows = match_rule(with_decisions(known, overrides, prior), rules)
    rows = rows.join(cards, "account", "left")
    merchant = F.upper("merchant")
    day = F.col("date")
    on_exception = merchant.contains(F.col("exception_merchant")) & day.between(
        F.col("exception_from"), F.col("exception_to")
    )
    personal_only = F.coalesce("personal_only", F.lit(False))
    note = F.when(F.coalesce("override_note", F.lit("")) != "", F.concat(F.lit(" ("), "override_note", F.lit(")")))
    ladder = [
        ((F.col("kind") == "payment") | merchant.contains(policy.payment_phrase.upper()), "skip", "payment row"),
        (F.col("amount") < 0, "skip", "refund"),
        (
            F.col("override_tag").isNotNull(),
            F.col("override_tag"),
            F.concat(F.lit("override"), F.coalesce(note, F.lit(""))),
        ),
        (
            F.col("prior_tag").isin(*VALID_TAGS),
            F.col("prior_tag"),
            F.coalesce(F.nullif("prior_why", F.lit("")), F.lit("carried from prior classified ledger")),
        ),
        (personal_only & on_exception, "business", "bounded merchant exception"),
        (personal_only, "personal", "personal-only card"),
        (
            (day >= F.col("personal_from")) & (F.col("rule_tag") == "business"),
            "needs-tag",
            "business-looking on a personal card",
        ),
        (day >= F.col("personal_from"), "personal", "card personal from date"),
        (F.col("rule_tag").isNotNull(), F.col("rule_tag"), F.concat(F.lit("merchant rule "), "rule_name")),
        (day < F.lit(policy.split_date), "needs-tag", "pre-split charge, unknown merchant"),
        (F.col("default_tag").isNotNull(), F.col("default_tag"), F.col("default_why")),
    ]
    tag, why = F.lit("needs-tag"), F.concat(F.lit("unknown account "), "account")
    for condition, t, w in reversed(ladder):
        tag = F.when(condition, t if isinstance(t, Column) else F.lit(t)).otherwise(tag)
        why = F.when(condition, w if isinstance(w, Column) else F.lit(w)).otherwise(why)
    entity = F.coalesce(F.nullif("rule_entity", F.lit("")), F.lit(policy.default_entity))
    coding = [F.coalesce(c, F.lit("")).alias(c) for c in ("bas_account", "vat_regime", "konto_name")]
    base = [c for c in charges.columns if c not in ("entity",)]
    return rows.select(*base, tag.alias("tag"), why.alias("why"), entity.alias("entity"), *coding)


def tag_summary(classified: DataFrame) -> DataFrame:
    """Rows and amount per tag, with the business amount on every row for the totals line."""
    per_tag = classified.groupBy("tag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(18,2)").alias("amount")
    )
    business = F.when(F.col("tag") == "business", F.col("amount")).otherwise(F.lit(0).cast("decimal(18,2)"))
    return per_tag.withColumn("business_amount", business)


def ledger_diff(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Refs in only one of two classified ledgers, and refs whose tag changed."""
    a = prior.select("ref", F.col("tag").alias("prior_tag"), F.lit(True).alias("_a"))
    b = new.select("ref", F.col("tag").alias("new_tag"), F.lit(True).alias("_b"))
    both = a.join(b, "ref", "full_outer")
    change = (
        F.when(F.col("_b").isNull(), "only-prior")
        .when(F.col("_a").isNull(), "only-new")
        .when(~F.col("prior_tag").eqNullSafe(F.col("new_tag")), "tag-changed")
    )
    return both.withColumn("change", change).filter(F.col("change").isNotNull()).select(
        "ref", "change", "prior_tag", "new_tag"
    )


def key_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only."""
    left = a.select(key).distinct()
    right = b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("only-a")).unionByName(
        right.join(left, key, "left_anti").withColumn("side", F.lit("only-b"))
    )


def union_mentions(first: DataFrame, then: DataFrame) -> DataFrame:
    """Money mentions of two text parts of one document: the earlier part wins per value and currency."""
    parts = first.withColumn("_part", F.lit(0)).unionByName(then.withColumn("_part", F.lit(1)))
    return first_by(parts, ["id", "value", "currency"], [F.col("_part"), F.col("pos")], ["_part", "pos"]).select(
        "id", "value", "currency", F.col("_part").alias("part"), "pos"
    )


def any_equal(column: Column, values) -> Column:
    return any_of([column == v for v in values])
