"""Seed items with mutable state: overlay, tags, lanes, queues, summaries, follow-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import MONEY

VALID_TAGS = ("business", "personal", "needs-tag", "ignore")
VALID_STATUSES = ("ready", "needs-receipt", "blocked", "pending-payout", "done", "ignore")
STATE_COLUMNS = ("tag", "status", "operator_note")


def overlay(seeds: DataFrame, state: DataFrame) -> DataFrame:
    """Seed items with their state laid over them, column by column."""
    set_columns = [c for c in STATE_COLUMNS if c in state.columns]
    s = state.select("id", *[F.col(c).alias(f"_{c}") for c in set_columns])
    rows = seeds.join(s, "id", "left")
    for c in set_columns:
        under = F.col(c) if c in seeds.columns else F.lit(None).cast("string")
        rows = rows.withColumn(c, F.coalesce(f"_{c}", under))
    return rows.drop(*[f"_{c}" for c in set_columns])


def inferred_tag(items: DataFrame, cards: DataFrame) -> DataFrame:
    """Tag of an item that has none: from its status, its source, then its card.

    ``cards``: card_ending, business, personal_from.
    """
    digits = F.regexp_replace(F.coalesce("card", F.lit("")), "[^0-9]", "")
    rows = items.withColumn("card_ending", F.right(digits, F.lit(4))).join(
        cards.select("card_ending", "business", "personal_from"), "card_ending", "left"
    )
    tag = (
        F.when(F.coalesce("tag", F.lit("")) != "", F.col("tag"))
        .when(F.col("status") == "ignore", "ignore")
        .when(F.col("status").isin("done", "pending-payout"), "business")
        .when(F.col("source") == "document", "business")
        .when(F.coalesce("business", F.lit(False)), "business")
        .when(F.col("date") >= F.col("personal_from"), "personal")
        .otherwise("needs-tag")
    )
    return rows.withColumn("tag", tag).drop("business", "personal_from")


def evidence_exists(documents: DataFrame, charges: DataFrame, family: str) -> DataFrame:
    """Source documents with a card row of the same merchant family, date and amount."""
    rows = charges.filter(F.lower("merchant").contains(family.lower()))
    keys = rows.select("date", F.round("amount", 2).alias("_amount")).distinct().withColumn("matched", F.lit(True))
    keyed = documents.withColumn("_amount", F.round("amount", 2))
    return keyed.join(keys, ["date", "_amount"], "left").withColumn("matched", F.coalesce("matched", F.lit(False))).drop("_amount")


def lane(items: DataFrame, family: str) -> DataFrame:
    """Work lane of each item and what to do next."""
    document = F.col("source") == "document"
    matched = evidence_exists(items.filter(document), items.filter(F.col("source") == "card"), family)
    rows = matched.unionByName(items.filter(~F.coalesce(document, F.lit(False))).withColumn("matched", F.lit(False)))
    card = F.col("source") == "card"
    where = (
        F.when((F.col("status") == "ignore") | (F.col("tag") == "ignore"), "skip-ignore")
        .when(card & (F.col("tag") == "personal"), "personal-reconcile")
        .when(card & F.col("status").isin("done", "pending-payout"), "already-handled")
        .when(card & (F.col("tag") == "business"), "external-card-fortnox")
        .when(document & F.col("matched"), "document-matched")
        .when(document, "document-review")
        .otherwise("needs-classification")
    )
    laned = rows.withColumn("lane", where)
    note = F.coalesce(F.nullif("operator_note", F.lit("")), F.nullif("action", F.lit("")))
    booking = F.col("lane") == "external-card-fortnox"
    action = (
        F.when(booking & (F.col("status") == "ready"), "add to the accountant's pack")
        .when(booking & (F.col("status") == "needs-receipt"), F.concat(F.lit("find or request the invoice: "), F.coalesce(note, F.lit("missing invoice"))))
        .when(booking & (F.col("status") == "blocked"), F.concat(F.lit("blocked: "), F.coalesce(note, F.lit("waiting on external input"))))
        .when(F.col("lane") == "personal-reconcile", "keep out of the company's expenses")
        .when(F.col("lane") == "already-handled", "keep as evidence, no new booking")
        .when(F.col("lane") == "skip-ignore", "skip")
        .when(F.col("lane") == "document-review", "no card row matches, review")
        .when(F.col("lane") == "document-matched", "evidence for a card row")
        .otherwise(F.coalesce(F.nullif("action", F.lit("")), F.lit("review and classify")))
    )
    return laned.withColumn("next_action", action)


# Searched as one text, in this order.
SEARCHED = ["id", "source", "merchant", "date", "amount", "reference", "invoice", "purpose", "action", "operator_note"]


def search_items(items: DataFrame, source=None, tag=None, status=None, text=None) -> DataFrame:
    """Items by source, tag and status, and by free text over their columns; newest first."""
    rows = items
    for column, want in (("source", source), ("tag", tag), ("status", status)):
        if want:
            rows = rows.filter(F.col(column) == want)
    if text:
        present = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SEARCHED if c in items.columns]
        rows = rows.filter(F.lower(F.concat_ws(" ", *present)).contains(text.lower()))
    return rows.orderBy(F.desc("date"), "id")


def item_summary(items: DataFrame) -> DataFrame:
    """Rows and amount in all, by source, by status and by tag."""
    named = items.select(
        F.coalesce("source", F.lit("Unknown")).alias("source"),
        F.coalesce("status", F.lit("ready")).alias("status"),
        F.coalesce("tag", F.lit("needs-tag")).alias("tag"),
        "amount",
    )
    sets = named.groupingSets([[F.col("source")], [F.col("status")], [F.col("tag")], []], "source", "status", "tag")
    by = sets.agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.sum("amount").cast(MONEY).alias("amount")
    )
    facet = F.when(F.col("_g") == 3, "source").when(F.col("_g") == 5, "status").when(F.col("_g") == 6, "tag").otherwise("all")
    return by.select(facet.alias("facet"), F.coalesce("source", "status", "tag", F.lit("")).alias("value"), "n", "amount")


def lane_queues(laned: DataFrame) -> DataFrame:
    """Rows, amount and a status histogram per lane."""
    per = laned.groupBy("lane", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s"))
    histogram = F.array_sort(F.collect_list(F.struct("status", "n")))
    return per.groupBy("lane").agg(
        F.sum("n").alias("rows"),
        F.sum("s").cast(MONEY).alias("amount"),
        F.map_from_entries(histogram).alias("statuses"),
    )


def closeout_counts(items: DataFrame) -> DataFrame:
    """Overlapping subset counts and sums of a close-out pack, in one pass."""
    card = F.col("source") == "card"
    business = card & (F.col("tag") == "business")
    subsets = {
        "card": card,
        "business": business,
        "business_ready": business & (F.col("status") == "ready"),
        "business_missing": business & (F.col("status") == "needs-receipt"),
        "business_blocked": business & (F.col("status") == "blocked"),
        "done": card & (F.col("status") == "done"),
        "pending": card & (F.col("status") == "pending-payout"),
        "personal": card & (F.col("tag") == "personal"),
        "ignored": F.col("status") == "ignore",
        "matched": F.col("lane") == "document-matched",
        "unmatched": F.col("lane") == "document-review",
    }
    aggs: list[Column] = []
    for name, condition in subsets.items():
        aggs.append(F.count_if(condition).alias(f"{name}_n"))
        aggs.append(F.coalesce(F.sum(F.when(condition, F.col("amount"))), F.lit(0)).cast(MONEY).alias(f"{name}_sek"))
    return items.agg(*aggs)


def next_actions(items: DataFrame) -> DataFrame:
    """Open business rows, then open personal rows, newest first."""
    status = F.coalesce("status", F.lit("ready"))
    follow = (
        F.when((F.col("tag") == "business") & ~status.isin("done", "ignore", "pending-payout"), "business")
        .when((F.col("tag") == "personal") & (status != "ignore"), "personal")
    )
    rows = items.withColumn("list", follow).filter(F.col("list").isNotNull())
    return rows.orderBy("list", F.desc("date"), "id")


def import_state(state: DataFrame, patches: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new state, skipped patches with the reason).

    Unknown ids are skipped, an invalid tag or status is refused, the latest patch wins per field
    and a field no patch names keeps its value.
    """
    known = seeds.select("id", F.lit(True).alias("_known"))
    reason = (
        F.when(F.col("_known").isNull(), "unknown id")
        .when(F.coalesce("tag", F.lit("")).isin("", *VALID_TAGS) == F.lit(False), "invalid tag")
        .when(F.coalesce("status", F.lit("")).isin("", *VALID_STATUSES) == F.lit(False), "invalid status")
    )
    judged = patches.join(known, "id", "left").withColumn("reason", reason).drop("_known")

    def latest(c):
        given = F.col(c).isNotNull() if c == "operator_note" else F.coalesce(F.col(c), F.lit("")) != ""
        return F.max_by(F.when(given, F.col(c)), F.when(given, F.struct("updated_at", "line"))).alias(f"_{c}")

    news = judged.filter(F.col("reason").isNull()).groupBy("id").agg(
        *[latest(c) for c in STATE_COLUMNS], F.max("updated_at").alias("_updated_at")
    )
    both = state.join(news, "id", "full_outer")
    return both.select(
        "id",
        *[F.coalesce(f"_{c}", c).alias(c) for c in STATE_COLUMNS],
        F.coalesce("_updated_at", "updated_at").alias("updated_at"),
    ), judged.filter(F.col("reason").isNotNull())


def seed_state(seeds: DataFrame, state: DataFrame | None) -> DataFrame:
    """The items to work with: seeds alone where no state has been recorded yet."""
    if state is None:
        state = seeds.sparkSession.createDataFrame([], "id string, tag string, status string, operator_note string")
    return overlay(seeds, state)


