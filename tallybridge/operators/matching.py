"""Charges to evidence messages: blocking, scoring, ranking, routing, evaluation."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.money import format_money
from ..functions.scale import exploded, interval_join
from ..functions.text import contains_any, in_senders, merchant_tokens, norm_ws, starts_with_any, subject_key


@dataclass(frozen=True)
class MatchPolicy:
    """Settings of a job: thresholds and, by name, generic term lists (lists of settings, not tables)."""

    bands: dict = field(default_factory=lambda: {"expense": (-2, 1), "card": (-1, 1)})
    window: tuple = (10, 5)
    strong: int = 70
    possible: int = 45
    weak: int = 25
    forward_days: int = 40
    terms: dict = field(default_factory=dict)
    # Entity and the address its receipts are sent in from.
    identities: dict = field(default_factory=dict)

    def list(self, name: str):
        return self.terms.get(name, [])


# --------------------------------------------------------------------------- worklist to pairs

def search_scope(expenses: DataFrame) -> DataFrame:
    """Whether a row is searched at all, and if not why."""
    reason = (
        F.when(F.col("type") != "Card Purchase", "not a card purchase")
        .when(F.coalesce("reconciled", F.lit("")) != "", "already reconciled")
        .when(F.col("personal"), "marked personal")
        .when(F.col("has_receipt"), "receipt present")
        .when(F.col("tag").isin("personal", "skip"), F.concat(F.lit("not searched (tag "), "tag", F.lit(")")))
    )
    return expenses.withColumn("skip_reason", F.coalesce(reason, F.lit(""))).withColumn(
        "search", F.col("skip_reason") == ""
    )


def with_vendor(worklist: DataFrame, vendors: DataFrame, policy: MatchPolicy) -> DataFrame:
    """Worklist rows with their vendor's settings, search window and lag band."""
    rows = worklist.join(vendors, "vendor_key", "left")
    band_lo, band_hi = F.col("band_lo"), F.col("band_hi")
    for ledger, (lo, hi) in policy.bands.items():
        band_lo = F.coalesce(band_lo, F.when(F.col("ledger") == ledger, lo))
        band_hi = F.coalesce(band_hi, F.when(F.col("ledger") == ledger, hi))
    before = F.coalesce("before", F.lit(policy.window[0]))
    after = F.coalesce("after", F.lit(policy.window[1]))
    return (
        rows.withColumn("band_lo", band_lo)
        .withColumn("band_hi", band_hi)
        .withColumn("window_from", F.date_sub("date", before))
        .withColumn("window_to", F.date_add("date", after))
    )


def candidates(worklist: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages of the same mailbox inside each charge's window."""
    return interval_join(worklist, messages, ["mailbox"], "window_from", "window_to", "day").withColumn(
        "lag_days", F.datediff("day", "date")
    )


def _filed(df: DataFrame, keep: list[str], blocks: list[tuple[str, str, Column]]) -> DataFrame:
    """One row per key: ``kind``, ``field`` and ``key`` of blocks (kind, field, keys).

    Blocks are tagged whole and cut up afterwards, so that no key is wrapped and compared as a struct.
    """
    tagged = [F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), keys.cast("array<string>").alias("keys")) for kind, field, keys in blocks]
    rows = exploded(df, keep, F.array(*tagged), "_b")
    return exploded(rows, [*keep, "_b.kind", "_b.field"], F.array_distinct("_b.keys"), "key")


def _no_keys() -> Column:
    return F.array().cast("array<string>")


def charge_blocks(worklist: DataFrame, stopwords) -> DataFrame:
    """Search keys of each charge: vendor senders, subject terms, merchant words, amounts.

    A vendor with a search of its own (``search_from`` and ``search_subject``, addresses or domains and
    phrases) is searched by that in place of its senders. ``kind`` says what found a message, ``field``
    where its key is looked up.
    """
    def own(name: str) -> Column:
        return F.coalesce(name, _no_keys()) if name in worklist.columns else _no_keys()

    searched = F.size(F.concat(own("search_from"), own("search_subject"))) > 0
    senders = F.concat(F.coalesce("senders", _no_keys()), F.coalesce("sender_exact", _no_keys()))
    words = F.array_distinct(
        F.concat(merchant_tokens(F.col("merchant"), stopwords), merchant_tokens(F.col("vendor_name"), stopwords))
    )
    amounts = F.array_distinct(F.array_compact(F.array("amount_sek", "foreign_amount")))
    blocks = [
        ("vendor", "vendor", F.transform(F.when(searched, own("search_from")).otherwise(senders), F.lower)),
        ("vendor", "subject", F.transform(own("search_subject"), F.lower)),
        ("subject", "subject", F.transform(F.coalesce("subject_terms", _no_keys()), F.lower)),
        ("merchant", "merchant", F.when(F.size(senders) == 0, words).otherwise(_no_keys())),
        ("amount", "amount", F.filter(amounts, lambda a: a >= 10)),
    ]
    return _filed(worklist, ["row_key", "mailbox", "window_from", "window_to"], blocks)


def message_blocks(messages: DataFrame, subject_terms, search_words) -> DataFrame:
    """Keys a message can be found under: address and parent domains, subject terms, words, amounts."""
    labels = F.split("from_domain", r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    # Most domains have few labels; these need no list of them.
    few = F.array_distinct(F.array(*[F.substring_index("from_domain", ".", -i) for i in range(1, 5)]))
    domains = F.when(F.col("from_domain").isNull(), _no_keys()).when(F.substring_index("from_domain", ".", -4) == F.col("from_domain"), few).otherwise(parents)
    rows = messages.withColumn("_subject", F.lower("subject"))
    named = [F.when(F.col("_subject").contains(t.lower()), F.lit(t.lower())) for t in subject_terms]
    words = F.when(contains_any(F.col("_subject"), search_words), merchant_tokens(F.col("subject"), [])).otherwise(_no_keys())
    blocks = [
        ("vendor", "vendor", F.concat(F.array("from_addr"), domains)),
        ("subject", "subject", F.array_compact(F.array(*named)) if named else _no_keys()),
        ("merchant", "merchant", words),
        ("amount", "amount", F.col("mentions")["value"]),
    ]
    return _filed(rows, ["message_id", "mailbox", "day"], blocks).drop("kind")


# What can find a message, in the order in which they are listed.
KINDS = ["amount", "merchant", "subject", "vendor"]


def blocked_pairs(worklist: DataFrame, messages: DataFrame, stopwords, subject_terms, search_words) -> DataFrame:
    """Pairs a search would find: one equi join over every blocking key and day bucket.

    Kinds travel as bits, so that pairs are hashed together and not sorted. Charges of a mailbox
    without a message go before their keys are repeated by day bucket.
    """
    worklist = worklist.join(messages.select("mailbox").distinct(), "mailbox", "left_semi")
    bit = F.lit(0)
    for i, kind in enumerate(KINDS):
        bit = F.when(F.col("kind") == kind, 1 << i).otherwise(bit)
    pairs = interval_join(
        charge_blocks(worklist, stopwords).withColumn("kind", bit),
        message_blocks(messages, subject_terms, search_words),
        ["mailbox", "field", "key"],
        "window_from",
        "window_to",
        "day",
    )
    found = pairs.groupBy("row_key", "message_id").agg(F.bit_or("kind").alias("_bits"))
    kinds = F.array_compact(F.array(*[F.when(F.col("_bits").bitwiseAND(F.lit(1 << i)) != 0, kind) for i, kind in enumerate(KINDS)]))
    return found.select("row_key", "message_id", kinds.alias("kinds"))


def paged(hits: DataFrame, messages: DataFrame) -> DataFrame:
    """Every hit with its place on the charge's result page of each kind, newest first."""
    dated = hits.join(messages.select("message_id", "day"), "message_id").select("row_key", "message_id", "day", F.explode("kinds").alias("kind"))
    newest = Window.partitionBy("row_key", "kind").orderBy(F.desc("day"), F.desc("message_id"))
    return dated.withColumn("place", F.row_number().over(newest).cast("bigint")).drop("day")


def read_details(messages: DataFrame, details: DataFrame) -> DataFrame:
    """Messages with what their details say, as ``rescore`` reads it for pairs that pass the gate."""
    extra = details.select(
        "message_id",
        F.col("mentions").alias("more"),
        F.coalesce("has_pdf", F.lit(False)).alias("has_pdf"),
        F.coalesce("has_html", F.lit(False)).alias("has_html"),
        F.coalesce("links", _no_keys()).alias("links"),
    )
    return messages.join(extra, "message_id", "left")


def facing(hits: DataFrame, charges: DataFrame, messages: DataFrame) -> DataFrame:
    """The facts of both sides of each hit.

    Narrow hits meet messages first; the rows that come of it travel once more, to their charge,
    and stay there: ranking groups by charge and needs no further shuffle.
    """
    return hits.join(messages, "message_id").join(charges, "row_key").withColumn("lag_days", F.datediff("day", "date"))


# --------------------------------------------------------------------------- scoring

# Words that mark a failed payment.
FAIL_TERMS = ["failed", "could not", "declined", "misslyckades"]
# Company words that never identify a vendor by name.
NAME_FILLERS = ["the", "inc", "llc", "ltd"]


def message_features(messages: DataFrame, policy: MatchPolicy) -> DataFrame:
    """What scoring needs to know about a message, worked out once per message and not per pair."""
    rows = messages.withColumns(
        {"subject_text": F.lower(F.trim("subject")), "name_text": F.lower(F.coalesce("from_name", F.lit("")))}
    )
    subject, addr, dom = F.col("subject_text"), F.col("from_addr"), F.col("from_domain")
    own = policy.list("own_senders")
    generic = (
        F.when(in_senders(addr, dom, policy.list("corroboration_senders")), "corroboration")
        .when(in_senders(addr, dom, policy.list("decoy_senders")) | contains_any(subject, policy.list("decoy_terms")), "decoy")
        .when(
            starts_with_any(subject, policy.list("forward_prefixes"))
            | contains_any(F.lower(F.coalesce("to", F.lit(""))), policy.list("forward_addresses")),
            "forward",
        )
        .when(addr.isin(*own) if own else F.lit(False), "own")
        .when(starts_with_any(subject, policy.list("reply_prefixes")), "reply")
        .otherwise("receipt")
    )
    return rows.withColumns(
        {
            "mail_class": generic,
            "refund_word": contains_any(subject, policy.list("refund_terms")),
            "receipt_word": contains_any(subject, policy.list("receipt_terms")),
            "fail_word": contains_any(subject, FAIL_TERMS),
        }
    )


def charge_features(worklist: DataFrame, stopwords) -> DataFrame:
    """What scoring needs to know about a charge, worked out once per charge and not per pair."""
    words = F.filter(
        F.regexp_extract_all(F.lower(F.coalesce("vendor_name", F.lit(""))), F.lit("([a-z]{3,})"), F.lit(1)),
        lambda w: ~w.isin(*NAME_FILLERS),
    )
    tokens = F.transform(merchant_tokens(F.col("merchant"), stopwords), lambda t: F.lower(t))
    return worklist.withColumns({"tokens": tokens, "vendor_words": words})


def message_class() -> Column:
    """What kind of mail a candidate is for this charge: the mail's own class, but a sender the
    vendor is known to advertise from is a decoy, and a refund mail is never a charge's receipt."""
    vendor_decoy = F.exists(
        F.coalesce("decoy_senders", _no_keys()),
        lambda e: (F.col("from_domain") == e) | F.col("from_domain").endswith(F.concat(F.lit("."), e)) | (F.col("from_addr") == e),
    )
    return (
        F.when(F.col("mail_class") == "corroboration", "corroboration")
        .when(vendor_decoy | (F.col("mail_class") == "decoy"), "decoy")
        .when((F.col("kind") != "refund") & F.col("refund_word"), "refund")
        .otherwise(F.col("mail_class"))
    )


def band_distance(lag: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo - lag, lag - hi, F.lit(0))


def amount_level(mentions: str, allow_fx: Column) -> Column:
    """Best agreement between the charge and any money mention of the message."""
    sek, foreign, currency = F.col("amount_sek"), F.col("foreign_amount"), F.col("foreign_currency")

    def close(value, target):
        return F.coalesce(F.abs(value - target) <= F.lit(Decimal("0.01")), F.lit(False))

    def some(test):
        return F.exists(mentions, test)

    def in_sek(m):
        return F.coalesce(m["currency"] == "SEK", F.lit(False)) & sek.isNotNull()

    def in_foreign(m):
        return F.coalesce(m["currency"] == currency, F.lit(False))

    return (
        F.when(some(lambda m: in_sek(m) & close(m["value"], sek)), "sek_exact")
        .when(some(lambda m: in_foreign(m) & close(m["value"], foreign)), "foreign_exact")
        .when(some(lambda m: m["currency"].isNull() & (close(m["value"], sek) | close(m["value"], foreign))), "unlabelled")
        .when(allow_fx & (sek != 0) & some(lambda m: in_sek(m) & (F.abs(m["value"] - sek) <= sek * F.lit(Decimal("0.03")))), "sek_fx")
        .when((F.col("class") == "receipt") & some(lambda m: in_sek(m) | in_foreign(m)), "contradiction")
        .otherwise("none")
    )


# Points per amount agreement.
AMOUNT_POINTS = {"sek_exact": 40, "foreign_exact": 35, "unlabelled": 20, "sek_fx": 15, "contradiction": -15, "none": 0}

SCORE_PARTS = ["s_amount", "s_date", "s_sender", "s_subject", "s_attachment", "s_class"]


def _level_points(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in AMOUNT_POINTS.items() for x in pair]), level)


def _total() -> Column:
    return F.greatest(F.lit(-100), F.least(F.lit(100), sum((F.col(c) for c in SCORE_PARTS), F.lit(0))))


def _listed(address: Column, domain: Column) -> Column:
    """Whether an address, or its domain or a parent of it, is among the vendor's senders."""
    return F.exists(
        F.coalesce("senders", _no_keys()),
        lambda e: F.when(e.contains("@"), address == F.lower(e)).otherwise(
            (domain == F.lower(e)) | domain.endswith(F.concat(F.lit("."), F.lower(e)))
        ),
    )


def score(pairs: DataFrame) -> DataFrame:
    """First pass: score every pair from -100 to 100 on message headers, each part in its own column.

    ``pairs`` joins charges with ``charge_features`` to messages with ``message_features``.
    """
    rows = pairs.withColumns(
        {
            "class": message_class(),
            "band_gap": band_distance(F.col("lag_days"), F.col("band_lo"), F.col("band_hi")),
            "in_window": F.col("day").between(F.col("window_from"), F.col("window_to")),
        }
    )
    foreign_billed = F.col("foreign_amount").isNotNull() | (F.coalesce("bill_currency", F.lit("SEK")) != "SEK")
    fx = foreign_billed & F.col("in_window") & (F.col("band_gap") <= 5)
    day = (
        F.when(~F.col("in_window"), 0)
        .when(F.col("band_gap") == 0, 25)
        .otherwise(F.greatest(F.lit(5), F.lit(25) - F.col("band_gap") * 3))
    )
    known = F.col("vendor_key").isNotNull()
    name, subject = F.col("name_text"), F.col("subject_text")
    sender = (
        F.when(known & F.exists(F.coalesce("sender_exact", _no_keys()), lambda e: F.lower(e) == F.col("from_addr")), 20)
        .when(known & _listed(F.col("from_addr"), F.col("from_domain")), 15)
        .when(known & _listed(F.col("reply_addr"), F.col("reply_domain")), 12)
        .when(known & F.exists("vendor_words", lambda w: name.contains(w)), 10)
        .when(~known & F.exists("tokens", lambda t: F.concat_ws(" ", name, F.col("from_domain")).contains(t)), 10)
        .otherwise(0)
    )
    refund = F.col("refund_word")
    base = (
        F.when(
            F.exists(F.coalesce("subject_terms", _no_keys()), lambda t: subject.contains(F.lower(t)))
            | (refund & (F.col("kind") == "refund")),
            10,
        )
        .when(F.col("receipt_word"), 5)
        .otherwise(0)
    )
    worded = F.when(F.exists("tokens", lambda t: subject.contains(t)), 3).otherwise(0)
    class_points = (
        F.when(F.col("class") == "forward", -15).when(F.col("class") == "reply", -25).otherwise(0)
        + F.when(F.col("fail_word"), -20).otherwise(0)
    )
    parts = rows.withColumns(
        {
            "allow_fx": fx,
            "amount_match": amount_level("mentions", fx),
            "s_date": day.cast("int"),
            "s_sender": sender,
            "s_subject": F.when(refund & (F.col("kind") != "refund"), -20).otherwise(F.least(base + worded, F.lit(10))),
            "s_attachment": F.lit(0),
            "s_class": class_points,
        }
    ).drop(
        "tokens", "vendor_words", "subject_text", "name_text", "mail_class", "refund_word", "receipt_word", "fail_word",
        "sender_exact", "subject_terms", "decoy_senders", "from_name", "to",
    )
    return parts.withColumn("s_amount", _level_points(F.col("amount_match"))).withColumn("score", _total())


def has_signal() -> Column:
    """A vendor or amount signal, not just a day inside the window."""
    return (F.col("s_sender") > 0) | (F.col("s_subject") >= 10) | ~F.col("amount_match").isin("none", "contradiction")


def two_signals() -> Column:
    """The amount agrees, or sender and subject both point at a receipt."""
    return ~F.col("amount_match").isin("none", "contradiction") | ((F.col("s_sender") > 0) & (F.col("s_subject") >= 5))


REJECTED_CLASSES = ("corroboration", "decoy", "own", "refund")


def gated() -> Column:
    """Whether a scored pair earns a read of its details: any signal, and no class that rules it out."""
    return F.coalesce(~F.col("class").isin(*REJECTED_CLASSES) & has_signal(), F.lit(False))


def detail_gate(scored: DataFrame) -> DataFrame:
    """The signalled candidates of each charge, best first; all of them, however many."""
    best = Window.partitionBy("row_key").orderBy(F.desc("score"), F.desc("day"), "message_id")
    return scored.filter(gated()).withColumn("gate_rank", F.row_number().over(best))


CANDIDATE_COLUMNS = [
    "row_key", "message_id", "thread_id", "day", "subject", "class", "lag_days", "band_gap", "amount_match",
    *SCORE_PARTS, "score", "meta_score", "has_pdf", "has_html",
]


def rescore(scored: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Second pass: mentions, attachments and links count for gated pairs only.

    Only the amount and attachment parts can change; the header score stays as ``meta_score``.
    Without ``details`` the pairs carry them (``read_details``), once per message and not per pair.
    """
    rows = scored.withColumn("gated", gated())
    if details is not None:
        rows = read_details(rows, details)
    rows = rows.withColumns(
        {
            "meta_score": F.col("score"),
            "has_pdf": F.coalesce(F.col("gated") & F.col("has_pdf"), F.lit(False)),
            "has_html": F.coalesce(F.col("gated") & F.col("has_html"), F.lit(False)),
            "mentions": F.when(F.col("gated") & F.col("more").isNotNull(), F.array_union("mentions", "more")).otherwise(
                F.col("mentions")
            ),
        }
    )
    kind = F.when(F.col("vendor_key").isNotNull(), F.col("attachments"))
    link = F.exists(
        F.coalesce("links", _no_keys()),
        lambda u: u.rlike("(?i)invoice|receipt|pdf|faktura|kvitto")
        | _listed(F.lit(""), F.lower(F.regexp_extract(u, "^https?://([^/:?#]+)", 1))),
    )
    attachment = (
        F.when(kind == "pdf", F.when(F.col("has_pdf"), 5).otherwise(0))
        .when(kind.isin("html", "none"), F.when(F.col("has_html"), 5).otherwise(0))
        .when(kind == "link", F.when(link, 5).otherwise(0))
        .when(F.col("has_pdf"), 5)
        .when(F.col("has_html"), 2)
        .otherwise(0)
    )
    level = F.when(F.col("gated"), amount_level("mentions", F.col("allow_fx"))).otherwise(F.col("amount_match"))
    parts = rows.withColumns(
        {"amount_match": level, "s_attachment": F.when(F.col("gated"), attachment).otherwise(F.lit(0))}
    )
    final = parts.withColumn("s_amount", _level_points(F.col("amount_match"))).withColumn("score", _total())
    return final.select(*CANDIDATE_COLUMNS)


def confidence(policy: MatchPolicy) -> Column:
    base = (
        F.when(F.col("score") >= policy.strong, "strong")
        .when(F.col("score") >= policy.possible, "possible")
        .when(F.col("score") >= policy.weak, "weak")
        .otherwise("dropped")
    )
    late = F.when((F.col("band_gap") > 14) & (base == "strong"), "possible").otherwise(base)
    return F.when(late.isin("strong", "possible") & ~two_signals(), "weak").otherwise(late)


def rank_candidates(scored: DataFrame, policy: MatchPolicy, top: int = 5) -> DataFrame:
    """The candidates shown per charge.

    One winner per thread, then strong and possible ones by score, distance from the band and age;
    with none of those at most two weak ones that carry two signals. Good candidates sort first,
    so keeping the first ``top`` rows per charge loses nothing and is done before the shuffle.
    """
    pool = scored.filter(~F.col("class").isin(*REJECTED_CLASSES))
    order = [-F.col("score"), -F.col("meta_score"), -F.unix_date("day"), F.col("message_id")]
    keep = ["message_id", "day", "subject", "score", "band_gap", "amount_match", "s_sender", "s_subject", "has_pdf"]
    winners = (
        pool.groupBy("row_key", "thread_id")
        .agg(
            F.min_by(F.struct(*keep), F.struct(*order)).alias("_w"),
            (F.count(F.lit(1)) - 1).alias("same_thread"),
        )
        .select("row_key", "thread_id", "_w.*", "same_thread")
    )
    rated = winners.withColumn("confidence", confidence(policy))
    good = F.col("confidence").isin("strong", "possible")
    hint = (F.col("confidence") == "weak") & two_signals()
    shown = rated.withColumn("_tier", F.when(good, 0).when(hint, 1)).filter(F.col("_tier").isNotNull())
    by = Window.partitionBy("row_key").orderBy(
        "_tier", F.desc("score"), "band_gap", F.desc("day"), "message_id"
    )
    first = shown.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    lead = Window.partitionBy("row_key")
    return (
        first.withColumn("_best", F.min("_tier").over(lead))
        .filter((F.col("_tier") == F.col("_best")) & ((F.col("_tier") == 0) | (F.col("rank") <= 2)))
        .drop("_tier", "_best")
    )


def side_lists(scored: DataFrame, top: int = 3) -> DataFrame:
    """Messages that support a charge without proving it, and those set aside with the reason.

    The best ``top`` of each list per charge, by header score.
    """
    kind = F.when(F.col("class") == "corroboration", "corroboration").when(F.col("class").isin(*REJECTED_CLASSES), "rejected")
    reason = (
        F.when(F.col("class") == "own", "sent by the mailbox owner, not a receipt")
        .when(F.col("class") == "refund", "refund mail, not the receipt of a charge")
        .when(F.col("class") == "decoy", "decoy sender or subject")
        .otherwise("")
    )
    rows = scored.withColumn("list", kind).filter(F.col("list").isNotNull()).select(
        "row_key", "list", "message_id", "score", "day", reason.alias("reason")
    )
    by = Window.partitionBy("row_key", "list").orderBy(F.desc("score"), F.desc("day"), "message_id")
    return rows.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= top).drop("day")


def best_second(ranked: DataFrame) -> DataFrame:
    """First and second candidate of each charge side by side."""
    def at(n, c, name):
        return F.max(F.when(F.col("rank") == n, F.col(c))).alias(name)

    wide = ranked.groupBy("row_key").agg(
        at(1, "message_id", "best"),
        at(1, "thread_id", "best_thread"),
        at(1, "day", "best_day"),
        at(1, "subject", "best_subject"),
        at(1, "score", "best_score"),
        at(1, "confidence", "confidence"),
        at(1, "has_pdf", "best_pdf"),
        at(1, "band_gap", "best_gap"),
        at(2, "message_id", "second"),
        at(2, "confidence", "second_confidence"),
        at(2, "has_pdf", "second_pdf"),
        F.count(F.lit(1)).alias("candidates"),
    )
    extra = (F.col("second_confidence") == "strong") | (
        (F.col("second_confidence") == "possible") & F.col("second_pdf") & ~F.col("best_pdf")
    )
    secondary = F.when(F.coalesce(extra, F.lit(False)) & F.col("confidence").isin("strong", "possible"), F.col("second"))
    return wide.withColumn("secondary", secondary)


def related_sends(best: DataFrame, sends: DataFrame, prefixes) -> DataFrame:
    """The latest earlier send that belongs to a best message, at most one per charge and ``side``.

    A send belongs to it if it is in the same mailbox and either in the same thread or of the same
    subject, where that holds a number. The side ``window`` takes sends inside the charge's search
    window, whatever their day; ``index`` takes sends of any time from the day of the best message on.
    Sends are reduced to one a day per mailbox and thread or subject before they meet charges, and
    to the latest of all for the index, so a charge meets no more sends than its window has days.

    ``best``: row_key, mailbox, window_from, window_to and the columns of ``best_second``.
    """
    def keys(thread: Column, subject: Column) -> Column:
        numbered = F.when(subject.rlike("[0-9]{3,}"), F.concat(F.lit("s:"), subject))
        return F.array_compact(F.array(F.concat(F.lit("t:"), thread), numbered))

    charges = exploded(
        best.withColumn("_subject", subject_key(F.col("best_subject"), prefixes)),
        ["row_key", "mailbox", "best", "best_day", "window_from", "window_to"], keys(F.col("best_thread").cast("string"), F.col("_subject")), "_k",
    )
    filed = exploded(
        sends.withColumn("_subject", subject_key(F.col("subject"), prefixes)),
        ["mailbox", "day", F.struct(F.col("message_id").alias("send_id"), F.col("from_addr").alias("send_from")).alias("_s")],
        keys(F.col("thread_id").cast("string"), F.col("_subject")), "_k",
    )
    daily = filed.groupBy("mailbox", "_k", "day").agg(F.max("_s").alias("_s"))
    latest = daily.groupBy("mailbox", "_k").agg(F.max(F.struct("day", "_s")).alias("_l")).select("mailbox", "_k", "_l.day", "_l._s")
    index = charges.join(latest, ["mailbox", "_k"]).filter(F.col("day") >= F.col("best_day"))
    window = interval_join(charges, daily, ["mailbox", "_k"], "window_from", "window_to", "day")
    cols = ["row_key", "best", "day", "_s"]
    both = index.select(F.lit("index").alias("side"), *cols).unionByName(window.select(F.lit("window").alias("side"), *cols))
    last = both.groupBy("row_key", "best", "side").agg(F.max(F.struct("day", "_s")).alias("_l"))
    return last.select("row_key", "best", "side", F.col("_l._s.send_id").alias("send_id"), F.col("_l.day").alias("send_day"), F.col("_l._s.send_from").alias("send_from"))


def last_send(related: DataFrame) -> DataFrame:
    """The later of a charge's sends: ``sent_id``, ``sent_day``, ``sent_from``."""
    last = related.groupBy("row_key").agg(F.max(F.struct("send_day", "send_id", "send_from")).alias("_l"))
    return last.select("row_key", F.col("_l.send_id").alias("sent_id"), F.col("_l.send_day").alias("sent_day"), F.col("_l.send_from").alias("sent_from"))


# What an input row says when its receipt has been sent in already.
SENT_PHRASES = ["confirm in app", "delvis kvittomatchning", "already forwarded"]
SENT_WHEN = r"forwarded (today|yesterday|on [0-9]|[0-9]{4}-[0-9]{2}-[0-9]{2})"


def said_sent(*hints: Column) -> Column:
    """Whether the notes of an input row say that its receipt was sent in."""
    text = F.lower(F.concat_ws(" ", *hints))
    return contains_any(text, SENT_PHRASES) | text.rlike(SENT_WHEN)


def route(rows: DataFrame, policy: MatchPolicy, run_date: Column) -> DataFrame:
    """What to do with a charge: confirm, forward, attach, pack, portal or none, and why.

    ``rows`` is the worklist with its vendor settings and its best candidate (nulls without one),
    plus ``sent_day`` (and ``sent_from``) of the latest earlier send. Where they are there, the notes
    of the input row (``status_hint``, ``hint_evidence``, ``hint_action``) and ``expense_id`` count too.
    """
    def given(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in rows.columns else F.lit("")

    age = F.datediff(run_date, "date")
    deadline = F.date_add("date", policy.forward_days - 1)
    usable = F.coalesce(F.col("confidence").isin("strong", "possible"), F.lit(False))
    expense = F.col("ledger") == "expense"
    sent = F.col("sent_day").isNotNull()
    told = said_sent(given("status_hint"), given("hint_evidence"), given("hint_action"))
    business = F.coalesce("tag", F.lit("")) == "business"
    fallback = F.coalesce("route_if_none", F.lit("none"))
    recent = age <= 1
    identity = F.lit(None).cast("string")
    for entity, address in policy.identities.items():
        identity = F.when(F.col("entity") == entity, address).otherwise(identity)
    decision = (
        F.when(usable & expense & (sent | told), "confirm")
        .when(usable & expense & (age < policy.forward_days), "forward")
        .when(usable & expense, "attach")
        .when(usable & business, "pack")
        .when(usable, "none")
        .when(fallback == "portal", "portal")
        .otherwise("none")
    )
    portal = F.coalesce(F.nullif("portal", F.lit("")), F.lit("vendor portal"))
    best = F.col("best").cast("string")
    by_number = F.concat(F.lit("; find the expense by receipt number "), "row_key")
    target = F.when(given("expense_id") != "", F.concat(F.lit(" on expense "), given("expense_id"))).otherwise(by_number)
    reason = (
        F.when(usable & expense & sent, F.concat(F.lit("already forwarded "), F.col("sent_day").cast("string"), F.lit("; confirm, do not forward again")))
        .when(usable & expense & told, F.concat(F.lit("already forwarded according to the input; confirm "), best, F.lit(", do not forward again")))
        .when(usable & expense & (age < policy.forward_days), F.concat(F.lit("forward "), best, F.lit(" before "), deadline.cast("string")))
        .when(usable & expense, F.concat(F.lit("attach "), best, target))
        .when(usable & business, F.concat_ws("; ", F.concat(F.lit("include "), best), F.concat(F.lit("secondary "), F.col("secondary").cast("string"))))
        .when(usable, F.concat(F.lit("receipt found ("), best, F.lit(") but the row needs a tag, now "), F.coalesce(F.nullif("tag", F.lit("")), F.lit("untagged"))))
        .when(fallback == "portal", portal)
        .when(fallback.isin("request", "ask"), F.coalesce(F.nullif("portal", F.lit("")), fallback))
        .when(F.col("vendor_key").isNotNull() & recent, F.concat(F.lit("too recent, recheck after "), F.date_add("date", 2).cast("string")))
        .otherwise("no receipt mail found in the search window")
    )
    other = usable & expense & sent & (F.nullif(given("sent_from"), F.lit("")) != identity)
    notes = F.concat_ws(
        "; ",
        F.when(F.col("vendor_entity") != F.col("entity"), F.lit("the vendor is listed under another entity")),
        F.when(other, F.concat(F.lit("that forward went from "), given("sent_from"), F.lit(", not from "), identity)),
        F.when(usable & (F.col("confidence") == "possible"), "review amount first"),
        F.when(usable & (F.col("best_gap") > 14), "verify the month"),
    )
    text = F.concat(
        F.when(F.col("kind") == "refund", "refund ").otherwise(""),
        reason,
        F.when(notes != "", F.concat(F.lit(" ("), notes, F.lit(")"))).otherwise(""),
    )
    out = (
        rows.withColumn("age_days", age)
        .withColumn("route", decision)
        .withColumn("route_reason", text)
        .withColumn("forward_from", F.when(F.col("route") == "forward", identity))
        .withColumn("forward_deadline", F.when(F.col("route") == "forward", deadline))
        .withColumn("recheck_after", F.when(~usable & recent, F.date_add("date", 2)))
    )
    # The input's own hint is kept in sight, unless it says what the route or the reason says.
    hint = norm_ws(given("status_hint"))
    low = F.lower(hint)
    repeated = hint.contains(" ") & F.lower("route_reason").contains(low)
    shown = (hint != "") & ~low.startswith("ready") & (low != F.col("route")) & ~repeated
    return out.withColumn("route_reason", F.when(shown, F.concat("route_reason", F.lit("; input hint: "), hint)).otherwise(F.col("route_reason")))


def fetch_decision(routed: DataFrame, min_confidence: str = "strong") -> DataFrame:
    """Which messages to fetch for a charge, in order, or a note why none."""
    rank = F.when(F.col("confidence") == "strong", 2).when(F.col("confidence") == "possible", 1).otherwise(0)
    need = {"strong": 2, "possible": 1}[min_confidence]
    go = (F.col("route") == "pack") & (rank >= need)
    ids = F.when(go, F.array_compact(F.array("best", "secondary"))).otherwise(F.array().cast("array<bigint>"))
    note = (
        F.when(go, "")
        .when(
            (F.col("route") == "pack") & (F.col("confidence") == "possible"),
            F.concat(F.lit("possible only, not fetched: "), "route_reason"),
        )
        .otherwise(F.concat("route", F.lit("/"), F.coalesce("confidence", F.lit("none")), F.lit(": "), "route_reason"))
    )
    return routed.withColumn("fetch_ids", ids).withColumn("fetch_note", note)


def evaluate(truth: DataFrame, ranked: DataFrame) -> DataFrame:
    """PASS, FAIL, INFO or SKIP per labelled charge, with the rank of the expected message.

    ``truth``: row_key, set, expected and secondary message (null when none).
    """
    expected = ranked.select("row_key", F.col("message_id").alias("expected"), F.col("rank").alias("expected_rank"))
    secondary = ranked.select("row_key", F.col("message_id").alias("secondary"), F.col("rank").alias("secondary_rank"))
    lead = ranked.filter(F.col("rank") == 1).select("row_key", F.col("confidence").alias("lead_confidence"))
    rows = (
        truth.join(expected, ["row_key", "expected"], "left")
        .join(secondary, ["row_key", "secondary"], "left")
        .join(lead, "row_key", "left")
    )
    verdict = (
        F.when(F.col("set").isin("pending", "positive_weak"), "INFO")
        .when(F.col("set") == "negative", F.when(F.col("lead_confidence") == "strong", "FAIL").otherwise("PASS"))
        .when(F.col("set") == "forward_only", F.when(F.col("secondary_rank").isNotNull(), "PASS").otherwise("FAIL"))
        .when(F.col("expected").isNull(), "SKIP")
        .when(F.col("expected_rank") == 1, "PASS")
        .when((F.col("set") == "positive_medium") & F.col("expected_rank").isNotNull(), "PASS")
        .otherwise("FAIL")
    )
    return rows.select("row_key", "set", verdict.alias("verdict"), F.col("expected_rank").alias("expected_rank"))


def evaluation_summary(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("set", "verdict").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("expected_rank") == 1).alias("at_rank_1")
    )


def latest_search(runs: DataFrame) -> DataFrame:
    """Newest search per key; a row is reachable by its row key and by its expense id.

    ``runs``: run_at, row_key, expense_id, queries (array of kind and hits), candidates, best.
    """
    keys = F.array_distinct(F.filter(F.array("row_key", "expense_id"), lambda k: F.coalesce(k, F.lit("")) != ""))
    spread = runs.filter(F.size("queries") > 0).withColumn("key", F.explode(keys))
    facts = F.struct(
        "run_at",
        F.size("queries").alias("query_count"),
        F.array_join(F.array_distinct(F.transform("queries", lambda q: q["kind"])), ",").alias("kinds"),
        F.aggregate("queries", F.lit(0).cast("bigint"), lambda a, q: a + q["hits"]).alias("hits"),
        "candidates",
        F.col("best").isNotNull().alias("has_best"),
    )
    order = F.struct("run_at", "row_key", "candidates", F.size("queries"))
    return spread.groupBy("key").agg(F.max_by(facts, order).alias("_r")).select("key", "_r.*")


def reusable(lists: DataFrame, now: Column) -> DataFrame:
    """Whether a stored result list may still be used, by the age of its window at fetch time."""
    age = F.unix_timestamp(now) - F.unix_timestamp("fetched_at")
    closed = F.datediff(F.to_date("fetched_at"), "window_end")
    ok = F.when(closed < 1, age <= 6 * 3600).otherwise((age <= 7 * 86400) | (closed > 14))
    return lists.withColumn("closed_days", closed).withColumn("reuse", ok)


def purge(details: DataFrame, lists: DataFrame, extract_version: int) -> DataFrame:
    """Stored details to drop: referenced by no list, or extracted by an older version."""
    used = lists.select(F.explode("ids").alias("message_id")).distinct().withColumn("_used", F.lit(True))
    rows = details.join(used, "message_id", "left")
    reason = (
        F.when(F.col("_used").isNull(), "unreferenced").when(F.col("extract_version") != extract_version, "old extract")
    )
    return rows.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("_used")


def fetch_coverage(records: DataFrame) -> DataFrame:
    """Rows by outcome, and how many of them have at least one file."""
    return records.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("files") > 0).alias("covered"),
        F.sum(F.when(F.col("status") == "fetched", F.col("files")).otherwise(0)).alias("new_files"),
    )


def worklist_table(routed: DataFrame) -> DataFrame:
    """The person-facing short table: one sentence per row, a deadline only where one is due."""
    return routed.select(
        "date",
        "merchant",
        format_money(F.col("amount_sek")).alias("amount"),
        "route",
        F.col("route_reason").alias("what_to_do"),
        F.coalesce(F.col("forward_deadline").cast("string"), F.lit("")).alias("deadline"),
        F.coalesce("confidence", F.lit("none")).alias("confidence"),
        "row_key",
    )

