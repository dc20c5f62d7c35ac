"""Merchant text to vendor: tokens, cleaning, tiered resolution, canonical names, senders."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import required_runs_of
from ..functions.scale import containing_pairs, exploded
from ..functions.text import compact, domain_of, merchant_tokens, norm_ws, slug
from ..session import settle

# Payment processors whose name leads a card descriptor.
PROCESSORS = [
    "PADDLE.NET", "PADDLE", "FS", "ZETTLE", "IZ", "IZETTLE", "SQ", "SUMUP", "PAYPAL", "PP", "LINK.COM", "CKO",
    "SVEA", "KLARNA", "STRIPE", "TST", "SP", "DRI", "2CO", "CHECKOUT", "ADYEN", "MOLLIE", "NETS", "BAMBORA",
    "TRUSTLY",
]
# Domain endings dropped from a merchant text.
ENDINGS = ["io", "co", "net", "ai", "dev", "app", "org", "eu", "com", "se", "nu", "uk", "us", "de", "dk", "no", "fi"]

# Tasks that merchants are dealt to where a regex has to be tried on all of them.
PARTS = 64


def exploded_tokens(rows: DataFrame, key: str, text: str, stopwords) -> DataFrame:
    """One row per distinctive word of a merchant text, with its position."""
    words = merchant_tokens(F.col(text), stopwords)
    return rows.select(key, F.posexplode(words).alias("pos", "token"))


def distinctive_tokens(vendors: DataFrame, stopwords) -> DataFrame:
    """Words used by exactly one vendor in its merchant texts or its name."""
    texts = vendors.select("vendor_order", "vendor_key", F.explode(F.array_append("merchants", F.col("name"))).alias("_t"))
    words = texts.select("vendor_order", "vendor_key", F.explode(merchant_tokens(F.col("_t"), stopwords)).alias("token"))
    owned = words.groupBy("token").agg(
        F.min("vendor_order").alias("vendor_order"),
        F.max("vendor_order").alias("_last"),
        F.min_by("vendor_key", "vendor_order").alias("vendor_key"),
    )
    return owned.filter(F.col("vendor_order") == F.col("_last")).drop("_last")


def regex_hits(merchants: DataFrame, vendors: DataFrame) -> DataFrame:
    """(merchant, vendor_order, length of the match) for every vendor regex that a merchant matches.

    A regex is filed under runs of which each of its matches holds one, so it is only tried on
    merchants that hold such a run, whatever the number of regexes. One without any such run may
    match anything and is tried on every merchant.
    """
    rows = vendors.filter(F.col("merchant_regex").isNotNull()).select("vendor_order", F.concat(F.lit("(?i)"), "merchant_regex").alias("regex"), required_runs_of(F.col("merchant_regex")).alias("_runs"))
    filed = rows.select("vendor_order", "regex", F.explode("_runs").alias("run"))
    near = containing_pairs(merchants, "merchant", filed, "run").select("merchant", "vendor_order", "regex").distinct()
    free = filed.filter(F.col("run") == "").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).drop("run")
    parted = merchants.withColumn("_part", F.pmod(F.xxhash64("merchant"), F.lit(PARTS)).cast("int"))
    anywhere = parted.join(free, "_part").select("merchant", "vendor_order", "regex")
    tried = near.unionByName(anywhere).filter(F.regexp_like("merchant", F.col("regex")))
    length = F.greatest(F.length(F.call_function("regexp_extract", F.col("merchant"), F.col("regex"), F.lit(0))), F.lit(1))
    return tried.select("merchant", "vendor_order", length.alias("length"))


def _candidates(merchants: DataFrame, vendors: DataFrame, tiered: bool, stopwords=()) -> DataFrame:
    """(merchant, tier, length, rank, vendor_order) for every way a distinct merchant can match."""
    texts = vendors.select("vendor_order", "merchant_exact", F.explode("merchants").alias("_p")).select(
        "vendor_order", "merchant_exact", F.upper(norm_ws(F.col("_p"))).alias("pattern")
    ).filter(F.col("pattern") != "")
    exact = merchants.join(texts.filter("merchant_exact").drop("merchant_exact"), F.col("merchant") == F.col("pattern"))
    within = containing_pairs(merchants, "merchant", texts.filter(~F.col("merchant_exact")).drop("merchant_exact"), "pattern")

    def shape(df: DataFrame, tier: int, length: Column, rank: Column) -> DataFrame:
        return df.select(
            "merchant",
            F.lit(tier).alias("tier"),
            length.cast("int").alias("length"),
            rank.cast("string").alias("rank"),
            "vendor_order",
        )

    none = F.lit("")
    found = shape(exact, 1 if tiered else 0, F.lit(0) if tiered else F.length("pattern"), none).unionByName(
        shape(within, 2 if tiered else 0, F.length("pattern"), none)
    )
    matched = regex_hits(merchants, vendors)
    found = found.unionByName(shape(matched, 3 if tiered else 0, F.lit(0) if tiered else F.col("length"), none))
    if tiered:
        words = merchants.select("merchant", F.explode(merchant_tokens(F.col("merchant"), stopwords)).alias("token"))
        by_word = words.join(distinctive_tokens(vendors, stopwords).drop("vendor_key"), "token")
        found = found.unionByName(shape(by_word, 4, F.lit(0), F.col("token")))
    return found


def _choices(found: DataFrame, vendors: DataFrame) -> DataFrame:
    """Per merchant its equally good vendors in order. The best tier is known before anything is listed,
    so a list holds ties only."""
    ways = found.groupBy("merchant", "vendor_order").agg(F.min(F.struct("tier", (-F.col("length")).alias("neg"), "rank")).alias("_b"))
    ways = ways.select("merchant", "vendor_order", F.struct("_b.tier", "_b.neg").alias("_way"), "_b.rank")
    best = ways.groupBy("merchant").agg(F.min("_way").alias("_best"))
    tied = ways.join(best, "merchant").filter(F.col("_way") == F.col("_best"))
    details = vendors.select("vendor_order", "vendor_key", F.col("name").alias("vendor_name"), "bill_currency", "amounts")
    one = F.struct(F.col("_way.tier").alias("tier"), F.col("_way.neg").alias("neg"), "rank", "vendor_order", "vendor_key", "vendor_name", "bill_currency", "amounts")
    return tied.join(details, "vendor_order").groupBy("merchant").agg(F.array_sort(F.collect_list(one)).alias("_choices"))


def resolve_vendor(charges: DataFrame, vendors: DataFrame, stopwords) -> DataFrame:
    """Vendor per charge by four tiers: exact text, longest contained text, regex, own word.

    Vendors tied in the winning tier are told apart by a listed amount (in the foreign currency,
    or in SEK for a vendor billed in SEK), else the first in table order wins and the row is
    flagged ambiguous. Matching runs over the distinct merchants only.
    """
    keyed = charges.withColumn("_m", F.upper(norm_ws(F.col("merchant"))))
    merchants = settle(keyed.select(F.col("_m").alias("merchant")).distinct())  # read once per tier
    choices = _choices(_candidates(merchants, vendors, True, stopwords), vendors).withColumnRenamed("merchant", "_m")
    joined = keyed.join(choices, "_m", "left")

    def listed(c):
        return F.exists(
            c["amounts"],
            lambda a: ((a["currency"] == F.col("foreign_currency")) & (F.abs(a["amount"] - F.col("foreign_amount")) <= F.lit(Decimal("0.01"))))
            | (
                (c["bill_currency"] == "SEK")
                & (a["currency"] == "SEK")
                & (F.abs(a["amount"] - F.col("amount_sek")) <= F.lit(Decimal("0.01")))
            ),
        )

    by_amount = F.try_element_at(F.filter("_choices", listed), F.lit(1))
    many = F.size("_choices") > 1
    picked = F.when(many, F.coalesce(by_amount, F.try_element_at("_choices", F.lit(1)))).otherwise(
        F.try_element_at("_choices", F.lit(1))
    )
    return (
        joined.withColumn("_pick", picked)
        .withColumn("vendor_key", F.col("_pick.vendor_key"))
        .withColumn("vendor_tier", F.col("_pick.tier"))
        .withColumn("ambiguous", F.coalesce(many & by_amount.isNull(), F.lit(False)))
        .drop("_m", "_choices", "_pick")
    )


def merchant_core(text: Column) -> Column:
    """The side of the star that names the merchant: right after a processor, else left."""
    left = F.regexp_extract(text, r"^\s*([^*]+?)\s*\*\s*(.+?)\s*$", 1)
    right = F.regexp_extract(text, r"^\s*([^*]+?)\s*\*\s*(.+?)\s*$", 2)
    name = F.regexp_replace(F.upper(left), "_+$", "")
    return F.when(left == "", F.trim(text)).when(name.isin(*PROCESSORS), right).otherwise(left)


def is_statement_code(token: Column) -> Column:
    """Letters and digits mixed the way a statement reference is, never a brand like 1PASSWORD."""
    return (
        (F.length(token) >= 6)
        & token.rlike("[0-9]")
        & token.rlike("[A-Za-z]")
        & (token.rlike("[0-9].*[0-9]") | token.rlike("[A-Za-z][0-9]"))
    )


def clean_merchant(merchant: Column, stopwords) -> Column:
    """Merchant text without processor, domain ending, stopwords, codes and repeated words."""
    core = merchant_core(norm_ws(merchant))
    bare = F.regexp_replace(core, "(?i)(?<=[A-Za-z0-9])\\.(?:" + "|".join(ENDINGS) + ")\\b", " ")
    stop = F.array(*[F.lit(w) for w in [*stopwords, "*", ""]])
    words = F.split(F.trim(bare), r"[\s*./\\|_]+")
    kept = F.filter(words, lambda w: ~F.array_contains(stop, F.upper(w)) & ~is_statement_code(w))
    once = F.filter(kept, lambda w, i: F.array_position(F.transform(kept, F.upper), F.upper(w)) == i + 1)
    return F.array_join(once, " ")


def title_case(text: Column) -> Column:
    """Capitalise words that are all upper or all lower case; leave mixed case alone."""
    def word(w):
        uniform = ((w == F.upper(w)) | (w == F.lower(w))) & (F.upper(w) != F.lower(w))
        cased = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
        return F.when(uniform, cased).otherwise(w)

    return F.array_join(F.transform(F.split(text, " "), word), " ")


def canonical_vendor(charges: DataFrame, vendors: DataFrame, rules: DataFrame, stopwords) -> DataFrame:
    """Vendor name and slug per charge.

    The longest alias match of any kind wins (ties by listed amount, then table order); an alias
    of a payment processor (key ending in ``_other``) names the vendor by its cleaned text; then
    the first coding rule; else the cleaned merchant text.
    """
    keyed = charges.withColumn("_text", norm_ws(F.col("merchant"))).withColumn("_m", F.upper("_text"))
    merchants = settle(keyed.select(F.col("_m").alias("merchant")).distinct())  # read once per tier
    choices = _choices(_candidates(merchants, vendors, False), vendors)
    patterns = rules.select("rule_order", F.col("name").alias("rule_name"), F.explode("patterns").alias("_p")).select(
        "rule_order", "rule_name", F.upper("_p").alias("pattern")
    )
    by_rule = (
        containing_pairs(merchants, "merchant", patterns, "pattern")
        .groupBy("merchant")
        .agg(F.min_by("rule_name", "rule_order").alias("_rule"))
    )
    lookup = merchants.join(choices, "merchant", "left").join(by_rule, "merchant", "left")
    joined = keyed.join(lookup.withColumnRenamed("merchant", "_m"), "_m", "left")

    def listed(c):
        return F.exists(
            c["amounts"],
            lambda a: (F.abs(a["amount"] - F.col("amount")) <= F.lit(Decimal("0.01"))) & (F.upper(a["currency"]) == F.col("currency")),
        )

    pick = F.coalesce(
        F.try_element_at(F.filter("_choices", listed), F.lit(1)), F.try_element_at("_choices", F.lit(1))
    )
    cleaned = clean_merchant(F.col("_text"), stopwords)
    cleaned_name = F.coalesce(F.nullif(title_case(cleaned), F.lit("")), F.nullif(title_case(F.col("_text")), F.lit("")))
    # Rule names carry grouping hints: a trailing remark, or alternatives separated by a slash.
    rule = F.regexp_replace("_rule", r"\s*\([^)]*\)\s*$", "")
    halves = F.transform(F.split(rule, " / "), lambda h: F.trim(h))
    named = F.filter(halves, lambda h: F.lower("_text").contains(F.lower(h)))
    rule_name = F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(halves, F.lit(1)))
    staged = joined.withColumn("_pick", pick).withColumn("_clean", cleaned_name).withColumn("_ruled", rule_name)
    processor = F.col("_pick.vendor_key").endswith("_other")
    name = (
        F.when(processor, F.col("_clean"))
        .when(F.col("_pick").isNotNull(), F.col("_pick.vendor_name"))
        .when(F.col("_rule").isNotNull(), F.col("_ruled"))
        .otherwise(F.coalesce("_clean", F.lit("Okand")))
    )
    slug_of = (
        F.when(F.col("_pick").isNotNull() & ~processor, slug(F.translate("_pick.vendor_key", "_", "-")))
        .when(F.col("_pick").isNull() & F.col("_rule").isNull(), slug(clean_merchant(F.col("_text"), stopwords)))
        .otherwise(slug(F.col("vendor")))
    )
    return (
        staged.withColumn("vendor", name)
        .withColumn("vendor_slug", slug_of)
        .drop("_text", "_m", "_choices", "_rule", "_pick", "_clean", "_ruled")
    )


def match_senders(messages: DataFrame, senders: DataFrame) -> DataFrame:
    """(message_id, vendor_key, how) where a sender entry is the address or a parent domain.

    A message is filed under its address and under each parent of its domain, so entries meet it
    by equality.
    """
    labels = F.split("from_domain", r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    filed = exploded(messages, ["message_id"], F.array_distinct(F.concat(F.array("from_addr"), parents)), "entry")
    entries = senders.select("vendor_key", F.lower("entry").alias("entry")).distinct()
    how = F.when(F.col("entry").contains("@"), "address").otherwise("domain")
    hits = filed.join(entries, "entry").withColumn("how", how)
    return hits.groupBy("message_id", "vendor_key").agg(F.min("how").alias("how"))


def with_address(messages: DataFrame, header: str, prefix: str) -> DataFrame:
    """Lower-case address and domain of a mail header."""
    inner = F.regexp_extract(header, "<([^>]*)>", 1)
    address = F.lower(F.trim(F.when(inner != "", inner).otherwise(F.col(header))))
    return messages.withColumn(f"{prefix}_addr", address).withColumn(f"{prefix}_domain", domain_of(F.col(f"{prefix}_addr")))


def known_ids(rows: DataFrame, key: str, note: str, marker: str = "Gmail") -> DataFrame:
    """Message ids written into notes as the marker word and sixteen hex digits."""
    ids = F.regexp_extract_all(F.col(note), F.lit(f"\\b{marker}\\s+([0-9a-f]{{16}})\\b"), F.lit(1))
    return rows.select(key, F.posexplode(ids).alias("pos", "message_id"))


def vendor_word(vendor: Column, merchant: Column) -> Column:
    """First name-like word (three or more letters or digits) of the vendor and of the merchant."""
    def first(text):
        words = F.transform(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9À-ſ]+"), compact)
        return F.try_element_at(F.filter(words, lambda w: F.length(w) >= 3), F.lit(1))

    return F.array_compact(F.array(first(vendor), first(merchant)))
