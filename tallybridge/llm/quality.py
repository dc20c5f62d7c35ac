"""Quality rules: a threshold table compiled into one projection, without user functions.

Measures of a text are whole numbers. Each rule bounds one of them, or the ratio of two, and is
compared in whole numbers (``1000 * part < limit * whole``), so a verdict never hangs on rounding.

Edge cases. A null or empty text has no words and fails the base rule. Lines without a word are
not lines here. A ratio over nothing counts as 0. Null ids and repeated rows are judged like any
other row. Further columns of the input are neither read nor returned by ``measured``, and kept
by ``kept_documents``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scale import exploded
from .registry import query, table
from .shared import WORDED, let, words_of

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it for on with as was at by an be this from or are which not "
    "le la les de des du et en un une que est pour dans qui par sur au pas plus ne ce se "
    "der die das und von zu den mit ist im nicht ein eine als auch auf für sich dem des sie "
    "el los las del y que es por con para se lo su al como una un no si"
).split()


class Rule(NamedTuple):
    """``low`` and ``high`` bound ``1000 * part / whole``, in texts of at least ``words`` words."""

    name: str
    part: str
    whole: str
    low: int | None
    high: int | None
    words: int = 0


# The production table. Per mille for ratios; characters per word for the mean length.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2500, 12000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("exclamations", "n_exclamations", "n_words", None, 300),
    Rule("capitals", "n_capitals", "word_chars", None, 500),
    Rule("stop_words", "n_stop_words", "n_words", 20, None, 50),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("stutter", "n_stutter", "n_words", None, 300),
)


def _occurrences(text: Column, pattern: str) -> Column:
    return (F.size(F.split(text, pattern, -1)) - 1).cast("bigint")


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows that occur at least twice, from the word hashes of a text.

    Windows are compared by 64 bits of hash within one text. Most texts repeat none, which a set
    of hashes tells; only the others sort their windows to find where the repeated ones lie.
    """
    n = F.size(hashes)
    windows = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))),
    )

    def covered(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            def at(k: Column, by: int) -> Column:
                return F.get(s, k + by)["h"]

            hit = F.transform(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda k: F.when(
                    F.coalesce(at(k, 0) == at(k, -1), F.lit(False)) | F.coalesce(at(k, 0) == at(k, 1), F.lit(False)),
                    F.get(s, k)["i"],
                ),
            )
            return F.sort_array(F.array_compact(hit))

        def reach(p: Column) -> Column:
            return F.aggregate(
                F.sequence(F.lit(0), F.size(p) - 1),
                F.lit(0),
                lambda total, k: total + F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(WINDOW))),
            )

        return let(let(pairs, starts), reach)

    def counted(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered(windows))

    return F.when(n < WINDOW, F.lit(0)).otherwise(let(windows, counted)).cast("bigint")


def measured(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """``keep`` and the measures of ``text``, one row per row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(*keep, whole.alias("_text"), words_of(F.col(text)).alias("_words"))
    hashed = split.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).withColumn(
        "_lines", F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(WORDED))
    )
    names = [c for c in split.columns if c not in ("_text", "_words")]
    return hashed.select(
        *names,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        _occurrences(F.col("_text"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("_hashes")).alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        _occurrences(F.col("_text"), "!").alias("n_exclamations"),
        _occurrences(F.col("_text"), r"\p{Lu}").alias("n_capitals"),
        F.size(F.filter("_words", lambda w: w.isin(*STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        F.size(F.filter("_hashes", lambda h, i: h == F.get(F.col("_hashes"), i - 1))).cast("bigint").alias("n_stutter"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def broken(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules a measured row breaks, in the table's order, one expression."""

    def breaks(rule: Rule) -> Column:
        part, whole = 1000 * F.col(rule.part), F.col(rule.whole)
        sides = []
        if rule.low is not None:
            sides.append(part < rule.low * whole)
        if rule.high is not None:
            sides.append(part > rule.high * whole)
        return reduce(or_, sides) & (F.col("n_words") >= rule.words)

    return F.array_compact(F.array(*(F.when(breaks(r), F.lit(r.name)) for r in rules)))


def judged(docs: DataFrame, keep: list[Column], text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, ``base_failed``, the broken rules and ``kept``, one row per row."""
    rows = measured(docs, keep, text)
    named = rows.withColumn("base_failed", base_failed()).withColumn("broken_rules", F.array_join(broken(rules), ","))
    return named.withColumn("kept", ~F.col("base_failed") & (F.col("broken_rules") == ""))


def kept_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with all their columns and nothing else.

    Rows go by way of an array of one or none: as a filter, the verdict would be pushed below the
    projections and every measure worked out anew for each rule that reads it.
    """
    whole = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_whole"))
    rows = judged(whole, [F.col("_row")], "_whole", rules)
    return exploded(rows, [], F.when(F.col("kept"), F.array("_row")), "_kept").select("_kept.*")


def _sql() -> str:
    def breaks(r: Rule) -> str:
        sides = [f"1000 * {r.part} < {r.low} * {r.whole}"] * (r.low is not None)
        sides += [f"1000 * {r.part} > {r.high} * {r.whole}"] * (r.high is not None)
        return f"CASE WHEN ({' OR '.join(sides)}) AND n_words >= {r.words} THEN '{r.name}' END"

    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM base),
windows AS (
  SELECT r, i, list(x) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g,
    lag(x) OVER (PARTITION BY r ORDER BY i) AS before, x FROM words),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows WHERE len(g) = 5) WHERE n > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i + unnest([0, 1, 2, 3, 4]) AS p FROM twice) GROUP BY r),
stutter AS (SELECT r, count(*) AS n FROM windows WHERE x = before GROUP BY r),
m AS (
  SELECT base.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(list_aggregate(w, 'string_agg', '')) AS BIGINT) AS chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclamations,
    CAST(length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(len(list_filter(w, lambda x: x IN ({stops}))) AS BIGINT) AS n_stop_words,
    CAST(coalesce(stutter.n, 0) AS BIGINT) AS n_stutter
  FROM base LEFT JOIN covered USING (r) LEFT JOIN stutter USING (r)),
f AS (SELECT * EXCLUDE (chars), coalesce(chars, 0) AS word_chars FROM m),
g AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    concat_ws(',', {", ".join(breaks(r) for r in RULES)}) AS broken_rules FROM f)
SELECT *, NOT base_failed AND broken_rules = '' AS kept FROM g"""


@query("op1_quality_rules", _sql())
def op1_quality_rules(spark, sf_dir):
    """Every document with its measures and verdict."""
    return judged(table(spark, sf_dir, "documents"), [F.col("doc_id")])
