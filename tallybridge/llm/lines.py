"""Line dedup by site-relative frequency.

Within a site (host), a line's ratio is the number of the site's pages that hold it over the
site's pages; lines above the ratio are boilerplate and go. Both counts are taken over all pages.

Edge cases. A null site is a site of its own. A null text stays null and holds no line; an empty
one stays empty. Lines without a word are never boilerplate. A line twice on a page counts once.
Repeated rows are pages like any other. A page all of whose worded lines are boilerplate is a
copy of other pages rather than a page with boilerplate round it; it stays whole, for the
near-duplicate stage to deal with. All columns of the input are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .registry import query, table
from .shared import WORDED, let, stored

# Headers and footers are on 8 to 13 % of a source's pages, other lines on less than 5 %.
RATIO = 0.05
LEAST_PAGES = 3


def _key(line: Column) -> Column:
    """128 bits of a line, so that lines need not be shuffled whole."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _worded(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORDED))


def boilerplate(docs: DataFrame, site: str, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per site that has any: ``_site``, ``_drop`` (keys of its boilerplate lines).

    A site's list is bounded: at most (mean lines per page / ratio) lines can exceed the ratio.
    Keys are counted in the map tasks first, so a hot site or line costs one row per task.
    """
    pages = docs.select(F.col(site).alias("_site"), F.col(text).alias("_text"))
    totals = pages.groupBy("_site").agg(F.count(F.lit(1)).alias("_pages"))
    keys = pages.select("_site", F.explode_outer(F.transform(F.array_distinct(_worded(F.col("_text"))), _key)).alias("_k"))
    counted = keys.filter("_k IS NOT NULL").groupBy("_site", F.col("_k.a").alias("a"), F.col("_k.b").alias("b")).agg(
        F.count(F.lit(1)).alias("_holding")
    )
    often = counted.filter(F.col("_holding") >= least_pages)
    return (
        often.join(totals.withColumnRenamed("_site", "_total_site"), F.col("_site").eqNullSafe(F.col("_total_site")))
        .filter(F.col("_holding") > ratio * F.col("_pages"))
        .groupBy("_site")
        .agg(F.collect_list(F.struct("a", "b")).alias("_drop"))
        .withColumnRenamed("_site", "_drop_site")
    )


def without_boilerplate(
    docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """``_row`` (the input row), ``_kept_text``, ``_lines`` and ``_dropped`` (worded lines, of these dropped)."""
    drop = stored(boilerplate(docs, site, text, ratio, least_pages))
    rows = docs.select(F.struct("*").alias("_row"), F.col(site).alias("_site"), F.col(text).alias("_text"))
    met = rows.join(drop, F.col("_site").eqNullSafe(F.col("_drop_site")), "left")

    def split(lines: Column) -> Column:
        marked = F.transform(lines, lambda x: F.struct(x.alias("line"), x.rlike(WORDED).alias("worded"), F.array_contains(F.col("_drop"), _key(x)).alias("drop")))

        def decide(m: Column) -> Column:
            worded = F.size(F.filter(m, lambda x: x["worded"]))
            out = F.size(F.filter(m, lambda x: x["worded"] & x["drop"]))
            rest = F.array_join(F.transform(F.filter(m, lambda x: ~(x["worded"] & x["drop"])), lambda x: x["line"]), "\n")
            keep = (out == 0) | (out == worded)
            return F.struct(
                F.when(keep, F.col("_text")).otherwise(rest).alias("text"),
                worded.cast("bigint").alias("lines"),
                F.when(keep, F.lit(0)).otherwise(out).cast("bigint").alias("dropped"),
            )

        return let(marked, decide)

    whole = F.struct(
        F.col("_text").alias("text"),
        F.size(_worded(F.coalesce("_text", F.lit("")))).cast("bigint").alias("lines"),
        F.lit(0).cast("bigint").alias("dropped"),
    )
    done = met.withColumn("_d", F.when(F.col("_drop").isNull() | F.col("_text").isNull(), whole).otherwise(let(F.split("_text", "\n", -1), split)))
    return done.select("_row", F.col("_d.text").alias("_kept_text"), F.col("_d.lines").alias("_lines"), F.col("_d.dropped").alias("_dropped"))


def deduplicated(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO) -> DataFrame:
    """The documents with their boilerplate lines gone; all other columns as they were."""
    done = without_boilerplate(docs, site, text, ratio)
    return done.select(*(F.col("_kept_text").alias(text) if c == text else F.col("_row")[c].alias(c) for c in docs.columns))


@query("op2_line_dedup", f"""
WITH pages AS (SELECT row_number() OVER () AS r, doc_id, source, text,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS w FROM documents),
totals AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
held AS (SELECT source, line, count(*) AS n FROM (SELECT r, source, unnest(list_distinct(w)) AS line FROM pages) GROUP BY source, line),
bad AS (
  SELECT held.source, list(line) AS d FROM held JOIN totals ON held.source IS NOT DISTINCT FROM totals.source
  WHERE held.n >= {LEAST_PAGES} AND held.n > CAST({RATIO} AS DOUBLE) * totals.n GROUP BY held.source),
marked AS (
  SELECT r, doc_id, pages.source, text, w, coalesce(d, []) AS d, len(list_filter(w, lambda x: list_contains(coalesce(d, []), x))) AS n
  FROM pages LEFT JOIN bad ON pages.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_lines, CAST(CASE WHEN n = len(w) THEN 0 ELSE n END AS BIGINT) AS n_dropped,
  CASE WHEN n = 0 OR n = len(w) THEN text
       ELSE array_to_string(list_filter(string_split(text, chr(10)),
              lambda x: NOT (regexp_matches(x, '[^\\x20\\x09-\\x0D]') AND list_contains(d, x))), chr(10)) END AS text
FROM marked""")
def op2_line_dedup(spark, sf_dir):
    """Every document without the boilerplate lines of its source."""
    done = without_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return done.select("_row.doc_id", "_row.source", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.col("_kept_text").alias("text"))
