"""Mixing sources to target weights by capped water-filling.

A source's target is its weight's share of the wanted size, but never more than ``epochs`` times
the source. What a clamped source cannot take goes to the others by weight, until none is above:
level = (wanted - sizes of clamped targets) / (weights of the rest). A target is then cut into
whole repetitions of the source and a fractional one: documents in a seeded order up to the
point where their sizes reach the fraction. The last document is in if more than half of it lies
below that point, so a source misses its target by at most half a document.

The point is found without sorting a source in one place: sizes are summed by (source, first
hex digits of the seeded key), the digit group that holds the point is looked up, and only its
documents go to the next level, where there are 4096 times fewer.

Edge cases. Null sources are one source, numbered last. A null or wordless text has size 0 and
is taken as often as the whole repetitions. A source of size 0 has target 0. Repeated rows count
as often as they stand there. With nothing to mix, the result is empty. Other columns are kept
by ``mixed_documents``, which repeats rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scale import number_rows
from ..session import settle
from .registry import query, table
from .shared import stored, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = "mix"
DIGITS = 3
LEVELS = 3


def size_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def key_of(ids: Column, text: Column) -> Column:
    """The seeded place of a document in its source's order: 128 bits as hex digits."""
    return F.md5(F.concat(F.lit(SEED), F.coalesce(ids.cast("string"), F.md5(F.coalesce(text, F.lit(""))))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``_source``, ``source_size`` and ``target`` from one row per source (``_source``, ``source_size``).

    Sources are numbered by code point, null last, and take the weights in turn. Only single
    figures (sums over all sources) come to the driver; each round clamps every source above its
    cap, so there are at most as many rounds as sources, in practice a handful.
    """
    ranked = number_rows(sizes.withColumn("_null", F.col("_source").isNull()), [], ["_null", "_source"], "_n")
    turn = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = settle(ranked.withColumn("_w", turn.cast("double")).withColumn("_cap", epochs * F.col("source_size").cast("double")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    clamped, held, free = F.lit(False), None, None
    while True:
        sums = rows.agg(F.sum(F.when(clamped, F.col("_cap"))), F.sum(F.when(~clamped, F.col("_w")))).first()
        if (held, free) == (sums[0] or 0.0, sums[1] or 0.0):
            break
        held, free = sums[0] or 0.0, sums[1] or 0.0
        clamped = F.col("_w") * (share * total - held) >= F.col("_cap") * free
    target = F.when(clamped, F.col("_cap")).otherwise(F.col("_w") * (share * total - held) / free)
    return settle(rows.select("_source", "source_size", target.alias("target")))


def _numbered_levels(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``_source``, ``_cut``: the key of the first document of the fractional repetition that is out.

    ``docs`` has ``_source``, ``size`` and ``_key``; ``plan`` has ``_source`` and ``_need``, the
    fractional repetition's size.
    """
    here = docs.select("_source", "size", "_key")
    need = plan.select(F.col("_source").alias("_s"), "_need", F.lit("").alias("_prefix"))
    for level in range(1, LEVELS):
        inside = here.join(need, F.col("_source").eqNullSafe(F.col("_s")) & F.col("_key").startswith(F.col("_prefix")))
        bins = inside.groupBy("_s", "_need", F.substring("_key", 1, DIGITS * level).alias("_bin")).agg(F.sum("size").alias("_bin_size"))
        # At most 4096 rows per source and level.
        upto = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = bins.withColumn("_upto", F.sum("_bin_size").over(upto))
        hit = summed.filter(F.col("_upto") > F.col("_need")).groupBy("_s").agg(F.min(F.struct("_bin", "_bin_size", "_upto", "_need")).alias("m"))
        need = settle(hit.select("_s", (F.col("m._need") - F.col("m._upto") + F.col("m._bin_size")).alias("_need"), F.col("m._bin").alias("_prefix")))
    inside = here.join(need, F.col("_source").eqNullSafe(F.col("_s")) & F.col("_key").startswith(F.col("_prefix")))
    # One row per key, then a running sum over the documents of one bin out of 4096 ** 2.
    keys = inside.groupBy("_s", "_need", "_key").agg(F.sum("size").alias("_key_size"))
    upto = Window.partitionBy("_s").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = keys.withColumn("_upto", F.sum("_key_size").over(upto)).filter(F.col("_upto") - F.col("_key_size") / 2 > F.col("_need"))
    cut = out.groupBy(F.col("_s").alias("_of")).agg(F.min("_key").alias("_at"))
    # Where every document of the last bin is in, the cut is the end of the bin.
    return need.join(cut, F.col("_s").eqNullSafe(F.col("_of")), "left").select(
        F.col("_s").alias("_cut_source"), F.coalesce("_at", F.concat("_prefix", F.lit("g"))).alias("_cut")
    )


def planned(sized: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> DataFrame:
    """One row per source: ``_plan_source``, ``source_size``, ``target``, ``_whole``, ``_cut``.

    A document is taken ``_whole`` times, and once more if its key is below ``_cut``.
    """
    sizes = sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    plan = plan.withColumn("_whole", whole).withColumn("_need", F.col("target") - F.col("_whole") * F.col("source_size"))
    cuts = _numbered_levels(sized, plan.filter("_need > 0"))
    met = plan.join(cuts, F.col("_source").eqNullSafe(F.col("_cut_source")), "left")
    return stored(met.select(F.col("_source").alias("_plan_source"), "source_size", "target", "_whole", F.coalesce("_cut", F.lit("")).alias("_cut")))


def _copies() -> Column:
    return F.col("_whole") + F.when(F.col("_key") < F.col("_cut"), 1).otherwise(0)


def mixed(docs: DataFrame, ids: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """``ids``, ``size``, ``source_size``, ``target`` and ``taken``, one row per row of ``docs``."""
    narrow = docs.select(ids, F.col(source).alias("_source"), size_of(F.col(text)).alias("size"), key_of(F.col(ids), F.col(text)).alias("_key"))
    sized = settle(narrow)
    plan = planned(sized, **options)
    met = sized.join(plan, F.col("_source").eqNullSafe(F.col("_plan_source")))
    return met.select(ids, "size", "source_size", "target", (F.col("size") * _copies()).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, ids: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken; all columns, nothing else.

    Texts are read again and met with one row per source; they are not shuffled for the choice.
    """
    key = key_of(F.col(ids), F.col(text)).alias("_key")
    sized = settle(docs.select(F.col(source).alias("_source"), size_of(F.col(text)).alias("size"), key))
    plan = planned(sized, **options)
    rows = docs.select(F.struct("*").alias("_row"), F.col(source).alias("_source"), key)
    met = rows.join(plan, F.col("_source").eqNullSafe(F.col("_plan_source")))
    times = F.expr("sequence(1, copies)")
    return (
        met.select("_row", _copies().cast("int").alias("copies")).filter("copies > 0").select("_row", F.explode(times).alias("_time")).select("_row.*")
    )


@query("op6_source_mix", rf"""
WITH d AS (
  SELECT doc_id, source, md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS k,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, sum(size) AS source_size,
    CAST([{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS DOUBLE) AS w
  FROM d GROUP BY source),
ranked AS (
  SELECT *, {float(EPOCHS)} * source_size AS cap, sum(w) OVER () AS all_w, CAST({SHARE} AS DOUBLE) * sum(source_size) OVER () AS wanted,
    row_number() OVER (ORDER BY {float(EPOCHS)} * source_size / w, source NULLS LAST) AS n FROM s),
running AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    all_w - coalesce(sum(w) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free FROM ranked),
level AS (SELECT held, free FROM running WHERE w * (wanted - held) < cap * free ORDER BY n LIMIT 1),
t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
    CAST(CASE WHEN level.free IS NULL OR w * (wanted - level.held) >= cap * level.free THEN cap
         ELSE w * (wanted - level.held) / level.free END AS DOUBLE) AS target
  FROM running LEFT JOIN level ON true),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS need,
    sum(size) OVER (PARTITION BY d.source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY d.source, k) AS own
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
c AS (SELECT source, min(k) AS cut FROM r WHERE upto - own / 2 > need GROUP BY source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN need > 0 AND (cut IS NULL OR k < cut) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r LEFT JOIN c ON r.source IS NOT DISTINCT FROM c.source""")
def op6_source_mix(spark, sf_dir):
    """Every document with its source's target and the words the mix takes of it."""
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
