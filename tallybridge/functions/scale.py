"""Building blocks that keep joins, numbering and digests spread over the cluster.

No join here or in the operators carries a broadcast hint: Spark ships a side to every task only
when its measured size is below ``spark.sql.autoBroadcastJoinThreshold``, at planning or at run
time, and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle

def exploded(df: DataFrame, keep: list, items: Column, alias: str) -> DataFrame:
    """One row per element of ``items``.

    The outer form, filtered afterwards: a plain explode makes the optimiser test the array for
    emptiness first, which computes an expensive array twice.
    """
    return df.select(*keep, F.explode_outer(items).alias(alias)).filter(F.col(alias).isNotNull())


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to as many tasks as the session setting ``spark.tallybridge.inputTasks`` says.

    For work that is heavy per row on input of few splits, as in a local session. Without the
    setting, as on a cluster, rows stay where they are.
    """
    tasks = df.sparkSession.conf.get("spark.tallybridge.inputTasks", None)
    return df.repartition(int(tasks)) if tasks else df


def first_by(df: DataFrame, keys: list[str], order: list[Column], keep: list[str] | None = None) -> DataFrame:
    """The first row per key. Combines before the shuffle, so a hot key costs one row per task."""
    cols = keep or [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*")


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    low: str,
    high: str,
    day: str,
    width: int = 8,
) -> DataFrame:
    """Pairs where the right row's ``day`` lies in the left row's ``[low, high]`` and keys agree.

    Days are cut into buckets of ``width``; a left row is repeated once per bucket it touches
    (two or three times for a sixteen-day window) and each right row sits in exactly one, so a
    pair meets once and the join is an equi join on (keys, bucket) that can be split under skew.
    """
    def bucket(d):
        return F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / width).cast("int")

    spans = left.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    placed = right.withColumn("_bucket", bucket(F.col(day)))
    pairs = spans.join(placed, [*keys, "_bucket"])
    return pairs.filter(F.col(day).between(F.col(low), F.col(high))).drop("_bucket")


def containing_pairs(texts: DataFrame, text: str, patterns: DataFrame, pattern: str, size: int = 3) -> DataFrame:
    """Every (text, pattern) pair where the text contains the pattern, without comparing all pairs.

    Both sides meet on short character runs: a pattern is filed under its first ``size``
    characters, a text under each run it holds of a length that patterns are filed under.
    ``texts`` should be distinct.
    """
    filed = patterns.filter(F.length(pattern) > 0).withColumn("_run", F.substring(pattern, 1, size))
    # One row: the lengths of runs that occur, an aggregate that travels to the texts.
    lengths = filed.agg(F.sort_array(F.collect_set(F.length("_run"))).alias("_lengths")).scalar()
    fits = F.filter("_lengths", lambda n: n <= F.length(text))
    runs = F.flatten(F.transform("_lengths", lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, n))))
    sized = texts.withColumn("_lengths", lengths).withColumn("_lengths", fits)
    cut = exploded(sized, texts.columns, F.array_distinct(runs), "_run")
    return cut.join(filed, "_run").filter(F.col(text).contains(F.col(pattern))).drop("_run")


def _sliced(df: DataFrame, by: list[str], partitions: int | None) -> DataFrame:
    """Rows range-partitioned by a total order and settled, each tagged with its slice."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    return settle(ranged.withColumn("_slice", F.spark_partition_id()))


def number_rows(df: DataFrame, group: list[str], order: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """Number the rows of each group from 1 in the given total order.

    No task holds a whole group: rows are range-partitioned by (group, order) and settled, each
    slice is numbered on its own, and the slice sizes (one row per group and slice) give the
    offsets. A group holding most of the table is simply spread over many slices.
    """
    ranged = _sliced(df, [*group, *order], partitions)
    sizes = ranged.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = Window.partitionBy(*group, "_slice").orderBy(*order)
    numbered = ranged.withColumn("_local", F.row_number().over(local))
    return (
        numbered.join(offsets, [*group, "_slice"])
        .withColumn(out, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_local", "_before", "_slice")
    )


def carry_down(df: DataFrame, group: list[str], order: list[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """The last non-null ``value`` at or above each row of its group, by the given total order.

    Works on slices like ``number_rows``: within a slice by a window, across slices through one
    row per group and slice.
    """
    ranged = _sliced(df, [*group, *order], partitions)
    set_only = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = ranged.groupBy(*group, "_slice").agg(F.max_by(value, set_only).alias("_end"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_above", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    local = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.withColumn("_local", F.last(value, ignorenulls=True).over(local))
    return (
        rows.join(carried, [*group, "_slice"])
        .withColumn(out, F.coalesce("_local", "_above"))
        .drop("_local", "_above", "_slice")
    )


def ordered_digest(df: DataFrame, group: list[str], position: str, line: str, block: int = 4096) -> DataFrame:
    """One sha256 per group over its lines in order, built as a tree of fixed-size blocks.

    ``position`` numbers the lines of a group from 1. Each level hashes at most ``block`` lines
    in one place, so the digest of a very long group is still computed piecewise.
    """
    level = df.select(*group, F.col(position).alias("_p"), F.sha2(F.col(line), 256).alias("_h"))
    for _ in range(4):
        level = (
            level.groupBy(*group, F.floor((F.col("_p") - 1) / block).alias("_b"))
            .agg(F.array_sort(F.collect_list(F.struct("_p", "_h"))).alias("_items"))
            .select(
                *group,
                (F.col("_b") + 1).alias("_p"),
                F.sha2(F.array_join(F.col("_items._h"), "\n"), 256).alias("_h"),
            )
        )
    return level.select(*group, F.col("_h").alias("digest"))
