"""Writers that can be run again without harm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.money import format_money
from ..session import settle


def _fingerprint(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Order-free content fingerprint per partition; combines before the shuffle."""
    row = F.xxhash64(*[F.col(c).cast("string") for c in columns])
    return df.groupBy(F.col(key).cast("string").alias(key)).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("x"), F.sum(F.shiftright(row, 32)).alias("s")
    )


def _remove(spark: SparkSession, path: str) -> None:
    """Remove a partition's folder in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_plan(df: DataFrame, path: str, key: str = "month") -> DataFrame:
    """Write ``df`` partitioned by ``key``, replacing only partitions whose content changed.

    A month planned again with fewer rows keeps nothing of the earlier run, one left without rows is
    removed; an unchanged month is not touched. Rows without a month are a partition like others.
    Returns the keys that were written. A first plan is worked out once, a later one twice: for its fingerprint and for its rows.
    """
    spark = df.sparkSession
    columns = sorted(c for c in df.columns if c != key)
    text = df.withColumn(key, F.col(key).cast("string"))

    def write(rows: DataFrame) -> None:
        # A few files of good size per month, however many tasks hold rows of it.
        dealt = rows.hint("rebalance", F.col(key))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)

    def but(left: DataFrame, right: DataFrame, by: list[str], how: str) -> DataFrame:
        return left.join(right.select(*[F.col(c).alias(f"_{c}") for c in by]), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], how)

    try:
        kept = spark.read.parquet(path)
    except AnalysisException:
        write(text)
        return settle(spark.read.parquet(path).select(F.col(key).cast("string").alias(key)).distinct())
    new = _fingerprint(text, key, columns)
    gone = []
    try:
        old = _fingerprint(kept, key, columns)
        # One row per partition of the plan.
        gone = [r[0] for r in but(old.select(key), new, [key], "left_anti").collect()]
        same = but(new, old, [key, "n", "x", "s"], "left_semi")
        changed = settle(but(new.select(key), same, [key], "left_anti"))
    except AnalysisException:
        changed = settle(new.select(key))
    write(but(text, changed, [key], "left_semi"))
    for value in gone:
        _remove(spark, f"{path.rstrip('/')}/{key}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}")
    return changed


def needs_tag_list(classified: DataFrame) -> DataFrame:
    """The list a person answers: rows that still need a tag, the amount as text."""
    return classified.filter(F.col("tag") == "needs-tag").select(
        "ref", "date", "merchant", format_money(F.col("amount"), "SEK").alias("amount"), "card", "why"
    )


def missing_list(expenses: DataFrame) -> DataFrame:
    """Expense rows without a document, in the layout the worklist reader takes back in."""
    return expenses.filter(~F.col("has_receipt")).select(
        "date", F.col("receipt_no").alias("pleo_receipt_no"), "expense_id", "merchant", F.col("amount_sek").alias("amount"), "type", "export_status"
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
