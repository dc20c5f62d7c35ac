"""Small helpers shared by the operators: words, bound values, and text in Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir

# A word is a run of characters other than blank, tab, line feed, vertical tab, form feed, return.
BLANKS = r"[\x20\x09-\x0D]+"
WORDED = r"[^\x20\x09-\x0D]"
# Rows of an Arrow batch that are turned into Python objects at a time.
SLICE = 256


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    For small results that meet a large table: once written, their size is known, and Spark ships
    them to every task if it is below its threshold and shuffles both sides if not.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """A folder that is done with goes, on whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def slices(batches: Iterable, rows: int = SLICE) -> Iterator:
    """Arrow batches cut into short ones, so that few long texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Remembered(dict):
    """A bounded memory of a pure function: what was used since the last two fillings stays.

    Only the cost of asking again depends on the bound, never a result.
    """

    def __init__(self, compute, entries: int):
        super().__init__()
        self.compute, self.entries, self.older = compute, entries, {}

    def keep(self, key, value) -> None:
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self.keep(key, value)
        return value
