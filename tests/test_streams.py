"""Streams over tables that are folders of part files."""

import pytest

from tallybridge.catalog import archive, streams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The driver's tables, each a folder of three files."""
    folder = tmp_path_factory.mktemp("parts")
    for name, key in (("documents", "doc_id"), ("labels", "doc_id"), ("events", "event_id"), ("orders", "o_orderkey")):
        spark.read.parquet(f"{SF}/{name}.parquet").repartitionByRange(3, key).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("query", [streams.r1, streams.r2, streams.r3])
def test_folders_are_read_like_files(spark, parts, query):
    got, want = query(spark, parts), query(spark, SF)
    assert not want.isEmpty()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_every_batch_is_kept(spark, parts):
    got = streams.r3(spark, parts, maxFilesPerTrigger=1)
    assert {r.id for r in got.collect()} == {r.id for r in archive.m1(spark, SF).collect()}


def test_one_mailbox_is_spread_over_keys(spark, tmp_path):
    """All messages and charges of one mailbox: the pairs of a batch join, from state under many buckets."""
    from pyspark.sql import functions as F

    from tallybridge.streaming import jobs

    messages = spark.range(600).select(F.col("id").alias("message_id"), F.lit(1).alias("mailbox"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 40_000).alias("message_time"))
    charges = spark.range(80).select(F.col("id").cast("string").alias("row_key"), F.lit(1).alias("mailbox"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 300_007).alias("charge_time"))
    want = messages.join(charges, "mailbox").filter("message_time BETWEEN charge_time - INTERVAL 10 DAYS AND charge_time + INTERVAL 5 DAYS").select("row_key", "message_id")
    for name, frame in (("m", messages), ("c", charges)):
        frame.write.parquet(f"{tmp_path}/{name}")
    streams_ = [spark.readStream.schema(f.schema).parquet(f"{tmp_path}/{n}") for n, f in (("m", messages), ("c", charges))]
    pairs = jobs.inbox_match(*streams_)
    got = jobs.run_available(pairs, f"{tmp_path}/out", f"{tmp_path}/state").select("row_key", "message_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 1000
