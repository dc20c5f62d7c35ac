"""The evidence archive on shared storage: versions of keyed buckets, changed batch by batch.

    records/version=V/bucket=B   all records of bucket B as of version V
    keys/version=V/slot=S        keys that became known in version V: files, and ids within a charge
    manifest/version=V           which version of each bucket counts; written last

A record lies in the bucket of its entity, its year and a hash of its stem, so the numbers of a
stem are next to each other. A batch looks its keys up, reads the buckets these lead to and those
its own stems fall into, and rewrites the buckets it changes; the files of all others stay.
A version without a manifest does not exist: what a failed batch left is overwritten, and a
batch that is replayed after its version was written does nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import settle
from .archive import CHARGE, ID_COLUMNS, RECORD_COLUMNS, _blank, upsert_touched

RECORD_SCHEMA = ", ".join(
    f"{c} {dict(number='bigint', date='date', amount_sek='decimal(18,2)').get(c, 'string')}" for c in RECORD_COLUMNS
)


class ArchiveLog:
    def __init__(self, spark: SparkSession, place: str, slots: int = 64):
        """``slots``: buckets per entity and year, and pieces of the key table."""
        self.spark, self.place, self.slots = spark, place.rstrip("/"), slots

    # -- versions

    def _exists(self, path: str) -> bool:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(found)

    def has(self, version: int) -> bool:
        return self._exists(f"{self.place}/manifest/version={version}/_SUCCESS")

    def latest(self) -> int:
        """The last version of an unbroken row, -1 for none."""
        version = -1
        while self.has(version + 1):
            version += 1
        return version

    def manifest(self, version: int) -> dict[str, int]:
        """Bucket and the version that holds it; as many entries as the archive has files."""
        rows = self.spark.read.schema("bucket string, held int").parquet(f"{self.place}/manifest/version={version}").collect()
        return {r.bucket: r.held for r in rows}

    # -- reading

    def records(self, version: int | None = None, buckets: set[str] | None = None) -> DataFrame:
        """All records as of a version (the latest), or those of some buckets."""
        held = self.manifest(self.latest() if version is None else version)
        paths = [f"{self.place}/records/version={v}/bucket={b}" for b, v in held.items() if buckets is None or b in buckets]
        reader = self.spark.read.schema(f"{RECORD_SCHEMA}, version int, bucket string").option("basePath", f"{self.place}/records")
        if not paths:
            return self.spark.createDataFrame([], RECORD_SCHEMA)
        return reader.parquet(*paths).drop("version", "bucket")

    def _keys(self, version: int, slots: list[int]) -> DataFrame:
        rows = self.spark.read.schema("kind string, key string, id string, bucket string, version int, slot int").parquet(f"{self.place}/keys")
        return rows.filter((F.col("version") <= version) & F.col("slot").isin(slots)).drop("version", "slot")

    # -- writing

    def bucket(self) -> Column:
        slot = F.pmod(F.xxhash64("stem"), F.lit(self.slots)).cast("string")
        return F.concat_ws("-", "entity", F.year("date").cast("string"), slot)

    def _slot(self, key: str = "key") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.slots)).cast("int")

    @staticmethod
    def _record_keys(name: str) -> Column:
        """A charge and one of its ids as one key; null without the id."""
        return F.when(~_blank(F.col(name)), F.concat_ws("|", *(F.col(c).cast("string") for c in CHARGE), name))

    def _write_keys(self, version: int, records: DataFrame, files: DataFrame) -> None:
        placed = records.withColumn("bucket", self.bucket())
        of_files = files.join(placed.select("id", "bucket"), "id").select(F.lit("sha").alias("kind"), F.col("sha").alias("key"), "id", "bucket")
        rows = of_files
        for name in ID_COLUMNS:
            rows = rows.unionByName(placed.select(F.lit(name).alias("kind"), self._record_keys(name).alias("key"), "id", "bucket").filter("key IS NOT NULL"))
        rows.withColumn("slot", self._slot()).repartition("slot").write.partitionBy("slot").mode("overwrite").parquet(f"{self.place}/keys/version={version}")

    def _commit(self, version: int, held: dict[str, int]) -> None:
        self.spark.createDataFrame(sorted(held.items()), "bucket string, held int").coalesce(1).write.mode("overwrite").parquet(f"{self.place}/manifest/version={version}")

    def _write_records(self, version: int, rows: DataFrame) -> None:
        rows.select(*RECORD_COLUMNS).withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(
            f"{self.place}/records/version={version}"
        )

    def create(self, records: DataFrame, files: DataFrame) -> None:
        """Version 0."""
        if self.has(0):
            return
        records = settle(records.select(*RECORD_COLUMNS))
        self._write_records(0, records)
        self._write_keys(0, records, files)
        buckets = records.select(self.bucket().alias("bucket")).distinct().collect()
        self._commit(0, {r.bucket: 0 for r in buckets})

    def apply(self, incoming: DataFrame, version: int) -> None:
        """Version ``version`` + 1: the archive of ``version`` after a batch (see ``upsert_touched``)."""
        if self.has(version + 1):
            return
        incoming = settle(incoming)
        kinds = [("sha", F.col("sha"))] + [(name, self._record_keys(name)) for name in ID_COLUMNS]
        asked = incoming.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in kinds))).alias("k")).select("k.*")
        asked = settle(asked.filter("key IS NOT NULL").distinct())
        # Slots and buckets are bounded by the archive's files, whatever the batch.
        slots = [r.slot for r in asked.select(self._slot().alias("slot")).distinct().collect()]
        known = settle(self._keys(version, slots).join(asked, ["kind", "key"], "left_semi"))
        own = incoming.select(self.bucket().alias("bucket"))
        met = {r.bucket for r in known.select("bucket").union(own).distinct().collect()}
        records = settle(self.records(version, met))
        files = known.filter("kind = 'sha'").select(F.col("key").alias("sha"), "id")
        touched, new_files, _ = upsert_touched(records, files, incoming)
        changed = touched.filter("outcome <> 'unchanged'")
        rewritten = {r.bucket for r in changed.select(self.bucket().alias("bucket")).distinct().collect()}
        kept = records.withColumn("bucket", self.bucket()).filter(F.col("bucket").isin(sorted(rewritten))).drop("bucket")
        kept = kept.join(changed.select("id"), "id", "left_anti")
        self._write_records(version + 1, kept.select(*RECORD_COLUMNS).unionByName(changed.select(*RECORD_COLUMNS)))
        self._write_keys(version + 1, changed, new_files)
        self._commit(version + 1, self.manifest(version) | dict.fromkeys(rewritten, version + 1))

    def vacuum(self, version: int) -> None:
        """Removes record files that no version from ``version`` on refers to; older versions can no longer be read."""
        used = {(b, v) for n in range(version, self.latest() + 1) for b, v in self.manifest(n).items()}
        for n in range(version):
            for b, v in self.manifest(n).items():
                if (b, v) not in used:
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.place}/records/version={v}/bucket={b}")
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
