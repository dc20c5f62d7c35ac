"""The archive on disk: what batches change, what they leave, and one scheme of ids."""

import os

import duckdb
import pytest

from tallybridge.catalog import archive as ca
from tallybridge.catalog.bindings import with_
from tallybridge.operators import archive as ar
from tallybridge.operators.archive_log import ArchiveLog
from tallybridge.session import settle

SF = "/root/testdata/sf0.001"
FIELDS = (
    "position long, sha string, stem string, entity string, date string, amount_sek double, expense_id string, card_ref string, "
    "vendor string, note string, invoice_number string, voucher string, booking_status string, source_kind string, source_ref string, source_from string, status string, merchant string"
)


def batch(spark, *docs):
    """Documents: (sha, stem, date, amount, expense, ref), in order."""
    rows = [(i, sha, stem, "alfa", date, float(amount), expense, ref, "", "", "", "", "", "mail", f"m{i}", "x", "", "M") for i, (sha, stem, date, amount, expense, ref) in enumerate(docs)]
    frame = spark.createDataFrame(rows, FIELDS)
    return frame.withColumn("date", frame["date"].cast("date")).withColumn("amount_sek", frame["amount_sek"].cast("decimal(18,2)"))


def files_of(place):
    return {os.path.relpath(os.path.join(d, f), place): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{place}/records") for f in names if f.startswith("part")}


def ids(log, version=None):
    return {r.id: (r.expense_id or "", r.card_ref or "") for r in log.records(version).collect()}


@pytest.fixture
def empty(spark, tmp_path):
    log = ArchiveLog(spark, str(tmp_path / "log"), slots=4)
    none = batch(spark).selectExpr(*(f"CAST(NULL AS bigint) AS {c}" if c == "number" else f"'' AS {c}" if c == "id" else c for c in ar.RECORD_COLUMNS))
    log.create(none, spark.createDataFrame([], "sha string, id string"))
    return log


def test_batches_and_replay(spark, empty, tmp_path):
    log, place = empty, str(tmp_path / "log")
    one = batch(spark, ("f1", "2026-01-05-shop-10", "2026-01-05", 10, "E1", ""), ("f2", "2025-03-01-shop-20", "2025-03-01", 20, "", "C1"), ("f1", "2026-01-05-shop-10", "2026-01-05", 10, "", ""))
    log.apply(one, 0)
    assert log.latest() == 1 and ids(log) == {"2026-01-05-shop-10": ("E1", ""), "2025-03-01-shop-20": ("", "C1")}
    first = files_of(place)
    # Another charge of one stem: numbers go on; a known file of another charge is refused.
    two = batch(spark, ("f3", "2026-01-05-shop-10", "2026-01-05", 10, "E2", ""), ("f2", "2026-01-06-shop-9", "2026-01-06", 9, "", ""), ("f4", "2026-01-05-shop-10", "2026-01-05", 10, "E3", ""))
    log.apply(two, 1)
    assert sorted(ids(log)) == ["2025-03-01-shop-20", "2026-01-05-shop-10", "2026-01-05-shop-10-2", "2026-01-05-shop-10-3"]
    second = files_of(place)
    assert {k: second[k] for k in first} == first
    # Only the bucket of the stem was written again.
    held = log.manifest(2)
    assert sorted(held.values()) == [1, 2] and [b for b, v in held.items() if v == 2][0].startswith("alfa-2026-")
    # A replay changes nothing, neither files nor records.
    log.apply(two, 1)
    log.apply(one, 0)
    assert files_of(place) == second and log.latest() == 2
    # The same documents again in a new version: nothing to rewrite.
    log.apply(two, 2)
    assert log.latest() == 3 and files_of(place) == second and log.manifest(3) == held
    # An older version can still be read, until it is vacuumed.
    assert sorted(ids(log, 1)) == ["2025-03-01-shop-20", "2026-01-05-shop-10"]
    log.vacuum(2)
    assert sorted(ids(log, 2)) == sorted(ids(log)) and len(files_of(place)) < len(second)


def test_what_a_failed_batch_left_does_not_count(spark, empty, tmp_path):
    log = empty
    one = batch(spark, ("f1", "s1", "2026-01-05", 10, "E1", ""))
    half = batch(spark, ("f9", "s9", "2026-01-09", 9, "E9", ""))
    # Records and keys of version 1 are there, its manifest is not.
    log._write_records(1, half.selectExpr("stem AS id", "stem", "CAST(1 AS bigint) AS number", *(c for c in ar.RECORD_COLUMNS if c not in ("id", "stem", "number"))))
    assert log.latest() == 0 and ids(log) == {}
    log.apply(one, 0)
    assert ids(log) == {"s1": ("E1", "")}


def test_rounds_within_a_batch(spark, empty):
    """A document joins a record opened by its own batch, by file or by id, also through another."""
    log = empty
    log.apply(
        batch(
            spark, ("f1", "s", "2026-02-01", 5, "E1", ""), ("f2", "s", "2026-02-01", 5, "E1", "R1"), ("f3", "s", "2026-02-01", 5, "", "R1"),
            ("f3", "s", "2026-02-01", 5, "", ""), ("f1", "s", "2026-02-01", 5, "E2", ""), ("f4", "s", "2026-02-01", 5, "E2", ""), ("f4", "s", "2026-02-02", 5, "", ""),
        ),
        0,
    )
    assert ids(log) == {"s": ("E1", "R1"), "s-2": ("E2", "")}


def test_one_file_holds_most_of_a_batch(spark, empty):
    docs = [("hot", f"s{i % 7}", "2026-02-01", 5, "", "") for i in range(400)] + [(f"f{i}", "t", "2026-02-03", i, "", "") for i in range(50)]
    empty.apply(batch(spark, *docs), 0)
    assert sorted(ids(empty)) == sorted(["s0", "t", *(f"t-{i}" for i in range(2, 51))])


def test_batches_equal_one_upsert(spark, tmp_path):
    """Several batches end where one ends, with the ids of one scheme."""
    records, files = ca._archived(spark, SF)
    incoming = settle(ca._incoming(spark, SF))
    log = ArchiveLog(spark, str(tmp_path / "log"))
    log.create(records, files)
    for number, (low, high) in enumerate([(-1, 60), (60, 61), (61, 10**9)]):
        log.apply(incoming.filter((incoming["position"] > low) & (incoming["position"] <= high)), number)
    whole, _, _ = ar.upsert_archive(records, files, incoming)
    assert sorted(map(tuple, log.records().collect())) == sorted(map(tuple, whole.drop("outcome").collect()))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_rounds_of_the_sql_are_enough(size):
    """No document is left after them."""
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/{size}/{name}.parquet'")
    body = with_("matched", body=ca.UPSERT_BODY[: ca.UPSERT_BODY.index("opened AS (")].rstrip().rstrip(",") + f" SELECT count(*) FROM pend{ca.ROUNDS}")
    assert con.execute(body).fetchone() == (0,)
