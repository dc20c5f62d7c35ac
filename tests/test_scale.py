"""The building blocks against plain definitions, with one key holding most of the rows."""

import random
import re

from pyspark.sql import Window, functions as F

from tallybridge.functions import scale
from tallybridge.functions.patterns import required_runs
from tallybridge.operators import vendor
from tallybridge.sources import sinks


def skewed(spark, n=4000):
    """Two thirds of the rows under one key."""
    key = F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    return spark.range(n).select("id", key.alias("key"), F.xxhash64("id").alias("order"), (F.col("id") % 7).alias("v"))


def test_number_rows(spark):
    rows = skewed(spark)
    got = {r.id: r.n for r in scale.number_rows(rows, ["key"], ["order"], "n", partitions=7).collect()}
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("order")))
    assert got == {r.id: r.n for r in want.collect()}


def test_number_rows_spreads_a_hot_group(spark):
    sizes = scale._sliced(skewed(spark), ["key", "order"], 8).groupBy("_slice").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 4000 / 3


def test_carry_down(spark):
    rows = skewed(spark).withColumn("h", F.when(F.col("v") == 0, F.col("id")))
    got = {r.id: r.u for r in scale.carry_down(rows, ["key"], ["order"], "h", "u", partitions=7).collect()}
    over = Window.partitionBy("key").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: r.u for r in rows.withColumn("u", F.last("h", ignorenulls=True).over(over)).collect()}
    assert got == want


def test_interval_join(spark):
    start = F.lit("2024-01-01").cast("date")
    left = skewed(spark, 300).select("key", F.col("id").alias("l"), F.date_add(start, F.col("v").cast("int") * 5).alias("lo"))
    left = left.withColumn("hi", F.date_add("lo", (F.col("l") % 20).cast("int")))
    right = skewed(spark, 300).select("key", F.col("id").alias("r"), F.date_add(start, (F.col("id") % 60).cast("int")).alias("d"))
    got = sorted((r.l, r.r) for r in scale.interval_join(left, right, ["key"], "lo", "hi", "d").collect())
    a, b = left.collect(), right.collect()
    want = sorted((x.l, y.r) for x in a for y in b if x.key == y.key and x.lo <= y.d <= x.hi)
    assert got == want and len(got) > 1000


def test_containing_pairs(spark):
    texts = ["small ring of gold", "a", "ab", "xyz", "ring", "", "åäö ring"]
    patterns = ["ring", "a", "ab", "gold", "zz", "åä", "small ring of gold!", "ö r"]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    p = spark.createDataFrame([(x,) for x in patterns], "p string")
    got = sorted((r.t, r.p) for r in scale.containing_pairs(t, "t", p, "p").collect())
    assert got == sorted((x, y) for x in texts for y in patterns if y in x)


def test_first_by_combines_before_the_shuffle(spark):
    df = scale.first_by(skewed(spark), ["key"], [F.col("order")], ["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
    want = skewed(spark).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("order"))).filter("n = 1")
    assert {(r.key, r.id) for r in df.collect()} == {(r.key, r.id) for r in want.collect()}


def test_write_plan_touches_only_changed_months(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01", "a", 1), ("2026-01", "b", 2), ("2026-02", "c", 3)], "month string, ref string, n int")
    path = str(tmp_path / "plan")
    assert sorted(r.month for r in sinks.write_plan(rows, path).collect()) == ["2026-01", "2026-02"]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "plan").rglob("*.parquet")}
    assert sinks.write_plan(rows, path).count() == 0
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "plan").rglob("*.parquet")}
    fewer = rows.filter("ref <> 'b'")
    assert [r.month for r in sinks.write_plan(fewer, path).collect()] == ["2026-01"]
    assert sorted(r.ref for r in spark.read.parquet(path).collect()) == ["a", "c"]
    # A month left without rows goes.
    assert sinks.write_plan(fewer.filter("ref = 'c'"), path).count() == 0
    assert [r.ref for r in spark.read.parquet(path).collect()] == ["c"]


def test_runs_a_regex_cannot_match_without():
    """Whatever text matches a pattern, in any case, holds one of its runs."""
    rng = random.Random(9)
    pieces = ["ab", "c", "(x|yz)", "(?:foo|ba[rz])", "[0-9]", "\\d{2}", ".", "a*", "b+", "(?:cd)?", "^", "$", "\\b", "[^q]", "(p(q|r)s)", "k{2,3}", "é"]
    letters = "abcdfkopqrsxyz0123 é"
    seen = 0
    for _ in range(400):
        pattern = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 5)))
        runs = required_runs(pattern)
        assert runs
        for _ in range(60):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 12)))
            if re.search(pattern, text, re.I):
                seen += 1
                assert any(x in text.upper() for x in runs), (pattern, text, runs)
    assert seen > 1000
    assert required_runs("^(COLD|new) Giz") == [" GIZ"] and required_runs("(one|three)x?") == ["ONE", "THREE"]
    assert required_runs("[a-z&&[^b]]]") == required_runs("(open") == required_runs(".*") == [""] and required_runs(None) == []


def test_fifty_thousand_regexes(spark):
    """Regexes meet merchants by the runs they need, not one by one."""
    n = 50_000
    rows = [(i, f"^shop{i:05d}\\b.*(store|kiosk)$" if i % 2 else f"(key{i:05d}|alt{i:05d}) \\d+") for i in range(n)] + [(n, "\\d{4}$"), (n + 1, None), (n + 2, "^.{3}$")]
    vendors = spark.createDataFrame(rows, "vendor_order int, merchant_regex string")
    merchants = [f"SHOP{i:05d} OLD {'STORE' if i % 3 else 'STORES'}" for i in range(1, 4000, 2)] + [f"THE ALT{i:05d} {i}" for i in range(0, 4000, 2)] + ["ABC", "NOTHING"]
    frame = spark.createDataFrame([(m,) for m in merchants], "merchant string")
    got = sorted((r.merchant, r.vendor_order, r.length) for r in vendor.regex_hits(frame, vendors).collect())
    want = [(m, int(m[4:9]), len(m)) for m in merchants if m.startswith("SHOP") and m.endswith("STORE")]
    want += [(m, int(m[7:12]), len(m) - 4) for m in merchants if m.startswith("THE")]
    want += [(m, n, 4) for m in merchants if re.search(r"\d{4}$", m)] + [("ABC", n + 2, 3)]
    assert got == sorted(want)


def test_write_plan_files_and_rows_without_a_month(spark, tmp_path):
    """A month's rows are in few files however they lay before, and rows of no month are kept, rewritten and removed like others."""
    import glob

    from tallybridge.sources import sinks

    path = str(tmp_path / "plan")
    rows = spark.createDataFrame([(f"2026-0{n % 3 + 1}" if n % 4 else None, f"r{n}") for n in range(96)], "month string, ref string").repartition(8)
    assert {r.month for r in sinks.write_plan(rows, path).collect()} == {"2026-01", "2026-02", "2026-03", None}
    assert len(glob.glob(f"{path}/*/*.parquet")) <= 4
    assert spark.read.parquet(path).count() == 96 and sinks.write_plan(rows, path).count() == 0
    fewer = rows.filter("month IS NOT NULL OR ref = 'r0'")
    assert [r.month for r in sinks.write_plan(fewer, path).collect()] == [None] and spark.read.parquet(path).count() == 73
    assert sinks.write_plan(rows.filter("month IS NOT NULL"), path).count() == 0
    assert spark.read.parquet(path).count() == 72
