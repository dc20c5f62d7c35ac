"""Classification and voucher goldens."""

import datetime as dt
from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from tallybridge.operators import ledger as lg, posting as po

D = dt.date
SPLIT = D(2025, 3, 10)
POLICY = lg.Policy("INBETALNING", SPLIT, "alfa")
RULE_SCHEMA = "rule_order int, name string, patterns array<string>, tag string, entity string, bas_account string, konto_name string, vat_regime string"
RULES = [
    (1, "Office and transport", ["PAPER MILL", "VAN HIRE"], "business", "alfa", "5410", "tools", "domestic25"),
    (2, "Hosting", ["CLOUD NINE"], "business", "beta", "6540", "it", "noneu_rc"),
    (3, "Coded, not tagged", ["CANTEEN"], None, "alfa", "6993", "misc", "none"),
]
CARD_SCHEMA = "account string, default_tag string, default_why string, personal_only boolean, personal_from date, exception_merchant string, exception_from date, exception_to date"
WORK, HOME, PRIVATE, TURNED = "card-w", "card-h", "card-p", "card-t"
EXCEPTION, TURN = (D(2025, 1, 15), D(2025, 2, 20)), D(2025, 2, 21)
CARDS = [
    (TURNED, None, None, False, TURN, None, None, None),
    (PRIVATE, None, None, True, None, "VAN HIRE", *EXCEPTION),
    (HOME, "personal", "goes home", False, None, None, None, None),
    (WORK, "business", "goes to work", False, None, None, None, None),
]
LATE, DAY = D(2025, 5, 5), dt.timedelta(days=1)
# What a row must become, with the start of the reason, and the rows that must become it: merchant, card, day, amount.
CASES = [
    (("needs-tag", "pre-split"), [("NO ONE KNOWS", WORK, SPLIT - DAY, 100), ("NO ONE KNOWS", HOME, SPLIT - DAY, 30), ("NO ONE KNOWS", TURNED, TURN - DAY, 100)]),
    (("business", "goes to work"), [("NO ONE KNOWS", WORK, SPLIT, 100), ("CANTEEN", WORK, LATE, 80)]),
    (("personal", "goes home"), [("NO ONE KNOWS", HOME, SPLIT, 25), ("NO ONE KNOWS", HOME, LATE, 25)]),
    (("needs-tag", "unknown account"), [("NO ONE KNOWS", "card-?", LATE, 10)]),
    (("business", "merchant rule"), [("PAPER MILL", WORK, LATE, 1), ("old paper mill ltd", HOME, LATE, 2), ("CLOUD NINE", WORK, LATE, 3), ("VAN HIRE", WORK, LATE, 4)]),
    (("business", "bounded merchant exception"), [("VAN HIRE CITY", PRIVATE, EXCEPTION[0], 5), ("VAN HIRE CITY", PRIVATE, EXCEPTION[1], 6)]),
    (("personal", "personal-only"), [("VAN HIRE CITY", PRIVATE, EXCEPTION[0] - DAY, 5), ("VAN HIRE CITY", PRIVATE, EXCEPTION[1] + DAY, 5), ("NO ONE KNOWS", PRIVATE, LATE, 5)]),
    (("personal", "card personal from date"), [("NO ONE KNOWS", TURNED, TURN, 7), ("NO ONE KNOWS", TURNED, LATE, 7)]),
    (("needs-tag", "business-looking"), [("PAPER MILL", TURNED, TURN, 8)]),
    (("skip", "payment row"), [("INBETALNING 17", WORK, LATE, -900)]),
    (("skip", "refund"), [("NO ONE KNOWS", HOME, LATE, -40), ("PAPER MILL", WORK, LATE, -1)]),
    (("business", "override (dinner, two guests)"), [("ANSWERED", HOME, LATE, 11)]),
    (("needs-tag", "asked before"), [("QUEUED", WORK, LATE, 12)]),
    (("business", "carried from prior"), [("CARRIED", HOME, LATE, 13)]),
]
ROWS = [(f"r{i}", *want, *row) for i, (want, row) in enumerate((want, row) for want, rows in CASES for row in rows)]
REF = {row[3]: row[0] for row in ROWS}


def classify(spark):
    charges = [(ref, day, merchant, card, Decimal(amount)) for ref, _, _, merchant, card, day, amount in ROWS] + [("", LATE, "WITHOUT REF", WORK, Decimal(5))]
    charges = lg.charge_kind(spark.createDataFrame(charges, "ref string, date date, merchant string, account string, amount decimal(18,2)"), POLICY.payment_phrase)
    # The later answer counts; an answer to a payment changes nothing; two cannot be read.
    lines = [
        (1, REF["ANSWERED"], "personal", "dinner"), (2, REF["ANSWERED"], "business", "dinner, two guests"), (3, REF["INBETALNING 17"], "business", ""),
        (4, REF["CLOUD NINE"], "perhaps", ""), (5, "", "personal", ""),
    ]
    overrides, bad = lg.valid_overrides(spark.createDataFrame(lines, "line int, ref string, tag string, note string"))
    prior = [(REF["ANSWERED"], "needs-tag", ""), (REF["QUEUED"], "needs-tag", "asked before"), (REF["CARRIED"], "business", "")]
    prior = spark.createDataFrame(prior, "ref string, tag string, why string")
    return lg.classify(charges, spark.createDataFrame(RULES, RULE_SCHEMA), overrides, prior, spark.createDataFrame(CARDS, CARD_SCHEMA), POLICY), bad


def test_classification_by_rule(spark):
    out, bad = classify(spark)
    got = {r.ref: r for r in out.collect()}
    assert set(got) == {row[0] for row in ROWS} and bad.count() == 2
    for ref, tag, why, merchant, card, day, _ in ROWS:
        assert (got[ref].tag, got[ref].why[: len(why)]) == (tag, why), (merchant, card, day, got[ref].why)
    coded = {merchant: (got[ref].bas_account, got[ref].entity) for ref, _, _, merchant, *_ in ROWS}
    assert coded["CANTEEN"] == ("6993", "alfa") and coded["CLOUD NINE"][1] == "beta" and coded["NO ONE KNOWS"][1] == "alfa"


def test_classification_totals(spark):
    summary = {r.tag: r for r in lg.tag_summary(classify(spark)[0]).collect()}
    assert {tag: r.n for tag, r in summary.items()} == dict(Counter(row[1] for row in ROWS))
    assert summary["business"].business_amount == sum(Decimal(row[6]) for row in ROWS if row[1] == "business")


def test_rule_match_is_the_first_that_fits(spark):
    merchants = ["PAPER MILL CLOUD NINE", "a canteen b", "xx", "", None]
    charges = spark.createDataFrame([(m,) for m in merchants], "merchant string")
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    listed = sorted(((r.rule_order, [p.upper() for p in r.patterns or [] if p]) for r in rules.collect()))
    want = {m: next((o for o, ps in listed if m and any(p in m.upper() for p in ps)), None) for m in merchants}
    assert {r.merchant: r.rule_order for r in lg.match_rule(charges, rules).collect()} == want and want["PAPER MILL CLOUD NINE"] == 1


def test_rule_match_has_no_product_join(spark):
    charges = spark.range(1000).select(F.concat(F.lit("PAPER MILL "), F.col("id").cast("string")).alias("merchant"))
    rules = spark.sql(
        "SELECT * FROM VALUES (1, 'a', array('MILL'), 'business', '', '', '', ''), (2, 'b', array('9'), 'personal', '', '', '', '') "
        "AS t(rule_order, name, patterns, tag, entity, bas_account, konto_name, vat_regime)"
    )
    done = lg.match_rule(charges, rules)
    text = done._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert done.filter("rule_order = 1").count() == 1000


REGIMES = [
    ("domestic25", "inclusive", 25), ("domestic12", "inclusive", 12), ("domestic6", "inclusive", 6), ("domestic25_half", "half", 25),
    ("eu_rc", "reverse", 25), ("noneu_rc", "reverse", 25), ("oss_pending", "gross", 0), ("none", "gross", 0), ("", "gross", 0),
]
ACCOUNTS = {"liability": 2890, "vat": 2641, "vat_out": 2614, "vat_in": 2645}
VOUCHERS = [
    ("ATFIX001", "129.00", "domestic25", "5410", [(5410, "103.20", 0), (2641, "25.80", 0), (2890, 0, "129.00")]),
    ("ATFIX002", "249.00", "domestic12", "6072", [(6072, "222.32", 0), (2641, "26.68", 0), (2890, 0, "249.00")]),
    ("ATFIX003", "59.00", "domestic6", "5810", [(5810, "55.66", 0), (2641, "3.34", 0), (2890, 0, "59.00")]),
    ("ATFIX004", "480.00", "domestic25_half", "5615", [(5615, "432.00", 0), (2641, "48.00", 0), (2890, 0, "480.00")]),
    ("ATFIX005", "49.11", "eu_rc", "6540", [(6540, "49.11", 0), (2890, 0, "49.11"), (2614, 0, "12.28"), (2645, "12.28", 0)]),
    ("ATFIX006", "981.09", "noneu_rc", "6540", [(6540, "981.09", 0), (2890, 0, "981.09"), (2614, 0, "245.27"), (2645, "245.27", 0)]),
    ("ATFIX007", "100.00", "oss_pending", "6540", [(6540, "100.00", 0), (2890, 0, "100.00")]),
    ("ATFIX008", "111.25", "none", "6990", [(6990, "111.25", 0), (2890, 0, "111.25")]),
    ("ATFIX009", "200.00", "", "6993", [(6993, "200.00", 0), (2890, 0, "200.00")]),
    ("ATFIX010", "123.45", "domestic25_half", "5615", [(5615, "111.10", 0), (2641, "12.35", 0), (2890, 0, "123.45")]),
    ("ATFIX011", "1999.99", "domestic25", "6540", [(6540, "1599.99", 0), (2641, "400.00", 0), (2890, 0, "1999.99")]),
    ("ATFIX012", "62.50", "domestic25", "5410", [(5410, "50.00", 0), (2641, "12.50", 0), (2890, 0, "62.50")]),
]
OTHERS = [
    ("ATFIX013", "business", "beta", "6540", "none", "50", "excluded", "entity beta"),
    ("ATFIX014", "needs-tag", "alfa", "6540", "none", "50", "excluded", "tag needs-tag"),
    ("ATFIX015", "business", "alfa", "", "none", "50", "excluded", "bas_account saknas"),
    ("ATFIX016", "business", "", "6540", "none", "50", "excluded", "entity saknas"),
    ("ATFIX017", "personal", "alfa", "6540", "none", "50", "out-of-scope", "tag personal"),
    ("ATFIX018", "business", "alfa", "6540", "none", "-50", "out-of-scope", "amount not positive"),
    ("ATFIX020", "skip", "alfa", "6540", "none", "50", "out-of-scope", "tag skip"),
    ("ATFIX021", "business", "alfa", "6540", "domestic99", "50", "excluded", "vat_regime okand 'domestic99'"),
]


def plan(spark):
    rows = [(r, D(2026, 8, 1 + i), f"SHOP {i}", "business", "alfa", b, v, Decimal(x)) for i, (r, x, v, b, _) in enumerate(VOUCHERS)]
    rows += [(r, D(2026, 8, 28), "OTHER", t, e, b, v, Decimal(x)) for r, t, e, b, v, x, _, _ in OTHERS]
    df = spark.createDataFrame(
        rows, "ref string, date date, merchant string, tag string, entity string, bas_account string, vat_regime string, amount decimal(18,2)"
    )
    regimes = spark.createDataFrame(REGIMES, "regime string, method string, rate int")
    return po.plan_disposition(df, "alfa", regimes), regimes


def test_dispositions_cover_every_row(spark):
    out, _ = plan(spark)
    got = {r.ref: (r.disposition, r.reason) for r in out.collect()}
    assert len(got) == len(VOUCHERS) + len(OTHERS)
    for r, *_, disposition, reason in OTHERS:
        assert got[r] == (disposition, reason)
    assert all(got[r[0]][0] == "planned" for r in VOUCHERS)


def test_voucher_goldens_balance(spark):
    out, regimes = plan(spark)
    posted = po.post_vouchers(out.filter("disposition = 'planned'"), regimes, ACCOUNTS).orderBy("ref", "line").collect()
    for ref, gross, _, _, lines in VOUCHERS:
        rows = [(r.account, r.debit, r.credit) for r in posted if r.ref == ref]
        assert rows == [(a, Decimal(d), Decimal(c)) for a, d, c in lines], ref
        assert sum(r[1] for r in rows) == sum(r[2] for r in rows)
    total = po.reimbursement_row(out.filter("disposition = 'planned'")).collect()
    assert [(r.month, r.date, r.amount, r.vouchers) for r in total] == [("2026-08", D(2026, 8, 31), Decimal("4544.39"), 12)]


def test_files_by_map_prefix_and_substring(spark):
    out, regimes = plan(spark)
    mapping = spark.createDataFrame([("ATFIX004", "map/a.pdf"), ("ATFIX007", "  ")], "ref string, file string")
    files = spark.createDataFrame([("ATFIX001_receipt.pdf",), ("scan_ATFIX006.png",), ("zz_ATFIX001.pdf",), ("a",)], "name string")
    found = po.attach_files(out.filter("disposition <> 'out-of-scope'"), mapping, files)
    got = {r.ref: (r.receipt_file, r.file_match) for r in found.collect()}
    assert got["ATFIX004"] == ("map/a.pdf", "map") and got["ATFIX001"] == ("ATFIX001_receipt.pdf", "prefix")
    assert got["ATFIX006"] == ("scan_ATFIX006.png", "contains") and got["ATFIX002"] == ("", "")
    status = {r.ref: r.status for r in po.plan_status(found, regimes).collect()}
    assert status["ATFIX001"] == "ok" and status["ATFIX002"] == "kvitto saknas" and status["ATFIX013"] == "excluded entity beta"
    assert status["ATFIX007"] == "kvitto saknas; oss policy pending"


def test_description_stays_under_100_and_keeps_ref(spark):
    rows = spark.createDataFrame([("R/1", "M" * 200), ("R2", "")], "ref string, merchant string")
    got = {r.ref: (r.description, r.safe_ref) for r in po.with_voucher_text(rows, "Utlagg kort").collect()}
    assert len(got["R/1"][0]) <= 99 and got["R/1"][0].endswith(" R/1") and got["R/1"][1] == "R_1"
    assert got["R2"][0] == "Utlagg kort R2"


def test_digest_changes_with_any_line(spark):
    out, regimes = plan(spark)
    numbered = po.number_vouchers(out.filter("disposition = 'planned'").withColumn("receipt_file", F.lit("")))
    post = po.post_vouchers(numbered, regimes, ACCOUNTS)
    one = po.batch_digest(numbered, post).collect()[0].batch_code
    changed = numbered.withColumn("receipt_file", F.when(F.col("ref") == "ATFIX005", "x").otherwise(""))
    assert one == po.batch_digest(numbered, post).collect()[0].batch_code != po.batch_digest(changed, post).collect()[0].batch_code
    assert len(one) == 16


def test_repeated_decisions_and_payouts_keep_one_row(spark):
    from tallybridge.operators import ledger, posting

    charges = spark.createDataFrame([("r1",), ("r2",), ("",)], "ref string")
    overrides = spark.createDataFrame([("r1", "private", "a"), ("r1", "work", "b")], "ref string, tag string, note string")
    prior = spark.createDataFrame([(1, "r1", "work ", "old"), (2, "r1", "private", "new"), (3, "", "work", "x")], "line int, ref string, tag string, why string")
    done = {r.ref: r for r in ledger.with_decisions(charges, overrides, prior).collect()}
    assert len(done) == 3 and done["r1"].prior_why == "new" and done["r1"].override_tag == "work" and done[""].prior_tag is None
    plan = spark.createDataFrame([("r1", "planned", "")], "ref string, disposition string, reason string")
    paid = spark.createDataFrame([("r1", "p2"), ("r1", "p1")], "ref string, payout_id string")
    assert [tuple(r) for r in posting.exclude_paid(plan, paid).select("disposition", "reason").collect()] == [("excluded", "already paid p1")]


def test_files_of_an_empty_ledger(spark):
    from tallybridge.operators import posting

    charges = spark.createDataFrame([], "ref string")
    mapping = spark.createDataFrame([], "ref string, file string")
    files = spark.createDataFrame([("R1 receipt.pdf",), (None,), ("",)], "name string")
    assert posting.attach_files(charges, mapping, files).collect() == []
    one = spark.createDataFrame([("R1",), ("longer than any file name",), (None,)], "ref string")
    assert {r.ref: r.file_match for r in posting.attach_files(one, mapping, files).collect()} == {"R1": "prefix", "longer than any file name": "", None: ""}


def test_file_names_are_cut_where_refs_fit(spark):
    """Pieces that no ref looks like are not made, and none that a ref equals is lost."""
    import random

    names = spark.createDataFrame([("1234567-1_receipt.pdf",)], "name string")
    refs = spark.createDataFrame([(f"{'7' * n}-1",) for n in range(1, 8)], "ref string")
    assert sorted(r.ref for r in po._pieces(names, refs).collect()) == sorted("1234567-1"[i:] for i in range(7))

    rng = random.Random(7)
    odd = ["å-ä", "…x", "A", "a.b", "AAAAAAAAAAAA9", "0", "--", "(1)", "9" * 15] + ["".join(rng.choice("aB3-é") for _ in range(6)) for _ in range(300)]
    files = ["".join(rng.choice("aB3-é") for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["xå-äå-ä", "…x(1)(1)", "--------", "9" * 40, "AAAAAAAAAAAAAA9", ""]
    charges = spark.createDataFrame([(r,) for r in sorted(set(odd))], "ref string")
    got = po.attach_files(charges, spark.createDataFrame([], "ref string, file string"), spark.createDataFrame([(f,) for f in files], "name string"))
    for r in got.collect():
        begin, inside = [f for f in files if f.startswith(r.ref)], [f for f in files if r.ref in f]
        assert (r.receipt_file, r.file_match) == ((min(begin), "prefix") if begin else (min(inside), "contains") if inside else ("", "")), r.ref
