"""Month stages, outcomes kept apart, to-do order, item lanes, state import, archive re-runs."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallybridge.catalog import archive as ca
from tallybridge.operators import archive as ar, items as it, status as st
from tallybridge.sources import files as fs

D = dt.date
SF = "/root/testdata/sf0.001"


def test_month_stages(spark):
    rows = [
        ("2026-08", 1, 0, 0, None, None, False), ("2026-07", 4, 2, 1, 2, 1, False), ("2026-06", 5, 3, 0, None, None, False),
        ("2026-05", 1, 1, 0, 1, 1, False), ("2026-04", 1, 0, 0, None, None, False), ("2026-03", 2, 2, 0, 2, 0, True), ("2026-02", 2, 2, 0, 2, 1, False), ("2026-01", 1, 1, 0, 1, 0, False),
    ]
    months = spark.createDataFrame(rows, "month string, rows long, business long, needs_tag_open long, vouchers long, booked long, held boolean")
    covered = st.coverage(spark.createDataFrame([(D(2026, 8, 2),)], "date date"))
    got = {r.month: r.stage for r in st.month_stage(months, covered).collect()}
    assert got == {"2026-08": "no-csv", "2026-07": "untagged", "2026-06": "no-plan", "2026-05": "booked", "2026-04": "nothing-to-book", "2026-03": "held", "2026-02": "partial", "2026-01": "planned"}
    row = covered.collect()[0]
    assert (row.closed_month, row.next_month, row.next_present, row.period_proven) == ("2026-07", "2026-08", False, False)
    statements = spark.createDataFrame([(D(2026, 8, 2),)], "date date")
    row = st.coverage(statements, spark.createDataFrame([(D(2026, 7, 3),)], "date date")).first()
    assert (row.closed_month, row.next_month, row.next_present) == ("2026-07", "2026-07", True)


def test_outcomes_do_not_imply_one_another(spark):
    ledger = spark.createDataFrame([("A", D(2026, 7, 1), "business"), ("B", D(2026, 7, 2), "business"), ("C", D(2026, 7, 3), "needs-tag")], "ref string, date date, tag string")
    ledger = ledger.withColumns({"entity": F.lit("alfa"), "bas_account": F.lit("5410"), "in_expense": F.lit(False)})
    plan = spark.createDataFrame([("A", "2026-07", True, "A 12", None, False)], "ref string, month string, uploaded boolean, plan_voucher string, plan_reason string, held boolean")
    empty = lambda ddl: spark.createDataFrame([], ddl)
    star = st.ledger_star(
        ledger, plan, empty("ref string, file string"), empty("ref string, id string, voucher string"),
        spark.createDataFrame([("B", D(2026, 8, 1))], "ref string, paid_on date"), spark.createDataFrame([("C", "personal")], "ref string, tag string"),
        empty("ref string, has_best boolean, searched_on date"),
    )
    got = {r.ref: r for r in st.ledger_state(star, "alfa").collect()}
    assert got["A"].booked and not got["A"].reimbursed and not got["A"].evidence and got["A"].state == "booked"
    assert got["B"].reimbursed and not got["B"].booked and got["B"].state == "reimbursed" and "kvitto saknas" in got["B"].step
    assert got["C"].state == "personal"  # the answer counts, whatever it was


def test_todo_order(spark):
    rows = [("b", "info", 5, "1"), ("a", "warn", 1, "129"), ("c", "warn", 1, "59426.85"), ("d", "warn", None, None), ("e", "crit", 1, "1"), ("f", "warn", 3, None)]
    df = spark.createDataFrame([(k, s, c, Decimal(a) if a else None) for k, s, c, a in rows], "key string, severity string, count long, amount_sek decimal(18,2)")
    assert [r.key for r in st.order_todo(df).collect()] == ["e", "f", "c", "a", "d", "b"]


def test_flagged_over_two_exports(spark):
    items = spark.createDataFrame([("1", "e1"), ("2", "e2"), ("3", "e3"), ("4", "e4"), ("5", "e5")], "receipt_no string, expense_id string")
    base = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "x"), ("4", "x"), ("4", "y"), ("5", "x")], "receipt_no string, sha string")
    new = spark.createDataFrame([("1", "z"), ("2", None), ("4", "y"), ("4", "x"), ("5", "x")], "receipt_no string, sha string")
    attached = spark.createDataFrame([("e5",)], "expense_id string")
    got = {r.receipt_no: r.status for r in st.flag_status(items, base, new, attached).collect()}
    assert got == {"1": "refiled", "2": "open", "3": "gone", "4": "open", "5": "refiled"}


def test_item_lanes(spark):
    rows = [
        ("1", "card", "-40115", "SHOP", D(2026, 7, 1), "10", "ready"), ("2", "card", "0223", "SHOP", D(2026, 5, 25), "10", "ready"), ("3", "card", "0223", "SHOP", D(2026, 5, 24), "10", "ready"),
        ("4", "card", "9", "SHOP", D(2026, 6, 1), "10", "done"), ("5", "expense", "", "SHOP", D(2026, 6, 1), "10", "ignore"), ("6", "document", "", "CITY VANS", D(2026, 6, 2), "99", "ready"),
        ("7", "card", "0115", "City Vans Hire", D(2026, 6, 2), "99", "ready"), ("8", "document", "", "CITY VANS", D(2026, 6, 3), "99", "ready"),
    ]
    df = spark.createDataFrame([(*r[:5], Decimal(r[5]), r[6]) for r in rows], "id string, source string, card string, merchant string, date date, amount decimal(18,2), status string")
    df = df.withColumns({"tag": F.lit(None).cast("string"), "operator_note": F.lit(""), "action": F.lit("")})
    cards = spark.createDataFrame([("0115", True, None), ("0223", False, D(2026, 5, 25))], "card_ending string, business boolean, personal_from date")
    got = {r.id: (r.tag, r.lane) for r in it.lane(it.inferred_tag(df, cards), "city vans").collect()}
    assert got == {
        "1": ("business", "external-card-fortnox"), "2": ("personal", "personal-reconcile"), "3": ("needs-tag", "needs-classification"), "4": ("business", "already-handled"),
        "5": ("ignore", "skip-ignore"), "6": ("business", "document-matched"), "7": ("business", "external-card-fortnox"), "8": ("business", "document-review"),
    }


def test_state_import(spark):
    seeds = spark.createDataFrame([("a",), ("b",)], "id string")
    state = spark.createDataFrame([("a", "business", "ready", "keep", "2026-01-01")], "id string, tag string, status string, operator_note string, updated_at string")
    patches = spark.createDataFrame([("a", "", "done", None, "2026-01-02", 1), ("a", "", "blocked", None, "2026-01-03", 2), ("x", "", "done", None, "2026-01-02", 3), ("b", "odd", "", None, "2026-01-02", 4)],
                                    "id string, tag string, status string, operator_note string, updated_at string, line int")
    new, skipped = it.import_state(state, patches, seeds)
    assert [tuple(r) for r in new.collect()] == [("a", "business", "blocked", "keep", "2026-01-03")]
    assert {r.line: r.reason for r in skipped.collect()} == {3: "unknown id", 4: "invalid tag"}


def test_upsert_again_changes_nothing(spark):
    first, files, _ = ar.upsert_archive(*ca._archived(spark, SF), ca._incoming(spark, SF))
    state, files = first.cache(), files.cache()
    again, same, _ = ar.upsert_archive(state.drop("outcome"), files, ca._incoming(spark, SF))
    assert sorted(same.collect()) == sorted(files.collect()) and files.select("sha").distinct().count() == files.count()
    assert {r.outcome for r in again.select("outcome").distinct().collect()} == {"unchanged"}
    a = {r.id: r for r in state.drop("outcome").collect()}
    b = {r.id: r for r in again.drop("outcome").collect()}
    assert a == b


def test_shared_file_goes_to_the_best_fit(spark):
    rows = spark.createDataFrame(
        [("f", 1, D(2026, 1, 1), "10", 0, 3), ("f", 2, D(2026, 2, 1), "20", 1, 9), ("g", 3, D(2026, 1, 1), "10", 0, 0), ("g", 4, D(2026, 1, 1), "10", 1, 0)],
        "sha string, position int, date date, amount string, amount_hit int, gap int",
    ).withColumn("entity", F.lit("alfa")).withColumn("amount_sek", F.col("amount").cast("decimal(18,2)"))
    got = {r.position: r.verdict for r in ar.arbitrate_shared(rows).collect()}
    assert got == {1: "refused", 2: "owner", 3: "uncontested", 4: "uncontested"}


def test_invoice_on_very_many_records(spark):
    rows = spark.range(3000).select(
        F.format_string("r%05d", "id").alias("id"), F.lit("INV-1").alias("invoice_number"), F.lit("receipt").alias("kind"),
        F.date_add(F.lit(D(2026, 1, 1)), F.when(F.col("id") == 2999, 1).otherwise(0)).alias("date"), F.lit(Decimal("10.00")).alias("amount_sek"))
    got = {r.id: r.other_id for r in ar.duplicate_invoices(rows).collect()}
    assert len(got) == 3000 and got["r00000"] == "r02999" and got["r02999"] == "r00000"


def test_same_file_under_two_numbers_only(spark):
    files = spark.createDataFrame([("s1", "1"), ("s1", "1"), ("s2", "2"), ("s2", "3")], "sha string, number string")
    assert sorted((r.sha, r.number) for r in ar.same_file_groups(files).collect()) == [("s2", "2"), ("s2", "3")]


def test_worklist_text(spark):
    text = ["Exporten 2026-08-21", "1. Same file on two expenses", "- 2600103  2026-07-20  Acme 12,00   wrong file   (QUEUED)", "- 2600104  Beta 1,00", "noise", "2. Other company", "- 2600105  2026-07-21  Gamma   made out to another  (EXPORTED)"]
    lines = spark.createDataFrame([("w", i, t) for i, t in enumerate(text)], "file string, pos int, line string")
    got = [(r.group_no, r.receipt_no, r.date, r.problem) for r in fs.parse_worklist(lines).orderBy("pos").collect()]
    assert got == [(1, "2600103", D(2026, 7, 20), "wrong file"), (1, "2600104", None, ""), (2, "2600105", D(2026, 7, 21), "made out to another")]


def test_formats(spark):
    assert fs.detect_format(["ref", "amount", "account", "kind", "source_file"]) == "normalized"
    assert fs.detect_format(["ref", "amount", "tag", "pack_status", "account", "dash_id"]) == "classified"
    try:
        fs.detect_format(["a"])
        raise AssertionError("an unknown header must fail")
    except ValueError as e:
        assert "unrecognised" in str(e)


def test_ledger_behind_the_statements(spark):
    statements = spark.createDataFrame([(D(2026, 8, 2),)], "date date")
    behind = st.coverage(statements, spark.createDataFrame([(D(2026, 5, 3),)], "date date"))
    assert sorted(r.month for r in st.months_behind(behind).collect()) == ["2026-05", "2026-06", "2026-07"]
    assert st.months_behind(st.coverage(statements)).isEmpty()
    none = st.coverage(statements, statements.filter("false"))
    assert [r.month for r in st.months_behind(none).collect()] == ["2026-07"]
    rows = [("2026-08", 1, 0, 0, None, None, False), ("2026-06", 4, 2, 1, 2, 2, False), ("2026-04", 4, 2, 0, 2, 2, False)]
    months = spark.createDataFrame(rows, "month string, rows long, business long, needs_tag_open long, vouchers long, booked long, held boolean")
    assert {r.month: r.stage for r in st.month_stage(months, behind).collect()} == {"2026-08": "no-csv", "2026-06": "no-plan", "2026-04": "booked"}
    assert {r.stage for r in st.month_stage(months, none).filter("month < '2026-08'").collect()} == {"no-plan"}


def test_sides_never_double_a_ledger_row(spark):
    ledger = spark.createDataFrame([("A", D(2026, 7, 1), "business")], "ref string, date date, tag string").withColumns({"entity": F.lit("alfa"), "bas_account": F.lit("5410"), "in_expense": F.lit(False)})
    plan = spark.createDataFrame([("A", "2026-07", False, None, "no account", False), ("A", "2026-07", True, "A 12", None, False)], "ref string, month string, uploaded boolean, plan_voucher string, plan_reason string, held boolean")
    star = st.ledger_star(
        ledger, plan, spark.createDataFrame([("A", "f2"), ("A", "f1")], "ref string, file string"), spark.createDataFrame([("A", "r2", "B 1"), ("A", "r1", "")], "ref string, id string, voucher string"),
        spark.createDataFrame([("A", D(2026, 8, 9)), ("A", D(2026, 8, 1))], "ref string, paid_on date"), spark.createDataFrame([("A", "personal"), ("A", "business")], "ref string, tag string"),
        spark.createDataFrame([("A", False, D(2026, 7, 1)), ("A", True, D(2026, 7, 9))], "ref string, has_best boolean, searched_on date"),
    ).collect()
    assert len(star) == 1
    r = star[0]
    assert (r.voucher, r.planned, r.evidence_file, r.archive_id, r.paid_on, r.answer, r.search_best, r.searched_on) == ("A 12", True, "f1", "r1", D(2026, 8, 1), "business", True, D(2026, 7, 9))


def test_newest_snapshot_by_time(spark):
    rows = [("a", "x.csv", "2026-05-02 10:00:00"), ("a", "y.csv", "2026-05-01 10:00:00"), ("b", "p_2026-05-03.csv", "2026-01-01 00:00:00"), ("b", "q.csv", "2026-05-02 00:00:00"), ("c", "m_2026-05.csv", "2026-05-01 00:00:00"), ("c", "n_2026-05.csv", "2026-04-01 00:00:00")]
    files = spark.createDataFrame(rows, "family string, name string, modified string")
    assert {r.family: (r.stamp, r.name) for r in st.newest_snapshot(files, "family", "name").collect()} == {"a": ("2026-05-02", "x.csv"), "b": ("2026-05-03", "p_2026-05-03.csv"), "c": ("2026-05", "m_2026-05.csv")}
    assert st.newest_snapshot(files.drop("modified"), "family", "name").filter("family = 'a'").first().name == "y.csv"


def test_board_figures_read_facts_instead_of_the_ledger(spark):
    rows = [
        (f"R{i}", D(2026, 5 + i % 3, 1 + i % 28), Decimal(i), ["business", "personal", "needs-tag", "skip"][i % 4], ["alfa", "beta"][i % 5 == 0], ["-1", "-2"][i % 2],
         i % 3 == 0, i % 7 == 0, [None, "business"][i % 8 == 2], ["no-receipt", "reimbursed", "needs-tag", "ready"][i % 4], D(2026, 7, 1 + i % 9) if i % 6 == 0 else None)
        for i in range(400)
    ] + [("N", None, None, "business", "alfa", "-1", False, False, None, "no-receipt", None)]
    states = spark.createDataFrame(rows, "ref string, date date, amount decimal(18,2), tag string, entity string, account string, evidence boolean, reimbursed boolean, answer string, state string, searched_on date")
    states = states.withColumn("month", F.date_format("date", "yyyy-MM")).withColumn("answered_tag", F.coalesce("answer", "tag"))
    facts = st.ledger_facts(states, "account")
    assert facts.count() < states.count() and facts.agg(F.sum("row_count")).first()[0] == states.count()
    plans = spark.createDataFrame([("2026-05", 3, 1, False, Decimal(9))], "month string, vouchers long, booked long, held boolean, plan_sek decimal(18,2)")
    empty = lambda ddl: spark.createDataFrame([], ddl)
    fresh = empty("source string, statement boolean, state string, age_days int")
    flagged = empty("status string, group string, amount_sek decimal(18,2)")

    def board(ledger):
        covered = st.coverage(ledger.select("date"))
        months = st.ledger_months(ledger, plans, "alfa")
        tasks = st.todo(
            flagged, empty("route string, owner string, amount_sek decimal(18,2)"), ledger, st.month_stage(months, covered), fresh,
            empty("kind string"), empty("severity string"), covered, "alfa", F.lit(D(2026, 9, 1)),
        )
        chips = st.source_chips(ledger, flagged, covered, fresh, F.lit(D(2026, 9, 1)), ["-1"], "export")
        line = st.headline(empty("has_receipt boolean"), ledger, plans, empty("kind string, amount_sek decimal(18,2)"))
        return [sorted(map(str, df.collect())) for df in (months.select(sorted(months.columns)), tasks, chips, line)]

    one, other = board(states), board(facts)
    assert one == other and len(one[1]) > 3


def test_star_joins_all_sides_at_once(spark):
    """Six sides meet in one aggregate, so a ledger row is joined twice: with its sides and its month."""
    from tallybridge.catalog import status as cs

    ledger = spark.createDataFrame([("A", D(2026, 7, 1), "business")], "ref string, date date, tag string").withColumns({"entity": F.lit("alfa"), "bas_account": F.lit("5410"), "in_expense": F.lit(False)})
    side = cs.plan_rows(spark, SF)
    star = st.ledger_star(
        ledger, side, side.select("ref", F.lit("f").alias("file")), side.select("ref", F.lit("r").alias("id"), F.lit("").alias("voucher")), side.select("ref", F.lit(D(2026, 8, 1)).alias("paid_on")),
        side.select("ref", F.lit("business").alias("tag")), side.select("ref", F.lit(True).alias("has_best"), F.lit(D(2026, 7, 1)).alias("searched_on")),
    )
    assert star._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2
