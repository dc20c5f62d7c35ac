"""The flows end to end over the small tables."""

from pyspark.sql import functions as F

from tallybridge.catalog import archive as ca, bindings as b, matching as cm, posting as cp, status as cs
from tallybridge.operators import archive as ar
from tallybridge.plans.match_charges import match_charges
from tallybridge.plans.month_close import month_close
from tallybridge.plans.status_board import status_board

SF = "/root/testdata/sf0.001"


def test_month_close_balances(spark):
    out = month_close(
        b.charges_raw(spark, SF), b.STATEMENT_ORDER, b.rules(spark), b.overrides(spark, SF), b.prior(spark, SF), b.cards(spark), b.regimes(spark),
        b.evidence_map(spark, SF), b.evidence_files(spark, SF), cp._paid(spark, SF), b.POLICY, b.ACCOUNTS,
    )
    per = out.postings.groupBy("month", "ref").agg(F.sum("debit").alias("d"), F.sum("credit").alias("c"))
    assert per.filter("d <> c").count() == 0 and per.count() == out.numbered.count() > 100
    total = out.postings.filter(F.col("account") == 2890).agg(F.sum("credit")).collect()[0][0]
    assert total == out.reimbursements.agg(F.sum("amount")).collect()[0][0]
    kinds = {r.disposition: r["count"] for r in out.plan.groupBy("disposition").count().collect()}
    assert sum(kinds.values()) == out.classified.count() and set(kinds) == {"planned", "excluded", "out-of-scope"}
    assert out.codes.count() == out.reimbursements.count() and out.warnings.count() > 0


def test_match_charges_agrees_with_the_queries(spark):
    raw = cm.worklist(spark, SF).select(
        "row_key", "mailbox", "ledger", "date", "merchant", "vendor_key", "kind", "amount_sek", "foreign_amount", "foreign_currency", "tag", "entity"
    )
    out = match_charges(
        raw, cm.vendors(spark), cm.messages(spark, SF), cm.details(spark, SF), cm.sends(spark, SF), cm.policy(spark), cm.STOP, cm.SUBJECT_TERMS, F.expr(cm.RUN_DATE)
    )
    got = {(r.row_key, r.message_id, r.rank) for r in out.ranked.collect()}
    assert got == {(r.row_key, r.message_id, r.rank) for r in cm.w2(spark, SF).collect()} and got
    assert out.routed.count() == raw.count()


def test_status_board_sections_agree(spark):
    on_list = ca.records(spark, SF).filter("lang = 'de'").select("id")
    board = status_board(
        cs.star(spark, SF), cs.plan_months(spark, SF), b.charges_raw(spark, SF).select("date"), b.expenses(spark, SF), cs.live(spark, SF), cs.flagged(spark, SF),
        ca.records(spark, SF), cs.st.open_warnings(cs._warnings(spark, SF), on_list), cs._lint(spark, SF), cs.sources(spark, SF), b.OWN, F.expr(cs.TODAY),
    )
    line = board.headline.collect()[0]
    assert line.business_rows == board.months.agg(F.sum("business")).collect()[0][0]
    assert board.steps.count() == 5 * board.months.count()
    keys = [r.key for r in board.todo.collect()]
    assert len(keys) == len(set(keys)) and "archive-errors" in keys and board.chips.count() == 6
    assert ar.warning_kinds(cs._warnings(spark, SF)).collect()[0].kind == "duplicate-invoice"
