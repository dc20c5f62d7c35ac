"""Statement rows to numbered, balanced vouchers and one reimbursement per month."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import ledger as lg, posting as po


@dataclass(frozen=True)
class MonthClose:
    classified: DataFrame
    plan: DataFrame
    numbered: DataFrame
    postings: DataFrame
    reimbursements: DataFrame
    codes: DataFrame
    warnings: DataFrame


def month_close(
    statement: DataFrame,
    order: list[str],
    rules: DataFrame,
    overrides: DataFrame,
    prior: DataFrame,
    cards: DataFrame,
    regimes: DataFrame,
    mapping: DataFrame,
    files: DataFrame,
    paid: DataFrame,
    policy: lg.Policy,
    accounts: dict[str, int],
) -> MonthClose:
    """Every month of the statement at once.

    ``numbered`` is settled by the numbering, so postings, reimbursements and approval codes read
    it rather than computing the ledger again.
    """
    charges = lg.charge_kind(lg.dedupe_statement(statement, order), policy.payment_phrase)
    classified = lg.classify(charges, rules, overrides, prior, cards, policy)
    plan = po.exclude_paid(po.plan_disposition(classified, policy.default_entity, regimes), paid)
    in_scope = po.attach_files(plan.filter(F.col("disposition") != "out-of-scope"), mapping, files, statement.select("ref"))
    status = po.plan_status(in_scope, regimes)
    numbered = po.number_vouchers(status.filter(F.col("disposition") == "planned"))
    postings = po.post_vouchers(numbered, regimes, accounts)
    return MonthClose(
        classified,
        plan,
        numbered,
        postings,
        po.reimbursement_row(numbered),
        po.batch_digest(numbered, postings),
        po.plan_warnings(status),
    )
