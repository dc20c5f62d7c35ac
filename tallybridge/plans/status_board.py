"""Exports, ledger, plans and archive to one status board, a table per section."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..operators import status as st
from ..session import settle

# The columns of the ledger star the sections below read.
STAR_COLUMNS = [
    "ref", "date", "month", "amount", "tag", "entity", "bas_account", "in_expense", "evidence", "booked", "reimbursed",
    "answer", "answered_tag", "plan_held", "planned", "search_best", "searched_on",
]


@dataclass(frozen=True)
class StatusBoard:
    expense_months: DataFrame
    ledger_rows: DataFrame
    months: DataFrame
    steps: DataFrame
    sources: DataFrame
    headline: DataFrame
    todo: DataFrame
    chips: DataFrame


def status_board(
    star: DataFrame,
    plan_months: DataFrame,
    charges: DataFrame,
    expenses: DataFrame,
    live: DataFrame,
    flagged: DataFrame,
    archive: DataFrame,
    warnings: DataFrame,
    lint_findings: DataFrame,
    sources: DataFrame,
    own_entity: str,
    today: Column,
) -> StatusBoard:
    """Every section is its own table; the ledger star is settled once because most of them read it."""
    rows = settle(star.select(*STAR_COLUMNS))
    cover = st.coverage(charges)
    months = st.month_stage(st.ledger_months(rows, plan_months, own_entity), cover)
    states = st.ledger_state(rows, own_entity)
    fresh = st.freshness(sources, today)
    line = st.headline(expenses, rows, plan_months, archive)
    tasks = st.todo(flagged, live, states, months, fresh, warnings, lint_findings, cover, own_entity, today)
    return StatusBoard(
        st.expense_months(expenses), st.newest_first(states), months, st.month_steps(months), fresh, line, st.order_todo(tasks), st.status_chips(line, tasks)
    )
