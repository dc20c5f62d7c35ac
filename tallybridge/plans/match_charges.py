"""Worklist to ranked evidence and a route per charge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import matching as mt
from ..session import settle


@dataclass(frozen=True)
class Matches:
    ranked: DataFrame
    routed: DataFrame


def match_charges(
    worklist: DataFrame,
    vendors: DataFrame,
    messages: DataFrame,
    details: DataFrame,
    sends: DataFrame,
    policy: mt.MatchPolicy,
    stopwords,
    subject_terms,
    run_date: Column,
) -> Matches:
    """All charges against all messages by blocked interval joins; ``ranked`` is settled once."""
    rows = mt.with_vendor(worklist, vendors, policy)
    searched = rows.filter(F.col("search")) if "search" in rows.columns else rows
    pairs = mt.blocked_pairs(searched, messages, stopwords, subject_terms, policy.list("search_words")).drop("kinds")
    charges = mt.charge_features(searched.drop("mailbox"), stopwords)
    mails = mt.message_features(messages.drop("mailbox"), policy)
    facts = mt.facing(pairs, charges, mt.read_details(mails, details))
    ranked = settle(mt.rank_candidates(mt.rescore(mt.score(facts)), policy))
    best = mt.best_second(ranked)
    marks = policy.list("forward_prefixes") + policy.list("reply_prefixes")
    placed = best.join(rows.select("row_key", "mailbox", "window_from", "window_to"), "row_key")
    sent = mt.last_send(mt.related_sends(placed, sends, marks))
    routed = mt.route(rows.join(best, "row_key", "left").join(sent, "row_key", "left"), policy, run_date)
    return Matches(ranked, mt.fetch_decision(routed))
