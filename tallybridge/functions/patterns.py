"""What a regular expression cannot match without: literal runs, read off its syntax tree."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, functions as F

# Members of a character class that are told apart; a larger class counts as any character.
CLASS = 64


def _class(items: Iterable) -> set[str] | None:
    """The characters of a class, None for too many or unknown ones."""
    found: set[str] = set()
    for kind, value in items:
        name = str(kind)
        if name == "LITERAL":
            found.add(chr(value))
        elif name == "RANGE" and value[1] - value[0] < CLASS:
            found |= set(map(chr, range(value[0], value[1] + 1)))
        elif name == "CATEGORY" and str(value) == "CATEGORY_DIGIT":
            found |= set("0123456789")
        else:
            return None
    return found if len(found) <= CLASS else None


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set whose shortest run is longer; of these the smaller one."""
    if a is None or b is None:
        return a if b is None else b
    return max(a, b, key=lambda x: (min(map(len, x)), -len(x)))


def _covering(nodes) -> set[str] | None:
    """Runs of which every match of a sequence contains one; None where there are none."""
    best, run = None, ""
    for kind, value in nodes:
        name, own = str(kind), None
        if name == "LITERAL" and value < 128:
            run += chr(value)
            continue
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            if name != "AT":
                best, run = (_better(best, {run}) if run else best), ""
            continue
        best, run = (_better(best, {run}) if run else best), ""
        if name == "IN":
            own = _class(value)
        elif name == "BRANCH":
            ways = [_covering(way) for way in value[1]]
            own = set().union(*ways) if all(ways) else None
        elif name == "SUBPATTERN":
            own = _covering(value[-1])
        elif name == "ATOMIC_GROUP":
            own = _covering(value)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            own = _covering(value[2])
        if own and all(c.isascii() for x in own for c in x):
            best = _better(best, own)
    return _better(best, {run}) if run else best


def required_runs(pattern: str | None) -> list[str]:
    """Upper-case runs of which every text that matches, whatever its case, contains one.

    The empty run alone where no such set is known: the pattern may match any text. A pattern that
    cannot be read here counts as such.
    """
    if pattern is None:
        return []
    try:
        # Classes within classes are read differently by the engine that matches.
        runs = None if re.search(r"\[[^\]]*(\[|&&)", pattern) else _covering(re._parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        runs = None
    return sorted({x.upper() for x in runs}) if runs else [""]


def required_runs_of(pattern: Column) -> Column:
    """``required_runs`` of a column of patterns, in Arrow batches."""

    def each(column: pa.Array) -> pa.Array:
        return pa.array([required_runs(p) for p in column.to_pylist()], pa.list_(pa.string()))

    each.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, "array<string>")(pattern)
