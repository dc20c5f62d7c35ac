"""License scans: short notices found in texts although they differ by a few characters.

A text becomes its words (A-Z in lower case, runs of letters, digits and all beyond ASCII) with one
blank between them. A notice holds where a stretch of whole words is at most ``edits`` characters
(put in, left out or exchanged) away from it.

1. Seeds. A notice is cut into ``edits`` + 1 pieces. Of any stretch within ``edits`` of it, one piece
   at least stands there unchanged (pigeonhole), at most ``edits`` places from where it would be.
   One Aho-Corasick automaton finds the pieces of all notices in one pass over the text.
2. Verification. Round each seed a window that holds every such stretch is searched by the
   regex library with the notice's error bound; the best match is the span, with its errors.
   Spans of a notice that overlap are one: that of the fewest errors, then the first.

A notice without edits is its own only piece and every place of it is a span.

Edge cases. Null and empty texts have no words and no span. Very long texts are scanned whole, in
one pass; work and memory grow with the text and its seeds. Repeated rows give a row each, empty
tables none. Rows keep their columns in ``_row``, so names cannot clash.
"""

from __future__ import annotations

from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .registry import query, table
from .shared import SLICE


class Notice(NamedTuple):
    label: str
    words: str
    edits: int


# The phrases that count as they stand.
BASE = (Notice("mit", "mit license", 0), Notice("apache", "apache license", 0), Notice("gpl", "general public license", 0))
# A notice shorter than SHORT takes no edit ("it license" is no "mit license"); others one for
# PER_EDIT characters, MOST_EDITS at most, so that seeds stay longer than five characters.
SHORT, PER_EDIT, MOST_EDITS = 14, 10, 4


def fuzzy(label: str, words: str) -> Notice:
    return Notice(label, words, 0 if len(words) < SHORT else min(MOST_EDITS, len(words) // PER_EDIT))


# Opening or naming words of public licenses.
NOTICES = (
    fuzzy("mit", "mit licence"),
    fuzzy("mit", "under the mit license"),
    fuzzy("mit", "mit open source license"),
    fuzzy("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    fuzzy("apache", "apache license"),
    fuzzy("apache", "licensed under the apache license version 2 0"),
    fuzzy("gpl", "gnu general public license"),
    fuzzy("gpl", "general public license"),
    fuzzy("lgpl", "gnu lesser general public license"),
    fuzzy("agpl", "gnu affero general public license"),
    fuzzy("bsd", "bsd license"),
    fuzzy("bsd", "under the bsd license"),
    fuzzy("bsd", "clause bsd license"),
    fuzzy("bsd", "redistribution and use in source and binary forms"),
    fuzzy("mpl", "mozilla public license"),
    fuzzy("epl", "eclipse public license"),
    fuzzy("isc", "permission to use copy modify and or distribute this software for any purpose"),
    fuzzy("cc", "licensed under cc by"),
    fuzzy("cc", "licensed under a creative commons"),
    fuzzy("cc", "creative commons attribution"),
    fuzzy("cc0", "cc0 1 0 universal"),
    fuzzy("unlicense", "this is free and unencumbered software released into the public domain"),
)

# One entry a byte: A-Z lower, digits, a-z and all beyond ASCII as they are, the rest blank.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_PLAIN).split()


def pieces(words: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces that make up the notice, each with its place in it."""
    ends = [len(words) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, words[a:b]) for a, b in zip(ends, ends[1:])]


class Scanner:
    """The automaton of all seeds and the patterns that verify them; one per worker and list of notices."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, notice in enumerate(notices):
            for at, piece in pieces(notice.words, notice.edits):
                seeds.setdefault(piece, []).append((number, at + len(piece) - 1))
        self.automaton = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.automaton.add_word(piece, places)
        if seeds:
            self.automaton.make_automaton()
        # Whole words: the bounds take no error.
        self.patterns = [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n.words)}){{e<={n.edits}}}(?![^ ])") for n in notices]

    def windows(self, text: str) -> set[tuple[int, int]]:
        """Number of a notice and where it would start, for each seed in the text."""
        if not self.notices:
            return set()
        return {(number, end - at) for end, places in self.automaton.iter(text) for number, at in places}

    def verified(self, text: str, number: int, start: int) -> tuple[int, int, int] | None:
        """The best stretch near ``start``: errors, start and end in characters."""
        notice = self.notices[number]
        low, high = max(0, start - notice.edits), start + len(notice.words) + 2 * notice.edits
        before = max(0, low - 1)
        # Where the window cuts a word, it ends in more foreign characters than edits can take up.
        cut = "\0" * (notice.edits + 1) if text[high : high + 1] not in ("", " ") else ""
        found = self.patterns[number].search(text[before:high] + cut, low - before)
        return None if found is None else (sum(found.fuzzy_counts), before + found.start(), before + found.end())

    def spans(self, text: str) -> list[tuple[int, int, int, int]]:
        """Number of the notice, errors, start and end of every span, by notice and start."""
        found: dict[int, set] = {}
        for number, start in self.windows(text):
            span = self.verified(text, number, start)
            if span is not None:
                found.setdefault(number, set()).add(span)
        out = []
        for number in sorted(found):
            kept: list[tuple[int, int, int]] = []
            for span in sorted(found[number], key=lambda s: (s[1], s[0], s[2])):
                if kept and span[1] < kept[-1][2]:
                    if span[0] < kept[-1][0]:
                        kept[-1] = span
                else:
                    kept.append(span)
            out += [(number, *span) for span in kept]
        return out


_SCANNERS: dict[tuple[Notice, ...], Scanner] = {}

FOUND = pa.struct([
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("notice", pa.int32()), ("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("errors", pa.int32())]))),
])
_FOUND_SQL = "struct<n_words:bigint,spans:array<struct<notice:int,label:string,first_word:bigint,n_words:bigint,errors:int>>>"


def scan_text(scanner: Scanner, text: bytes | None) -> dict:
    words = plain_words(text)
    joined = b" ".join(words).decode("utf-8", "replace")
    spans, at, word = [], 0, 0
    for number, errors, start, end in sorted(scanner.spans(joined), key=lambda s: (s[2], s[0])):
        word += joined.count(" ", at, start)
        at = start
        spans.append({
            "notice": number, "label": scanner.notices[number].label, "first_word": word,
            "n_words": joined.count(" ", start, end) + 1, "errors": errors,
        })
    return {"n_words": len(words), "spans": spans}


def found_notices(text: Column, notices: tuple[Notice, ...]) -> Column:
    """``n_words`` of a text and its ``spans``, by place: notice (its number), label, first word, words and errors."""

    def each(column: pa.Array) -> pa.Array:
        scanner = _SCANNERS.get(notices) or _SCANNERS.setdefault(notices, Scanner(notices))
        parts = [
            pa.array([scan_text(scanner, t) for t in column.slice(at, SLICE).to_pylist()], FOUND) for at in range(0, len(column), SLICE)
        ]
        return pa.concat_arrays(parts or [pa.array([], FOUND)])

    each.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, _FOUND_SQL)(text.cast("binary"))


def scanned(docs: DataFrame, text: str = "text", notices: tuple[Notice, ...] = BASE + NOTICES) -> DataFrame:
    """``_row`` (the input row) and ``_found``: words, and every span of every notice."""
    return docs.select(F.struct("*").alias("_row"), found_notices(F.col(text), notices).alias("_found"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


@query("op13_license_scans")
def op13_license_scans(spark, sf_dir):
    """Every document with its exact phrases and the labels of all notices within their edits."""
    notices = BASE + NOTICES
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scanned(docs, notices=notices).select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_found.n_words").alias("n_words"), F.col("_found.spans").alias("_spans")
    )
    length = F.array(*(F.lit(len(n.words)) for n in notices))
    base = F.filter("_spans", lambda s: s["notice"] < len(BASE))
    likeness = F.transform("_spans", lambda s: 1 - s["errors"] / F.get(length, s["notice"]))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first_word"])).alias("last_word"),
        _joined(F.transform(base, lambda s: s["label"])).alias("base_labels"),
        _joined(F.transform("_spans", lambda s: s["label"])).alias("labels"),
        F.coalesce(F.array_max(likeness), F.lit(0.0)).alias("score"),
    )
