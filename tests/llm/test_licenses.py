"""License scans against a plain search: every stretch of whole words, by edit distance."""

import random
import re

import pytest

from tallybridge.llm import licenses
from tallybridge.llm.licenses import BASE, NOTICES, Notice

from .conftest import folder, rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(CAPITALS))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def plain_spans(words, notice):
    """All stretches within the edits: first word, words, errors."""
    out = []
    for i in range(len(words)):
        for n in range(1, len(words) - i + 1):
            stretch = " ".join(words[i : i + n])
            if len(stretch) > len(notice.words) + notice.edits:
                break
            if len(stretch) >= len(notice.words) - notice.edits:
                errors = edits(stretch, notice.words)
                if errors <= notice.edits:
                    out.append((i, n, errors))
    return out


def base_of(words):
    places = [(i, n.label) for n in BASE for i in range(len(words)) if words[i : i + len(n.words.split())] == n.words.split()]
    starts = [i for i, _ in places]
    return len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def mutated(rng, text, times):
    letters = list(text)
    for _ in range(times):
        at = rng.randrange(len(letters))
        kind = rng.randrange(3)
        if kind == 0:
            letters[at] = rng.choice("abcxyz 7é")
        elif kind == 1:
            letters.insert(at, rng.choice("abcxyz 7é"))
        elif len(letters) > 1:
            del letters[at]
    return "".join(letters)


def planted():
    rng = random.Random(11)
    fill = "the of license public general gnu mit apache under licensed software permission it summit cc by é漢 river creative commons".split()
    texts = []
    for number in range(90):
        notice = rng.choice(NOTICES)
        noise = [" ".join(rng.choice(fill) for _ in range(rng.randrange(0, 12))) for _ in range(3)]
        body = [mutated(rng, notice.words.title(), rng.randrange(0, 6)) for _ in range(2)]
        texts.append(rng.choice(["\n", ", ", " ", ""]).join([noise[0], body[0], noise[1], body[1], noise[2]]))
    return texts + ["MIT License MIT license" * 3, "the summit license", "make it license free", "general public license general public license", "mit\nlicense", "mitlicense", "MIT-LICENSE!"]


def test_spans_against_every_stretch():
    scanner = licenses.Scanner(BASE + NOTICES)
    held = 0
    for text in planted():
        words = words_of(text)
        found = licenses.scan_text(scanner, text.encode())
        assert found["n_words"] == len(words)
        for number, notice in enumerate(scanner.notices):
            want = plain_spans(words, notice)
            got = [(s["first_word"], s["n_words"], s["errors"]) for s in found["spans"] if s["notice"] == number]
            assert set(got) <= set(want)
            held += len(got)
            # Every stretch that holds lies at or across a reported span that has no more errors at its best.
            for first, n, errors in want:
                across = [s for s in got if s[0] < first + n and first < s[0] + s[1]]
                assert across, (text, notice)
            if want:
                assert min(s[2] for s in got) == min(e for _, _, e in want)
            if notice.edits == 0:
                assert sorted(got) == sorted(want)
    assert held > 100


def test_query(spark, awkward, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(planted())] + [(None, None, "x"), (900, "", "x"), (901, "MIT License", "x"), (901, "MIT License", "x"), (902, "a" * 100_000 + " Apache License " + "b " * 50_000, "x")]
    place = folder(spark, tmp_path, documents=(rows, "doc_id long, text string, _found string"))
    names, got = rows_of(spark, "op13_license_scans", place)
    assert names == sorted(["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(dict(zip(names, r))["doc_id"], []).append(dict(zip(names, r)))
    for doc, text, _ in rows:
        for r in by_id[doc]:
            words = words_of(text)
            assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_of(words)
            assert r["n_words"] == len(words)
            assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
            assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
            if len(words) < 200:
                labels = {n.label for n in BASE + NOTICES if plain_spans(words, n)}
                assert r["labels"] == ",".join(sorted(labels)), text
    assert len(by_id[901]) == 2 and by_id[902][0]["labels"] == "apache" and by_id[None][0]["labels"] == ""


def test_clean_documents_stay_clean(spark):
    names, got = rows_of(spark, "op13_license_scans", "/root/testdata/sf0.001")
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    at = {n: i for i, n in enumerate(names)}
    labelled = {r[at["doc_id"]] for r in got if r[at["labels"]]}
    assert labelled and labelled == {i for i, t in texts.items() if "icense" in (t or "")}


def test_empty_table_and_own_notices(spark, nothing):
    assert rows_of(spark, "op13_license_scans", nothing)[1] == []
    docs = spark.createDataFrame([(1, "Alle Rechte vorbehaltn", "y")], "doc_id long, text string, _row string")
    own = licenses.scanned(docs, notices=(Notice("reserved", "alle rechte vorbehalten", 2),)).first()
    assert own._row._row == "y" and [(s.label, s.first_word, s.n_words, s.errors) for s in own._found.spans] == [("reserved", 0, 3, 1)]
    assert licenses.scanned(docs, notices=()).first()._found.spans == []


@pytest.mark.parametrize("notice", NOTICES)
def test_pieces_make_up_the_notice(notice):
    cut = licenses.pieces(notice.words, notice.edits)
    assert "".join(p for _, p in cut) == notice.words and len(cut) == notice.edits + 1
    assert all(notice.words[at : at + len(p)] == p for at, p in cut)
