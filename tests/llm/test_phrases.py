"""Phrase mining against SQL and against counting everything in one place."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallybridge.llm import phrases

from .conftest import assert_oracle, folder, rows_of

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(docs):
    """Places of every phrase by language, and of all words."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(CAPITALS)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    f[lang or "und", " ".join(w[i : i + size])] += 1
    return f, n


def plain_ranks(docs):
    f, n = plain_counts(docs)
    often = {k: c for k, c in f.items() if c >= 10 and " " in k[1]}
    out = []
    for (lang, phrase), a in often.items():
        w = phrase.split(" ")
        if any(y == lang and len(p.split(" ")) > len(w) and f" {phrase} " in f" {p} " and 100 * c >= 50 * a for (y, p), c in often.items()):
            continue
        cuts = []
        for k in range(1, len(w)):
            x, y = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((1000000 * a * a // (x * y), k, x, y))
        score, _, x, y = min(cuts)
        out.append((lang, -score, -a, phrase.encode(), phrase, x, y))
    rows, rank = [], Counter()
    for lang, score, a, _, phrase, x, y in sorted(out):
        rank[lang] += 1
        if rank[lang] <= 2000:
            rows.append((-a, x, lang, n[lang], phrase, y, rank[lang], -score))
    return sorted(rows, key=repr)


def crowd(seed, n=400):
    rng = random.Random(seed)
    words = ["New", "york", "times", "the", "of", "to", "a", "naïve", "Über", "漢字", "x1", "\x01", "\x1cz", "THE", "e" * 300]
    weights = [8, 8, 8, 20, 10, 10, 10, 3, 3, 3, 2, 2, 2, 5, 1]
    out = []
    for _ in range(n):
        w = rng.choices(words, weights, k=rng.randrange(0, 40))
        out.append(("".join(x + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\r\n", " \x0b "]) for x in w), rng.choice(["en", "en", "en", "de", None])))
    return out


def test_query(spark, awkward, nothing, tmp_path):
    assert_oracle(spark, "op12_phrase_mining", "/root/testdata/sf0.001")
    assert_oracle(spark, "op12_phrase_mining", awkward)
    assert rows_of(spark, "op12_phrase_mining", nothing)[1] == []
    docs = crowd(1) + [("same words again, same words again", "en")] * 300 + [(None, "en"), ("", None), ("lone", "xx"), ("a b " * 20_000, "long")]
    place = folder(spark, tmp_path, documents=([(t, x, "n", 1) for t, x in docs], "text string, lang string, words string, fresh int"))
    names, got = assert_oracle(spark, "op12_phrase_mining", place)
    assert names == ["a", "l", "lang", "n", "phrase", "r", "rank", "score"]
    assert got == plain_ranks(docs) and len(got) > 100


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_counts_whatever_the_shards(spark, shards, monkeypatch):
    """However late a phrase becomes active, it is counted in full; with filters that let everything through as well."""
    docs = crowd(2, 150)
    f, n = plain_counts(docs)
    want = sorted((lang, p.count(" ") + 1, p, c) for (lang, p), c in f.items() if c >= 10)
    frame = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    for most in (phrases.MOST_BITS, 6):
        monkeypatch.setattr(phrases, "MOST_BITS", most)
        found = phrases.mined(frame, shards=shards)
        assert sorted(map(tuple, phrases.phrase_counts(found).collect())) == want
        assert {r.lang: r.n for r in found.totals.collect()} == dict(n)


def test_words_that_share_a_hash(spark, monkeypatch):
    """All is done anew with another salt."""
    docs, dealt, salts = crowd(4, 100), phrases.dealt, []
    f, _ = plain_counts(docs)

    def poor(rows, shards, salt):
        salts.append(salt)
        blocks = dealt(rows, shards, salt)

        def spoil(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    few = np.frombuffer(row.column("hashes")[0].as_py(), "<u8") % 5 + 1
                    few[0] = 0
                    yield row.set_column(row.schema.get_field_index("hashes"), "hashes", pa.array([few.tobytes()], pa.binary()))

        return blocks if salt else blocks.mapInArrow(spoil, blocks.schema)

    monkeypatch.setattr(phrases, "dealt", poor)
    found = phrases.phrase_counts(phrases.mined(spark.createDataFrame(docs, "text string, lang string")))
    assert {(r.lang, r.phrase): r.f for r in found.collect()} == {k: c for k, c in f.items() if c >= 10} and salts == [0, 1]


def test_blocks(monkeypatch):
    """Borders between blocks and between stretches of a text change no count."""
    texts = [t for t, _ in crowd(3, 60)]
    f, n = plain_counts([(t, "en") for t in texts])
    every = phrases.Filter(6)
    every.words[:] = -1 % 2**64
    for full, octets in ((1, 1), (7, 5), (50, 64), (phrases.BLOCK, phrases.BYTES)):
        monkeypatch.setattr(phrases, "BLOCK", full)
        monkeypatch.setattr(phrases, "BYTES", octets)
        dealer, got, words = phrases.Dealer(), Counter(), 0
        blocks = [b for t in texts for b in dealer.add(t.encode())] + [dealer.block()]
        assert (len(blocks) > 1) == (full < 1000)
        for block in blocks:
            hashes = np.array([0, *(phrases.word_hash(w, 1) for w in block.words[1:])], np.uint64)
            name = dict(zip(hashes.tolist()[1:], (w.decode() for w in block.words[1:])))
            words += int(np.count_nonzero(block.ids[: block.own]))
            for key, counts, _ in phrases.counted(block, hashes, 2, {1: {0: every}, 2: {1: every}}, 3):
                for *parts, c in zip(*(k.tolist() for k in key), counts.tolist()):
                    got["en", " ".join(name[x] for x in parts)] += c
        assert got == f and words == n["en"]


def test_filter(spark):
    rng = np.random.default_rng(1)
    held = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    rows = spark.createDataFrame(pa.table({"a": pa.array(held.view(np.int64)), "b": pa.array(held[::-1].copy().view(np.int64))}))
    one, two = phrases.filter_of(rows, 1, len(held)), phrases.filter_of(rows, 2, len(held))
    other = rng.integers(0, 2**64, 100_000, dtype=np.uint64)
    assert one.holds(held).all() and one.holds(other).mean() < 0.01
    assert two.holds(phrases.pair_hash(held, held[::-1])).all() and two.holds(other).mean() < 0.01
    assert phrases.Filter.bits_for(10**12) == phrases.MOST_BITS


def test_scores_beyond_64_bits(spark):
    a, x, y = 10**12, 3 * 10**12 + 7, 10**12 + 1
    counts = spark.createDataFrame([(1, 0, 0, x), (2, 0, 0, y), (1, 2, 0, a)], "a long, b long, c long, f long")
    assert [tuple(r) for r in phrases.scored(counts).collect()] == [(1, 2, 0, a, x, y, 10**6 * a * a // (x * y))]
