"""Operators beyond SQL: against brute force, the public libraries, and held-out accuracy."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tallybridge.llm import embeddings, langid, packing, queries, simhash, tokens, vptree
from tallybridge.llm.components import components
from tallybridge.llm.registry import reachable

from .conftest import folder, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(params=["driver", "awkward"])
def place(request, awkward):
    return SF if request.param == "driver" else awkward


def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]


def classes(n, pairs):
    """The smallest index each of n is linked with, one by one."""
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return [top(x) for x in range(n)]


def test_token_counts(spark, place):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for doc, text, _ in documents(spark, place):
        n = len(model.encode(text or ""))
        want.append((doc, len((text or "").encode()), n, n > 4096))
    assert rows_of(spark, "op5_token_counts", place)[1] == sorted(want, key=repr)


def test_token_counts_of_odd_strings():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, merges = sentencepiece.SentencePieceProcessor(model_file=path), tokens.Merges.of_model(path)
    rng = random.Random(3)
    alphabet = list("aehint  \n\n\t") + ["▁", "é", "漢", "🙂", "​", "the", " a", "<s>", "\r", "\x00", "0", "."]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))
        assert merges.count(text) == len(model.encode(text)), repr(text)


def test_remembered_is_bounded():
    from tallybridge.llm.shared import Remembered

    asked = []
    memory = Remembered(lambda k: asked.append(k) or k * 2, 3)
    assert [memory[i % 5] for i in range(50)] == [2 * (i % 5) for i in range(50)]
    assert len(memory) <= 3 and len(memory.older) <= 3


def whole_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for t in texts]


def test_ids_of_odd_strings():
    own = packing.Ids(packing.vocabulary())
    rng = random.Random(4)
    alphabet = list("ab  \n\t'") + ["'s", "é", "漢", "🙂", " ", " ", "12", "...", "<|endoftext|>", "word"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(4000)]
    for text, ids in zip(texts, whole_ids(texts)):
        assert own.of(text) == ids[:-1].tobytes(), repr(text)


def test_words_of_a_text_are_asked_for_at_once():
    """A text's unknown words cost one call; ids are the same when memory is small and forgets."""
    for entries in (packing.REMEMBERED, 50):
        own = packing.Ids(packing.vocabulary(), entries)
        asked, whole = [], own.tokenizer

        class Counted:
            def encode(self, text, **options):
                asked.append(text)
                return whole.encode(text, **options)

        own.tokenizer = Counted()
        texts = [" ".join(f"{a}{b}{c}{mark}" for c in "àqz") + "\n" + b for a in ("bra", "Ünw", "漢") for b in ("lo", "ße", "n") for mark in ("", ",", ".")]
        text = " ".join(texts)
        assert own.of(text) == whole_ids([text])[0][:-1].tobytes()
        assert entries < 100 or len(asked) < 20
        for text, ids in zip(texts, whole_ids(texts)):
            assert own.of(text) == ids[:-1].tobytes(), repr(text)


def check_pieces(rows, documents_):
    """Every id of every document in one piece, sequences gapless and without padding."""
    want = {}
    for (doc, _, _), ids in zip(documents_, whole_ids([t for _, t, _ in documents_])):
        want.setdefault(doc, []).append(ids)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(want)
    for doc, own in pieces.items():
        left = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in own)
        assert sum(p[1] for p in left) == sum(map(len, want[doc]))
        for p in left:
            assert any(len(ids) == p[3] and zlib.crc32(ids[p[0] : p[0] + p[1]].tobytes()) == p[2] for ids in want[doc])
        for total in {p[3] for p in left}:
            copies = sum(len(ids) == total for ids in want[doc])
            covered = np.zeros(total, int)
            for p in left:
                if p[3] == total:
                    covered[p[0] : p[0] + p[1]] += 1
            assert (covered == copies).all()
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0


def test_packing(spark, place):
    check_pieces(queries.QUERIES["op8_curve_packing"](spark, place).collect(), documents(spark, place))


def test_hilbert_is_a_curve():
    bits = 3
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    order = cells[np.argsort(packing.hilbert(cells, bits))]
    assert sorted(packing.hilbert(cells, bits)) == list(range(512))
    # Each step of the curve moves to a neighbour along one axis.
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_share_sequences(spark):
    """Copies lie next to each other along the curve."""
    texts = [("river stone " * 40) if i % 3 else f"other words number {i * 7919} " * 30 for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    reachable(spark)
    keys = {r.doc_id: r.k for r in docs.select("doc_id", packing.curve_key(F.col("text")).alias("k")).collect()}
    assert len({keys[i] for i in range(60) if i % 3}) == 1 and len(set(keys.values())) > 10


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, place):
    docs = documents(spark, place)
    prints = [plain_fingerprint(t) for _, t, _ in docs]
    near = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = classes(len(docs), near)
    least = {}
    for (doc, _, _), r in zip(docs, root):
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    want = [(least.get(r), doc, f"{p:016x}") for (doc, _, _), r, p in zip(docs, root, prints)]
    assert rows_of(spark, "op7_simhash_near_dedup", place)[1] == sorted(want, key=repr)


def test_simhash_links_by_brute_force(spark):
    """Chains, dense balls larger than a leaf, and strangers: no pair within the radius is missed."""
    rng = random.Random(5)
    points = {rng.getrandbits(64) for _ in range(1500)}
    centre = rng.getrandbits(64)
    points |= {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(0, 64, 5)}
    chain = rng.getrandbits(64)
    for _ in range(60):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        points.add(chain)
    own = sorted(points)
    near = [(i, j) for i in range(len(own)) for j in range(i) if (own[i] ^ own[j]).bit_count() <= 4]
    want = classes(len(own), near)
    array = np.array(own, dtype=np.uint64)
    assert vptree.connected(array, 4).tolist() == want
    reachable(spark)
    frame = spark.createDataFrame([(int(x), i) for i, x in enumerate(array.view(np.int64))], "fp long, id long").repartition(3)
    got = {r.fp: r.component_id for r in simhash.grouped(frame, "id").collect()}
    assert [got[int(x)] for x in array.view(np.int64)] == want


def test_simhash_keeps_one_of_each_group(spark, awkward):
    reachable(spark)
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    kept = simhash.kept_documents(docs)
    assert kept.columns == docs.columns
    groups = simhash.near_duplicates(docs).select("component_id").distinct().count()
    assert kept.count() == groups
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and 1 in ids and 2 not in ids and 3 not in ids


def test_components(spark):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    pairs += [(500 - i, 499 - i) for i in range(30)] + [(7, 7), (900, 900), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    known = sorted({x for p in pairs if None not in p for x in p})
    at = {x: i for i, x in enumerate(known)}
    want = classes(len(known), [(at[a], at[b]) for a, b in pairs if a is not None])
    assert got == {x: known[want[at[x]]] for x in known}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_few_links_take_few_jobs(spark, monkeypatch):
    """Links of one task are joined up there: a long chain goes in one round, not in many."""
    from tallybridge.llm import components as module

    settled = []
    plain = module.settle
    monkeypatch.setattr(module, "settle", lambda df: settled.append(1) or plain(df))
    chain = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(chain).agg(F.count("*").alias("n"), F.max("root").alias("root")).first()
    assert (got.n, got.root) == (3001, 0)
    assert len(settled) <= 6
    # Cut into pieces of few links, the result is the same.
    monkeypatch.setattr(module, "PIECE", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = components(chain.filter("a != 1700")).groupBy("root").count().orderBy("root").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(r) for r in got] == [(0, 1701), (1701, 1300)]


VECTORS = "vec_id long, embedding array<float>, label int, gid string, filters string"


def test_embeddings(spark, tmp_path):
    rng = np.random.default_rng(8)

    def near(v, cosine):
        other = rng.standard_normal(len(v))
        other -= other @ v / (v @ v) * v
        return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)

    rows = [rng.standard_normal(64) for _ in range(300)]
    for i in range(60):
        rows += [near(rows[i], 0.905), near(rows[i], 0.89), near(rows[i], 0.97) * 5, rows[i]]
    dense = rng.standard_normal(64)
    rows += [near(dense, 0.985) for _ in range(150)] + [dense] * 40
    vectors = [np.asarray(r, dtype=np.float32) for r in rows]
    unit = [v.astype(float) / np.linalg.norm(v.astype(float)) for v in vectors]
    cosines = np.array(unit) @ np.array(unit).T
    links = (cosines >= 0.9) & ~np.eye(len(rows), dtype=bool)
    root = classes(len(rows), list(zip(*np.nonzero(links))))
    # Others that link with nothing, and a width of their own.
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [-1.0, 0.0], [3.0], [4.0]]
    table = [(i, [float(x) for x in v], 1, "x", "y") for i, v in enumerate(vectors)] + [(10_000 + i, v, None, "x", "y") for i, v in enumerate(odd)]
    path = folder(spark, tmp_path, embeddings=(table, VECTORS))
    order, found = rows_of(spark, "op10_cap_filters", path)
    got = {r[order.index("vec_id")]: dict(zip(order, r)) for r in found}
    assert len(got) == len(table)
    missed = over = 0
    for i in range(len(rows)):
        missed += int(links[i].sum()) - got[i]["n_links"]
        over += got[i]["n_links"] > links[i].sum()
        assert got[i]["kept"] == (got[i]["component_id"] == i)
    assert over == 0 and missed <= 0.005 * links.sum()
    assert sum(got[i]["component_id"] != root[i] for i in range(len(rows))) <= 2
    for i, links_, component in [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, 0, 8), (9, 0, 9), (10, 1, 10), (11, 1, 10)]:
        assert (got[10_000 + i]["n_links"], got[10_000 + i]["component_id"]) == (links_, 10_000 + component)
    # Tiles smaller than the dense group give the same.
    tiled = embeddings.near_duplicates(spark.read.parquet(f"{path}/embeddings.parquet"), tile=16)
    assert sorted((tuple(r) for r in tiled.select(*order).collect()), key=repr) == found
    none = folder(spark, tmp_path / "none", embeddings=([], VECTORS))
    assert rows_of(spark, "op10_cap_filters", none)[1] == []


def test_decode_lists_every_filter():
    rng = np.random.default_rng(9)
    units = rng.standard_normal((50, 12))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    for blocks in (1, 2, 3):
        _, books = embeddings.product_codes(12, 1, blocks, 1.5, 20, 1)[0]
        cuts = np.cumsum([0, *(b.shape[1] for b in books)])
        want = []
        for n, u in enumerate(units):
            scores = np.zeros(1)
            for lo, hi, book in zip(cuts, cuts[1:], books):
                scores = (scores[:, None] + (book @ u[lo:hi])[None, :]).ravel()
            want += [(n, int(f)) for f in np.flatnonzero(scores >= 0.4 * np.sqrt(blocks))]
        row, code = embeddings.decode(units, books, 0.4)
        assert list(zip(row.tolist(), code.tolist())) == want


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    order, rows = rows_of(spark, "op4_language_id", sf)
    got = {r[order.index("doc_id")]: dict(zip(order, r)) for r in rows}
    docs = documents(spark, sf)
    held = [d for d in docs if got[d[0]]["held_out"]]
    assert {d[0] for d in held} == {d[0] for d in docs if zlib.crc32(str(d[0]).encode()) % 4 == 2}
    assert np.mean([got[d]["lang_pred"] == lang for d, _, lang in held if lang]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_awkward(spark, awkward, nothing):
    order, rows = rows_of(spark, "op4_language_id", awkward)
    got = [dict(zip(order, r)) for r in rows]
    assert len(got) == len(documents(spark, awkward))
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {1, 2, 3, 13, 22} | {d for d, t, _ in documents(spark, awkward) if d and not any(c.isalpha() for c in t or "")}
    assert all((r["lang_pred"] == "und") == (r["score"] == 0) for r in got)
    assert rows_of(spark, "op4_language_id", nothing)[1] == []


def test_forward_sums_every_segmentation():
    pieces = langid.Pieces(langid.vocabulary())
    word = "▁thera"
    lattice = pieces.lattice([word])
    chance = np.random.default_rng(1).random((pieces.size, 2))
    chance[0] = 0

    def total(at, k):
        if at == len(word):
            return 1.0
        return sum(chance[lattice[0, at, n - 1], k] * total(at + n, k) for n in range(1, len(word) - at + 1) if lattice[0, at, n - 1])

    assert np.allclose(langid.forward(lattice, chance)[0, -1], [total(0, 0), total(0, 1)])
    uses = langid.expected(lattice, chance[:, 0], np.array([3.0]))
    step = 1e-6
    piece = int(lattice[0, 0, 1])
    more = chance.copy()
    more[piece] *= 1 + step
    slope = 3 * (np.log(langid.forward(lattice, more)[0, -1, 0]) - np.log(total(0, 0))) / np.log1p(step)
    assert np.isclose(uses[piece], slope, rtol=1e-3)


@pytest.mark.parametrize("name", ["op5_token_counts", "op7_simhash_near_dedup", "op8_curve_packing"])
def test_empty_tables(spark, nothing, name):
    assert rows_of(spark, name, nothing)[1] == []


def test_places_are_means_of_word_vectors():
    import pyarrow as pa

    texts = ["a bb  ccc\nbb", None, "", "  ", "bb a ccc bb", "x" * 3000, "é ü", "ccc"]
    got = packing.places(pa.array(texts))
    assert np.allclose(got[0], got[4]) and not got[1].any() and not got[2].any() and not got[3].any()
    single = {w: packing.places(pa.array([w]))[0] for w in ("a", "bb", "ccc")}
    assert np.allclose(got[0], (single["a"] + 2 * single["bb"] + single["ccc"]) / 4)
    whole, old = packing.places(pa.array(texts * 50)), packing.STRETCH
    packing.STRETCH = 16
    assert np.array_equal(packing.places(pa.array(texts * 50).slice(3)), whole[3:])
    packing.STRETCH = old


def test_one_row_repeated_is_spread_over_ranges(spark):
    """Equal rows are told apart by their position, so no range takes most of them."""
    docs = spark.createDataFrame([(1, "same words again and again " * 20)] * 3000 + [(i, f"text {i} of its own " * 20) for i in range(1500)], "doc_id long, text string").repartition(5)
    reachable(spark)
    ends = packing.range_ends(docs, F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), 8)
    placed = docs.select(packing.curve_place(F.col("text"), F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), ends).alias("p"))
    counts = [r["count"] for r in placed.groupBy("p.range").count().collect()]
    assert len(counts) == 8 and max(counts) < 2 * 4500 / 8
    assert len(packing.range_ends(docs.filter("false"), F.lit(1).cast("bigint"), 8)) == 0
