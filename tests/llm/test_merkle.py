"""The Merkle manifest against SQL and against trees built one node after the other."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybridge.llm import merkle

from .conftest import assert_oracle, folder, rows_of

SF = "/root/testdata/sf0.001"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([H("".join(row[i : i + 3])) for i in range(0, len(row), 3)])
    return levels


def plain_proof(levels, place):
    out = ""
    for row in levels[:-1]:
        run = place // 3 * 3
        out += "".join(h for i, h in enumerate(row[run : run + 3], run) if i != place)
        place //= 3
    return out


def plain_fold(leaf, proof, ways):
    for place, size in ways:
        while size > 1:
            width = min(3, size - place // 3 * 3)
            others, proof = proof[: 64 * (width - 1)], proof[64 * (width - 1) :]
            left = place % 3 * 64
            leaf = H(others[:left] + leaf + others[left:])
            place, size = place // 3, -(-size // 3)
    assert proof == ""
    return leaf


def record(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_manifest(docs):
    leaves = sorted(((d, record(d, d["text"])) for d in docs), key=lambda x: ((x[0]["source"] is not None, (x[0]["source"] or "").encode()), (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0), x[1]))
    sources = {}
    for d, h in leaves:
        sources.setdefault(d["source"], []).append((d, h))
    trees = [plain_tree([h for _, h in rows]) for rows in sources.values()]
    over = plain_tree([t[-1][0] for t in trees])
    out = []
    for number, (rows, tree) in enumerate(zip(sources.values(), trees)):
        for place, (d, h) in enumerate(rows):
            proof = plain_proof(tree, place) + plain_proof(over, number)
            doc = d["doc_id"]
            odd = doc is None or zlib.crc32(str(doc).encode()) % 2 == 1
            bad = h if odd or d["text"] is None else record(d, d["text"].replace("\n", ""))
            back = plain_fold(bad, proof, [(place, len(rows)), (number, len(trees))])
            out.append((doc, back, h, H(proof), over[-1][0], tree[-1][0], back == over[-1][0]))
    return sorted(out, key=repr)


def documents(spark, place):
    return [r.asDict() for r in spark.read.parquet(f"{place}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_query(spark, awkward, nothing):
    for place in (SF, awkward):
        names, got = assert_oracle(spark, "op11_merkle_manifest", place)
        assert names == ["doc_id", "folded_root", "leaf", "proof_sha256", "root", "subroot", "verified"]
        assert got == plain_manifest(documents(spark, place))
        assert {r[-1] for r in got} == {True, False}
    assert rows_of(spark, "op11_merkle_manifest", nothing)[1] == []


@pytest.mark.parametrize("rows", [[1], [1, 1], [4, 1, 2187, 1, 9], [1] * 40, [3000], [729, 730, 2], [0, 5]])
def test_sizes(spark, tmp_path, rows):
    """Group sizes round the tiles and the partitions; a text that stands there very often."""
    docs = [(i % 900, "same" if i % 3 else f"a\nb{i}", "en", f"s{g}" if g else None, 4) for g, n in enumerate(rows) for i in range(n)]
    place = folder(spark, tmp_path, documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    assert rows_of(spark, "op11_merkle_manifest", place)[1] == plain_manifest(documents(spark, place))


@pytest.mark.parametrize("block", [1, 7, 100, 1000])
def test_borders_between_partitions(spark, block):
    """Wherever the borders lie, and with one row that is most of the table."""
    rows = [("a", 1, "hot")] * 2500 + [("b", i, f"t{i}") for i in range(40)] + [(f"c{i}", i, "x") for i in range(30)]
    docs = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "source string, doc_id long, text string")
    done = merkle.manifest(docs, "doc_id", "source", merkle.record_hash([F.col("doc_id"), F.col("text")]), block=block)
    back = merkle.fold(F.col("leaf"), F.col("siblings"), F.col("place"), F.col("leaves"), F.col("group_place"), F.col("groups"))
    got = done.withColumn("back", back).collect()
    assert len(got) == len(rows) and len({(r.g, r.place) for r in got}) == len(rows)
    groups = {}
    for g, i, t in sorted(rows):
        groups.setdefault(g, []).append(H(f"{len(str(i))}:{i}{len(t)}:{t}"))
    trees = {g: plain_tree(h) for g, h in groups.items()}
    over = plain_tree([t[-1][0] for t in trees.values()])
    number = {g: i for i, g in enumerate(trees)}
    for r in got:
        assert (r.root, r.back, r.subroot, r.groups) == (over[-1][0], over[-1][0], trees[r.g][-1][0], len(trees))
        assert r.siblings == plain_proof(trees[r.g], r.place) + plain_proof(over, number[r.g])


def test_octopus_is_least():
    """Nothing asked for can be derived, and what is there is enough."""
    rng = random.Random(5)
    for _ in range(300):
        size = rng.randrange(1, 400)
        known = np.array(sorted(rng.sample(range(size), rng.randrange(1, size + 1))))
        have = set(known.tolist())
        n, lacks = size, merkle.missing(known, size)
        for lack in lacks:
            assert not have & set(lack.tolist())
            every = have | set(lack.tolist())
            # Each run that holds a known node is complete, and no other run is touched.
            assert every == {c for p in {x // 3 for x in have} for c in range(3 * p, min(n, 3 * p + 3))}
            have, n = {x // 3 for x in have}, -(-n // 3)
        assert n == 1 and len(lacks) == len(plain_tree(["x"] * size)) - 1
