"""The pipeline against a plain version of all five stages over the same documents."""

import hashlib
import re

import corpus_pipeline
import pytest

from tallybridge.llm import lines, mixing, quality

from .test_free_operators import check_pieces, classes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passes(text):
    words = WORD.findall(text or "")
    worded = [x for x in (text or "").split("\n") if WORD.search(x)]
    where = {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = len({i + k for at in where.values() if len(at) > 1 for i in at for k in range(5)})
    n = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(worded) - len(set(worded)), "n_lines": len(worded), "n_exclamations": (text or "").count("!"),
        "n_capitals": sum(c.isupper() and c != c.lower() for c in text or ""), "n_stop_words": sum(w in quality.STOP_WORDS for w in words),
        "n_stutter": sum(a == b for a, b in zip(words, words[1:])),
    }
    if len(words) < 10 or 100 * repeated > 20 * len(words):
        return False
    for r in quality.RULES:
        ratio, whole = 1000 * n[r.part], n[r.whole]
        if len(words) >= r.words and ((r.low is not None and ratio < r.low * whole) or (r.high is not None and ratio > r.high * whole)):
            return False
    return True


def without_boilerplate(docs):
    pages, holding = {}, {}
    for d in docs:
        pages[d["source"]] = pages.get(d["source"], 0) + 1
        for x in {x for x in d["text"].split("\n") if WORD.search(x)}:
            holding[d["source"], x] = holding.get((d["source"], x), 0) + 1
    out = []
    for d in docs:
        def often(x, s=d["source"]):
            return WORD.search(x) and holding[s, x] >= lines.LEAST_PAGES and holding[s, x] > lines.RATIO * pages[s]

        kept = [x for x in d["text"].split("\n") if not often(x)]
        out.append(d | {"text": "\n".join(kept)} if any(WORD.search(x) for x in kept) else d)
    return out


def five_words(text):
    """The distinct runs of five words, A-Z in lower case; all words where there are fewer."""
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def one_of_each(docs):
    """The first document of each group of texts that are 0.8 or more alike, directly or through others."""
    sets = [five_words(d["text"]) for d in docs]
    alike = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or (min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and 5 * len(a & b) >= 4 * len(a | b))]
    first = {}
    for d, g in zip(docs, classes(len(docs), alike)):
        if g not in first or d["doc_id"] < first[g]["doc_id"]:
            first[g] = d
    return list(first.values())


def mix(docs):
    size = {d["doc_id"]: len(WORD.findall(d["text"])) for d in docs}
    names = sorted({d["source"] for d in docs}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[d["doc_id"]] for d in docs if d["source"] == s) for s in names}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    clamped, wanted = set(), mixing.SHARE * sum(total.values())
    while True:
        rest = wanted - sum(2 * total[s] for s in clamped)
        free = sum(weight[s] for s in names if s not in clamped)
        over = {s for s in names if s not in clamped and weight[s] * rest >= 2 * total[s] * free}
        if not over:
            break
        clamped |= over
    out = []
    for s in names:
        target = 2 * total[s] if s in clamped else weight[s] * rest / free
        whole = int(target // total[s]) if total[s] else 0
        need, at = target - whole * total[s], 0
        own = sorted((hashlib.md5(f"{mixing.SEED}{d['doc_id']}".encode()).hexdigest(), d["doc_id"], d) for d in docs if d["source"] == s)
        for _, doc, d in own:
            at += size[doc]
            out += [d] * (whole + (need > 0 and at - size[doc] / 2 <= need))
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage keeps, from the driver's smallest documents."""
    sf, folder = "/root/testdata/sf0.001", tmp_path_factory.mktemp("stages")
    found = [spark.read.parquet(f"{sf}/documents.parquet")]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, found[-1], sf).write.parquet(f"{folder}/{number}")
        found.append(spark.read.parquet(f"{folder}/{number}"))
    return found


def rows(frame):
    return sorted((r.asDict() for r in frame.collect()), key=lambda d: (d["doc_id"], d["text"]))


def ordered(docs):
    return sorted(docs, key=lambda d: (d["doc_id"], d["text"]))


def test_stages(stages):
    docs = [r.asDict() for r in stages[0].collect()]
    columns = stages[0].columns
    for number, plain in enumerate([lambda d: [x for x in d if passes(x["text"])], without_boilerplate, one_of_each, mix], 1):
        docs = plain(docs)
        assert stages[number].columns == columns
        assert rows(stages[number]) == ordered(docs), corpus_pipeline.STAGES[number - 1][0]
    check_pieces(stages[5].collect(), [(d["doc_id"], d["text"], None) for d in docs])


def test_run(spark, stages):
    done = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert done.columns == stages[5].columns
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(done.select("doc_id", "doc_tokens").distinct().collect()) == sorted(stages[5].select("doc_id", "doc_tokens").distinct().collect())
    assert set(key) <= set(done.columns)


def test_empty_and_awkward_documents(spark, awkward, nothing):
    for sf_dir in (awkward, nothing):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        whole = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert docs.columns == whole or name == "curve packing"
        assert docs.isEmpty() == (sf_dir == nothing)
