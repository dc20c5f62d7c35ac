"""Operators that SQL can say: against their oracles over the driver's and over awkward tables."""

import pytest
from .conftest import assert_oracle, folder, rows_of
from pyspark.sql import functions as F

from tallybridge.llm import chat, hosts, lines, mixing, quality

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_line_dedup", "op6_source_mix"])
def test_documents(spark, awkward, nothing, name):
    assert_oracle(spark, name, SF)
    _, rows = assert_oracle(spark, name, awkward)
    assert len(rows) == spark.read.parquet(f"{awkward}/documents.parquet").count()
    assert rows_of(spark, name, nothing)[1] == []


@pytest.mark.parametrize("name", ["op3_chat_formatting", "op9_url_filters"])
def test_other_tables(spark, name):
    assert_oracle(spark, name, SF)


def plain_repeats(words):
    where = {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({i + k for starts in where.values() if len(starts) > 1 for i in starts for k in range(5)})


def test_repeat_words(spark):
    texts = ["a b c d e f a b c d e g", "a a a a a a", "a a a a a", "a b c d", "a b c d e a b c d e", "p q r s t u v p q r s t u v p q r s t u v", ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.measured(frame, [F.col("doc_id")]).collect()}
    assert got == {i: plain_repeats(t.split()) for i, t in enumerate(texts)}


def test_quality_keeps_rows_whole(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    verdicts = {r.doc_id for r in quality.judged(docs, [F.col("doc_id")]).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == verdicts
    assert 5 in verdicts and not verdicts & {1, 2, 3, 10, 22}
    assert [r.doc_id for r in kept.collect()].count(5) == 2


def test_line_dedup_keeps_content(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    done = {r.doc_id: r for r in lines.deduplicated(docs).filter("source = 'd'").collect()}
    assert "Subscribe" not in done[17].text and "Subscribe" not in done[18].text and done[19].text.count("\n") == 0
    # Nothing but boilerplate: a copy, not a page with boilerplate round it.
    assert done[20].text == "Subscribe to the newsletter of this site"
    assert lines.deduplicated(docs).columns == docs.columns


def test_mix_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 5)], "_source string, source_size long")
    got = {r._source: r.target for r in mixing.targets(sizes).collect()}
    # Weights 3, 1, 2, 3: a, b and null are clamped, c takes what is left.
    assert got == {"a": 200.0, "b": 20.0, None: 10.0, "c": 1115 * 1.5 - 230}


def test_mix_near_targets(spark):
    sf = "/root/testdata/sf0.01"
    done = mixing.mixed(spark.read.parquet(f"{sf}/documents.parquet"))
    again = mixing.mixed(spark.read.parquet(f"{sf}/documents.parquet"))
    assert done.exceptAll(again).isEmpty()
    assert done.filter("taken > 2 * size").isEmpty()
    for r in done.groupBy("target", "source_size").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= r.most / 2


def test_mixed_documents(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    taken = {(r.doc_id, r.size): r.taken for r in mixing.mixed(docs).collect()}
    copies = mixing.mixed_documents(docs).groupBy("doc_id", mixing.size_of(F.col("text")).alias("words")).count().collect()
    own = docs.groupBy("doc_id", mixing.size_of(F.col("text")).alias("words")).count().collect()
    rows = {(r.doc_id, r.words): r["count"] for r in own}
    for r in copies:
        assert r["count"] * r.words == taken[r.doc_id, r.words] * rows[r.doc_id, r.words]
    assert mixing.mixed_documents(docs).columns == docs.columns


CHAT = "conv_id long, turn long, role string, text string, formatted string"


def test_chat_awkward(spark, tmp_path):
    marks = [chat.OPEN, chat.BODY, chat.NEXT, chat.CLOSE, "</s>", "[INST]", "<<SYS>>", "<|endoftext|>"]
    rows = [
        (1, 0, "user", "a", "x"), (1, 1, "user", "b", "x"), (1, 2, "assistant", "c\\!d", "x"), (1, 3, "assistant", "", "x"), (1, 4, "user", None, "x"),
        (2, None, None, "no role", "x"), (2, None, "tool<|im_sep|>", "<" + chat.CLOSE + "\\", "x"), (2, 5, "assistant", "".join(marks) * 2, "x"),
        (3, 1, "assistant", "same", "x"), (3, 1, "assistant", "same", "x"), (None, 1, "user", "q", "x"), (4, 1, "assistant", "long " * 50_000, "x"),
        *((5, i, "assistant" if i % 3 else "user", "<s" + ">" * (i % 4) + "\\" * (i % 3), "x") for i in range(60)),
    ]
    path = folder(spark, tmp_path, conversations=(rows, CHAT))
    assert_oracle(spark, "op3_chat_formatting", path)
    done = {r.conv_id: r for r in chat.formatted(spark.read.parquet(f"{path}/conversations.parquet")).collect()}
    one = done[1]
    assert one.formatted.count(chat.OPEN) == 3 and one.formatted.count(chat.NEXT) == 2
    # No control string but the template's own, whatever the texts say.
    for r in done.values():
        assert not any(m in r.formatted for m in ("</s>", "[INST]", "<<SYS>>", "<|endoftext|>"))
        assert r.formatted.count(chat.OPEN) == r.formatted.count(chat.CLOSE) == r.formatted.count(chat.BODY)
        assert "".join(s.text for s in r.segments) == r.formatted


def test_chat_empty(spark, tmp_path):
    path = folder(spark, tmp_path, conversations=([], CHAT))
    assert [r[0] for r in rows_of(spark, "op3_chat_formatting", path)[1]] == [-1]


PAGES, LABELS = "page_id long, url string, html string, host string", "doc_id long, quality int, toxic int"


def test_hosts_awkward(spark, tmp_path):
    urls = [
        None, "", "no scheme", "http://", "http://a.com", "http://A.com/", "http://example.com/en/1", "http://www.example.com/en/2", "http://x.www.example.com/en/3",
        "http://notexample.com/en/4", "https://u@shop.net:80/es/5?x=1", "ftp://net/fr/6#y", "http://a.net/de/7", "a://b://c/8", "http://h.co.uk/9", "http://h.co.uk/9",
        "http://É.com/x", "http://com", "http://x.org?q=/12", "http://.../", "http://bad.org/" + "z" * 20_000 + "/99999999999999999999",
    ]
    urls += [f"http://bad.org/{100 + i}" for i in range(60)] + [f"http://good.org/{300 + i}" for i in range(60)]
    labels = [(100 + i, 0, 0) for i in range(50)] + [(300 + i, 1, 0) for i in range(50)] + [(7, None, None), (None, 0, 1), (8, 1, 1), (8, 1, 0), (9, 0, None)]
    path = folder(spark, tmp_path, pages=([(i, u, None, "x") for i, u in enumerate(urls)], PAGES), labels=(labels, LABELS))
    order, rows = assert_oracle(spark, "op9_url_filters", path)
    got = {r[order.index("page_id")]: dict(zip(order, r)) for r in rows}
    at = {u: got[i] for i, u in enumerate(urls)}
    assert at["http://example.com/en/1"]["rule"] == "example.com/en/" and at["http://x.www.example.com/en/3"]["verdict"] == "allow"
    assert at["http://notexample.com/en/4"]["rule"] == "com/" and at["http://com"]["rule"] is None and at["http://a.com"]["rule"] is None
    assert at["http://bad.org/155"]["verdict"] == "block" and at["http://good.org/355"]["verdict"] == "allow"
    assert at["a://b://c/8"] == {"page_id": 13, "host": "b:", "path": "//c/8", "rule": None, "verdict": at["a://b://c/8"]["verdict"]}


def test_hosts_without_labels(spark, tmp_path):
    path = folder(spark, tmp_path, pages=([(1, "http://a.org/1", None, "x")], PAGES), labels=([], LABELS))
    assert rows_of(spark, "op9_url_filters", path)[1] == [("a.org", 1, "/1", None, "allow")]
    none = folder(spark, tmp_path / "none", pages=([], PAGES), labels=([], LABELS))
    assert rows_of(spark, "op9_url_filters", none)[1] == []


def test_hosts_are_column_expressions(spark):
    plan = hosts.judged(
        spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), spark.createDataFrame(list(hosts.RULES), "rule string, action string")
    )._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


