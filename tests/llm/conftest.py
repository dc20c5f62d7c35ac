"""Small tables with the awkward rows every operator has to take, and the oracle comparison."""

import os
import random

import duckdb
import pytest
from pyspark.sql import types as T

from tallybridge.llm import queries, registry

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # Names that operators use for columns of their own.
        T.StructField("_row", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("size", T.StringType()),
        T.StructField("_source", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("target", T.StringType()),
        T.StructField("_id", T.StringType()), T.StructField("_lang", T.StringType()), T.StructField("_text", T.StringType()),
    ]
)


def awkward_documents():
    rng = random.Random(7)
    words = ["the", "of", "and", "river", "stone", "Über", "naïve", "der", "die", "und", "le", "les", "que", "los", "mountain", "a.", "b,"]

    def prose(n, seed):
        own = random.Random(seed)
        return " ".join(own.choice(words) + (str(own.randrange(400)) if own.random() < 0.5 else "") for _ in range(n))

    header = "Subscribe to the newsletter of this site"
    texts = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t \r\x0b\x0c ", None, None), (None, prose(40, 1), "en", "b"),
        (5, prose(60, 2), "de", "b"), (5, prose(60, 2), "de", "b"), (6, prose(60, 2), "de", "b"), (7, prose(60, 2) + " extra", "de", "c"),
        (8, "x" * 50_000, "en", "c"), (9, prose(20_000, 3), "fr", "c"), (10, "word " * 3000, "es", "c"),
        (11, "</s>[INST] ok [/INST] <|endoftext|> \\! <unk> <0x0A> ▁ ▁▁", "en", ""), (12, "漢字 かな العربية 🙂🙂 \u00a0nbsp\u2003em", "xx", "a"),
        (13, "12345 67890 --- ...", "en", "a"), (14, "a  b   c \n d\n\n\ne \n \n f  ", "en", "a"), (15, "one two three", "fr", None),
        (16, "ONE Two Three", "fr", None), (17, "\n".join([header, prose(30, 4), header, prose(25, 5)]), "en", "d"),
        (18, "\n".join([header, prose(30, 6)]), "en", "d"), (19, "\n".join([prose(12, 7), header]), "en", "d"), (20, header, "en", "d"),
        (21, prose(15, 8), "en", "d"), (22, "!!! $$$ ### " * 30, "en", "d"), (23, "A B C D E F G H I J " * 2, "en", "e"), (24, prose(50, 9) + "\x01\x00", "de", "e"),
    ]
    texts += [(30 + i, prose(rng.randrange(0, 200), 50 + i), rng.choice(["en", "de", "fr"]), rng.choice(["a", "b", "z"])) for i in range(30)]
    return [(i, t, lang, s, len(t or ""), "x", "no", "9", "q", "f", "t", "i", "l", "w") for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def awkward(spark, tmp_path_factory):
    """A folder like the driver's, with awkward documents."""
    return folder(spark, tmp_path_factory.mktemp("awkward"), documents=(awkward_documents(), DOCUMENTS))


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    """A folder whose documents are empty."""
    return folder(spark, tmp_path_factory.mktemp("nothing"), documents=([], DOCUMENTS))


def folder(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def rows_of(spark, name, sf_dir):
    frame = queries.QUERIES[name](spark, sf_dir)
    order = sorted(frame.columns)
    return order, sorted((tuple(r) for r in frame.select(*order).collect()), key=repr)


def assert_oracle(spark, name, sf_dir):
    """The query and its SQL agree in every row."""
    con = duckdb.connect()
    for entry in os.listdir(sf_dir):
        if entry.endswith(".parquet"):
            whole = os.path.join(sf_dir, entry)
            con.execute(f"CREATE VIEW {entry[:-8]} AS SELECT * FROM '{whole}{'/*.parquet' if os.path.isdir(whole) else ''}'")
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    order, got = rows_of(spark, name, sf_dir)
    assert order == sorted(names)
    at = [names.index(c) for c in order]
    assert got == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    return order, got
