"""Phrase collocations by dynamic itemset counting.

Texts are dealt to ``SHARDS`` shards, which are scanned one after the other, round and round. Words are
counted from the first scan on. A longer phrase becomes active once both phrases it is made of (without
its last and without its first word) have been met ``least`` times, is counted from the next scan on
together with all that is active by then, whatever the lengths, and is complete after one full cycle
of its own. Scanning ends when nothing is active: after three cycles at most, and earlier where no
phrase became active late.

- Dealing turns texts into blocks of words as numbers, each block with the hashes and names of its
  words, so texts are taken apart once. A phrase is the 64-bit hashes of its words from then on; names
  come back at the end, and should two words that are met often share a hash, all is done anew
  with another salt.
- A scan counts in its map tasks and gives one row per phrase and block. Which phrases are active is
  told by Bloom filters, one per length and per step at which phrases reached the count; they have
  no false negatives, and their size is bounded (``MOST_BITS``). What they let through wrongly
  costs time only: a phrase with a part below the count is itself below it.
- Counts are kept per shard, so a shard scanned twice for a phrase is not counted twice. Rows that
  are complete are put aside, those below the count dropped; only open ones are shuffled again.
- Scores and cuts come from joins of the finished counts, all in whole numbers.

Edge cases. Null and empty texts hold no words; a null language is ``und``. A word may be as long as
its text. A text longer than a block is continued in the next: a phrase across the border counts once.
Repeated rows count as often as they stand there. Ties go to the phrase that is first in bytes. An
empty table, and one without a phrase met often enough, give no rows. Only the two columns named
are read, and renamed at once, so others cannot clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import count as count_from
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from xxhash import xxh64_intdigest

from ..session import shared_dir
from .registry import query, table
from .shared import removed, slices, stored

SHARDS = 3
LEAST = 10
LONGEST = 3
TOP = 2000
MILLION = 1_000_000
# A phrase goes if a longer one has this share of its places, in hundredths.
COVERED = 50
# A filter has BITS bits an entry, 2 ** MOST_BITS at most (16 MB); an entry sets up to four of one word.
BITS, MOST_BITS = 16, 27
# Words from which a block is full, bytes of text that are words at a time (half as many words at
# most), and the bits of a word's number: three fit into one of 64.
BLOCK, BYTES, PLACE = 1_500_000, 1 << 20, 21
MASK = (1 << PLACE) - 1

_END = b"\xff"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + _END * 10 + b" ")


class Filter:
    """A Bloom filter over 64-bit hashes, in words of 64 bits: an entry's bits lie in one word."""

    def __init__(self, bits: int):
        self.words = np.zeros(1 << (bits - 6), np.uint64)

    @staticmethod
    def bits_for(entries: int) -> int:
        return min(MOST_BITS, max(10, (BITS * entries - 1).bit_length()))

    @staticmethod
    def places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """The word and the bits of each hash, in a filter of so many words."""
        bits = np.zeros(len(hashes), np.uint64)
        for shift in (0, 6, 12, 18):
            bits |= np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
        return (hashes >> np.uint64(24)) & np.uint64(words - 1), bits

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        spots, bits = self.places(hashes, len(self.words))
        return self.words[spots] & bits == bits


def word_hash(word: bytes, salt: int) -> int:
    """Never 0, which stands for no word."""
    return xxh64_intdigest(word, salt) or 1


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = a * np.uint64(0x9E3779B97F4A7C15) + b
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


def _reached(filters: dict[int, Filter], hashes: np.ndarray) -> np.ndarray:
    """The step at which each hash's phrase reached the count, the last that may be; -1 for none."""
    found = np.full(len(hashes), -1, np.int64)
    for step in sorted(filters):
        found[filters[step].holds(hashes)] = step
    return found


class Numbers(dict):
    """Numbers of words in the order in which they come; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


class Block(NamedTuple):
    """Words of one language by number. Phrases that start within ``own`` are this block's."""

    own: int
    ids: np.ndarray
    words: list[bytes]


class Dealer:
    """Turns the texts of one language into blocks."""

    def __init__(self):
        self.numbers, self.parts, self.held = Numbers(), [], 0

    def _take(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        self.held += len(words)

    def block(self, later: int = 0) -> Block:
        """What is held, of which the last ``later`` words belong to the next block."""
        found = Block(self.held - later, np.concatenate(self.parts), list(self.numbers))
        self.__init__()
        return found

    def add(self, text: bytes) -> Iterator[Block]:
        """A text's words, from stretches that end at a blank; blocks that are full on the way."""
        text, at, tail = text.translate(_PLAIN).replace(_END, b" " + _END + b" "), 0, []
        while at < len(text):
            end = text.find(b" ", at + BYTES)
            end = len(text) if end < 0 else end
            words = text[at:end].split()
            self._take(words)
            tail, at = (tail + words[1 - LONGEST :])[1 - LONGEST :], end
            if self.held >= BLOCK:
                # The next block begins with words that this one needs as well.
                yield self.block(later=len(tail))
                self._take(tail)
        self._take([_END])


_BLOCKS = pa.schema([
    ("shard", pa.int32()), ("lang", pa.string()), ("own", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("hashes", pa.binary()), ("names", pa.list_(pa.string())),
])
_BLOCKS_SQL = "shard int, lang string, own bigint, n bigint, ids binary, hashes binary, names array<string>"


def dealt(docs: DataFrame, shards: int, salt: int) -> DataFrame:
    """Blocks of the texts (``lang``, ``text`` as bytes), dealt to shards in turn."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealers: dict[str, Dealer] = {}
        turn = count_from(TaskContext.get().partitionId())

        def row(lang: str, block: Block) -> pa.RecordBatch:
            salted = xxh64_intdigest(lang.encode(), salt)
            hashes = np.fromiter((word_hash(w, salted) for w in block.words), np.uint64, len(block.words))
            hashes[0] = 0
            # The first is the end of a piece and has no name.
            names = pa.array(block.words[1:], pa.binary()).view(pa.string())
            names = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
            words = int(np.count_nonzero(block.ids[: block.own]))
            values = [next(turn) % shards], [lang], [block.own], [words], [block.ids.astype("<u4").tobytes()], [hashes.astype("<u8").tobytes()]
            return pa.record_batch([*(pa.array(v, t) for v, t in zip(values, _BLOCKS.types)), names], schema=_BLOCKS)

        for part in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                dealer = dealers.get(lang) or dealers.setdefault(lang, Dealer())
                for block in dealer.add(text):
                    yield row(lang, block)
            # All languages together hold one block and one short slice of rows.
            while sum(d.held for d in dealers.values()) >= BLOCK:
                fullest = max(dealers, key=lambda x: dealers[x].held)
                yield row(fullest, dealers[fullest].block())
        for lang, dealer in dealers.items():
            if dealer.held:
                yield row(lang, dealer.block())

    return docs.mapInArrow(deal, _BLOCKS_SQL)


def counted(block: Block, hashes: np.ndarray, step: int, filters: dict[int, dict[int, Filter]], shards: int) -> Iterator[tuple]:
    """Counts of a block's phrases that are active at ``step``: hashes of the words, count, last step."""
    ids, own = block.ids, block.own
    if step < shards:
        seen = np.bincount(ids[:own], minlength=len(hashes))
        seen[0] = 0
        some = np.flatnonzero(seen)
        yield (hashes[some],), seen[some], np.full(len(some), shards - 1)
    if 1 not in filters:
        return
    since = _reached(filters[1], hashes)
    since[0] = -1
    a, b = ids[:-1], ids[1:]
    near = np.minimum(since[a], since[b]) >= 0
    active = near & (np.maximum(since[a], since[b]) + shards >= step)
    active[own:] = False
    keys, counts = np.unique(a[active] << PLACE | b[active], return_counts=True)
    x, y = keys >> PLACE, keys & MASK
    yield (hashes[x], hashes[y]), counts, np.maximum(since[x], since[y]) + shards
    if 2 not in filters:
        return
    pairs = np.full(len(a), -1, np.int64)
    spots = np.flatnonzero(near)
    pairs[spots] = _reached(filters[2], pair_hash(hashes[a[spots]], hashes[b[spots]]))
    first, second = pairs[:-1], pairs[1:]
    active = (np.minimum(first, second) >= 0) & (np.maximum(first, second) + shards >= step)
    active[own:] = False
    spots = np.flatnonzero(active)
    keys, at, counts = np.unique(ids[spots] << (2 * PLACE) | ids[spots + 1] << PLACE | ids[spots + 2], return_index=True, return_counts=True)
    until = np.maximum(first[spots[at]], second[spots[at]]) + shards
    yield (hashes[keys >> (2 * PLACE)], hashes[keys >> PLACE & MASK], hashes[keys & MASK]), counts, until


_KEY = ["a", "b", "c"]
_SCANNED = pa.schema([*((k, pa.int64()) for k in _KEY), ("fresh", pa.int64()), ("until", pa.int32())])
_SCANNED_SQL = "a bigint, b bigint, c bigint, fresh bigint, until int"


def scanned(blocks: DataFrame, step: int, filters: dict[int, dict[int, Filter]], shards: int) -> DataFrame:
    """A row per phrase active at ``step`` and block: ``a``, ``b``, ``c`` (hashes of its words, 0 for none), its count and last step."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            own, ids, hashes = (part.column(i)[0] for i in range(3))
            block = Block(own.as_py(), np.frombuffer(ids.as_buffer(), "<u4").astype(np.int64), [])
            for words, counts, until in counted(block, np.frombuffer(hashes.as_buffer(), "<u8"), step, filters, shards):
                none = np.zeros(len(counts), np.int64)
                key = [w.view(np.int64) for w in words] + [none] * (len(_KEY) - len(words))
                columns = [pa.array(x, t) for x, t in zip([*key, counts, until], _SCANNED.types)]
                yield from pa.Table.from_arrays(columns, schema=_SCANNED).to_batches(max_chunksize=1 << 16)

    return blocks.select("own", "ids", "hashes").mapInArrow(scan, _SCANNED_SQL)


def filter_of(phrases: DataFrame, words: int, entries: int) -> Filter:
    """A filter of the rows' phrases: their bits, put together word by word."""
    made = Filter(Filter.bits_for(entries))
    size = len(made.words)

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [batch.column(i).to_numpy().view(np.uint64) for i in range(words)]
            spots, bits = Filter.places(hashes[0] if words == 1 else pair_hash(*hashes), size)
            yield pa.record_batch({"spot": pa.array(spots.astype(np.int64)), "bits": pa.array(bits.view(np.int64))})

    rows = phrases.select(*_KEY[:words]).mapInArrow(places, "spot bigint, bits bigint")
    # At most 2 ** (MOST_BITS - 6) rows, whatever the table.
    whole = rows.groupBy("spot").agg(F.bit_or("bits").alias("bits")).toArrow()
    made.words[whole["spot"].to_numpy()] = whole["bits"].to_numpy().view(np.uint64)
    return made


def _length() -> Column:
    return F.when(F.col("c") != 0, 3).when(F.col("b") != 0, 2).otherwise(1)


def _cycles(spark: SparkSession, place: str, states: str, least: int, shards: int) -> DataFrame:
    """Scans the blocks until nothing is active: ``a``, ``b``, ``c`` and ``f`` of every phrase met often enough.

    A phrase's state: ``n`` (its count so far), ``seen`` (a bit for each shard in it) and ``until``, its last step.
    """
    columns = {**dict.fromkeys(_KEY, "bigint"), "until": "int", "n": "bigint", "seen": "bigint"}
    kept = ", ".join(f"{name} {kind}" for name, kind in (columns | {"step": "int", "open": "int", "new": "boolean"}).items())
    filters: dict[int, dict[int, Filter]] = {}
    step, last = 0, shards - 1
    while step <= last:
        shard = step % shards
        blocks = spark.read.schema(_BLOCKS_SQL).parquet(place).filter(F.col("shard") == shard)
        none = F.lit(None).cast("bigint")
        rows = scanned(blocks, step, filters, shards).withColumns({"n": none, "seen": none})
        if step:
            before = spark.read.schema(kept).parquet(states).filter((F.col("step") == step - 1) & (F.col("open") == 1))
            rows = rows.unionByName(before.select(*columns).withColumn("fresh", none))
        now = rows.groupBy(*_KEY).agg(
            F.max("until").alias("until"), F.sum("fresh").alias("fresh"), F.coalesce(F.max("n"), F.lit(0)).alias("before"), F.coalesce(F.max("seen"), F.lit(0)).alias("seen")
        )
        # A shard that was counted before does not count again.
        known = F.col("seen").bitwiseAND(F.lit(1 << shard)) != 0
        now = now.withColumn("n", F.col("before") + F.when(known, F.lit(0)).otherwise(F.coalesce("fresh", F.lit(0))))
        now = now.withColumn("seen", F.when(F.col("fresh").isNull(), F.col("seen")).otherwise(F.col("seen").bitwiseOR(F.lit(1 << shard))))
        now = now.filter((F.col("n") >= least) | (F.col("until") > step))
        now = now.select(*columns, ((F.col("n") >= least) & (F.col("before") < least)).alias("new"), (F.col("until") > step).cast("int").alias("open"))
        now.write.partitionBy("open").parquet(f"{states}/step={step}")
        if step:
            removed(spark, f"{states}/step={step - 1}/open=1")
        reached = spark.read.schema(kept).parquet(states).filter((F.col("step") == step) & F.col("new")).withColumn("words", _length())
        for row in reached.filter(F.col("words") < LONGEST).groupBy("words").count().collect():
            filters.setdefault(row["words"], {})[step] = filter_of(reached.filter(F.col("words") == row["words"]), row["words"], row["count"])
            last = step + shards
        step += 1
    # Should a complete phrase have been let through once more, its earlier row holds more.
    every = spark.read.schema(kept).parquet(states).filter(F.col("n") >= least)
    return every.groupBy(*_KEY).agg(F.max("n").alias("f"))


class Mined(NamedTuple):
    """``counts``: ``a``, ``b``, ``c``, ``f`` of phrases; ``names``: ``h``, ``lang``, ``name`` of words; ``totals``: ``lang``, ``n``."""

    counts: DataFrame
    names: DataFrame
    totals: DataFrame


def mined(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, shards: int = SHARDS, salt: int = 0) -> Mined:
    """Every phrase of up to three words that is met ``least`` times, the words in them, and all words' places by language."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/llm-phrases-{uuid.uuid4().hex}"
    place = f"{folder}/blocks"
    rows = docs.filter(F.col(text).isNotNull()).select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    # Small row groups: a reader holds one, of few blocks, at a time.
    dealt(rows, shards, salt).write.option("parquet.block.size", 1 << 24).partitionBy("shard").parquet(place)
    counts = stored(_cycles(spark, place, f"{folder}/states", least, shards))
    blocks = spark.read.schema(_BLOCKS_SQL).parquet(place)
    totals = stored(blocks.groupBy("lang").agg(F.sum("n").alias("n")))
    words = blocks.select("hashes", "lang", "names").mapInArrow(_named, "h bigint, lang string, name string")
    often = counts.filter("b = 0").select(F.col("a").alias("h"))
    met = words.join(often, "h", "left_semi").groupBy("h").agg(F.min(F.struct("lang", "name")).alias("x"), F.max(F.struct("lang", "name")).alias("y"))
    met = stored(met)
    if not met.filter("x != y").isEmpty():
        removed(spark, folder)
        return mined(docs, text, lang, least, shards, salt + 1)
    removed(spark, folder)
    return Mined(counts, met.select("h", "x.lang", "x.name"), totals)


def _named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1):
        hashes, names = np.frombuffer(part.column(0)[0].as_buffer(), "<i8")[1:], part.column(2)[0].values
        langs = pa.array([part.column(1)[0].as_py()]).take(pa.array(np.zeros(len(hashes), np.int64)))
        whole = pa.table({"h": pa.array(hashes), "lang": langs, "name": names})
        yield from whole.to_batches(max_chunksize=1 << 16)


def phrase_counts(found: Mined) -> DataFrame:
    """``lang``, ``words``, ``phrase``, ``f`` of every phrase met often enough."""
    rows = found.counts.withColumn("words", _length())
    return _with_names(rows, found.names).select("lang", "words", "phrase", "f")


def _with_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``lang`` and ``phrase`` to rows of ``a``, ``b``, ``c``."""
    for key in _KEY:
        own = names.select(F.col("h").alias(key), F.col("name").alias(f"_{key}"), *([F.col("lang")] if key == "a" else []))
        rows = rows.join(own, key, "inner" if key == "a" else "left")
    return rows.withColumn("phrase", F.concat_ws(" ", "_a", "_b", "_c")).drop("_a", "_b", "_c")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exact for counts of up to 10 ** 15."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    return F.call_function("div", a * a * F.lit(MILLION).cast("decimal(7,0)"), left * right)


def scored(counts: DataFrame, covered: int = COVERED) -> DataFrame:
    """Every phrase of two words or more that no longer one covers: ``a``, ``b``, ``c``, ``f``, ``l``, ``r``, ``score``."""
    found = counts.filter("b != 0").select(*_KEY, F.col("f").alias("n"))
    none = F.lit(0).cast("bigint")

    def cut(k: int, *parts: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), *(x.alias(n) for x, n in zip(parts, ("x1", "x2", "y1", "y2"))))

    a, b, c = (F.col(k) for k in _KEY)
    cuts = F.when(c == 0, F.array(cut(1, a, none, b, none))).otherwise(F.array(cut(1, a, none, b, c), cut(2, a, b, c, none)))
    cut_up = found.withColumn("cut", F.explode(cuts)).select(*_KEY, "n", "cut.*")
    parts = counts.filter("c = 0")
    left, right = parts.select(F.col("a").alias("x1"), F.col("b").alias("x2"), F.col("f").alias("l")), parts.select(F.col("a").alias("y1"), F.col("b").alias("y2"), F.col("f").alias("r"))
    met = cut_up.join(left, ["x1", "x2"]).join(right, ["y1", "y2"]).withColumn("score", _score(F.col("n"), F.col("l"), F.col("r")))
    best = met.groupBy(*_KEY, "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    longer = found.filter("c != 0").select(F.explode(F.array(F.struct("a", "b"), F.struct(b.alias("a"), c.alias("b")))).alias("p"), "n")
    most = longer.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.max("n").alias("most")).withColumn("c", none)
    rest = best.join(most, _KEY, "left").filter(F.coalesce(100 * F.col("most") < covered * F.col("n"), F.lit(True)))
    return rest.select(*_KEY, F.col("n").alias("f"), "s.l", "s.r", "s.score")


def collocations(found: Mined, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The first ``top`` collocations of every language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    langs = found.names.select(F.col("h").alias("a"), "lang")
    rows = scored(found.counts, covered).join(langs, "a")
    # Names are looked up for what may be among the first, ties at the end included.
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"))
    first = rows.withColumn("_rank", F.rank().over(order)).filter(F.col("_rank") <= top).drop("_rank", "lang")
    named = _with_names(first, found.names).select("lang", "phrase", F.col("f").alias("a"), "l", "r", "score")
    exact = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(exact).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(found.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query("op12_phrase_mining", rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents WHERE text IS NOT NULL),
worded AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS words, unnest(w) AS phrase FROM worded
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM worded WHERE len(w) > 2),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
f AS (SELECT lang, words, phrase, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT lang, phrase, c, unnest(range(1, words)) AS k, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.c AS a, k, x.c AS l, y.c AS r, {MILLION}::HUGEINT * cuts.c * cuts.c // (x.c::HUGEINT * y.c) AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[:k], ' ') JOIN f AS y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, p, max(c) AS most FROM (
    SELECT lang, c, array_to_string(string_split(phrase, ' ')[:2], ' ') AS p FROM f WHERE words = 3
    UNION ALL SELECT lang, c, array_to_string(string_split(phrase, ' ')[2:], ' ') FROM f WHERE words = 3) GROUP BY lang, p),
ranked AS (
  SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
  FROM best JOIN totals ON totals.lang = best.lang LEFT JOIN longer ON longer.lang = best.lang AND longer.p = phrase
  WHERE most IS NULL OR 100 * most < {COVERED} * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {TOP}""")
def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language."""
    return collocations(mined(table(spark, sf_dir, "documents").select("text", "lang")))
