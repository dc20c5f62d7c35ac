"""Language identification by segmentation-marginalised unigrams.

A language is a probability for every piece of a fixed public vocabulary (plus one for any
character the vocabulary lacks). A word's probability is the sum over all ways to cut it into
pieces, worked out by a forward pass; a text's is the product over its words. The predicted
language has the highest; the score is its share among all languages, taken as equally likely.

Fitting is expectation maximisation: forward-backward passes give each piece's expected count
over all segmentations. It uses the whole texts of at most ``rows`` labelled documents per
language (those first by a hash of their id), a documented bound; expected counts are summed by
Spark, and only one number per piece and language reaches the driver.

Words are runs of letters, lower-cased; a word longer than ``LONGEST`` characters is scored in
stretches of that length, so no product underflows. A worker remembers words' scores.

Edge cases. A null text, or one without a letter, is ``und`` with score 0, and so is everything
if there is no labelled row. Null languages are not learned. A null id counts as not held out.
Ties go to the first language by code point. Repeated rows are predicted like any row.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .registry import query, table

ROWS = 500
ROUNDS = 3
# Parts of a language among which its first documents are chosen.
PARTS = 256
SMOOTHING = 0.05
LONGEST = 32
REMEMBERED = 300_000
MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")


class Pieces:
    """The vocabulary: number 0 is no piece, ``size - 1`` any character it lacks."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.number = {model.id_to_piece(i): n for n, i in enumerate(kept, 1)}
        self.size = len(kept) + 2
        self.widest = max(map(len, self.number), default=1)

    def lattice(self, words: list[str]) -> np.ndarray:
        """For words of one length: the piece at (word, start, length - 1), 0 for none."""
        n = len(words[0])
        widest = min(n, self.widest)
        get, other = self.number.get, self.size - 1
        found = np.zeros((len(words), n, widest), dtype=np.int32)
        for w, word in enumerate(words):
            found[w] = [[get(word[i : i + k], 0) if i + k <= n else 0 for k in range(1, widest + 1)] for i in range(n)]
        single = found[:, :, 0]
        single[single == 0] = other
        return found


_PIECES: dict[str, Pieces] = {}


def pieces_at(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def forward(lattice: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """alpha[word, end, language]: the probability of the first ``end`` characters, all cuts summed."""
    words, n, widest = lattice.shape
    alpha = np.zeros((words, n + 1, chance.shape[1]))
    alpha[:, 0] = 1.0
    for end in range(1, n + 1):
        for k in range(1, min(widest, end) + 1):
            alpha[:, end] += alpha[:, end - k] * chance[lattice[:, end - k, k - 1]]
    return alpha


def expected(lattice: np.ndarray, chance: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in one language, words weighted by ``times``."""
    words, n, widest = lattice.shape
    alpha = forward(lattice, chance[:, None])[:, :, 0]
    beta = np.zeros((words, n + 1))
    beta[:, n] = 1.0
    total = np.zeros(len(chance))
    for start in range(n - 1, -1, -1):
        for k in range(1, min(widest, n - start) + 1):
            beta[:, start] += chance[lattice[:, start, k - 1]] * beta[:, start + k]
    weight = times / alpha[:, n]
    for start in range(n):
        for k in range(1, min(widest, n - start) + 1):
            piece = lattice[:, start, k - 1]
            use = weight * alpha[:, start] * chance[piece] * beta[:, start + k]
            total += np.bincount(piece, weights=use, minlength=len(chance))
    return total


def stretches(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word), LONGEST)]


def by_length(words) -> list[list[str]]:
    groups: dict[int, list[str]] = {}
    for word in words:
        groups.setdefault(len(word), []).append(word)
    return list(groups.values())


class Model(NamedTuple):
    """``chance[piece, language]``; row 0 is zero."""

    path: str
    languages: tuple[str, ...]
    chance: np.ndarray


class Scorer:
    """Log probabilities of words under every language, kept for words seen before."""

    def __init__(self, model: Model, entries: int = REMEMBERED):
        self.model, self.entries = model, entries
        self.pieces = pieces_at(model.path)
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.languages)))

    def learn(self, words: set[str]) -> None:
        unseen = words.difference(self.place)
        if len(self.place) + len(unseen) > self.entries:
            self.place.clear()
            unseen = words
        parts = {MARK + w: stretches(MARK + w) for w in unseen}
        value: dict[str, np.ndarray] = {}
        for group in by_length({p for ps in parts.values() for p in ps}):
            for at in range(0, len(group), 4096):
                some = group[at : at + 4096]
                last = forward(self.pieces.lattice(some), self.model.chance)[:, -1]
                value.update(zip(some, np.log(last)))
        need = len(self.place) + len(unseen)
        if need > len(self.table):
            grown = np.zeros((2 * need, self.table.shape[1]))
            grown[: len(self.table)] = self.table
            self.table = grown
        for marked, own in parts.items():
            at = self.place[marked[1:]] = len(self.place)
            self.table[at] = value[own[0]] if len(own) == 1 else sum(value[p] for p in own)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [LETTERS.findall((t or "").lower()) for t in texts]
        self.learn(set().union(*found))
        out = []
        for words in found:
            if not any(c.isalpha() for w in words for c in w):
                out.append(("und", 0.0))
                continue
            at = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
            logs = self.table[at].sum(axis=0)
            best = int(np.argmax(logs))
            out.append((self.model.languages[best], float(1.0 / np.exp(logs - logs[best]).sum())))
        return out


_SCORERS: dict[str, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    """One scorer and its memory per worker process and model."""
    name = hashlib.sha256(model.chance.tobytes() + repr(model[:2]).encode()).hexdigest()
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(model)
    return _SCORERS[name]


def held_out(ids: Column) -> Column:
    return F.coalesce(F.crc32(ids.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, path: str, ids: str, text: str, lang: str, rows: int = ROWS, rounds: int = ROUNDS) -> Model:
    """The model of the languages of ``docs`` (rows to learn from; null languages are passed over)."""
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    # Renamed first: docs may have columns of these names.
    named = docs.select(F.col(ids).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    named = named.filter(F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    # Chosen on narrow rows, first within parts of a language and then among what these leave, so that
    # no task takes rows from every partition of a large language. Spark limits before each shuffle.
    narrow = named.select("_id", "_lang").withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(PARTS)))
    within = Window.partitionBy("_lang", "_part").orderBy(F.xxhash64("_id"), "_id")
    few = narrow.withColumn("_n", F.row_number().over(within)).filter(F.col("_n") <= rows)
    chosen = few.select("_id", "_lang").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= rows)
    keys = chosen.select("_id", "_lang").distinct().toDF("_key", "_own")
    sample = named.join(keys, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_lang") == F.col("_own")), "left_semi")
    sample = sample.select(F.col("_lang").alias("lang"), F.col("_text").alias("text"))

    def words(batches):
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}
            for own, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in LETTERS.findall(whole.lower()):
                    for part in stretches(MARK + word):
                        counts[own, part] = counts.get((own, part), 0) + 1
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts]), pa.array(list(counts.values()), pa.int64())],
                    names=["lang", "word", "n"],
                )

    seen = settle(sample.mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = tuple(r[0] for r in seen.select("lang").distinct().orderBy("lang").collect())
    size = pieces_at(path).size
    chance = np.full((size, len(languages)), 1.0 / (size - 1))
    chance[0] = 0.0
    for _ in range(rounds if languages else 0):
        now = chance

        def uses(batches):
            pieces, total = pieces_at(path), np.zeros_like(now)
            for batch in batches:
                rows_ = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
                for k, own in enumerate(languages):
                    times = {word: n for lang_, word, n in rows_ if lang_ == own}
                    for group in by_length(times):
                        for at in range(0, len(group), 4096):
                            some = group[at : at + 4096]
                            total[:, k] += expected(pieces.lattice(some), now[:, k], np.array([times[w] for w in some], dtype=float))
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(k), pa.array(total[piece, k])], names=["piece", "k", "uses"])

        # At most one row per piece and language.
        summed = seen.mapInArrow(uses, "piece long, k long, uses double").groupBy("piece", "k").agg(F.sum("uses").alias("uses")).toArrow()
        chance = np.full_like(now, SMOOTHING)
        chance[summed["piece"].to_numpy(), summed["k"].to_numpy()] += summed["uses"].to_numpy()
        chance[0] = 0.0
        chance /= chance.sum(axis=0)
    return Model(path, languages, chance)


def predicted(model: Model, text: str = "text") -> Column:
    """A struct column ``lang_pred``, ``score`` of the text."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def each(column: pa.Array) -> pa.Array:
        rows: list[tuple[str, float]] = []
        scorer = _scorer(model) if model.languages else None
        for at in range(0, len(column), 256):
            texts = column.slice(at, 256).to_pylist()
            rows += scorer.predict(texts) if scorer else [("und", 0.0)] * len(texts)
        return pa.array([{"lang_pred": a, "score": b} for a, b in rows], kind)

    each.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, "lang_pred string, score double")(F.col(text))


def identified(docs: DataFrame, path: str, ids: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score``, one row per row."""
    model = fit(docs.filter(~held_out(F.col(ids))), path, ids, text, lang, rows)
    done = docs.select(F.col(ids).alias("doc_id"), held_out(F.col(ids)).alias("held_out"), predicted(model, text).alias("_p"))
    return done.select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    """Every document with its predicted language."""
    return identified(table(spark, sf_dir, "documents"), vocabulary())
