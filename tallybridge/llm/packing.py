"""Packing documents into sequences along a space-filling curve.

1. A document's words are hashed to random vectors in a few dimensions; their mean is the
   document's place, and the place's position on a Hilbert curve its key. Documents with the same
   words in like shares get near keys.
2. Rows are dealt to ranges of the curve and sorted in them by (key, a hash of the row and its
   position), so a group of equal documents or of repeated rows that holds a third of the table is
   spread over many ranges. The ends of the ranges come from a bounded sample of the rows
   (``SAMPLE``), weighed by their lengths; they only decide how even the ranges are. A row's key is
   worked out once. Where rows come from anything but a stored table, settle them first: the
   position must be the same when a lost task is run again.
3. Each range is tokenised in order and laid end to end into sequences of ``length`` ids. What
   remains at the end of a range is cut into sequences whose lengths are powers of two, so
   nothing is padded. Texts move once; ids never do.

Edge cases. A null or empty text is the end id alone. Null ids and repeated rows are documents
like any other (a repeated row is packed as often as it stands there); sequence ids are unique
within one evaluation. Other columns are not read.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .registry import query, table
from .shared import Remembered, slices

LENGTH = 2048
END = 1
DIMENSIONS = 3
BITS = 10
REMEMBERED = 600_000
# Punctuation that stands apart from the letters before it.
MARKS = ".,;:!?"
# Rows whose places tell where ranges end, and the bits of a place that tell equal keys apart.
SAMPLE, TIES = 1 << 14, 33

# Bytes that part words, and a random number for every pair of neighbouring bytes.
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_PAIRS = np.random.default_rng(42).integers(0, 2**64, 1 << 16, dtype=np.uint64)
# Bytes of text that are arrays at a time; a longer document is one stretch.
STRETCH = 1 << 20


def places(column: pa.Array) -> np.ndarray:
    """A row per text: the mean of its words' random vectors, the origin for no words.

    A word's hash is the sum of the numbers of its byte pairs, the first byte paired with 0; its
    coordinates are stretches of 16 bits. Whole stretches of texts are worked out at once.
    """
    column = column.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    found = np.zeros((len(column), DIMENSIONS))
    if not len(column) or ends[0] == ends[-1]:
        return found
    octets = np.frombuffer(column.buffers()[2], np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + STRETCH, side="right")) - 1)
        own = octets[ends[first] : ends[last]]
        cuts = ends[first : last + 1] - ends[first]
        blank = _BLANK[own]
        start = ~blank
        start[1:] &= blank[:-1]
        heads = cuts[:-1][np.diff(cuts) > 0]
        start[heads] |= ~blank[heads]
        at = np.flatnonzero(start)
        if len(at):
            pairs = own.astype(np.uint16)
            pairs[1:] |= np.where(start[1:], 0, own[:-1]).astype(np.uint16) << 8
            numbers = _PAIRS[pairs]
            numbers[blank] = 0
            hashes = np.add.reduceat(numbers, at)
            doc = np.searchsorted(cuts[1:], at, side="right")
            n = np.maximum(np.bincount(doc, minlength=last - first), 1)
            for k in range(DIMENSIONS):
                side = ((hashes >> np.uint64(48 - 16 * k)) & np.uint64(0xFFFF)) / 32768.0 - 1.0
                found[first:last, k] = np.bincount(doc, weights=side, minlength=last - first) / n
        first = last
    return found


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The position on the Hilbert curve of each row of cell numbers below 2 ** bits.

    From the outermost bit inwards, every set bit of an axis reflects the lower bits of the first
    axis, every unset one exchanges them with that axis's; what remains is a Gray code.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            is_set = (x[i] >> bit) & 1 == 1
            swap = np.where(is_set, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(is_set, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flips ^= np.where((x[n - 1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flips
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _keys(column: pa.Array) -> np.ndarray:
    cells = np.floor((0.5 + 0.5 * np.tanh(4 * places(column))) * (1 << BITS)).clip(0, (1 << BITS) - 1)
    return hilbert(cells)


def curve_key(text: Column) -> Column:
    """The Hilbert key of a text's place."""

    def each(column: pa.Array) -> pa.Array:
        return pa.array(_keys(column))

    each.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, "bigint")(text)


def curve_place(text: Column, tie: Column, ends: np.ndarray) -> Column:
    """``place`` on the curve, equal keys told apart by ``tie``, and the number of the ``range`` between ``ends``."""

    def each(column: pa.Array, ties: pa.Array) -> pa.Array:
        place = _keys(column) << TIES | ties.to_numpy() & ((1 << TIES) - 1)
        return pa.StructArray.from_arrays([pa.array(place), pa.array(np.searchsorted(ends, place).astype(np.int32))], names=["place", "range"])

    each.__annotations__ = {"column": pa.Array, "ties": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, "place bigint, range int")(text, tie)


def range_ends(rows: DataFrame, tie: Column, ranges: int) -> np.ndarray:
    """Places at which ranges of about equal length of text end, from a sample of the rows."""
    share = min(1.0, SAMPLE / max(1, rows.count()))
    few = rows.sample(share, 42) if share < 1 else rows
    place = curve_place(F.col("text"), tie, np.zeros(0, np.int64))["place"].alias("place")
    found = few.select(place, (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("weight")).toArrow().sort_by("place")
    weights = np.cumsum(found["weight"].to_numpy().astype(np.int64))
    if not len(weights):
        return np.zeros(0, np.int64)
    return found["place"].to_numpy()[np.searchsorted(weights, weights[-1] * np.arange(1, ranges) / ranges)]


class Ids:
    """Token ids of whole texts as little-endian 32-bit bytes, piece by piece from memory.

    The vocabulary's pattern gives a blank to the word after it and never joins what is left and
    right of a single blank or line feed, so a text's ids are those of the pieces between them,
    one after the other. Next to other white space a line feed stays within its piece. That fails
    where a blank has white space on both sides, and where the text holds an added token's string;
    such texts are encoded whole. The words of a text that memory lacks are asked for in one call.
    """

    _RUN = re.compile(r"\s\s")
    _BLANK_RUN = re.compile(r"\s \s")

    def __init__(self, path: str, entries: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Words and what follows a line feed in texts without runs of white space; other pieces as they stand.
        self.words = Remembered(self.word, entries)
        self.pieces = Remembered(self.piece, entries // 4)

    def whole(self, text: str) -> bytes:
        ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
        if sys.byteorder != "little":
            ids.byteswap()
        return ids.tobytes()

    def piece(self, text: str) -> bytes:
        """A piece's ids; what stands apart under the pattern anyway is remembered on its own.

        That is a line feed before a word, and punctuation after a letter.
        """
        if text[0] == "\n" and len(text) > 1 and not text[1].isspace():
            return self.pieces["\n"] + self.pieces[text[1:]]
        stem = text.rstrip(MARKS)
        if len(stem) < len(text) and stem[-1:].isalpha():
            return self.pieces[stem] + self.pieces[text[len(stem) :]]
        return self.whole(text)

    def word(self, word: str) -> bytes:
        """The ids of a word with the blank before it; what begins with a line feed has no blank."""
        if word[:1] == "\n":
            return self.piece(word)
        stem = word.rstrip(MARKS)
        if len(stem) < len(word) and stem[-1:].isalpha():
            return self.words[stem] + self.pieces[word[len(stem) :]]
        return self.whole(" " + word)

    def learn(self, words: set[str]) -> None:
        """Remembers those of the words, without marks at their end, that are letters alone: one call for all.

        A blank and letters are one stretch under the pattern, so each word's ids are those that begin in it.
        """
        known, older = self.words, self.words.older
        fresh = [w for w in {w.rstrip(MARKS) for w in words} if w.isalpha() and w not in known and w not in older]
        if not fresh:
            return
        found = self.tokenizer.encode(" " + " ".join(fresh), add_special_tokens=False)
        ids = np.array(found.ids, dtype="<u4")
        starts = np.cumsum([0, *(len(w) + 1 for w in fresh)])
        cuts = np.searchsorted(np.array([at for at, _ in found.offsets]), starts).tolist()
        for word, i, j in zip(fresh, cuts, cuts[1:]):
            known.keep(word, ids[i:j].tobytes())

    def of(self, text: str) -> bytes:
        if not text:
            return b""
        if any(a in text for a in self.added):
            return self.whole(text)
        if not self._RUN.search(text):
            first, *words = text.replace("\n", " \n").split(" ")
            found = list(map(self.words.get, words))
            if None in found:
                self.learn({w for w, ids in zip(words, found) if ids is None})
                found = [self.words[w] if ids is None else ids for w, ids in zip(words, found)]
        elif not self._BLANK_RUN.search(text):
            first, *rest = text.split(" ")
            found = [self.pieces[" " + piece] for piece in rest]
        else:
            return self.whole(text)
        return (self.pieces[first] if first else b"") + b"".join(found)


_LOADED: dict[str, Ids] = {}


def ids_at(path: str) -> Ids:
    """One tokenizer and its memory per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]


SCHEMA = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: Iterable[tuple[object, bytes]], length: int = LENGTH) -> Iterator[list[tuple]]:
    """Finished sequences: lists of (doc, start, ids, doc tokens) that fill ``length`` ids, or a power of two."""
    held: list[tuple] = []
    room = length
    for doc, ids in docs:
        total, at = len(ids) // 4, 0
        while at < total:
            n = min(room, total - at)
            held.append((doc, at, ids[4 * at : 4 * (at + n)], total))
            at, room = at + n, room - n
            if not room:
                yield held
                held, room = [], length
    rest, size = length - room, 1 << length.bit_length()
    while rest:
        size >>= 1
        if rest < size:
            continue
        rest -= size
        part, room = [], size
        while room:
            doc, at, ids, total = held[0]
            n = min(room, len(ids) // 4)
            part.append((doc, at, ids[: 4 * n], total))
            held[0] = (doc, at + n, ids[4 * n :], total)
            if not held[0][2]:
                held.pop(0)
            room -= n
        yield part


def packed(docs: DataFrame, path: str, ids: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece of a document: where it comes from, its ids' checksum, where it lies."""
    rows = docs.select(F.col(ids).alias("doc_id"), F.col(text).alias("text"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("doc_id", "text", F.monotonically_increasing_id())
    keyed = rows.withColumn("_p", curve_place(F.col("text"), tie, range_ends(rows, tie, ranges)))
    ranged = keyed.repartitionById(ranges, F.col("_p.range")).sortWithinPartitions("_p.place").select("doc_id", "text")
    schema = SCHEMA.format(kind=rows.schema["doc_id"].dataType.simpleString())
    last = np.array([end], dtype="<u4").tobytes()

    def each(batches):
        tokens = ids_at(path)
        base = TaskContext.get().partitionId() << 40
        kind = None

        def documents():
            nonlocal kind
            for batch in slices(batches):
                kind = batch.column(0).type
                for doc, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield doc, tokens.of(whole or "") + last

        def batch_of(rows):
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        out = []
        for number, sequence in enumerate(pack(documents(), length)):
            offset = 0
            for doc, start, part, total in sequence:
                out.append((doc, start, len(part) // 4, zlib.crc32(part), total, base + number, offset))
                offset += len(part) // 4
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return ranged.mapInArrow(each, schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op8_curve_packing")
def op8_curve_packing(spark, sf_dir):
    """Every document's pieces and the sequences they lie in."""
    return packed(table(spark, sf_dir, "documents"), vocabulary())
