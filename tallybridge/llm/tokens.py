"""Token counts by byte-pair merging over a heap and a linked list.

A text's symbols are its characters. The adjacent pair whose merged piece ranks best in the
vocabulary is merged, the leftmost first among equals, until no pair is a piece. The count is
the number of symbols at the start less the merges; a character that no piece covers counts as
its UTF-8 bytes (byte fallback). No ids are made.

Blanks become the word mark, one is put before the text. No piece of the vocabulary holds a mark
after another character (checked when it is loaded), so no merge reaches from one word into the
next one's marks, and a text's count is the sum over its words, which a worker remembers. Line
feeds likewise join with nothing.

Edge cases. A null or empty text has no tokens and no bytes. Strings of control tokens are
ordinary text. Nothing is cut or padded. Null ids and repeated rows are counted like any row;
other columns are not read.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .registry import query, table
from .shared import Remembered

MARK = "▁"
LIMIT = 4096
REMEMBERED = 400_000


class Merges:
    """Ranks of a vocabulary's pieces and the counts they lead to."""

    def __init__(self, ranks: dict[str, float], byte_fallback: bool = True, entries: int = REMEMBERED):
        self.ranks, self.byte_fallback = ranks, byte_fallback
        joined = [p for p in ranks if len(p) > 1]
        self.by_word = not any(MARK in p.lstrip(MARK) for p in joined)
        self.by_line = not any("\n" in p for p in joined)
        self.words = Remembered(self.merged, entries)

    @classmethod
    def of_model(cls, path: str) -> Merges:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        # 2 is byte-pair encoding; other kinds and normalisers would need other rules.
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError(f"{path}: not a byte-pair model over plain text")
        return cls({p.piece: -p.score for p in model.pieces if p.type == 1}, spec.byte_fallback)

    def cost(self, symbol: str) -> int:
        """Tokens of a symbol that stays as it is."""
        return 1 if symbol in self.ranks or not self.byte_fallback else len(symbol.encode())

    def merged(self, text: str) -> int:
        """Tokens of a marked text, by merging."""
        ranks, symbols = self.ranks, list(text)
        n = len(symbols)
        count = sum(map(self.cost, symbols))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(symbols[i] + symbols[i + 1])
            if rank is not None:
                heap.append((rank, i, symbols[i] + symbols[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i]
            # Stale unless both parts still stand side by side as they did.
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != piece:
                continue
            count += 1 - self.cost(symbols[i]) - self.cost(symbols[j])
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(piece + symbols[k])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, piece + symbols[k]))
            h = before[i]
            if h >= 0:
                rank = ranks.get(symbols[h] + piece)
                if rank is not None:
                    heapq.heappush(heap, (rank, h, symbols[h] + piece))
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = " " + text.replace(MARK, " ")
        if not self.by_word:
            return self.merged(text.replace(" ", MARK))
        if "  " in text:
            # Runs of blanks stay with the word after them.
            return sum(self.words[w.replace(" ", MARK)] for w in _MARKED.findall(text))
        if self.by_line:
            # A line feed joins with nothing, so each line's first word starts a piece of its own.
            text = text.replace("\n", " \n")
        words = [w if w[:1] == "\n" and self.by_line else MARK + w for w in text[1:].split(" ")]
        return sum(map(self.words.__getitem__, words))


_MARKED = re.compile(r" +[^ ]*")
_LOADED: dict[str, Merges] = {}


def merges_at(path: str) -> Merges:
    """One vocabulary and its memory per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Merges.of_model(path)
    return _LOADED[path]


def counted(docs: DataFrame, path: str, ids: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit``, one row per row."""

    def each(column: pa.Array) -> pa.Array:
        merges = merges_at(path)
        found: list[int] = []
        for at in range(0, len(column), 256):
            found += [merges.count(t) for t in column.slice(at, 256).to_pylist()]
        return pa.array(found, pa.int64())

    each.__annotations__ = {"column": pa.Array, "return": pa.Array}
    rows = docs.select(
        F.col(ids).alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.arrow_udf(each, "bigint")(F.col(text)).alias("n_tokens"),
    )
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    """Every document with its bytes and tokens."""
    return counted(table(spark, sf_dir, "documents"), vocabulary())
