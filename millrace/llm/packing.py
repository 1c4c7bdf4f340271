"""Sum-of-squares packing of token sequences.

A document's tokens are cut into pieces of at most `capacity`; each piece is placed where the sum, over the residual
gaps of the open bins, of the squared number of bins with that gap becomes smallest, a new bin being one of the choices.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_batches, trim

CAPACITY = 4096
END = 1
LOOSE = 0.98  # sequences filled less are packed once more
SHARD = 16_384
CACHED_WORDS = 150_000  # of a generation, a few dozen MB in each worker
_TOKENIZERS: dict[str, tuple] = {}


# The letters that byte-level BPE writes for bytes: printable ones stand for themselves, the others from U+0100 on
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {c: 256 + k for k, c in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
_LOWER_LINE = bytes(32 if c == 10 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_LETTER = np.array([97 <= c <= 122 for c in range(256)])
_MARK = np.array([33 <= c <= 126 and not chr(c).isalnum() and c != 39 for c in range(256)])


class Words:
    """Encodes texts by a lower-casing word-level BPE whose tokens never span a space or a line feed.

    Texts are cut there and between a letter and a mark other than an apostrophe, where its words end too. A word's ids
    are kept, in two generations of bounded size; words of letters alone go to the model directly. A text that
    holds a special token goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.kept, self.before = self.tokenizer.model, {b"": b""}, {}

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    @staticmethod
    def cut(text: str) -> list[bytes]:
        raw = text.encode("utf-8", "surrogatepass").translate(_LOWER_LINE)
        b = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(_LETTER[b[:-1]] & _MARK[b[1:]]) + 1
        return (np.insert(b, at, 32).tobytes() if len(at) else raw).split(b" ")

    def ids(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        if text.isalpha() and text.lower() == text and unicodedata.is_normalized("NFC", text):
            ids = [t.id for t in self.model.tokenize(text if text.isascii() else word.decode("latin-1").translate(_BYTE_LETTERS))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.kept) > CACHED_WORDS:
            self.before, self.kept = self.kept, {b"": b""}
        special = {k for k, t in enumerate(texts) if any(x in t for x in self.special)}
        split, kept, before = [[] if k in special else self.cut(t) for k, t in enumerate(texts)], self.kept, self.before
        for w in {w for words in split for w in words if w not in kept}:
            ids = before.get(w)
            kept[w] = self.ids(w) if ids is None else ids
        done = [b"".join([kept[w] for w in words]) for words in split]
        for k in special:
            done[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, "<u4").tobytes()
        return done


def tokenize(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = True) -> DataFrame:
    """Pieces of documents: doc_id, piece, start, length, ids_crc32 and, unless left out, ids.

    A null text counts as empty and gives one piece of the end token alone; repeated rows give pieces each. Columns of
    docs other than the two named are not read, so their names don't matter.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, last = Words.of(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.iloc[k : k + 256]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                rows = []
                for i, ids in zip(part["doc_id"], words.encode(texts), strict=True):
                    ids += last
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((i, p, at // 4, len(own) // 4, zlib.crc32(own), np.frombuffer(own, "<u4").astype(np.int64)) if with_ids else (i, p, at // 4, len(own) // 4, zlib.crc32(own)))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
        trim()

    small_batches(docs.sparkSession)
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(pieces, schema)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the order given, by the sum-of-squares rule; ties take the smallest gap."""
    gaps = np.zeros(capacity + 1, np.int64)  # open bins by residual gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        # placing into gap g changes the sum by 2 (N[g-s] - N[g] + 1); closing a bin by 1 - 2 N[s]; a new bin by 2 N[C-s] + 1
        rest = capacity - s
        cost = np.where(gaps[s:capacity] > 0, 2 * (gaps[:rest] - gaps[s:capacity] + 1), np.iinfo(np.int64).max)
        if rest and gaps[s]:
            cost[0] = 1 - 2 * gaps[s]
        k = int(cost.argmin()) if rest else 0
        if rest and cost[k] <= 2 * gaps[rest] + 1 and gaps[s + k]:
            g = s + k
            b = stacks[g].pop()
            gaps[g] -= 1
        else:
            g, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - g
        if g - s:
            stacks[g - s].append(b)
            gaps[g - s] += 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset.

    The pieces are dealt at random to shards of about `shard` pieces, which pack independently and longest first. What lies
    in sequences that a shard leaves less than full (LOOSE) is packed once more, dealt together from all shards. Pieces
    longer than `capacity` or shorter than 1 are an error; no piece gives no sequence.
    """
    n = max(1, -(-pieces.count() // shard))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def packed(turn: int):
        def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
            lengths = rows["length"].to_numpy(np.int64)
            if len(lengths) and not 1 <= lengths[-1] <= lengths[0] <= capacity:
                raise ValueError("a piece's length is out of bounds")
            bins, offsets = place(lengths, capacity)
            loose = (np.bincount(bins, weights=lengths) < LOOSE * capacity)[bins]
            return rows.drop(columns="shard").assign(sequence_id=(turn << 60) + (key[0] << 32) + bins, offset=offsets, loose=loose)

        return pack

    def dealt(rows: DataFrame, turn: int, shards: int) -> DataFrame:
        rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", F.lit(turn)), F.lit(shards)))
        return rows.groupBy("shard").applyInPandas(packed(turn), f"{columns}, sequence_id long, offset long, loose boolean")

    if n == 1:
        return dealt(pieces, 0, 1).drop("loose")
    done = checkpoint(dealt(pieces, 0, n))
    loose = done.where("loose").drop("sequence_id", "offset", "loose")
    again = dealt(loose, 1, max(1, -(-loose.count() // shard)))
    return done.where("not loose").unionByName(again).drop("loose")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return pack_pieces(checkpoint(pieces))
