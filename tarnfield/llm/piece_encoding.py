"""SentencePiece encoding and decoding over a given piece vocabulary.

The best segmentation of a text is the one of highest total piece score. An
Aho-Corasick automaton over the pieces reads the text once; at each position its
output links give every piece that ends there, longest first, and each relaxes
the best score at the position (Viterbi in the same pass). A character without a
piece costs the lowest score less 10 and is written as its UTF-8 byte pieces.
Ties go to the longer last piece.

No piece of the vocabulary has a space mark after another character (checked
when it is loaded), so no piece crosses the end of a word: words are segmented
apart, and a bounded table of words already seen saves most of the work without
changing a result.

Spaces are written as the mark U+2581 and one is put in front, as the
vocabulary's own settings say; nothing else is normalised. Decoding inverts it
exactly for any text without that mark.

Defined results: a null or empty text has no pieces and decodes to the empty
text. A mark U+2581 in the text decodes to a space, and `exact` is false. Rows
are independent. Extra columns are kept by `encode` and `decode`; columns that have
the names of the results are replaced. The vocabulary file is read by the driver and
sent to the executors.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnfield.llm.shared import CACHES, over_arrow, tidy

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words that each of two tables keeps; the older is dropped when the newer is full.
MEMO_WORDS = 150_000
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNKNOWN_PENALTY = 10.0
_WORD = re.compile(f"{MARK}+[^{MARK}]*")


class Pieces:
    """The automaton, and the tables of a vocabulary file."""

    def __init__(self, content: bytes):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(content)
        self.prefix = model.normalizer_spec.add_dummy_prefix
        pieces = [(p.piece, p.score, p.type) for p in model.pieces]
        self._load(pieces)

    @classmethod
    def of(cls, pieces: list[tuple[str, float, int]], prefix: bool = True) -> Pieces:
        out = cls.__new__(cls)
        out.prefix = prefix
        out._load(pieces)
        return out

    def _load(self, pieces: list[tuple[str, float, int]]) -> None:
        self.automaton, self.single = ahocorasick.Automaton(), set()
        self.bytes_of = [b""] * len(pieces)
        self.byte_ids: dict[int, int] = {}
        self.unknown, lowest = 0, 0.0
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == NORMAL:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} crosses the end of a word")
                self.automaton.add_word(piece, (len(piece), score, i))
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
                lowest = min(lowest, score)
                if len(piece) == 1:
                    self.single.add(piece)
            elif kind == BYTE:
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:-1], 16)])
            elif kind == UNKNOWN:
                self.unknown = i
        self.automaton.make_automaton()
        self.unknown_score = lowest - UNKNOWN_PENALTY
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # an unknown character's cost is on the first of its byte pieces
        self.scores = np.array([score if kind == NORMAL else 0.0 for _, score, kind in pieces])
        for b, i in self.byte_ids.items():
            self.scores[i] = 0.0 if 0x80 <= b < 0xC0 else self.unknown_score

    def segment(self, word: str) -> tuple[list[int], float]:
        """Piece ids and score of the best segmentation of one word."""
        n = len(word)
        best, back = [0.0] + [None] * n, [None] * (n + 1)
        done = 0  # positions up to here are final

        def bare(to: int) -> None:
            nonlocal done
            while done < to:
                at = done + 1
                if word[done] not in self.single and best[done] is not None:
                    score = best[done] + self.unknown_score
                    if best[at] is None or score > best[at]:
                        best[at], back[at] = score, (done, -1)
                done = at

        # matches come in order of their end, so all that ends earlier is settled before
        for end, (size, score, i) in self.automaton.iter(word):
            end += 1
            if end - 1 > done:
                bare(end - 1)
            total = best[end - size] + score
            if best[end] is None or total > best[end]:
                best[end], back[end] = total, (end - size, i)
        bare(n)
        ids, at = [], n
        while at:
            start, i = back[at]
            if i >= 0:
                ids.append(i)
            else:
                ids.extend(self.byte_ids.get(b, self.unknown) for b in reversed(word[start:at].encode("utf-8", "surrogatepass")))
            at = start
        return ids[::-1], best[n]

    def encode(self, text: str | None) -> bytes:
        """int32 piece ids as bytes."""
        if not text:
            return b""
        text = text.replace(" ", MARK)
        words = _WORD.findall(MARK + text) if self.prefix else re.findall(f"^[^{MARK}]+|{MARK}+[^{MARK}]*", text)
        memo, older, out = self.memo, self.older, []
        for w in words:
            got = memo.get(w)
            if got is None:
                got = older.get(w)
                if got is None:
                    got = array("i", self.segment(w)[0]).tobytes()
                if len(memo) >= MEMO_WORDS:
                    self.older = older = memo
                    self.memo = memo = {}
                if len(w) <= 64:
                    memo[w] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw[1:] if self.prefix and raw[:1] == b" " else raw


@lru_cache(maxsize=2)
def pieces(content: bytes) -> Pieces:
    return Pieces(content)


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


CACHES[__name__] = pieces.cache_clear


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """documents with piece_ids, n_pieces, piece_score, and exact: whether the ids decode to the text."""
    at = documents.columns.index(text)
    names = ["piece_ids", "n_pieces", "piece_score", "exact"]
    kept = [f for f in documents.schema.fields if f.name.lower() not in names]
    schema = T.StructType([*kept, T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("piece_score", T.DoubleType()), T.StructField("exact", T.BooleanType())])
    keep = [i for i, f in enumerate(documents.schema.fields) if f.name.lower() not in names]

    sent = documents.sparkSession.sparkContext.broadcast(read(vocabulary))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(sent.value)
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                texts = part.column(at).to_pylist()
                got = [p.encode(t) for t in texts]
                sizes = np.array([len(ids) // 4 for ids in got], np.int64)
                values = np.frombuffer(b"".join(got), np.int32)
                bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = values.tolist()
                exact = [p.decode(flat[a:b]) == (t or "").encode("utf-8", "surrogatepass") for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))
                score = np.concatenate([[0.0], np.cumsum(p.scores[values])])
                new = [ids, pa.array(sizes), pa.array(score[bounds[1:]] - score[bounds[:-1]]), pa.array(exact)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), *new], names=schema.names)

    return over_arrow(documents, run, schema)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """encoded with the text of its piece ids; bytes that are no UTF-8 become U+FFFD."""
    at = encoded.columns.index(ids)
    keep = [i for i, f in enumerate(encoded.schema.fields) if f.name.lower() != out.lower()]
    schema = T.StructType([*(encoded.schema.fields[i] for i in keep), T.StructField(out, T.StringType())])
    sent = encoded.sparkSession.sparkContext.broadcast(read(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(sent.value)
        for batch in batches:
            texts = [p.decode(x or []).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(texts, pa.string())], names=schema.names)

    return over_arrow(encoded, run, schema)
