"""Byte-pair token counts and offsets from a rank file, in Arrow batches."""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A rank file as tiktoken writes them: a base64 token and its rank a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's texts are cut before pairs are merged.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Bpe:
    """Counts and character ranges of a text's tokens."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        self.pattern = pattern
        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(t): int(r) for t, r in pairs}, special_tokens={})

    def ids(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def head(self, text: str, tokens: int) -> str:
        """The characters that the first tokens cover whole."""
        return text[: int(self.bounds(text)[0][: tokens + 1][-1])]

    def bounds(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Characters at the n + 1 token edges: rounded down to a character's start, and up past its end."""
        sizes = np.array([len(self.encoding.decode_single_token_bytes(i)) for i in self.ids(text)], np.int64)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        raw = np.frombuffer(text.encode(), np.uint8)
        leads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters that begin before each byte
        inside = np.append((raw & 0xC0) == 0x80, False)[edge]  # an edge amid a character
        return leads[edge] - inside, leads[edge]

    def run_counts(self, text: str) -> tuple[int, Callable[[int, int], int]]:
        """The text's tokens, and a function of two places: the tokens of the text between them, as if it stood alone.

        The text is encoded once. By PATTERN, a run of white space begins a piece of its own, and every piece depends on
        what follows it only, so pieces begin alike before the last blank of the run at the first place and the run at the second;
        only these two runs are encoded anew. Texts of another pattern are encoded as they are asked for.
        """
        if self.pattern != PATTERN:
            return self.count(text), lambda a, b: self.count(text[a:b])
        import regex

        high = self.bounds(text)[1]
        blanks = [m.span() for m in regex.finditer(r"\p{White_Space}+", text)]
        stops = [stop for _, stop in blanks]

        def count(a: int, b: int) -> int:
            i, j = bisect_left(stops, a + 1), bisect_left(stops, b)
            # a piece begins at the last blank before a word, or where the word does
            first = stops[i] - 1 if i < len(blanks) and blanks[i][0] <= a else a
            last = blanks[j][0] if j < len(blanks) and blanks[j][0] < b else b
            if first >= last:
                return self.count(text[a:b])
            inner = np.searchsorted(high, [first, last], "right")
            return self.count(text[a:first]) + int(inner[1] - inner[0]) + self.count(text[last:b])

        return len(high) - 1, count

    def windows(self, text: str, size: int, overlap: int = 0) -> list[tuple[int, int]]:
        """Character ranges of windows of `size` tokens; the last ends with the text. No tokens: one empty window."""
        low, high = self.bounds(text)
        n, step = len(low) - 1, size - overlap
        firsts = [0, *range(step, n - overlap, step)] if n > size else [0]
        return [(int(low[f]), int(high[min(f + size, n)])) for f in firsts]


@lru_cache(maxsize=2)
def loaded(ranks: bytes, pattern: str) -> Bpe:
    return Bpe(ranks, pattern)


def read(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def each_text(rows: DataFrame, key: str, text: str, make, schema: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Rows make(bpe, key, text) of every row; a null text is empty. The rank file is read here and sent to the executors."""
    sent = rows.sparkSession.sparkContext.broadcast(read(vocabulary))  # a vocabulary, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(sent.value, pattern)
        for batch in batches:
            out = [row for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for row in make(bpe, k, t or "")]
            cols = list(zip(*out, strict=True)) or [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return rows.select(key, text).mapInArrow(run, schema)


def token_counts(rows: DataFrame, key: str, text: str = "text", **how) -> DataFrame:
    """key and the number of byte-pair tokens of its text."""
    return each_text(rows, key, text, lambda bpe, k, t: [(k, bpe.count(t))], f"{key} {dict(rows.dtypes)[key]}, tokens long", **how)
