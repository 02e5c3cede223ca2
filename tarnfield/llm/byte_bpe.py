"""Byte-level BPE encoding and decoding, long texts in overlapping chunks.

A text is split into pre-tokens by the vocabulary's pattern, and each pre-token is
merged on its own, lowest rank first (ties: leftmost). A long text is cut into
chunks that overlap; all chunks of all texts are pre-tokenised in parallel, each
as if it began a text. The pattern looks at nothing left of a match, so where a
chunk and the one before it have a boundary in common, both go on alike from
there: the first common boundary in the overlap is where they are stitched, and
every chunk then encodes the pre-tokens from its own stitch to the next one, again
in parallel. Boundaries within three characters of a chunk's cut end are not
trusted: a match looks no further ahead than one character past its end, or
three past its beginning.

A text some of whose chunks have no boundary in common with the one before (a
pre-token longer than the overlap) is put together and pre-tokenised whole, so
results do not depend on the chunks.

The classes of letters and numbers follow the Unicode version of the installed
tiktoken, which may be older than that of the pattern library: characters that
only the newer calls letters or numbers are matched as symbols.

Decoding looks up each id's bytes and concatenates them.

Defined results: a null or empty text has no ids and decodes to no bytes. Rows are
independent, repeated rows get equal ids. Other columns are kept, but for those that
have a result's name. An empty table gives an empty result. An id without bytes is an
error. The vocabulary file is read by the driver and sent to the executors; a chunk's
pre-tokens are those of the pattern given, which must not look behind.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfield.llm.shared import CACHES, over_arrow, stored, tidy

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Characters of a chunk, and how many of the next chunk's it has besides.
CHUNK, OVERLAP = 1 << 15, 512
#: How far a match looks ahead of its beginning at most, besides the character after it.
AHEAD = 3
#: Pre-tokens whose ids a worker keeps; when there are more, those of the texts at hand stay.
MEMO_PIECES = 300_000
#: Bytes from which a pre-token is merged alone, by a heap.
LONG_PIECE = 64
#: Texts, and characters, that are encoded at a time.
ROWS, CHARACTERS = 500, 1 << 20
#: The table of pairs: its size as a power of two, and how keys are spread over it.
TABLE = 20
HASH, MASK, SHIFT = 0x9E3779B97F4A7C1, (1 << 62) - 1, 62 - TABLE


def _classes(pattern: str) -> set[str]:
    """The characters that tiktoken's pattern matches."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return set(probe.decode_bytes(probe.encode_ordinary(every)).decode())


@lru_cache(maxsize=1)
def newer() -> str:
    """Characters that are letters or numbers to the pattern library, but not to tiktoken."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    return "".join(sorted(set().union(*(set(regex.findall(p, every)) - _classes(p) for p in (r"\p{L}", r"\p{N}")))))


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Ranks:
    """A vocabulary: the bytes of every id, pre-tokens of a text, and the ids of a pre-token."""

    def __init__(self, content: bytes, pattern: str, odd: str):
        self.rank = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in content.splitlines() if line)}
        self.bytes_of = {i: piece for piece, i in self.rank.items()}
        self.pattern = regex.compile(pattern)
        # not a letter, number, space or quote
        self.plain = {ord(c): "☠" for c in odd}
        self.odd = frozenset(odd)
        self.memo: dict[str, bytes] = {}
        # ids whose bytes together are a piece, as an open table of 2**TABLE slots: left id * none + right id, and the piece's
        self.none = max(self.bytes_of) + 1
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.byte_pairs = np.array([self.rank.get(bytes([a, b]), self.none) for a in range(256) for b in range(256)], np.int32)
        found = [(a, b, i) for piece, i in self.rank.items() for cut in range(1, len(piece)) if (a := self.rank.get(piece[:cut])) is not None and (b := self.rank.get(piece[cut:])) is not None]
        a, b, value = np.array(found or [(0, 0, 0)], np.int64).T
        self.keys, self.values = np.full(1 << TABLE, -1), np.zeros(1 << TABLE, np.int32)
        key, todo = a * self.none + b, np.arange(len(found))
        slot = (key * HASH & MASK) >> SHIFT
        # of those that want one slot the last gets it
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]], self.values[slot[free]] = key[free], value[free]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) % len(self.keys)

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text; together they are the text."""
        if text.isascii() or self.odd.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.plain))]

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """int32 ids of each pre-token, as bytes: merges of many go on at once, one in each a round."""
        out: list[bytes] = [b""] * len(pieces)
        some = []
        for i, piece in enumerate(pieces):
            whole = self.rank.get(piece)
            if whole is not None:
                out[i] = array("i", [whole]).tobytes()
            elif len(piece) > LONG_PIECE:
                out[i] = array("i", self._long(piece)).tobytes()
            else:
                some.append(i)
        if some:
            ids, sizes = self._rounds([pieces[i] for i in some])
            raw, stops = ids.tobytes(), np.cumsum(sizes * 4).tolist()
            for i, a, b in zip(some, [0, *stops], stops, strict=False):
                out[i] = raw[a:b]
        return out

    def _rounds(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some pre-tokens laid together, and how many each has."""
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.of_byte[raw]
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        # the rank of each id and the one after it
        pair = np.full(len(ids), self.none, np.int32)
        pair[:-1] = self.byte_pairs[raw[:-1].astype(np.int32) << 8 | raw[1:]]
        pair[np.cumsum(size) - 1] = self.none
        done = []
        while len(ids):
            begin = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            count = np.diff(np.append(begin, len(ids)))
            least = np.minimum.reduceat(pair, begin)
            over = least == self.none
            if over.any():
                gone = np.repeat(over, count)
                done.append((piece[gone], ids[gone]))
                ids, piece, pair, least, count = ids[~gone], piece[~gone], pair[~gone], least[~over], count[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(pair == np.repeat(least, count))
            at = at[np.append(True, piece[at[1:]] != piece[at[:-1]])]
            ids[at] = pair[at]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, piece, pair = ids[stay], piece[stay], pair[stay]
            at -= np.arange(len(at))  # one element has gone for each that came before
            near = np.concatenate([at, at[at > 0] - 1])
            after = np.minimum(near + 1, len(ids) - 1)
            joined = (near + 1 < len(ids)) & (piece[near] == piece[after])
            pair[near] = np.where(joined, self._pair_ranks(ids[near], ids[after]), self.none)
        which, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(which, kind="stable")].astype(np.int32), np.bincount(which, minlength=len(pieces))

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of two ids' bytes together, `none` where they are no piece."""
        key = left.astype(np.int64) * self.none + right
        slot = (key * HASH & MASK) >> SHIFT
        out = np.full(len(key), self.none, np.int32)
        look = np.arange(len(key))
        while len(look):
            have = self.keys[slot[look]]
            same = have == key[look]
            out[look[same]] = self.values[slot[look[same]]]
            look = look[~same & (have >= 0)]
            slot[look] = (slot[look] + 1) % len(self.keys)
        return out

    def _long(self, piece: bytes) -> list[int]:
        """The same by a heap of pairs over a linked list: a pre-token may be as long as a text."""
        n = len(piece)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        get = self.rank.get
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            # a pair counts only while both of its parts are as they were
            if end[i] != middle or middle >= n or end[middle] != stop:
                continue
            end[i], after[i] = stop, after[middle]
            end[middle] = -1
            if after[i] < n:
                before[after[i]] = i
                if (r := get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[after[i]]))
            if (j := before[i]) >= 0 and (r := get(piece[j:stop])) is not None:
                heapq.heappush(heap, (r, j, i, stop))
        out, i = [], 0
        while i < n:
            out.append(self.rank[piece[i : end[i]]])
            i = after[i]
        return out

    def encode(self, texts: list[list[str]]) -> list[bytes]:
        """int32 ids, as bytes, of some texts' pre-tokens."""
        here = set().union(*texts)
        memo = self.memo
        new = [p for p in here if p not in memo]
        if len(memo) + len(new) > MEMO_PIECES:
            self.memo = memo = {p: memo[p] for p in here if p in memo}
        memo.update(zip(new, self.merged([p.encode() for p in new]), strict=True))
        out = [b"".join(map(memo.__getitem__, t)) for t in texts]
        for p in new:
            if len(p) > LONG_PIECE:
                del memo[p]
        return out


@lru_cache(maxsize=2)
def ranks(content: bytes, pattern: str, odd: str) -> Ranks:
    return Ranks(content, pattern, odd)


CACHES[__name__] = ranks.cache_clear


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded length together; a longer text is alone."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        size = len(t or "")
        if i > a and (held + size > CHARACTERS or i - a >= ROWS):
            yield a, i
            a, held = i, 0
        held += size
    if texts:
        yield a, len(texts)


def _ids(got: list[bytes]) -> list[pa.Array]:
    """token_ids and n_tokens of some texts."""
    sizes = np.array([len(x) // 4 for x in got], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(got), np.int32))), pa.array(sizes)]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column laid together, and the bounds of each row's; a null row has none."""
    counts = column.value_lengths().fill_null(0).to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)])


def _cut(long: DataFrame, column: str, keep: list[T.StructField], sent, chunk: int, overlap: int) -> DataFrame:
    """Pre-tokenised chunks: row, chunk, start, its text, `ends` of its pre-tokens, and the other columns as `doc` on the first."""
    others = F.struct(*(F.col(f"`{f.name}`") for f in keep)) if keep else F.struct(F.lit(0).alias("none"))
    told = long.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{column}`").alias("text"), others.alias("doc"))
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(chunk))

    # only chunks are dealt; the text is cut by slices in one go, as a substring by character walks from the beginning
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, n, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), range(len(batch)), strict=True):
                parts = [text[a : a + chunk + overlap] for a in range(0, n * chunk, chunk)]
                first = pa.array([doc] + [None] * (n - 1), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([row] * n), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array(parts, pa.string()), batch.column(3).take(first)], names=["row", "chunk", "n", "text", "doc"])

    kind = told.schema["doc"].dataType
    pieces = told.select("row", "text", F.size(starts).alias("n"), "doc").mapInArrow(cut, T.StructType([T.StructField("row", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("doc", kind)]))

    @tidy
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(*sent.value)
        for batch in batches:
            got = [np.cumsum(list(map(len, r.pieces(t))), dtype=np.int32) for t in batch.column(3).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
            ends = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*got, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([*batch.columns, ends], names=[*batch.schema.names, "ends"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("ends", T.ArrayType(T.IntegerType()))])
    return pieces.repartition("row", "chunk").mapInArrow(split, schema)


def _stitches(chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """row, chunk, `begin` and `stop` of what the chunk encodes, within it, and whether all chunks of the row are stitched."""
    by_row = Window.partitionBy("row").orderBy("chunk")
    # the chunk's own beginning is a boundary of it
    head = F.filter(F.concat(F.array(F.lit(0)), F.col("ends")), lambda e: e <= overlap)
    tail = F.transform(F.filter("ends", lambda e: (e >= chunk) & (e <= chunk + overlap - AHEAD)), lambda e: e - chunk)
    zones = chunks.select("row", "chunk", "n", head.alias("head"), tail.alias("tail"))
    meet = zones.select("row", "chunk", "n", F.array_min(F.array_intersect("head", F.lag("tail").over(by_row))).alias("meet"))
    begin = F.when(F.col("chunk") == 0, 0).otherwise(F.col("meet"))
    whole = Window.partitionBy("row")
    return meet.select("row", "chunk", begin.alias("begin"), (F.lead("meet").over(by_row) + chunk).alias("stop"), (F.count("meet").over(whole) == F.col("n") - 1).alias("stitched"))


def _long_encoded(long: DataFrame, column: str, keep: list[T.StructField], sent, chunk: int, overlap: int) -> DataFrame:
    chunks = stored(_cut(long, column, keep, sent, chunk, overlap), "chunks")
    told = chunks.join(_stitches(chunks, chunk, overlap), ["row", "chunk"])
    part = told.where("stitched").select("row", "chunk", "text", "ends", "begin", "stop", "doc")
    # what has no common boundary somewhere: the chunks without their overlaps are the text
    own = F.struct("chunk", F.substring("text", 1, chunk).alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["text"]), "")
    rest = told.where("not stitched").groupBy("row").agg(text.alias("text"), F.first("doc", ignorenulls=True).alias("doc"))
    rest = rest.select("row", F.lit(0).alias("chunk"), "text", F.lit(None).cast("array<int>").alias("ends"), F.lit(0).alias("begin"), F.lit(None).cast("int").alias("stop"), "doc")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(*sent.value)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in _groups(texts):
                part, pieces = batch.slice(a, b - a), []
                values, bounds = _lists(part.column(3))
                whole = part.column(3).is_null().to_pylist()
                for i, (text, begin, stop) in enumerate(zip(texts[a:b], part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True)):
                    if whole[i]:
                        pieces.append(r.pieces(text))
                        continue
                    at = np.append(0, values[bounds[i] : bounds[i + 1]])
                    at = at[(at >= begin) & (at <= (len(text) if stop is None else stop))].tolist()
                    pieces.append([text[i:j] for i, j in zip(at[:-1], at[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _ids(r.encode(pieces))[0], part.column(6)], names=["row", "chunk", "ids", "doc"])

    kind = chunks.schema["doc"].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("doc", kind)])
    coded = part.unionByName(rest).mapInArrow(run, schema)
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"]))
    rows = coded.groupBy("row").agg(ids.alias("ids"), F.first("doc", ignorenulls=True).alias("doc"))
    return rows.select(*(F.col("doc").getField(f.name).alias(f.name) for f in keep), F.col("ids").alias("token_ids"), F.size("ids").cast("long").alias("n_tokens"))


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", pattern: str = PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """documents with token_ids and n_tokens. Texts of one chunk are encoded where they lie, longer ones are dealt by chunk."""
    if not AHEAD < overlap < chunk:
        raise ValueError(f"an overlap has more than {AHEAD} characters, and fewer than a chunk")
    fields = documents.schema.fields
    keep = [f for f in fields if f.name.lower() not in ("token_ids", "n_tokens")]
    column = F.col(f"`{text}`")
    sent = documents.sparkSession.sparkContext.broadcast((read(vocabulary), pattern, newer()))
    at = documents.columns.index(text)
    places = [fields.index(f) for f in keep]
    schema = T.StructType([*keep, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ranks(*sent.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in _groups(texts):
                part = batch.slice(a, b - a)
                got = r.encode([r.pieces(t) if t else [] for t in texts[a:b]])
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *_ids(got)], names=schema.names)

    is_long = F.coalesce(F.length(column), F.lit(0)) > chunk + overlap
    short = over_arrow(documents.where(~is_long), run, schema)
    return short.unionByName(_long_encoded(documents.where(is_long), text, keep, sent, chunk, overlap))


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """encoded with the bytes of its ids, concatenated; null ids decode to no bytes."""
    fields = encoded.schema.fields
    at, places = encoded.columns.index(ids), [i for i, f in enumerate(fields) if f.name.lower() != out.lower()]
    schema = T.StructType([*(fields[i] for i in places), T.StructField(out, T.BinaryType())])
    sent = encoded.sparkSession.sparkContext.broadcast((read(vocabulary), PATTERN, newer()))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = ranks(*sent.value).bytes_of
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                values, bounds = _lists(part.column(at))
                flat, bounds = list(map(of.__getitem__, values.tolist())), bounds.tolist()
                got = [b"".join(flat[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), pa.array(got, pa.binary())], names=schema.names)

    return over_arrow(encoded, run, schema)


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")
