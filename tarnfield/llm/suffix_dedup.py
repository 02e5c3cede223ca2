"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

A byte goes if a string of `length` bytes that covers it also starts earlier
(smaller doc_id, or the same document and an earlier start). Suffixes need only be
ordered through `length` bytes, most significant digits first, and a group of one
drops out at the pass that isolates it:

1. First digit, at sampled suffixes only. Every window of `length` bytes has an
   anchor, the 32-byte string within it of least hash (leftmost on ties); equal
   windows have equal anchors at equal distance. The windows that share an anchor
   form an interval of starts. Intervals are dealt by the anchor's 32 bytes.
2. Next digit: within an anchor's group, the bytes that all windows of the interval
   cover. An interval whose bytes stand in an earlier block is decided whole, and so
   is one whose anchor has no other continuation.
3. Last digit: anchors with several continuations have the windows of each first
   interval ordered by all `length` bytes.

Digits are compared by 64-bit hashes, so each pass is a merge of sorted arrays of
numbers. Documents lie in blocks of ascending doc_id. A block sends each radix
bucket the sorted distinct digits it holds, the bucket answers which of them an
earlier block holds, and the block settles order within itself. Copies of a text
within a block are sent once, so a large group of copies costs a row a block.

Defined results: a null or empty text has no bytes. Rows of equal doc_id count as
documents in the order of their bytes; a null doc_id comes last. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.shared import BASE_INV, PASS_BYTES, blocks_of, buffers, id_bounds, mix, ordered_block, powers, prefix_hash, stored, tidy

LENGTH, ANCHOR = 100, 32
#: Bytes of text that a block has on average, at most.
BLOCK_BYTES = 64 << 20
POSITION = np.uint64(24)
EARLIER, MIXED = 1, 2
RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


class Pass:
    """A piece of the corpus: one or more whole texts, or a stretch of a long one, with its windows' intervals."""

    def __init__(self, parts: list[tuple[int, int, np.ndarray]], length: int):
        """parts: (text, offset within it, bytes), each of at least `length` bytes."""
        self.length = length
        self.data = np.concatenate([p[2] for p in parts])
        sizes = np.array([len(p[2]) for p in parts])
        ends = np.cumsum(sizes)
        self.text = np.array([p[0] for p in parts])
        self.shift = np.array([p[1] for p in parts]) - (ends - sizes)
        self.sums, self.inv = prefix_hash(self.data), powers(BASE_INV, len(self.data) + 1)
        width, n = length - ANCHOR + 1, len(self.data) - ANCHOR + 1
        at = np.arange(n)
        key = mix((self.sums[ANCHOR:] - self.sums[:n]) * self.inv[:n])
        tagged = (key >> POSITION << POSITION) | at.astype(np.uint64)
        padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
        padded[:n] = tagged
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        starts = n - width + 1
        anchor = (np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & np.uint64((1 << 24) - 1)).astype(np.int64)
        part = np.searchsorted(ends, np.arange(starts), "right")
        inside = np.flatnonzero(np.arange(starts) + length <= ends[part])
        a, p = anchor[inside], part[inside]
        new = np.ones(len(inside), bool)
        new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(inside)) - 1
        self.first, self.last, self.part = inside[first], inside[last], p[first]
        anchor = a[first]
        self.anchor_hash = key[anchor]
        stop = self.last + length
        body = (self.sums[stop] - self.sums[self.first]) * self.inv[self.first]
        self.body_hash = mix(mix(body) ^ ((stop - self.first).astype(np.uint64) << np.uint64(32)) ^ (anchor - self.first).astype(np.uint64))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, start) of all windows of some intervals, in order."""
        size = self.last[which] - self.first[which] + 1
        interval = np.repeat(which, size)
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return interval, self.first[interval] + offset

    def slim(self) -> Pass:
        """Without the running sums, which are eight times the text; they are made again if windows are asked for."""
        self.sums = self.inv = None
        return self

    def window_hash(self, start: np.ndarray) -> np.ndarray:
        if self.sums is None:
            self.sums, self.inv = prefix_hash(self.data), powers(BASE_INV, len(self.data) + 1)
        return mix((self.sums[start + self.length] - self.sums[start]) * self.inv[start] + np.uint64(0x7F4A7C15))


def _passes(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[Pass]:
    parts, held = [], 0
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        for at in range(a, max(b - length + 1, a), PASS_BYTES):
            piece = data[at : min(at + PASS_BYTES + length - 1, b)]
            parts.append((i, at - a, piece))
            held += len(piece)
            if held >= PASS_BYTES:
                yield Pass(parts, length)
                parts, held = [], 0
    if parts:
        yield Pass(parts, length)


def _joint(anchor: np.ndarray, body: np.ndarray) -> np.ndarray:
    return mix(anchor * np.uint64(3) + body)


def _deal(block: int, buckets: int, digit: np.ndarray, *others: np.ndarray) -> list[tuple]:
    """Rows (bucket, block, bytes of each array), dealt by the first."""
    to = (digit % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
    arrays = [x[order] for x in (digit, *others)]
    return [(k, block, *(x[a:b].tobytes() for x in arrays)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


PACKET, PACKET_NAMES, PACKET_TYPES = "bucket int, block int, x binary, y binary", ["bucket", "block", "x", "y"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
ANSWER, ANSWER_NAMES, ANSWER_TYPES = "block int, kind int, x binary, y binary", ["block", "kind", "x", "y"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _gather(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, x, y) of all packets laid end to end."""
    xs = [np.frombuffer(b, np.uint64) for b in table.column("x").to_pylist()]
    ys = [np.frombuffer(b or b"", np.uint64) for b in table.column("y").to_pylist()]
    block = np.repeat(table.column("block").to_numpy(), [len(x) for x in xs])
    cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.uint64)
    return block, cat(xs), cat(ys)


def _answer(block: np.ndarray, keys: np.ndarray, flags: np.ndarray | None, kind: int) -> list[tuple]:
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order], prepend=-1, append=-1))
    return [(int(block[order[a]]), kind, keys[order[a:b]].tobytes(), None if flags is None else flags[order[a:b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _second_digit(table: pa.Table) -> pa.Table:
    """Of a bucket's anchors: which continuations an earlier block holds, and which anchors have several."""
    block, anchor, body = _gather(table)
    order = np.lexsort((block, body, anchor))
    block, anchor, body = block[order], anchor[order], body[order]
    new_anchor = np.ones(len(anchor), bool)
    new_anchor[1:] = anchor[1:] != anchor[:-1]
    new_body = new_anchor.copy()
    new_body[1:] |= body[1:] != body[:-1]
    holder = block[np.flatnonzero(new_body)][np.cumsum(new_body) - 1] if len(block) else block
    group = np.cumsum(new_anchor) - 1
    bodies = np.bincount(group, new_body) if len(block) else np.zeros(0)
    flags = (EARLIER * (holder < block) + MIXED * (bodies[group] > 1)).astype(np.uint8) if len(block) else np.zeros(0, np.uint8)
    told = flags > 0
    return _table(_answer(block[told], _joint(anchor, body)[told], flags[told], 0), ANSWER_NAMES, ANSWER_TYPES)


def _last_digit(table: pa.Table) -> pa.Table:
    """Of a bucket's windows: which an earlier block holds."""
    block, window, _ = _gather(table)
    order = np.lexsort((block, window))
    block, window = block[order], window[order]
    new = np.ones(len(window), bool)
    new[1:] = window[1:] != window[:-1]
    holder = block[np.flatnonzero(new)][np.cumsum(new) - 1] if len(block) else block
    told = holder < block
    return _table(_answer(block[told], window[told], None, 1), ANSWER_NAMES, ANSWER_TYPES)


class Block:
    """A block's documents in order, and what the radix buckets have answered."""

    def __init__(self, docs: pa.Table, answers: pa.Table, length: int):
        docs = docs.append_column("__bytes", docs.column("text").cast(pa.binary())) if docs.num_rows else docs
        if docs.num_rows:
            docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending"), ("__bytes", "ascending")], null_placement="at_end"))
        self.docs, self.length = docs, length
        self.data, self.offsets = buffers(docs.column("text").combine_chunks() if docs.num_rows else pa.array([], pa.string()))
        told = [(k, np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint8) if y is not None else None) for k, x, y in zip(*(answers.column(c).to_pylist() for c in ("kind", "x", "y")), strict=True)]
        keys = np.concatenate([x for k, x, _ in told if k == 0] or [np.zeros(0, np.uint64)])
        flags = np.concatenate([y for k, _, y in told if k == 0] or [np.zeros(0, np.uint8)])
        order = np.argsort(keys)
        self.keys, self.flags = keys[order], flags[order]
        self.held = np.sort(np.concatenate([x for k, x, _ in told if k == 1] or [np.zeros(0, np.uint64)]))

    def intervals(self) -> list[tuple[Pass, np.ndarray, np.ndarray]]:
        """(pass, whether each of its intervals is a repeat as a whole, whether its windows must be looked at)."""
        sizes, joint, passes = [], [], []
        for p in _passes(self.data, self.offsets, self.length):
            sizes.append(len(p.first))
            joint.append(_joint(p.anchor_hash, p.body_hash))
            passes.append(p.slim())
        keys = np.concatenate(joint) if joint else np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        flags = np.where(self.keys[at] == keys, self.flags[at], 0) if len(self.keys) else np.zeros(len(keys), np.uint8)
        again = np.ones(len(keys), bool)
        again[np.unique(keys, return_index=True)[1]] = False
        whole = ((flags & EARLIER) > 0) | again
        look = ~whole & ((flags & MIXED) > 0)
        cuts = np.cumsum(sizes)[:-1]
        return list(zip(passes, np.split(whole, cuts), np.split(look, cuts), strict=True)) if sizes else []


def deduplicate(documents: DataFrame, length: int = LENGTH, blocks: int | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (byte ranges removed) and kept (the bytes that stay) of every row."""
    spark = documents.sparkSession
    if blocks is None:
        # a block's texts are in one task: as many blocks as a shuffle has partitions, more if these would hold too much
        size = documents.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
        blocks = max(blocks_of(spark), -(-size // BLOCK_BYTES))
    buckets = blocks
    bounds = id_bounds(documents, blocks)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", ordered_block(F.col("doc_id"), bounds).cast("int").alias("block"))

    @tidy
    def first_digit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            block = batch.column(2).to_numpy(zero_copy_only=False)
            data, offsets = buffers(batch.column(1))
            for p in _passes(data, offsets, length):
                of = block[p.text[p.part]]
                for b in np.unique(of):
                    pairs = np.stack([p.anchor_hash[of == b], p.body_hash[of == b]], 1)
                    found.setdefault(int(b), []).append(pairs)
        for b, lists in found.items():
            pairs = np.concatenate(lists)
            pairs = pairs[np.unique(_joint(pairs[:, 0], pairs[:, 1]), return_index=True)[1]]
            yield from _table(_deal(b, buckets, pairs[:, 0], pairs[:, 1]), PACKET_NAMES, PACKET_TYPES).to_batches()

    @tidy
    def windows(docs_table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(docs_table, answers, length)
        out = []
        for p, _, look in block.intervals():
            if look.any():
                out.append(p.window_hash(p.windows(np.flatnonzero(look))[1]))
            p.slim()
        number = (docs_table if docs_table.num_rows else answers).column("block")[0].as_py()
        rows = _deal(number, buckets, np.unique(np.concatenate(out))) if out else []
        return _table([(*r, None) for r in rows], PACKET_NAMES, PACKET_TYPES)

    @tidy
    def removed(docs_table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(docs_table, answers, length)
        n = block.docs.num_rows
        marks: list[list[np.ndarray]] = [[] for _ in range(n)]
        looked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def mark(text: np.ndarray, start: np.ndarray) -> None:
            cuts = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                marks[text[a]].append(start[a:b])

        for p, whole, look in block.intervals():
            if whole.any():
                interval, start = p.windows(np.flatnonzero(whole))
                part = p.part[interval]
                mark(p.text[part], start + p.shift[part])
            if look.any():
                interval, start = p.windows(np.flatnonzero(look))
                part = p.part[interval]
                looked.append((p.text[part], start + p.shift[part], p.window_hash(start)))
                p.slim()
        if looked:
            text, start, h = (np.concatenate(x) for x in zip(*looked, strict=True))
            repeat = np.ones(len(h), bool)
            repeat[np.unique(h, return_index=True)[1]] = False
            if len(block.held):
                repeat |= block.held[np.minimum(np.searchsorted(block.held, h), len(block.held) - 1)] == h
            mark(text[repeat], start[repeat])
        spans, kept = [], []
        for i in range(n):
            raw = block.data[block.offsets[i] : block.offsets[i + 1]]
            if not marks[i]:
                spans.append([])
                kept.append(raw.tobytes())
                continue
            change = np.zeros(len(raw) + 1, np.int32)
            start = np.concatenate(marks[i])
            np.add.at(change, start, 1)
            np.add.at(change, start + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            kept.append(raw[~gone].tobytes())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        ids = block.docs.column("doc_id").combine_chunks() if n else pa.array([], pa.int64())
        return pa.table([ids, pa.array(np.diff(block.offsets)[:n]), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    second = stored(docs.mapInArrow(first_digit, PACKET).groupBy("bucket").applyInArrow(_second_digit, ANSWER), "second-digit")
    by_block = docs.groupBy("block")
    last = by_block.cogroup(second.groupBy("block")).applyInArrow(windows, PACKET).groupBy("bucket").applyInArrow(_last_digit, ANSWER)
    return by_block.cogroup(second.unionByName(last).groupBy("block")).applyInArrow(removed, RESULT)
