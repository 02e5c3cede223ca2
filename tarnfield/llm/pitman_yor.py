"""Language-model scores by a hierarchical Pitman-Yor model.

The model has three layers of Chinese restaurants. Every training token sits in the
restaurant of the word before it (a text's first token in that of the end); a new
table there draws its word from the word restaurant, whose customers are these tables. A new table
of the word restaurant draws its word from a spelling model. The spelling
model is a hierarchy of byte restaurants, one for each context of the last two
bytes of the word; contexts with the same last byte share a parent, these share
the root, and below it all bytes are alike. Each table of the word restaurant
seats its word's spelling there. Outcomes are the known words and one more, a word
that training has not seen (as in the base score, whose denominator counts V + 1
outcomes): its probability is what the word restaurant leaves to new tables times
what the spelling model leaves to unknown spellings. The V + 1 add up to 1.

Seating is sampled by blocked Gibbs steps: all customers of one dish leave and are
seated again, given all other tables (how they sat before has no part in that
conditional, so only the others' tables are kept from sweep to sweep). The number of their tables is
drawn from the conditional itself, whose weights are generalised Stirling numbers: by their recursion for
up to LONG customers at up to EXACT tables, by their contour integral for more. Draws are hashes of dish and sweep:
a task that runs again draws the same. The first state has one table for each
dish. A sweep seats all three layers: the context restaurants given the words' probabilities, the word restaurant, whose customers
are the contexts' tables, given the spellings', and the byte restaurants. After the burn-in, the predictive probabilities of several
samples, each with its own seating of all layers, are averaged, and a text's score is the sum of its tokens' log10.

How it runs. Texts become blocks of up to BLOCK_TOKENS tokens: a block is one row of a
working table and holds its sorted distinct word hashes and its tokens as places among
them, packed. For each layer a block sends every bucket of the hash range the sorted
keys it holds with their counts, as one packed row; a bucket adds up the counts of all
blocks and answers in the order asked, so that answers carry no keys. A pair belongs to one of the
blocks that hold it, by its hash, which alone draws its tables; the others are told their sum over the samples. All counts cover all training texts. A key
costs a bucket one entry for each block, however frequent it is. The byte contexts have a
fixed bound (256**3 counts), so their seating is sampled on the driver.

Defined results: a null or empty text is one end token. Without training texts
every token is unknown, N is 0 and the score is 0, the log of certainty. Repeated rows
are training or held-out alike and each counts. An empty table gives an empty
result. Extra columns are ignored. A word that training has not seen is a context
without customers: what follows it comes from the word restaurant. A text's end is a token whose spelling is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.shared import WORK, Words, blocks_of, buffers, crc_mod, discard, gathered, mix, packed, stored, stored_alone, tidy, unpacked, words

CONCENTRATION = 1.0
BURN_IN, SAMPLES, BYTE_PASSES = 2, 3, 2
#: A table of generalised Stirling numbers goes to so many customers at so many tables; where more customers sit, or more tables carry weight,
#: the integral for an entry is used.
LONG, EXACT = 4096, 512
#: Points of the integral; logs of weights below the greatest that are still drawn from; dishes of a vectorised pass.
NODES, KEEP, PASS_DISHES = 24, 30.0, 1024
#: Dishes of at most EXACT customers that one pass draws, and numbers of tables weighed at a time.
DRAWN_DISHES, STEP = 1 << 14, 16
END_HASH = np.uint64(0xE2D)
SPACE = 0x20
#: Words of a task that one vectorised pass works on.
PASS_WORDS = 100_000
#: A block is closed by the text that reaches so many tokens.
BLOCK_TOKENS = 2_000_000
#: Bytes of text that one vectorised pass over texts works on.
PASS_BYTES = 1 << 19


def draw(key: np.ndarray, *salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1), a function of key and salt."""
    s = 0
    for x in salt:
        s = (s * 0x9E3779B97F4A7C15 + x + 1) % 2**64
    return ((mix(mix(key + np.uint64(s))) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


@lru_cache(maxsize=4)
def log_stirling(n: int, d: float, tables: int = 0) -> np.ndarray:
    """Logs of the generalised Stirling numbers: [c, t] is the weight of all seatings of c customers at t tables, for t of at most n, or at most `tables`."""
    wide = tables or n
    out = np.full((n + 1, wide + 2), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, wide + 1)
    for c in range(1, n):
        out[c + 1, 1:-1] = np.logaddexp(out[c, :-2], out[c, 1:-1] + np.log(np.maximum(c - t * d, 1e-300)))
    return out


def drawn(c: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, theta: float, u: np.ndarray) -> np.ndarray:
    """Tables of dishes of at most LONG customers, drawn from their exact conditional by uniform numbers u.

    Weights are a single hill over the numbers of tables: they are taken STEP at a time until e^-KEEP below the heaviest.
    A dish that has not come so far at EXACT tables is not drawn (NaN).
    """
    stirling = log_stirling(LONG, d, EXACT)
    order = np.argsort(-c, kind="stable")
    out = np.empty(len(c))
    for begin in range(0, len(c), DRAWN_DISHES):
        here = order[begin : begin + DRAWN_DISHES]
        n, log_base, o = c[here].astype(np.int64), np.log(base[here] * d), others[here] + theta / d
        parts, top, carry, some, t = [], np.full(len(n), -np.inf), np.zeros(len(n)), np.arange(len(n)), 1
        while len(some) and t <= EXACT:
            step = np.arange(t, min(t + STEP, int(n[some[0]]) + 1, EXACT + 1))
            w = np.cumsum(np.log(o[some, None] + (step - 1)) + log_base[some, None], axis=1)
            w += carry[some, None]
            carry[some] = w[:, -1]
            w += stirling[n[some, None], step]
            parts.append((t, some, w))
            top[some] = np.maximum(top[some], w.max(1))
            t = int(step[-1]) + 1
            some = some[(n[some] >= t) & (w[:, -1] > top[some] - KEEP)]
        open_, total = some, np.zeros(len(n))
        for _, some, w in parts:
            w -= top[some, None]
            np.exp(w, out=w)
            total[some] += w.sum(1)
        left, found = u[here] * total, np.ones(len(n))
        for t, some, w in parts:
            up = np.cumsum(w, axis=1)
            before = (up < left[some, None]).sum(1)
            inside = (left[some] > 0) & (before < w.shape[1])
            found[some[inside]] = t + before[inside]
            # what has been found asks for nothing more
            left[some] = np.where(inside, -1.0, left[some] - up[:, -1])
        out[here] = np.minimum(found, n)
        out[here[open_]] = np.nan
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function of positive numbers, by Stirling's series from 8 on."""
    x = np.asarray(x, float).copy()
    low = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        low += np.where(small, np.log(np.where(small, x, 1.0)), 0.0)
        x += small
    r = 1 / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + r * (1 / 12 - r * r * (1 / 360 - r * r / 1260)) - low


def log_stirling_at(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log_stirling's entry for any number of customers c > t, as an integral; within 1e-4 of the recursion's for c > 64.

    With f(x) = (1 - (1 - x)^d) / d the number is c!/t! times the coefficient of x^c in f^t. Its contour crosses the real line where
    the integrand is least, or 1/c before the branch point at 1. Up to a half of the way to 0 it is a parabola around the cut
    behind 1, further on a circle around 0.
    """
    out = np.empty(len(c))
    all_n, all_t = np.asarray(c, float), np.asarray(t, float)
    far = _crossing(all_n, all_t, d, False) > 0.5
    for some, circle in ((~far, False), (far, True)):
        n, k = all_n[some], all_t[some]
        if not len(n):
            continue
        at = _crossing(n, k, d, circle)
        if circle:
            ratio = lambda x: k * x * d * (1 - x) ** (d - 1) / -np.expm1(d * np.log1p(-x))  # noqa: E731, B023
            spread = np.maximum((ratio(at * 1.0001) - ratio(at * 0.9999)) / 2e-4, 1e-9)
            width = np.minimum(np.pi, 16 / np.sqrt(spread)) / NODES
            x = at[:, None] * np.exp(1j * (np.arange(NODES) + 0.5) * width[:, None])
            log_y, part = np.log1p(-x), x
        else:
            # until the peak's bell or, where few tables make it wide, the power's decay has gone down to e^-18
            decay = np.expm1(18 / (n - k + 1)) / at
            width = np.minimum(np.sqrt(18 / (n * at * (1 - d))), np.sqrt(1 + decay)) / NODES
            turn = 1 + 1j * (np.arange(NODES) + 0.5) * width[:, None]
            log_y = np.log(at)[:, None] + 2 * np.log(turn)
            x, part = -np.expm1(log_y), 2 * at[:, None] * turn
        height = k[:, None] * np.log(-np.expm1(d * log_y) / d) - (n[:, None] + 1) * np.log(x)
        top = height.real.max(1)
        area = (np.exp(height - top[:, None]) * part).real.sum(1) * width / np.pi
        out[some] = top + np.log(np.maximum(area, 1e-300)) + log_gamma(n + 1) - log_gamma(k + 1)
    return out


def _crossing(n: np.ndarray, t: np.ndarray, d: float, from_zero: bool) -> np.ndarray:
    """Where the contour crosses the real line, as the distance from 1, or from 0 where that is the short one; by bisection of its log."""
    low, high = np.log((1e-3 if from_zero else 1.0) / n), np.full(len(n), np.log(0.9) if from_zero else 0.0)
    for _ in range(24 if from_zero else 14):
        mid = (low + high) / 2
        x = np.exp(mid) if from_zero else -np.expm1(mid)
        log_y = np.log1p(-x) if from_zero else mid
        before = t * x * d * np.exp((d - 1) * log_y) / -np.expm1(d * log_y) < n
        up = before if from_zero else ~before
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return np.exp(low)


def drawn_among_many(c: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, theta: float, u: np.ndarray) -> np.ndarray:
    """As drawn, for dishes of any number of customers above 64 and uniform numbers u.

    Logs of weights are taken at some numbers of tables, closing in on those within e^-KEEP of the heaviest, and
    interpolated between these: the weight of many tables is a smooth, single hill.
    """
    out = np.empty(len(c))
    for begin in range(0, len(c), PASS_DISHES):
        here = slice(begin, begin + PASS_DISHES)
        n, b, o, r = c[here].astype(float), np.log(base[here]) + np.log(d), others[here] + theta / d, u[here]
        low, high = np.ones(len(n)), n - 1

        def weights(t: np.ndarray) -> np.ndarray:
            wide = lambda x: np.repeat(x, t.shape[1])  # noqa: E731, B023
            flat = t.ravel()
            return (log_stirling_at(wide(n), flat, d) + flat * wide(b) + log_gamma(wide(o) + flat)).reshape(t.shape)  # noqa: B023

        for turn in range(3):
            share = np.linspace(0, 1, 12)
            t = low[:, None] * (high / low)[:, None] ** share if turn == 0 else low[:, None] + (high - low)[:, None] * share
            t = np.rint(t)
            w = weights(t)
            best = w.argmax(1)
            light = w < w.max(1)[:, None] - KEEP
            place = np.arange(t.shape[1])
            left = np.where(light & (place < best[:, None]), place, -1).max(1)
            right = np.where(light & (place > best[:, None]), place, t.shape[1]).min(1)
            at = lambda i: t[np.arange(len(n)), np.clip(i, 0, t.shape[1] - 1)]  # noqa: E731, B023
            # a hill may lie between two numbers: its neighbours stay
            low, high = at(np.minimum(left, best - 1)), at(np.maximum(right, best + 1))
        t = low[:, None] + (high - low)[:, None] * np.linspace(0, 1, 25)
        t = np.rint(t)
        w = weights(t)
        for i in range(len(n)):
            kinds, first = np.unique(t[i], return_index=True)
            steps = kinds if len(kinds) == 1 else np.unique(np.rint(np.linspace(kinds[0], kinds[-1], min(int(kinds[-1] - kinds[0]) + 1, 1025))))
            logs = w[i][first]
            if len(steps) > len(kinds):
                logs = _between(kinds, logs, steps)
            up = np.cumsum(np.exp(logs - logs.max()))
            out[begin + i] = steps[min(int(np.searchsorted(up, r[i] * up[-1])), len(steps) - 1)]
    return out


def _between(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values of a smooth function between its known points, by cubics through the four nearest."""
    i = np.clip(np.searchsorted(x, at, "right") - 2, 0, len(x) - 4)
    out = np.zeros(len(at))
    for j in range(4):
        part = y[i + j].copy()
        for k in range(4):
            if k != j:
                part *= (at - x[i + k]) / (x[i + j] - x[i + k])
        out += part
    return out


def gibbs(c: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, theta: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish after a sweep: draws from their conditional given all other tables."""
    out = np.empty(len(c))
    u, few = draw(key, sweep, 0), c <= LONG
    out[few] = drawn(c[few], base[few], others[few], d, theta, u[few])
    out[~few] = np.nan
    many = np.isnan(out)
    out[many] = drawn_among_many(c[many], base[many], others[many], d, theta, u[many])
    return out


def _discount(once: float, twice: float) -> float:
    return float(np.clip(once / max(once + 2 * twice, 1.0), 0.05, 0.95))


def discount(counts: np.ndarray) -> float:
    return _discount(float((counts == 1).sum()), float((counts == 2).sum()))


def _renumbered(codes: np.ndarray, number: np.ndarray) -> np.ndarray:
    n = int(number.max()) + 1 if len(number) else 1
    return (number[codes >> 16] * n + number[(codes >> 8) & 0xFF]) * n + number[codes & 0xFF]


@dataclass
class Spelling:
    """Predictive probabilities of the byte restaurants: seen codes add a term, the rest is the parent's share."""

    codes: np.ndarray  # (b1 << 16) | (b2 << 8) | b3 of seen bytes in contexts b1 b2
    own: np.ndarray
    share: np.ndarray  # by context b1 b2: what goes to the parent
    parent: np.ndarray  # 256 x 256: probability of a byte after the last byte

    @classmethod
    def sampled(cls, codes: np.ndarray, counts: np.ndarray, sweep: int) -> Spelling:
        """Gibbs seating of the byte restaurants, children before parents."""
        flat = np.full(256, 1 / 256)

        def level(c: np.ndarray, ctx: np.ndarray, base: np.ndarray, key: np.ndarray, n_ctx: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            d = discount(c)
            customers = np.bincount(ctx, c, n_ctx)
            t = np.minimum(c, 1.0)  # the first state
            for i in range(BYTE_PASSES):
                others = np.bincount(ctx, t, n_ctx)[ctx] - t
                t = gibbs(c, base, others, d, CONCENTRATION, key, sweep * 1009 + salt * 31 + i)
            tables = np.bincount(ctx, t, n_ctx)
            own = (c - d * t) / (CONCENTRATION + customers[ctx])
            return t, own, (CONCENTRATION + d * tables) / (CONCENTRATION + customers)

        codes = codes.astype(np.int64)
        counts = counts.astype(float)
        # parents start from the least seating: a table for each child
        pair, at = np.unique(codes & 0xFFFF, return_inverse=True)
        key = lambda x: mix(x.astype(np.uint64) + np.uint64(11))
        c1 = np.bincount(at, minlength=len(pair)).astype(float)
        parent = flat
        for turn in range(2):
            byte, at0 = np.unique(pair & 0xFF, return_inverse=True)
            if turn == 0:
                c0 = np.bincount(at0, minlength=len(byte)).astype(float)
            _, own0, share0 = level(c0, np.zeros(len(byte), np.int64), flat[byte], key(byte), 1, 3 * turn)
            root = share0[0] * flat
            root[byte] += own0
            t1, own1, share1 = level(c1, pair >> 8, root[pair & 0xFF], key(pair + 512), 256, 3 * turn + 1)
            parent = share1[:, None] * root[None, :]
            parent[pair >> 8, pair & 0xFF] += own1
            t2, own2, share2 = level(counts, codes >> 8, parent[(codes >> 8) & 0xFF, codes & 0xFF], key(codes + (1 << 20)), 1 << 16, 3 * turn + 2)
            c1 = np.bincount(at, t2, len(pair))
            c0 = np.bincount(at0, t1, len(byte))
        return cls(codes, own2, share2, parent)

    @classmethod
    def flat(cls) -> Spelling:
        return cls(np.zeros(0, np.int64), np.zeros(0), np.ones(1 << 16), np.full((256, 256), 1 / 256))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(a number for each byte, the own part of every code of these numbers): seen bytes are few, the others share one."""
        seen = np.zeros(256, bool)
        for shift in (0, 8, 16):
            seen[(self.codes >> shift) & 0xFF] = True
        number = np.where(seen, np.cumsum(seen) - 1, seen.sum()).astype(np.int64)
        out = np.zeros((int(seen.sum()) + 1) ** 3, np.float32)
        out[_renumbered(self.codes, number)] = self.own
        return number, out

    def probability(self, codes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        number, own = table
        return own[_renumbered(codes, number)] + self.share[codes >> 8] * self.parent[(codes >> 8) & 0xFF, codes & 0xFF]


def spelled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all bytes, word of each) of words with a space before and after; starts have two spaces of context."""
    data, offsets = buffers(column)
    size = np.diff(offsets)
    n = size + 1
    word = np.repeat(np.arange(len(size)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    src = np.minimum(offsets[:-1][word] + place, max(len(data) - 1, 0))
    raw = data[src].astype(np.int64) if len(data) else np.full(len(src), SPACE, np.int64)
    b3 = np.where(place < size[word], raw, SPACE)
    b2 = np.where(place >= 1, np.roll(b3, 1), SPACE)
    b1 = np.where(place >= 2, np.roll(b3, 2), SPACE)
    return (b1 << 16) | (b2 << 8) | b3, word


@dataclass
class Sweep:
    """What seating a sweep's words needs."""

    number: int
    spelling: Spelling
    tables: float  # in the word restaurant before it
    after: float = 0.0  # tables after it
    known: float = 0.0  # what the spelling model gives all known words
    customers: float = 0.0  # in the word restaurant


@dataclass
class Model:
    discount: float
    tokens: int
    kinds: int
    sweeps: list[Sweep]


def _seat_words(h: np.ndarray, c: np.ndarray, g0: np.ndarray, d: float, sweep: Sweep) -> np.ndarray:
    out = np.zeros(len(c))
    has = c > 0
    others = np.full(has.sum(), max(sweep.tables - 1, 0.0))
    out[has] = gibbs(c[has].astype(float), g0[has], others, d, CONCENTRATION, h[has], sweep.number)
    return out


def _g0(spelling: Spelling, table: tuple[np.ndarray, np.ndarray], codes: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    return np.exp(np.bincount(word, np.log(spelling.probability(codes, table)), n))


# ---------------------------------------------------------------- blocks of texts

BLOCK = "block long, ids binary, nulls binary, held binary, sizes binary, vocab binary, counts binary, lens binary, words binary, tokens binary"


@dataclass
class Block:
    """The texts of a block as places of their tokens among the block's sorted distinct word hashes."""

    ids: np.ndarray
    nulls: np.ndarray
    held: np.ndarray
    sizes: np.ndarray  # tokens of each text, its end included
    vocab: np.ndarray
    tokens: np.ndarray

    @classmethod
    def read(cls, row: pa.Table) -> Block:
        get = lambda name, kind, rising=False: unpacked(row.column(name)[0].as_py(), kind, rising)
        return cls(get("ids", np.int64), get("nulls", np.uint8), get("held", np.uint8), get("sizes", np.int64), get("vocab", np.uint64, True), get("tokens", np.int32))

    def before(self) -> np.ndarray:
        """Each token's context: the place of the token before it, for a text's first that of the end."""
        end = np.searchsorted(self.vocab, END_HASH)
        return np.concatenate([[end], self.tokens[:-1]]).astype(np.int32)

    def trains(self) -> np.ndarray:
        return np.repeat(self.held == 0, self.sizes)


@dataclass
class Pairs:
    """The distinct (word before, word) pairs of a block in the order of their hashes."""

    keys: np.ndarray
    prev: np.ndarray  # places in the block's vocabulary
    word: np.ndarray
    counts: np.ndarray  # training tokens in this block
    of: np.ndarray  # each token's pair

    @classmethod
    def found(cls, block: Block) -> Pairs:
        prev = block.before()
        key = _pair_key(block.vocab[prev], block.vocab[block.tokens])
        order = np.argsort(key)
        k = key[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        start = np.flatnonzero(new)
        of = np.empty(len(k), np.int32)
        of[order] = np.cumsum(new) - 1
        counts = np.bincount(of[block.trains()], minlength=len(start))
        first = order[start]
        return cls(k[start], prev[first], block.tokens[first], counts, of)


def _pair_key(prev: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(mix(prev) * np.uint64(3) + h)


class _Gatherer:
    """Texts on their way into a block."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.tokens = 0

    def add(self, w: Words, ids: pa.Array, held: np.ndarray) -> None:
        order = np.argsort(w.hash)
        h = w.hash[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        place = np.empty(len(h), np.int32)
        place[order] = np.cumsum(new, dtype=np.int32) - 1
        some = ids.slice(w.first, w.n_docs)
        self.parts.append((h[new], _texts(w, order[new]), place, w.counts + 1, some.fill_null(0).to_numpy(), some.is_null().to_numpy(zero_copy_only=False), held[w.first : w.first + w.n_docs]))
        self.tokens += len(h) + w.n_docs

    def close(self, number: int) -> pa.RecordBatch:
        every = np.concatenate([*(p[0] for p in self.parts), [END_HASH]]).astype(np.uint64)
        vocab, first, at = np.unique(every, return_index=True, return_inverse=True)
        text = pa.concat_arrays([*(p[1] for p in self.parts), pa.array([""])]).take(pa.array(first))
        at, cut, tokens = at.astype(np.int32), 0, []
        for h, _, place, sizes, *_ in self.parts:
            # a text's end follows its words
            stream = np.empty(len(place) + len(sizes), np.int32)
            word = np.ones(len(stream), bool)
            word[np.cumsum(sizes) - 1] = False
            stream[word], stream[~word] = at[cut : cut + len(h)][place], at[-1]
            tokens.append(stream)
            cut += len(h)
        tokens = np.concatenate(tokens)
        sizes, ids, nulls, held = (np.concatenate([p[i] for p in self.parts]) for i in (3, 4, 5, 6))
        counts = np.bincount(tokens[np.repeat(held == 0, sizes)], minlength=len(vocab))
        data, offsets = buffers(text)
        cells = [packed(ids), packed(nulls.astype(np.uint8)), packed(held.astype(np.uint8)), packed(sizes), packed(vocab, True), packed(counts.astype(np.int64)), packed(np.diff(offsets)), packed(data[offsets[0] : offsets[-1]]), packed(tokens)]
        self.parts, self.tokens = [], 0
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([c], pa.binary()) for c in cells]], names=[x.split()[0] for x in BLOCK.split(", ")])


def blocks(documents: DataFrame, training: Column) -> DataFrame:
    """The working table of blocks; a block has the texts of one task."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~training).cast("int").alias("held"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = _Gatherer(), TaskContext.get().partitionId() << 24
        for batch in batches:
            held = batch.column(2).to_numpy(zero_copy_only=False)
            for w in words(batch.column(1), size=PASS_BYTES):
                block.add(w, batch.column(0), held)
                if block.tokens >= BLOCK_TOKENS:
                    yield block.close(number)
                    number += 1
        if block.parts:
            yield block.close(number)

    return stored(docs.mapInArrow(run, BLOCK), "blocks")


# ---------------------------------------------------------------- blocks ask, buckets answer

ASK = "bucket int, block long, keys binary, a binary, b binary"
ANSWER = "block long, kind int, bucket int, a binary, b binary, c binary, n long, m long"
_ASK_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_ANSWER_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
OF_PAIRS, OF_WORDS, OF_STATE, OF_SHARED, OF_SAMPLES = 0, 1, 2, 3, 4
OWN, SHARED = 1, 2


def _rows(rows: list[tuple], spec: str, types: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in spec.split(", ")])


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's stretch of the sorted keys begins; buckets share out the range of hashes."""
    edges = np.array([-(-(k << 64) // buckets) for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _asks(block: int, buckets: int, keys: np.ndarray, *counts: np.ndarray) -> list[tuple]:
    cuts = _cuts(keys, buckets)
    cells = lambda a, b: [packed(x[a:b]) for x in counts] + [None] * (2 - len(counts))
    return [(k, block, packed(keys[a:b], True), *cells(a, b)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _asked(table: pa.Table, kind: type = np.int64) -> list[tuple[int, np.ndarray, np.ndarray | None, np.ndarray | None]]:
    """(block, keys, counts, counts) of a bucket's rows, in the order of blocks."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("block", "keys", "a", "b")), strict=True), key=lambda r: r[0])
    return [(block, unpacked(keys, np.uint64, True), *(None if x is None else unpacked(x, kind) for x in (a, b))) for block, keys, a, b in rows]


def _answers(table: pa.Table, kind: int, keys: np.ndarray, buckets: int, *kinds: type) -> list[np.ndarray]:
    """The arrays that the buckets answered, in the order of keys."""
    cuts = _cuts(keys, buckets)
    out = [np.zeros(len(keys), k) for k in kinds]
    some = table.filter(pc.equal(table.column("kind"), kind))
    for row in some.select(["bucket", "a", "b", "c"]).to_pylist():
        for x, name, k in zip(out, "abc", kinds, strict=False):
            x[cuts[row["bucket"]] : cuts[row["bucket"] + 1]] = unpacked(row[name], k)
    return out


def vocabulary(of_blocks: DataFrame, buckets: int) -> DataFrame:
    """bucket, h, word, c (training tokens) of every distinct word."""

    @tidy
    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts, lens = unpacked(row["vocab"], np.uint64, True), unpacked(row["counts"], np.int64), unpacked(row["lens"], np.int64)
                data, at = unpacked(row["words"], np.uint8), np.concatenate([[0], np.cumsum(lens)])
                cuts = _cuts(keys, buckets)
                out = [(k, row["block"], packed(keys[a:b], True), packed(counts[a:b]), packed(lens[a:b]), packed(data[at[a] : at[b]])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                yield from _rows(out, f"{ASK}, words binary", [*_ASK_TYPES, pa.binary()]).to_batches()

    @tidy
    def counted(table: pa.Table) -> pa.Table:
        asked = _asked(table)
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        data = [unpacked(table.column("words")[int(i)].as_py(), np.uint8) for i in order]
        keys, first, at = np.unique(np.concatenate([x[1] for x in asked]), return_index=True, return_inverse=True)
        c = np.bincount(at, np.concatenate([x[2] for x in asked]), len(keys)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([x[3] for x in asked]))])
        text = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(np.concatenate(data).tobytes()))
        bucket = pa.array(np.full(len(keys), table.column("bucket")[0].as_py(), np.int32))
        return pa.table([bucket, pa.array(keys.view(np.int64)), text.take(pa.array(first)).cast(pa.string()), pa.array(c)], names=["bucket", "h", "word", "c"])

    asked = of_blocks.select("block", "vocab", "counts", "lens", "words").mapInArrow(asks, f"{ASK}, words binary")
    return asked.groupBy("bucket").applyInArrow(counted, "bucket int, h long, word string, c long")


def pair_counts(of_blocks: DataFrame, buckets: int) -> DataFrame:
    """Answers: for each of a block's pairs, the training tokens in other blocks (a), and OWN where it is the block's own,
    with SHARED where other blocks hold it too (b). n and m: own pairs that training has once and twice."""

    @tidy
    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                pairs = Pairs.found(Block.read(row))
                yield from _rows(_asks(row.column("block")[0].as_py(), buckets, pairs.keys, pairs.counts), ASK, _ASK_TYPES).to_batches()

    @tidy
    def added(table: pa.Table) -> pa.Table:
        asked = _asked(table)
        keys, counts = (np.concatenate([x[i] for x in asked]) for i in (1, 2))
        order = np.argsort(keys, kind="stable")  # of equal keys the lowest block's comes first; the hash says which is the owner's
        k = keys[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        at = np.empty(len(k), np.int64)
        at[order] = np.cumsum(new) - 1
        total = np.bincount(at, counts).astype(np.int64)
        start = np.flatnonzero(new)
        holders = np.diff(start, append=len(k))
        own = np.where(holders[at] > 1, SHARED, 0).astype(np.uint8)
        own[order[start + (mix(k[start]) % holders.astype(np.uint64)).astype(np.int64)]] |= OWN
        rows, cut, bucket = [], 0, table.column("bucket")[0].as_py()
        for block, mine, c, _ in asked:
            part = slice(cut, cut + len(mine))
            all_c, owned = total[at[part]], own[part]
            rows.append((block, OF_PAIRS, bucket, packed(all_c - c), packed(owned), None, int(((all_c == 1) & (owned & OWN > 0)).sum()), int(((all_c == 2) & (owned & OWN > 0)).sum())))
            cut += len(mine)
        return _rows(rows, ANSWER, _ANSWER_TYPES)

    return of_blocks.mapInArrow(asks, ASK).groupBy("bucket").applyInArrow(added, ANSWER)


def _of_block(of_blocks: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """run(the block's row, its answers) for every block."""
    return of_blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tidy(run), schema)


def _of_bucket(asks: DataFrame, vocab: DataFrame, run, schema: str) -> DataFrame:
    """run(asks of the bucket, its words sorted by hash) for every bucket."""

    def sort(asked: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known.column("h").to_numpy().view(np.uint64))
        return run(asked, known.take(pa.array(order)))

    return asks.groupBy("bucket").cogroup(vocab.groupBy("bucket")).applyInArrow(tidy(lambda asked, known: sort(asked, known)), schema)


SEATS = "block long, vocab binary, prev binary, word binary, counts binary, kinds binary, heads binary"


def seats(of_blocks: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """What sweeps need of each block: its own pairs of two customers or more, and for each of its words the own pairs of one customer
    (who has one table in every sweep) that end with it (kinds) and begin with it (heads)."""

    def run(row: pa.Table, told: pa.Table) -> pa.Table:
        block = Block.read(row)
        pairs = Pairs.found(block)
        c = _owned(pairs, told, buckets)
        some, once = c > 1, c == 1
        sums = [np.bincount(x[once], minlength=len(block.vocab)) for x in (pairs.word, pairs.prev)]
        cells = [packed(block.vocab, True), packed(pairs.prev[some]), packed(pairs.word[some]), packed(c[some]), *map(packed, sums)]
        return _rows([(row.column("block")[0].as_py(), *cells)], SEATS, [pa.int64(), *[pa.binary()] * 6])

    return _of_block(of_blocks, answers, run, SEATS)


def _owned(pairs: Pairs, told: pa.Table, buckets: int) -> np.ndarray:
    """Training tokens of a block's own pairs, 0 for those of other blocks."""
    more, own = _answers(told, OF_PAIRS, pairs.keys, buckets, np.int64, np.uint8)
    return np.where(own & OWN, pairs.counts + more, 0)


def swept(of_seats: DataFrame, told: DataFrame, buckets: int, d: float, number: int) -> DataFrame:
    """A sweep over all pairs, given the words' probabilities and the tables of their restaurants (OF_WORDS) and how the pairs sat
    (OF_STATE); without these the first state, of one table a pair.

    Asks: the customers that a block's own pairs send to the word restaurant (a) and their tables in the word's own restaurant (b).
    A row of bucket -1 has the pairs' tables (a) and their sums over the samples (b).
    """

    def run(row: pa.Table, told: pa.Table) -> pa.Table:
        get = lambda name, kind, rising=False: unpacked(row.column(name)[0].as_py(), kind, rising)
        vocab, prev, word, c = get("vocab", np.uint64, True), get("prev", np.int32), get("word", np.int32), get("counts", np.int64)
        t, total = np.ones(len(c), np.int64), np.zeros(len(c), np.int64)
        if len(told):
            [was] = told.filter(pc.equal(told.column("kind"), OF_STATE)).select(["a", "b"]).to_pylist()
            tables, p = _answers(told, OF_WORDS, vocab, buckets, np.int64, np.float32)
            others = tables[prev] - unpacked(was["a"], np.int64)
            t = gibbs(c.astype(float), p[word].astype(float), others.astype(float), d, CONCENTRATION, _pair_key(vocab[prev], vocab[word]), number).astype(np.int64)
            total = unpacked(was["b"], np.int64) + (t if number >= BURN_IN else 0)
        sums = [get(name, np.int64) + np.bincount(x, t, len(vocab)).astype(np.int64) for name, x in (("kinds", word), ("heads", prev))]
        block = row.column("block")[0].as_py()
        return _rows([*_asks(block, buckets, vocab, *sums), (-1, block, None, packed(t), packed(total))], ASK, _ASK_TYPES)

    return _of_block(of_seats, told, run, ASK)


def states(of_sweep: DataFrame) -> DataFrame:
    """The rows of a sweep that say how pairs sit, as answers to their blocks."""
    zero = F.lit(0).cast("long")
    return of_sweep.where("bucket < 0").select("block", F.lit(OF_STATE).alias("kind"), "bucket", "a", "b", F.lit(None).cast("binary").alias("c"), zero.alias("n"), zero.alias("m"))


WORDS = "bucket int, h long, word string, c long, k long, t long, seated long, g0 double, codes array<long>, tables array<long>"


def _sums(asked: pa.Table, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What blocks send for each word of a bucket, added up."""
    asks = [(np.searchsorted(h, keys), a, b) for _, keys, a, b in _asked(asked)]
    return tuple(sum((np.bincount(x[0], x[i], len(h)) for x in asks), np.zeros(len(h))).astype(np.int64) for i in (1, 2))


def seated_words(of_sweep: DataFrame, known: DataFrame, sweep: Sweep, d: float) -> DataFrame:
    """known (bucket, h, word, c, seated: tables so far) after a sweep over the words: customers k, tables t of the word's own restaurant,
    tables, and g0, what the spelling model gives the word. A bucket's first row has the tables of its spellings' codes."""
    sent = known.sparkSession.sparkContext.broadcast((sweep, d))

    def run(asked: pa.Table, words: pa.Table) -> pa.Table:
        s, dd = sent.value
        h, c = words.column("h").to_numpy().view(np.uint64), words.column("c").to_numpy()
        k, t = _sums(asked, h)
        was, seated, g0 = words.column("seated").to_numpy(), np.zeros(len(h), np.int64), np.zeros(len(h))
        table, seen, sums = s.spelling.table(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        has = np.flatnonzero(c > 0)
        for a in range(0, len(has), PASS_WORDS):
            part = has[a : a + PASS_WORDS]
            codes, word = spelled(words.column("word").take(pa.array(part)))
            g0[part] = _g0(s.spelling, table, codes, word, len(part))
            if s.number < 0:
                seated[part] = 1
            else:
                seated[part] = gibbs(k[part].astype(float), g0[part], s.tables - was[part].astype(float), dd, CONCENTRATION, h[part], s.number)
            keys, more = _by_code(codes, seated[part][word])
            seen, at = np.unique(np.concatenate([seen, keys]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([sums, more]), len(seen)).astype(np.int64)
        first = lambda x: pa.array([x, *[None] * (len(h) - 1)], pa.list_(pa.int64()))
        cells = [words.column("bucket"), words.column("h"), words.column("word"), words.column("c"), pa.array(k), pa.array(t), pa.array(seated), pa.array(g0), first(seen), first(sums)]
        return pa.table(cells, names=[x.split()[0] for x in WORDS.split(", ")])

    return _of_bucket(of_sweep.where("bucket >= 0"), known, run, WORDS)


def _by_code(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of n by code, in the order of codes; the bytes that occur are numbered, so that sums are counted and not sorted."""
    byte = np.zeros(256, bool)
    for shift in (0, 8, 16):
        byte[(codes >> shift) & 0xFF] = True
    sums = np.bincount(_renumbered(codes, np.cumsum(byte) - 1), n)
    at, bytes_, size = np.flatnonzero(sums), np.flatnonzero(byte), int(byte.sum())
    return (bytes_[at // size**2] << 16) | (bytes_[at // size % size] << 8) | bytes_[at % size], sums[at]


def told_words(of_sweep: DataFrame, of_words: DataFrame, sweep: Sweep, d: float) -> DataFrame:
    """Answers: for each of a block's words the tables of its own restaurant (a), its probability in the word restaurant (b) and, after the last sweep, its training tokens (c)."""
    last = sweep.number == BURN_IN + SAMPLES - 1
    base = CONCENTRATION + d * sweep.after
    customers, left = CONCENTRATION + sweep.customers, 1 - min(sweep.known, 1.0)

    def run(asked: pa.Table, words: pa.Table) -> pa.Table:
        h, c, k, t, seated, g0 = (words.column(x).to_numpy() for x in ("h", "c", "k", "t", "seated", "g0"))
        p = np.where(c > 0, np.maximum(k - d * seated + base * g0, 1e-30 * customers), base * left) / customers
        rows = []
        for block, keys, _, _ in _asked(asked):
            at = np.searchsorted(h.view(np.uint64), keys)
            rows.append((block, OF_WORDS, asked.column("bucket")[0].as_py(), packed(t[at]), packed(p[at].astype(np.float32)), packed(c[at]) if last else None, 0, 0))
        return _rows(rows, ANSWER, _ANSWER_TYPES)

    nothing = F.lit(None).cast("binary")
    asks = of_sweep.where("bucket >= 0").select("bucket", "block", "keys", nothing.alias("a"), nothing.alias("b"))
    return _of_bucket(asks, of_words.select("bucket", "h", "c", "k", "t", "seated", "g0"), run, ANSWER)


def sampled(of_seats: DataFrame, vocab: DataFrame, buckets: int, d: float, since: int) -> tuple[list[DataFrame], DataFrame]:
    """(what words are told in each sample, how pairs sit in the end): every sweep seats the pairs given the words' probabilities, the
    words given the pairs' tables and the spellings given the words' tables."""
    spark = of_seats.sparkSession
    told, state, known = spark.createDataFrame([], ANSWER), Sweep(-1, Spelling.flat(), 0.0), vocab.withColumn("seated", F.lit(0).cast("long"))
    samples, before, of_word = [], None, 0.0
    for number in range(-1, BURN_IN + SAMPLES):
        # what a step was the last to read goes before the next one writes
        of_sweep = stored(swept(of_seats, told, buckets, d, number), f"sweep{number}")
        if before is not None:
            discard(spark, since, f"sweep{before}", *([f"told{before}"] if before < BURN_IN else []))
        of_words = stored(seated_words(of_sweep, known, state, of_word), f"words{number}")
        discard(spark, since, "vocabulary" if before is None else f"words{before}")
        sums = of_words.agg(F.sum("k").alias("k"), F.sum("seated").alias("t"), F.sum("g0").alias("g0"), F.count_if(F.col("k") == 1).alias("n1"), F.count_if(F.col("k") == 2).alias("n2")).first()
        of_word = _discount(sums.n1, sums.n2) if number < 0 else of_word
        state.after, state.known, state.customers = float(sums.t), sums.g0, float(sums.k)
        answers = stored(told_words(of_sweep, of_words, state, of_word), f"told{number}")
        if number >= BURN_IN:
            samples.append(answers)
        if number + 1 < BURN_IN + SAMPLES:
            # at most 256**3 codes
            got = of_words.where("codes is not null").select(F.inline(F.arrays_zip("codes", "tables"))).groupBy("codes").agg(F.sum("tables").alias("n")).orderBy("codes").toArrow()
            state = Sweep(number + 1, Spelling.sampled(got.column("codes").to_numpy(), got.column("n").to_numpy(), number + 2), float(sums.t))
        told, known = answers.unionByName(states(of_sweep)), of_words.select("bucket", "h", "word", "c", "seated")
        before = number
    discard(spark, since, f"words{before}")
    return samples, states(of_sweep)


def shared_tables(of_blocks: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """Answers: for a block's pairs of two customers or more that other blocks hold too, their tables summed over the samples (a), as their owner has them."""

    def asks(row: pa.Table, told: pa.Table) -> pa.Table:
        pairs = Pairs.found(Block.read(row))
        c, shared, total = _told_pairs(pairs, told, buckets)
        return _rows(_asks(row.column("block")[0].as_py(), buckets, pairs.keys[shared], total[shared]), ASK, _ASK_TYPES)

    @tidy
    def added(table: pa.Table) -> pa.Table:
        asked = _asked(table)
        kinds, at = np.unique(np.concatenate([x[1] for x in asked]), return_inverse=True)
        total = np.bincount(at, np.concatenate([x[2] for x in asked]), len(kinds)).astype(np.int64)[at]
        cuts = np.cumsum([0, *(len(x[1]) for x in asked)])
        rows = [(x[0], OF_SHARED, table.column("bucket")[0].as_py(), packed(total[a:b]), None, None, 0, 0) for x, a, b in zip(asked, cuts[:-1], cuts[1:], strict=True)]
        return _rows(rows, ANSWER, _ANSWER_TYPES)

    return _of_block(of_blocks, answers, asks, ASK).groupBy("bucket").applyInArrow(added, ANSWER)


def _told_pairs(pairs: Pairs, told: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(training tokens, whether others hold it and its tables vary, the tables of own pairs that vary summed over the samples) of a block's pairs."""
    more, own = _answers(told, OF_PAIRS, pairs.keys, buckets, np.int64, np.uint8)
    c, total = pairs.counts + more, np.zeros(len(pairs.keys), np.int64)
    for was in told.filter(pc.equal(told.column("kind"), OF_STATE)).column("b").to_pylist():
        total[(own & OWN > 0) & (c > 1)] = unpacked(was, np.int64)
    return c, (own & SHARED > 0) & (c > 1), total


def first_tables(of_blocks: DataFrame, answers: DataFrame, vocab: DataFrame, buckets: int) -> DataFrame:
    """Answers: for each of a block's words its training tokens (c), its share of them (b) and the tables of its own restaurant in the first state,
    one for each pair that training has (a)."""
    total = float(vocab.agg(F.sum("c")).first()[0] or 1)
    first = swept(seats(of_blocks, answers, buckets), vocab.sparkSession.createDataFrame([], ANSWER), buckets, 0.5, -1)

    def added(asked: pa.Table, known: pa.Table) -> pa.Table:
        h, c = known.column("h").to_numpy().view(np.uint64), known.column("c").to_numpy()
        t, rows = _sums(asked, h)[1], []
        for block, keys, _, _ in _asked(asked):
            at = np.searchsorted(h, keys)
            rows.append((block, OF_WORDS, asked.column("bucket")[0].as_py(), packed(t[at]), packed((c[at] / total).astype(np.float32)), packed(c[at]), 0, 0))
        return _rows(rows, ANSWER, _ANSWER_TYPES)

    return _of_bucket(first.where("bucket >= 0"), vocab, added, ANSWER).unionByName(states(first))


def seated_contexts(of_blocks: DataFrame, answers: DataFrame, vocab: DataFrame, buckets: int, tokens: int, d: float) -> DataFrame:
    """vocab with k, a word's customers in the word restaurant, and t, the tables of its own restaurant, after one sweep over all pairs from the
    first state, in which words have their shares of the tokens."""
    of_sweep = swept(seats(of_blocks, answers.where(F.col("kind") == OF_PAIRS), buckets), answers, buckets, d, 0)

    def added(asked: pa.Table, known: pa.Table) -> pa.Table:
        k, t = _sums(asked, known.column("h").to_numpy().view(np.uint64))
        return known.append_column("k", pa.array(k)).append_column("t", pa.array(t))

    return _of_bucket(of_sweep.where("bucket >= 0"), vocab, added, "bucket int, h long, word string, c long, k long, t long")


def _texts(w: Words, which: np.ndarray) -> pa.Array:
    size = w.end[which] - w.start[which]
    at = np.repeat(w.start[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(which), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(w.data[at].tobytes())])


def fitted(vocab: DataFrame) -> Model:
    """Samples the word restaurant's seating, a pass over the vocabulary for each sweep. Its customers are the contexts'
    tables (k), or all training tokens (c) of a vocabulary without contexts."""
    spark = vocab.sparkSession
    known = vocab.where("c > 0").select("h", "word", F.col("k" if "k" in vocab.columns else "c").alias("c"))
    total = known.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    tokens, kinds = int(total.n or 0), int(total.v)
    d = _discount(total.n1, total.n2)
    state = Sweep(-1, Spelling.flat(), float(kinds))
    sweeps = []
    for number in range(-1, BURN_IN + SAMPLES) if kinds else []:
        sent = spark.sparkContext.broadcast((state, d))

        @tidy
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            sweep, dd = sent.value
            table = sweep.spelling.table()
            seen, sums, tables, spent = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0.0
            for part in gathered(batches, PASS_WORDS):
                codes, word = spelled(part.column(1))
                c = part.column(2).to_numpy()
                # the first pass has a table for each word
                g0 = _g0(sweep.spelling, table, codes, word, len(c)) if sweep.number >= 0 else np.zeros(len(c))
                t = np.ones(len(c)) if sweep.number < 0 else _seat_words(part.column(0).to_numpy().view(np.uint64), c, g0, dd, sweep)
                spent += float(g0.sum())
                tables += int(t.sum())
                keys, at = np.unique(codes, return_inverse=True)
                more = np.bincount(at, t[word], len(keys)).astype(np.int64)
                seen, at = np.unique(np.concatenate([seen, keys]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([sums, more]), len(seen)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int64()), pa.array(np.append(sums, tables), pa.int64()), pa.array(np.append(np.zeros(len(seen)), spent))], names=["code", "n", "x"])

        # at most 256**3 codes and the number of tables
        got = known.mapInArrow(run, "code long, n long, x double").groupBy("code").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("code").toArrow()
        code, n = got.column("code").to_numpy(), got.column("n").to_numpy()
        state.after, state.known = float(n[0]), float(got.column("x")[0].as_py())
        if number >= BURN_IN:
            sweeps.append(state)
        state = Sweep(number + 1, Spelling.sampled(code[1:], n[1:], number + 2), float(n[0]))
        sent.unpersist()
    return Model(d, tokens, kinds, sweeps)


def word_samples(vocab: DataFrame, model: Model) -> DataFrame:
    """bucket, h, c, t and p: each word's predictive probability without context in every sample."""
    sent = vocab.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        tables = [s.spelling.table() for s in m.sweeps]
        for part in gathered(batches, PASS_WORDS):
            h, c, k = part.column(0).to_numpy().view(np.uint64), part.column(2).to_numpy(), part.column(3).to_numpy()
            codes, word = spelled(part.column(1))
            p = np.ones((len(c), max(len(m.sweeps), 1)))
            for i, (s, table) in enumerate(zip(m.sweeps, tables, strict=True)):
                unseen = (CONCENTRATION + m.discount * s.after) * (1 - min(s.known, 1.0)) / (CONCENTRATION + m.tokens)
                g0 = _g0(s.spelling, table, codes, word, len(c))
                t = _seat_words(h, np.where(c > 0, k, 0), g0, m.discount, s)
                own = (k - m.discount * t + (CONCENTRATION + m.discount * s.after) * g0) / (CONCENTRATION + m.tokens)
                p[:, i] = np.where(c > 0, np.maximum(own, 1e-30), unseen)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(5), part.column(0), part.column(2), part.column(4), lists], names=["bucket", "h", "c", "t", "p"])

    k = F.col("k") if "k" in vocab.columns else F.col("c")
    t = F.col("t") if "t" in vocab.columns else F.lit(0).cast("long")
    bucket = F.col("bucket") if "bucket" in vocab.columns else F.lit(0)
    return vocab.select("h", "word", "c", k.alias("k"), t.alias("t"), bucket.alias("bucket")).mapInArrow(run, "bucket int, h long, c long, t long, p array<double>")


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(documents: DataFrame, training: Column | None = None) -> DataFrame:
    """Scores of every row's whole text, learned from the rows where `training` holds."""
    training = crc_mod(F.col("doc_id"), 10) != 0 if training is None else training
    since, buckets = len(WORK), blocks_of(documents.sparkSession)
    of_blocks = blocks(documents, training)
    vocab = stored(vocabulary(of_blocks, buckets), "vocabulary")
    total = vocab.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = int(total.n or 0), int(total.v)
    of_pairs = stored(pair_counts(of_blocks.select("block", "ids", "nulls", "held", "sizes", "vocab", "tokens"), buckets), "pairs")
    rare = of_pairs.agg(F.sum("n").alias("n1"), F.sum("m").alias("n2")).first()
    d = _discount(rare.n1 or 0, rare.n2 or 0)
    texts = of_blocks.select("block", "ids", "nulls", "held", "sizes", "vocab", "tokens")
    told, n_samples = of_pairs, 0
    if v:
        of_seats = stored(seats(texts, of_pairs, buckets), "seats")
        samples, state = sampled(of_seats, vocab, buckets, d, since)
        discard(documents.sparkSession, since, "seats", "vocabulary")
        told = of_pairs.unionByName(state)
        told = told.unionByName(stored(shared_tables(texts, told, buckets), "shared"))
        for sample in samples:
            told = told.unionByName(sample.withColumn("kind", F.lit(OF_SAMPLES + n_samples)))
            n_samples += 1

    def run(row: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block.read(row)
        pairs = Pairs.found(block)
        c_pair, shared, total = _told_pairs(pairs, answers, buckets)
        # one customer has one table in every sample
        total[c_pair == 1] = n_samples
        total[shared] = _answers(answers, OF_SHARED, pairs.keys[shared], buckets, np.int64)[0]
        own, share, c = c_pair - d * total / max(n_samples, 1), np.zeros(len(c_pair)), np.zeros(len(block.vocab), np.int64)
        del shared, total
        for i in range(n_samples):
            # training tokens are the same in all samples and told with the last
            tables, p, *counts = _answers(answers, OF_SAMPLES + i, block.vocab, buckets, np.int64, np.float32, *[np.int64] * (i == n_samples - 1))
            share += (CONCENTRATION + d * tables)[pairs.prev] * p[pairs.word] / n_samples
            c = counts[0] if counts else c
        # without training texts every token is the one outcome
        log_p = np.log10((own + (share if n_samples else CONCENTRATION)) / (CONCENTRATION + c)[pairs.prev])
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        doc, n_docs = np.repeat(np.arange(len(block.ids)), block.sizes), len(block.ids)
        known = np.bincount(doc, (c > 0)[block.tokens], n_docs).astype(np.int64)
        cells = [pa.array(block.ids, mask=block.nulls > 0), pa.array(block.held > 0), pa.array(block.sizes), pa.array(known), pa.array(np.bincount(doc, base[block.tokens], n_docs)), pa.array(np.bincount(doc, log_p[pairs.of], n_docs))]
        return pa.table(cells, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = stored_alone(_of_block(texts, told, run, RESULT), "scores", since)
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))
