"""Document fingerprints: one-permutation MinHash, densified and packed to low-order bits.

Every five-word shingle of the lower-cased (A-Z) text is hashed once; the top
eight bits choose one of 256 bins and each bin keeps its smallest hash. An empty
bin borrows from another bin, found by a probe order of its own that is the same
for all documents (optimal densification): eight hashed probes, and if they all
meet empty bins, the filled bin whose hash with the empty bin's number is least.
A bin is stored as the low four bits of its hash, 256 bins as 64 bytes in
hexadecimal. Two unlike bins still agree in one case of 16, so with m the share
of equal bins the likeness is (m - 1/16) / (1 - 1/16), at least 0.

All of it is column expressions: no shuffle to fingerprint, and one by block of
ascending doc_id to see the next document.

Defined results: a text of one to four words is one shingle, the whole sequence;
a text without words has the empty fingerprint, which is like another empty one
(1) and unlike all others (0). Rows with equal doc_id are ordered by the text's
hash. The only row of a table is its own next. Extra columns are ignored by
`with_edits` and kept by `fingerprinted`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.shared import WS, ascii_lower, blocks_of, id_bounds, ordered_block

SHINGLE, BINS, BITS, PROBES = 5, 256, 4, 8
PER_LONG = 64 // BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with a value that is computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bin(h: Column) -> Column:
    return F.shiftright(h, 56) + F.lit(128)


def shingles(text: Column) -> Column:
    """Hashes of the text's five-word shingles."""
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WS), lambda x: x != "")

    def of(h: Column) -> Column:
        full = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]))
        return F.when(F.size(h) >= SHINGLE, full).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    return let(F.transform(words, lambda x: F.xxhash64(x)), of)


def _packed(hashes: Column) -> Column:
    """Bins of a shingle list as BITS-bit numbers, PER_LONG of them to a long; null without shingles."""

    def mins(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(F.get(s, i - 1), 56) != F.shiftright(x, 56)))

    def aligned(m: Column) -> Column:
        gap = lambda x, i: _bin(x) - F.when(i == 0, F.lit(-1)).otherwise(_bin(F.get(m, i - 1))) - 1
        none = F.lit(None).cast("long")
        runs = F.transform(m, lambda x, i: F.concat(F.array_repeat(none, gap(x, i).cast("int")), F.array(x)))
        tail = F.array(F.array_repeat(none, (F.lit(BINS - 1) - _bin(F.element_at(m, -1))).cast("int")))
        return F.flatten(F.concat(runs, tail))

    def dense(m: Column, a: Column) -> Column:
        probes = lambda j: [F.get(a, F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
        last = lambda j: F.get(F.array_sort(F.transform(m, lambda x: F.struct(F.xxhash64(j, _bin(x)).alias("o"), x.alias("v")))), F.lit(0))["v"]
        return F.transform(a, lambda v, j: F.coalesce(v, *probes(j), last(j)).bitwiseAND(F.lit((1 << BITS) - 1)))

    def pack(d: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), lambda k: F.aggregate(F.slice(d, k * PER_LONG + 1, PER_LONG), F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(v)))

    body = let(F.sort_array(hashes), lambda s: let(mins(s), lambda m: let(aligned(m), lambda a: let(dense(m, a), pack))))
    return F.when(F.size(hashes) > 0, body)


def packed(text: Column) -> Column:
    return let(shingles(text), _packed)


def as_hex(p: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(p, lambda x: F.lpad(F.lower(F.hex(x)), PER_LONG * BITS // 4, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, corrected for bins that agree by chance."""
    ones = F.lit(0x1111111111111111).cast("long")

    def unlike(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseOR(F.shiftrightunsigned(d, 3)).bitwiseAND(ones))

    differing = F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda acc, n: acc + n)
    chance = 1.0 / (1 << BITS)
    corrected = F.greatest(F.lit(0.0), ((1 - differing / float(BINS)) - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(corrected)


def fingerprinted(documents: DataFrame, out: str = "fingerprint") -> DataFrame:
    """documents with the fingerprint of every row's whole text."""
    return documents.withColumn(out, as_hex(packed(F.col("text"))))


def with_next(documents: DataFrame, blocks: int | None = None) -> DataFrame:
    """doc_id, text, fp, and the same of the next document in ascending doc_id, after the last the first.

    Documents are dealt into blocks of ascending ids; each block's first document is a guest of the
    block before it too, so that every row finds its next one within its block.
    """
    blocks = blocks or blocks_of(documents.sparkSession)
    bounds = id_bounds(documents, blocks)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text")).withColumn("block", ordered_block(F.col("doc_id"), bounds)).withColumn("tie", F.xxhash64("text"))
    # one row for each block
    firsts = rows.groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("f"))
    w = Window.orderBy("block")
    before = F.coalesce(F.lag("block").over(w), F.max("block").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select(before.alias("guest_of"), F.col("f.doc_id").alias("f_id"), F.col("f.tie").alias("f_tie"))
    rows = rows.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("tie") == F.col("f_tie")), "left")
    rows = rows.withColumn("fp", packed(F.col("text")))
    places = F.when(F.col("guest_of").isNull(), F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("guest")), F.struct(F.col("guest_of").alias("b"), F.lit(True).alias("guest"))))
    rows = rows.select("doc_id", "text", "tie", "fp", F.explode(places).alias("place")).select("doc_id", "text", "tie", "fp", "place.b", "place.guest")
    order = Window.partitionBy("b").orderBy("guest", F.col("doc_id").isNull(), "doc_id", "tie")
    out = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fp", F.lead("fp").over(order))
    return out.where(~F.col("guest")).select("doc_id", "text", "fp", "next_text", "next_fp")


def with_edits(documents: DataFrame, blocks: int | None = None) -> DataFrame:
    """Every text's fingerprint beside that of its edited text: its last quarter replaced by as much of the next document's beginning."""
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - q), F.substring("next_text", F.lit(1), q))
    out = with_next(documents, blocks).select("doc_id", "fp", "next_fp", n.cast("long").alias("n_chars"), edited.alias("edited"))
    out = out.select("doc_id", "fp", "next_fp", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("edited")).alias("edited_fp"))
    return out.select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
