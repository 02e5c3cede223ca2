"""Chunkers: windows of tokens or words, sections of marked-up text, whole texts.

Chunks are rows (doc_id, chunk_no, start, stop, headings): ranges of code points, so that a chunk's text is a slice of its
document. What a heading path is made of are lines and running maxima over a document's lines, all columns; byte-pair
counts are made in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions import bpe

TOKEN = "[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]"
# A heading line, a break between paragraphs, and the depth of headings.
HEADING = "^(#{1,6})[ \\t]+(.+?)[ \\t]*$"
PARAGRAPH_BREAK = r"\n[ \t]*\n"
LEVELS = 6
PIECE = "doc_id long, chunk_no long, start long, stop long"


def fixed_windows(docs: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """doc_id, chunk_no, first and stop token of windows of `size` tokens; the last ends at the text's end. No tokens: one empty window."""
    step = size - overlap
    n = F.regexp_count("text", F.lit(TOKEN))
    w = docs.select("doc_id", n.alias("n")).withColumn("first", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n"), F.lit(1)) - 1, F.lit(step))))
    w = w.where((F.col("first") == 0) | (F.col("first") - step + size < F.col("n")))
    return w.select("doc_id", (F.col("first") / step).cast("long").alias("chunk_no"), F.col("first").cast("long").alias("first"), F.least(F.col("first") + size, F.col("n")).cast("long").alias("stop"))


def bpe_windows(docs: DataFrame, size: int, overlap: int = 0, **how) -> DataFrame:
    """doc_id, chunk_no, start, stop of windows of `size` byte-pair tokens that each begin `size - overlap` after the one before."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to size - 1")
    return bpe.each_text(docs, "doc_id", "text", lambda b, d, t: [(d, i, *r) for i, r in enumerate(b.windows(t, size, overlap))], PIECE, **how)


def word_chunks(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, chunk_no, start, stop (code points) and text of chunks of `size` space-separated words."""
    ws = F.split("text", " ")
    lists = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws), F.lit(1)), F.lit(size)), lambda i: F.array_join(F.slice(F.col("ws"), i, F.lit(size)), " "))
    d = docs.withColumn("ws", ws).select("doc_id", F.posexplode(lists).alias("chunk_no", "text"))
    # a chunk begins one space after the chunks before it
    before = F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("start", F.coalesce(before, F.lit(0)))
    return d.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("start").cast("long").alias("start"), (F.col("start") + F.length("text")).cast("long").alias("stop"), "text")


def whole(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.lit(0).cast("long").alias("chunk_no"), F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("stop"))


def heading_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, level, title of the lines that are headings (one to six # and a space)."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike("^#{1,6}[ \\t]+\\S"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.length(F.regexp_extract("line", "^(#+)", 1)).cast("long").alias("level"), F.trim(F.regexp_extract("line", "^#{1,6}[ \\t]+(.*)$", 1)).alias("title"))


def _path(last: list[Column]) -> Column:
    """Titles of the last heading of each level that no heading of a lower level follows."""
    titles, lower = [], F.lit(-1)
    for heading in last:
        titles.append(F.when(heading["no"] > lower, heading["title"]))
        lower = F.greatest(lower, heading["no"])
    return F.filter(F.array(*titles), lambda t: t.isNotNull())


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section_no, start, stop, headings: from one heading to the next, with the path of headings.

    A heading without text of its own belongs to the section below it. Each line is a row; paths and borders are
    running maxima and sums over a document's lines.
    """
    in_doc = Window.partitionBy("doc_id").orderBy("no")
    so_far, earlier = in_doc.rowsBetween(Window.unboundedPreceding, 0), in_doc.rowsBetween(Window.unboundedPreceding, -1)
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "line"))
    head = F.col("line").rlike(HEADING)
    lines = lines.select("doc_id", "no", "line", head.alias("head"), F.when(head, F.length(F.regexp_extract("line", HEADING, 1))).alias("level"))
    start = F.coalesce(F.sum(F.length("line") + 1).over(earlier), F.lit(0))
    last = F.lead("no").over(in_doc).isNull()
    lines = lines.withColumn("start", start).withColumn("stop", F.col("start") + F.length("line") + F.when(last, 0).otherwise(1))
    lines = lines.withColumn("part", F.sum(F.col("head").cast("int")).over(so_far))
    title = F.struct("no", F.regexp_extract("line", HEADING, 2).alias("title"))
    parts = lines.groupBy("doc_id", "part").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("level").alias("level"), F.min(F.when(F.col("head"), title)).alias("title"),
        F.bool_or(~F.col("head") & F.col("line").rlike("\\S")).alias("has_text"),
    )
    parts = parts.where("start < stop")
    in_parts = Window.partitionBy("doc_id").orderBy("part")
    for i in range(1, LEVELS + 1):
        parts = parts.withColumn(f"h{i}", F.max(F.when(F.col("level") == i, F.col("title"))).over(in_parts.rowsBetween(Window.unboundedPreceding, 0)))
    closes = F.col("has_text") | F.lead("part").over(in_parts).isNull()
    parts = parts.withColumn("path", _path([F.col(f"h{i}") for i in range(1, LEVELS + 1)])).withColumn("closes", closes)
    # parts without text run up to the next that has some
    parts = parts.withColumn("section_no", F.coalesce(F.sum(F.col("closes").cast("long")).over(in_parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = parts.groupBy("doc_id", "section_no").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max_by("path", "part").alias("headings"))
    return out.select("doc_id", "section_no", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "headings")


def fitted(b: bpe.Bpe, text: str, limit: int) -> list[tuple[int, int]]:
    """Ranges of at most `limit` tokens: the whole text, else as many whole paragraphs as fit, else windows of a paragraph."""
    import regex

    tokens, count = b.run_counts(text)
    if tokens <= limit:
        return [(0, len(text))]
    edges = sorted({0, len(text), *(m.end() for m in regex.finditer(PARAGRAPH_BREAK, text))})
    out, at = [], 0
    while at < len(edges) - 1:
        to = at
        while to < len(edges) - 1 and count(edges[at], edges[to + 1]) <= limit:
            to += 1
        if to == at:
            out += [(edges[at] + x, edges[at] + y) for x, y in b.windows(text[edges[at] : edges[at + 1]], limit)]
            to += 1
        else:
            out.append((edges[at], edges[to]))
        at = to
    return out


def structure_chunks(docs: DataFrame, limit: int = 256, **how) -> DataFrame:
    """doc_id, chunk_no, start, stop, headings: sections, cut where they have more than `limit` byte-pair tokens."""
    texts = sections(docs).join(docs.select("doc_id", "text"), "doc_id")
    key = F.struct("doc_id", "section_no", "start", "headings").alias("section")
    rows = texts.select(key, F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start")).alias("text"))
    kind = dict(rows.dtypes)["section"]

    def cut(b, s, t):
        return [(s, i, x, y) for i, (x, y) in enumerate(fitted(b, t, limit))]

    pieces = bpe.each_text(rows, "section", "text", cut, f"section {kind}, piece long, low long, high long", **how)
    no = F.row_number().over(Window.partitionBy("section.doc_id").orderBy("section.section_no", "piece")) - 1
    return pieces.select("section.doc_id", no.cast("long").alias("chunk_no"), (F.col("section.start") + F.col("low")).alias("start"), (F.col("section.start") + F.col("high")).alias("stop"), "section.headings")
