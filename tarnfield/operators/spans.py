"""Where evidence stands in documents, and which chunks hold it.

Evidence is found by one automaton over all its strings, which reads every text once, whatever the number
of strings. A set of strings that is longer than BLOCK_CHARS is dealt into blocks, each an automaton of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of evidence in one automaton, about; a node of it takes some tens of bytes.
BLOCK_CHARS = 1 << 22
#: Characters of a document that one key of an interval join stands for.
BIN_CHARS = 1 << 13


@lru_cache(maxsize=2)
def _automaton(strings: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for i, s in enumerate(strings):
        out.add_word(s, (i, len(s)))
    out.make_automaton()
    return out


def _found(docs: DataFrame, strings: tuple[str, ...]) -> DataFrame:
    """doc_id, evidence, start of the first place of each string in each document; an empty one stands at the beginning."""
    sent = docs.sparkSession.sparkContext.broadcast(strings)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("evidence", T.StringType()), T.StructField("start", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = sent.value
        search = _automaton(tuple(s for s in strings if s))
        words = [s for s in strings if s]
        for batch in batches:
            row, evidence, start = [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                first: dict[int, int] = {} if len(words) == len(strings) else {-1: 0}
                if words:
                    for end, (i, size) in search.iter(text):
                        if i not in first:
                            first[i] = end - size + 1
                row += [r] * len(first)
                evidence += [words[i] if i >= 0 else "" for i in first]
                start += first.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(evidence, pa.string()), pa.array(start, pa.int64())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def spans(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Where each item's evidence first stands word for word in a document: item_id, doc_id, start, stop.

    Null evidence stands nowhere, empty evidence at the beginning of every text. The strings of a block go to all tasks.
    """
    wanted = items.where("evidence is not null").select("item_id", "evidence")
    strings = wanted.select("evidence").distinct()
    n = max(1, -(-(strings.agg(F.sum(F.length("evidence"))).first()[0] or 0) // BLOCK_CHARS))
    block = F.pmod(F.xxhash64("evidence"), F.lit(n))
    parts = [_found(docs, tuple(r.evidence for r in strings.where(block == b).collect())) for b in range(n)]  # BLOCK_CHARS at a time
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    return hits.join(wanted, "evidence").select("item_id", "doc_id", "start", (F.col("start") + F.length("evidence")).alias("stop"))


def held(found: DataFrame, chunks: DataFrame, how: str = "inner", size: int = BIN_CHARS) -> DataFrame:
    """Spans (doc_id, start, stop, ..) and the chunks (doc_id, start, stop, ..) that hold them whole; found's columns, then chunks' but doc_id as c_...

    Both are keyed by document and bin of characters: a span by the bin it begins in, a chunk by every bin it
    touches. So a pair meets once, and a long document is many keys. how: inner, left, left_semi or left_anti.
    """
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    keyed = chunks.select(F.col("doc_id").alias("c_doc"), *(F.col(c).alias(f"c_{c}") for c in chunks.columns if c != "doc_id"))
    keyed = keyed.withColumn("c_bin", F.explode(F.sequence(cell("c_start"), F.greatest(cell("c_start"), cell("c_stop")))))
    holds = (F.col("doc_id") == F.col("c_doc")) & (cell("start") == F.col("c_bin")) & (F.col("c_start") <= F.col("start")) & (F.col("stop") <= F.col("c_stop"))
    return found.join(keyed, holds, how).drop("c_doc", "c_bin")
