"""Both halves of a search index over the same texts: term statistics and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.operators.retrieval import KeywordIndex
from tarnfield.sources.stores import KeyedStore, text_key

#: The schema of a store of vectors.
VECTORS = "key string, v array<float>"


@dataclass(frozen=True)
class Index:
    keywords: KeywordIndex
    vectors: DataFrame  # pos, v


def embedded(texts: DataFrame, model: str, embed: Callable[[list[str]], list[list[float]]], store: KeyedStore) -> DataFrame:
    """texts (.., text) with v: every distinct text that the store lacks is embedded once, and kept under a digest of model and text."""
    keyed = texts.withColumn("key", text_key(F.lit(model), F.col("text")))
    new = store.missing(keyed).join(keyed.select("key", "text").dropDuplicates(["key"]), "key").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(embed(batch.column(1).to_pylist()), pa.list_(pa.float32()))], names=["key", "v"])

    store.put(new.mapInArrow(run, VECTORS))
    return store.get_many(keyed).drop("key")


def build_index(chunks: DataFrame, model: str, embed: Callable[[list[str]], list[list[float]]], store: KeyedStore) -> Index:
    """An index of all chunks (pos, embed_text), whoever may read them: statistics are not filtered by access."""
    texts = chunks.select("pos", F.col("embed_text").alias("text"))
    return Index(KeywordIndex(texts), embedded(texts, model, embed, store).select("pos", "v"))
