"""Writing a library: one Markdown file a document, a manifest, and the passes of a run."""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_text(fields: dict) -> str:
    """Front matter of the fields that are set, then the body."""
    head = {k: v for k, v in fields.items() if k != "body" and v not in (None, [])}
    return f"---\n{yaml.safe_dump(head, sort_keys=False, allow_unicode=True)}---\n{fields['body']}"


def write_documents(documents: DataFrame, folder: str) -> DataFrame:
    """Writes doc_id@version.md into a folder that executors share; returns the manifest (file, sha256, bytes).

    A file's name and content follow from its document, so a task that runs again writes the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            rows = []
            for fields in batch.to_pylist():
                raw = document_text(fields).encode()
                name = f"{fields['doc_id']}@{fields['version']}.md"
                with fs.open_output_stream(posixpath.join(base, name)) as out:
                    out.write(raw)
                rows.append((name, hashlib.sha256(raw).hexdigest(), len(raw)))
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["file", "sha256", "bytes"])

    return documents.mapInArrow(run, "file string, sha256 string, bytes long")


def run_passes(records: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """run_id, started, finished, calls, failures of each pass; rows of earlier passes stay unless they are run again."""
    now = records.groupBy("run_id").agg(F.min("recorded_utc").alias("started"), F.max("recorded_utc").alias("finished"), F.count("*").alias("calls"), F.count_if(F.col("error").isNotNull()).alias("failures"))
    return now if earlier is None else earlier.join(now.select("run_id"), "run_id", "left_anti").unionByName(now)


def write_items(items: DataFrame, path: str, defaults: dict | None = None) -> None:
    """One JSON line an item; nulls, empty lists and values that equal their default are left out."""
    cells = []
    for f in items.schema.fields:
        c, empty = F.col(f"`{f.name}`"), F.lit(False)
        if f.dataType.typeName() == "array":
            empty = F.size(c) == 0
        if f.name in (defaults or {}):
            empty = empty | (c == F.lit(defaults[f.name]))
        cells.append(F.when(~F.coalesce(empty, F.lit(False)), c).alias(f.name))
    items.select(F.to_json(F.struct(*cells)).alias("value")).write.mode("overwrite").text(path)


def review_sheet(items: DataFrame, documents: DataFrame) -> DataFrame:
    """item_id, type, question and the text of each evidence span, for reading by hand.

    items: item_id, type, question, evidence (array of doc_id, version, start, end); documents: doc_id, version, body.
    """
    spans = items.select("item_id", "type", "question", F.posexplode_outer("evidence").alias("no", "span"))
    text = F.substring("body", F.col("span.start") + 1, F.col("span.end") - F.col("span.start"))
    of = documents.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "body")
    read = spans.join(of, (F.col("span.doc_id") == F.col("d")) & (F.col("span.version") == F.col("v")), "left").select("item_id", "type", "question", "no", text.alias("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"])
    return read.groupBy("item_id", "type", "question").agg(F.array_join(parts, "\n").alias("evidence"))
