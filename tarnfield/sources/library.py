"""Reading and writing the document library: front matter, items, manifest, logs and sheets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = "struct<doc_id:string,version:int,start:int,end:int>"
DOCUMENT = "doc_id string, version int, title string, family string, products array<string>, access string, status string, effective_from date, effective_to date, superseded_by string, deleted_on date, body string"
ITEM = f"id string, type string, asker string, history array<struct<role:string,content:string>>, question string, resolved_question string, answerable boolean, evidence array<{SPAN}>, distractor_spans array<{SPAN}>, stale_spans array<{SPAN}>, restricted_spans array<{SPAN}>, heading string, answer string, key_values array<string>, unanswerable_reason string"
RUN_RECORD = "call_id string, request_hash string, model_label string, mode string, cell map<string,string>, source string, attempts int, result string, error string, recorded_utc string"
CHOICES = {"family": ("article", "policy", "internal"), "access": ("public", "staff"), "status": ("current", "superseded", "deleted")}


class LibraryError(ValueError):
    """A library that does not hold together."""


def parse_document(text: str) -> dict:
    """Fields of a Markdown file with YAML front matter; the body is what follows the closing line."""
    lines = text.split("\n")
    if lines[0].strip() != "---" or "---" not in [x.strip() for x in lines[1:]]:
        raise LibraryError("the file has no front matter between --- lines")
    close = next(i for i, x in enumerate(lines[1:], 1) if x.strip() == "---")
    fields = yaml.safe_load("\n".join(lines[1:close])) or {}
    known = {f.split(" ")[0] for f in DOCUMENT.replace("array<string>", "x").split(", ")} - {"body"}
    if unknown := set(fields) - known:
        raise LibraryError(f"unknown fields: {sorted(unknown)}")
    for name, allowed in CHOICES.items():
        if fields.get(name) not in allowed:
            raise LibraryError(f"{name} is {fields.get(name)!r}, not one of {allowed}")
    return fields | {"body": "\n".join(lines[close + 1 :])}


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder of *.md with file name, SHA-256 of the bytes and doc_key; parsing runs in Arrow batches."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder).select("path", "content")
    schema = T.StructType().add("file", "string").add("sha256", "string")
    for f in spark.createDataFrame([], DOCUMENT).schema.fields:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for path, digest, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = parse_document(raw.decode("utf-8"))
                rows.append({n: got.get(n) for n in arrow.names} | {"file": path.rsplit("/", 1)[-1], "sha256": digest})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", F.sha2("content", 256).alias("digest"), "content").mapInArrow(run, schema).withColumn("doc_key", F.concat_ws("@", "doc_id", "version"))


def library_problems(documents: DataFrame, manifest: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """file or item, problem: files that differ from the manifest (file, sha256), misnamed files, spans out of bounds."""
    both = documents.select("file", "sha256", "doc_key").join(manifest.select("file", F.col("sha256").alias("expected")), "file", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("expected").isNull(), "not listed").when(F.col("sha256") != F.col("expected"), "changed").when(F.col("file") != F.concat(F.col("doc_key"), F.lit(".md")), "misnamed")
    out = both.select(F.col("file").alias("what"), problem.alias("problem")).where("problem is not null")
    if items is None:
        return out
    kinds = ("evidence", "distractor_spans", "stale_spans", "restricted_spans")
    spans = items.select("id", F.explode(F.concat(*[F.coalesce(k, F.array().cast(f"array<{SPAN}>")) for k in kinds])).alias("s"))
    placed = spans.select("id", F.concat_ws("@", "s.doc_id", "s.version").alias("doc_key"), "s.start", "s.end").join(documents.select("doc_key", F.length("body").alias("n")), "doc_key", "left")
    bad = placed.where("n is null or start < 0 or end <= start or end > n").select(F.col("id").alias("what"), F.lit("span out of bounds").alias("problem"))
    unsupported = items.where(F.col("answerable") != (F.coalesce(F.size("evidence"), F.lit(0)) > 0)).select(F.col("id").alias("what"), F.lit("answerable without evidence or the reverse").alias("problem"))
    return out.unionByName(bad).unionByName(unsupported)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSONL file; blank lines are skipped, a line that does not parse fails the read."""
    return spark.read.schema(ITEM).option("mode", "FAILFAST").json(path)


def read_records(spark: SparkSession, path: str, schema: str = RUN_RECORD) -> DataFrame:
    """Records of an append-only JSONL log with their line's place; a torn line is left out.

    line_no rises with the place in a file, however the file is split: a split's first byte plus the line's number in it, which
    is less than the split's bytes.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    first = text.groupBy("file", "block").agg(F.min("id").alias("first"))  # a row for each split
    text = text.join(first, ["file", "block"]).withColumn("line_no", F.col("block") + F.col("id") - F.col("first")).where(F.trim("value") != "")
    parsed = text.select("line_no", F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.where("r._corrupt is null").select("line_no", "r.*").drop("_corrupt")


def read_conditions(spark: SparkSession, results: str, schema: str) -> DataFrame:
    """Item logs of results/<condition>/log.jsonl, with the condition."""
    return spark.read.schema(schema).json(f"{results}/*/log.jsonl").withColumn("condition", F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/log\\.jsonl$", 1))


def read_sheet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV sheet of text cells: a byte order mark is allowed, the header must be exactly `columns`, blank rows go."""
    df = spark.read.option("header", True).csv(path)
    names = [c.removeprefix("﻿") for c in df.columns]
    if sorted(names) != sorted(columns):
        raise LibraryError(f"missing columns {sorted(set(columns) - set(names))}, unknown columns {sorted(set(names) - set(columns))}")
    df = df.toDF(*names).select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in columns])
    return df.where(F.coalesce(*columns).isNotNull())


def yes_no(c: Column) -> Column:
    """True, false or null of a y/n cell."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("y", "yes", "true", "1"), True).when(low.isin("n", "no", "false", "0"), False)


def read_yaml(path: str) -> dict:
    """A YAML mapping; keys and values that YAML 1.1 reads as booleans for on/off stay text."""

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {k: [(tag, rx) for tag, rx in v if tag != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|false|True|False)$"), list("tTfF"))
    with open(path) as f:
        got = yaml.load(f, Loader)  # noqa: S506
    if not isinstance(got, dict):
        raise LibraryError(f"{path} is no mapping")
    return got


def write_log(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls written out."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def write_summary(df: DataFrame, path: str, columns: list[str], *order: str) -> None:
    """A CSV with fixed columns and order: for summaries, which are small."""
    df.select(*columns).orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


ARTICLE = "article_id string, product string, identifier string, role string, group int, text string"


def read_first_edition(spark: SparkSession, folder: str, codes: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The first edition's articles (with title, their first line) and questions (with item_id: the type's code and its place among its type).

    Both files are one JSON document each; they are small.
    """
    articles = spark.read.schema(f"articles array<struct<{', '.join(c.replace(' ', ':', 1) for c in ARTICLE.split(', '))}>>").option("multiLine", True).json(f"{folder}/corpus.json")
    articles = articles.select(F.inline("articles")).withColumn("title", F.trim(F.split_part("text", F.lit("\n"), F.lit(1))))
    questions = spark.read.schema("questions array<struct<type:string,article_id:string,question:string>>").option("multiLine", True).json(f"{folder}/questions.json")
    earlier = F.size(F.filter(F.slice("questions", 1, F.col("no")), lambda q: q["type"] == F.col("q.type")))
    code = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[F.col("q.type")]
    numbered = questions.select("questions", F.posexplode("questions").alias("no", "q"))
    return articles, numbered.select(F.format_string("%s-%03d", code, earlier).alias("item_id"), "q.*")
