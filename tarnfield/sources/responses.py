"""Responses by request in a shared folder: one JSON file each, put in place by a rename, so that a reader sees a whole one or none."""

from __future__ import annotations

import json
import uuid
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ResponseFolder:
    """Answers of requests, and failures of one run, under a URI that pyarrow.fs opens on every executor."""

    def __init__(self, uri: str, run: str):
        self.uri, self.run = uri.rstrip("/"), run

    def _place(self, request_hash: str, ok: bool) -> tuple[pafs.FileSystem, str]:
        fs, root = pafs.FileSystem.from_uri(self.uri)
        return fs, f"{root}/{'answers' if ok else f'failed-{self.run}'}/{request_hash[:2]}/{request_hash}.json"

    def get(self, request_hash: str) -> dict[str, Any] | None:
        """The answer to a request, or its failure in this run."""
        for ok in (True, False):
            fs, path = self._place(request_hash, ok)
            if fs.get_file_info(path).type == pafs.FileType.File:
                with fs.open_input_stream(path) as f:
                    return json.loads(f.read())
        return None

    def put(self, record: dict[str, Any]) -> None:
        fs, path = self._place(record["request_hash"], record["ok"])
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with fs.open_output_stream(part) as f:
            f.write(json.dumps(record, ensure_ascii=False).encode())
        fs.move(part, path)

    def answers(self, spark: SparkSession, schema: str) -> DataFrame:
        """All answers as a table; of none there is an empty one."""
        fs, root = pafs.FileSystem.from_uri(self.uri)
        if fs.get_file_info(f"{root}/answers").type != pafs.FileType.Directory:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{self.uri}/answers")

    def lacking(self, calls: DataFrame, schema: str) -> DataFrame:
        return calls.join(self.answers(calls.sparkSession, schema).select(F.col("request_hash")), "request_hash", "left_anti")
