"""What a run was made with, and the history of its passes: one JSON file of a results folder, on the driver."""

from __future__ import annotations

import json
import os
import platform
import subprocess
from importlib import metadata

from pyspark.sql import DataFrame

from tarnfield.sources.itemlog import write_summary_json

PACKAGES = ("pyspark", "pyarrow", "numpy", "pandas")


def git_state(folder: str = ".") -> dict[str, str | bool | None]:
    """The commit that a folder is at and whether files differ from it; nulls where there is no repository."""

    def git(*words: str) -> str | None:
        done = subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True, check=False)
        return done.stdout.strip() if done.returncode == 0 else None

    changed = git("status", "--porcelain")
    return {"commit": git("rev-parse", "HEAD"), "changed": None if changed is None else changed != ""}


def versions() -> dict[str, str]:
    return {"python": platform.python_version()} | {p: metadata.version(p) for p in PACKAGES}


def read_metadata(path: str) -> dict | None:
    """The file's content, None if there is none; a file that is no JSON object is an error."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    if not isinstance(got, dict):
        raise ValueError(f"{path} is no JSON object")
    return got


def record_run(path: str, passes: DataFrame, folder: str = ".", **facts: object) -> dict:
    """Writes the passes of a run (run_id, started, finished, calls, failures) beside those of earlier ones, with when the first began and the last ended.

    A pass that is run again takes the place of its earlier row. passes: a row for each run.
    """
    rows = [r.asDict() for r in passes.orderBy("started", "run_id").collect()]
    earlier = (read_metadata(path) or {}).get("passes", [])
    ids = {r["run_id"] for r in rows}
    every = sorted([*(r for r in earlier if r["run_id"] not in ids), *json.loads(json.dumps(rows, default=str))], key=lambda r: (r["started"], r["run_id"]))
    out = {"git": git_state(folder), "versions": versions(), "passes": every, "started": every[0]["started"] if every else None, "finished": max((r["finished"] for r in every), default=None), **facts}
    write_summary_json(out, path)
    return out
