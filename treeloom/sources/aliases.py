"""Path aliases of script projects from tsconfig.json or jsconfig.json."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "pattern_pos int, pattern string, target_pos int, target string, base_url string"


def rows(config: dict | None) -> list[tuple]:
    options = (config or {}).get("compilerOptions")
    options = options if isinstance(options, dict) else {}
    paths = options.get("paths")
    base = options.get("baseUrl", ".")
    if not isinstance(paths, dict):
        return []
    return [(i, p, j, t, base if isinstance(base, str) else ".") for i, (p, targets) in enumerate(paths.items()) if isinstance(targets, list) for j, t in enumerate(targets) if isinstance(t, str)]


def load(folder: str) -> dict | None:
    """The first of the two files that exists; one that isn't JSON counts as none, the other is not tried then."""
    for name in ("tsconfig.json", "jsconfig.json"):
        path = os.path.join(folder, name)
        if os.path.exists(path):
            try:
                with open(path, encoding="utf-8") as f:
                    config = json.load(f)
            except json.JSONDecodeError:
                return None
            return config if isinstance(config, dict) else None
    return None


def patterns(spark: SparkSession, config: dict | None) -> DataFrame:
    return spark.createDataFrame(rows(config), SCHEMA)
