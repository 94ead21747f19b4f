"""Registry of named sources: one required, the rest optional."""

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class Sources:
    """Finds data sets by exact key below a folder and opens them lazily.

    A key maps to ``<folder>/<key><suffix>.parquet``. Keys are matched exactly,
    so a longer file name that contains a key is never taken for it.
    """

    def __init__(self, spark: SparkSession, folder, keys, required=(), suffix=""):
        self.frames: dict[str, DataFrame | None] = {}
        for key in keys:
            path = os.path.join(folder, f"{key}{suffix}.parquet")
            try:
                self.frames[key] = spark.read.parquet(path)
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
                    raise
                self.frames[key] = None
        absent = [k for k in required if self.frames.get(k) is None]
        if absent:
            raise FileNotFoundError(f"required source missing: {absent} in {folder}")

    def __getitem__(self, key) -> DataFrame | None:
        return self.frames.get(key)

    def present(self):
        return {k: v for k, v in self.frames.items() if v is not None}

    def has(self, key, *columns):
        df = self.frames.get(key)
        return df is not None and all(c in df.columns for c in columns)
