"""A table of the newest row per key, kept by the micro-batches of an update stream.

Every batch adds a run (the rows it changed) and commits a manifest that lists the runs; a
reader takes the newest manifest. Runs are merged as in a log-structured table: while the last
run has at least half the rows of the one before it, the two become one, in which each key
stands once. So there are never more runs than the logarithm of the rows, a row is rewritten
about as often, and what a reader opens follows the live keys, not the history.

A batch that is repeated after a failure finds itself in the manifest and changes nothing; one
that failed before its manifest was written starts over in a folder of its own.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrisk.session import delete

VERSION = "_version"


class Versioned:
    """The table below ``folder``, one row per ``keys``."""

    def __init__(self, spark: SparkSession, folder: str, keys):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), list(keys)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _manifests(self):
        """Numbers of the committed manifests, oldest first."""
        at = self._path("manifest")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _read(self, number):
        stream = self.fs.open(self._path(f"manifest/{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def manifest(self) -> dict:
        """{"batch": last batch, "runs": [[folder, rows], ...]}, oldest run first."""
        known = self._manifests()
        return self._read(known[-1]) if known else {"batch": -1, "runs": []}

    def _commit(self, state):
        """The manifest appears under its name at once or not at all."""
        number = state["batch"]
        part = self._path(f"manifest/.{number}.{uuid.uuid4().hex}")
        stream = self.fs.create(part)
        try:
            stream.write(json.dumps(state).encode())
        finally:
            stream.close()
        if not self.fs.rename(part, self._path(f"manifest/{number}.json")):
            raise RuntimeError(f"manifest {number} of {self.folder} was written by someone else")

    def _run(self, df: DataFrame):
        """Write a run; its folder and number of rows."""
        name = f"runs/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        return [name, self.spark.read.parquet(f"{self.folder}/{name}").count()]

    def _newest(self, runs) -> DataFrame:
        df = self.spark.read.option("mergeSchema", True).parquet(
            *[f"{self.folder}/{name}" for name, _ in runs])
        if len(runs) == 1:
            return df
        rest = [c for c in df.columns if c not in self.keys]
        return df.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), VERSION).alias("_v")) \
            .select(*self.keys, "_v.*")

    def update(self, batch: DataFrame, batch_id: int):
        """Put in the changed rows of a micro-batch, at most one per key."""
        state = self.manifest()
        if state["batch"] >= batch_id:
            return
        before = [list(r) for r in state["runs"]]
        run = self._run(batch.withColumn(VERSION, F.lit(batch_id).cast("long")))
        runs = [*before, run] if run[1] else list(before)
        made = [run]
        while len(runs) > 1 and 2 * runs[-1][1] >= runs[-2][1]:
            run = self._run(self._newest(runs[-2:]))
            made.append(run)
            runs[-2:] = [run]
        self._commit({"batch": batch_id, "runs": runs})
        for own in made:  # runs that were merged on the way have no reader yet
            if own not in runs:
                delete(self.spark, f"{self.folder}/{own[0]}")
        # a reader may still be at the manifest before this one; older ones and their runs go
        known = self._manifests()
        kept = {name for n in known[-2:] for name, _ in self._read(n)["runs"]}
        for n in known[:-2]:
            for name, _ in self._read(n)["runs"]:
                if name not in kept:
                    delete(self.spark, f"{self.folder}/{name}")
            self.fs.delete(self._path(f"manifest/{n}.json"), False)

    def read(self) -> DataFrame:
        """The newest row of each key; None before the first batch with rows."""
        runs = self.manifest()["runs"]
        return self._newest(runs).drop(VERSION) if runs else None
