"""A stage that remembers which parts of a run are finished, so that a rerun skips them."""

from __future__ import annotations

import hashlib
import json
import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from .staging import Stage, staging_root

#: Plan nodes whose rows come from the driver's memory and are not shown by the plan.
_HIDDEN = re.compile(r"LogicalRDD|ExistingRDD|LocalRelation (?!<empty>)")


class SharedFiles:
    """Small texts in the shared folder, written whole."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str) -> tuple:
        path = self.jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.conf), path

    def exists(self, name: str) -> bool:
        store, path = self._path(name)
        return store.exists(path)

    def remove(self, name: str) -> None:
        store, path = self._path(name)
        store.delete(path, True)

    def write(self, name: str, text: str) -> None:
        """Write beside the name and rename, so that a reader sees all of it or nothing."""
        store, path = self._path(name)
        _, beside = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        out = store.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        store.delete(path, False)
        store.rename(beside, path)

    def read(self, name: str) -> str:
        store, path = self._path(name)
        source = store.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def names(self, folder: str) -> list[str]:
        store, path = self._path(folder)
        if not store.exists(path):
            return []
        return sorted(found.getPath().getName() for found in store.listStatus(path))


def part_facts(df: DataFrame) -> dict | None:
    """What a part's rows follow from: its plan, its schema, and the files it reads, with their size.

    None if the plan does not show it all, as for rows made from Python values.
    """
    execution = df._jdf.queryExecution()
    plan = execution.analyzed().canonicalized().toString()
    if _HIDDEN.search(plan):
        return None
    leaves = execution.optimizedPlan().collectLeaves()
    sizes = [str(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    files = "\n".join(sorted(df.inputFiles()))
    return {
        "plan": hashlib.sha256(plan.encode()).hexdigest(),
        "schema": df.schema.simpleString(),
        "files": hashlib.sha256(files.encode()).hexdigest(),
        "bytes": sorted(sizes),
    }


class ResumableStage(Stage):
    """A run's folder of a fixed name, with a manifest entry for every finished part.

    ``write`` first looks for a part of the same label, settings, plan and input files. If
    its entry is there, the rows are not computed again; if not, whatever an earlier run
    left of the part is overwritten, and the entry is written last. ``settings`` has to name
    what a plan does not show, such as the version of a model. A file that is replaced by
    another one of the same name and size is not noticed.

    Parts made from Python values are always computed. ``skipped`` and ``computed`` list the
    labels of this run.
    """

    def __init__(self, spark: SparkSession, name: str, settings: str = "", root: str | None = None) -> None:
        super().__init__(spark, root)
        base = (root or staging_root(spark)).rstrip("/")
        self.folder = f"{base}/rowcensus/{re.sub(r'[^A-Za-z0-9_-]+', '_', name)}"
        self.settings, self.files = settings, SharedFiles(spark)
        self.skipped: list[str] = []
        self.computed: list[str] = []
        self._guard, self._busy = threading.Lock(), {}

    def _entry(self, key: str) -> str:
        return f"{self.folder}/manifest/{key}.json"

    def write(self, df: DataFrame, label: str) -> str:
        safe = re.sub(r"[^A-Za-z0-9_-]+", "_", label)[:60]
        facts = part_facts(df)
        known = json.dumps([label, self.settings, facts], sort_keys=True) if facts else uuid.uuid4().hex
        key = hashlib.sha256(known.encode()).hexdigest()[:32]
        path = f"{self.folder}/parts/{safe}-{key}"
        with self._guard:
            mine = self._busy.setdefault(key, threading.Lock())
        # Equal parts of one run are computed once; the others wait for it.
        with mine:
            if facts and self.files.exists(self._entry(key)):
                self.skipped.append(label)
                return path
            df.write.mode("overwrite").parquet(path)
            self.files.write(self._entry(key), json.dumps({"label": label, "settings": self.settings, "path": path, **(facts or {})}))
            self.computed.append(label)
        return path

    def manifest(self) -> list[dict]:
        """The entries of all finished parts."""
        folder = f"{self.folder}/manifest"
        return [json.loads(self.files.read(f"{folder}/{name}")) for name in self.files.names(folder) if name.endswith(".json")]
