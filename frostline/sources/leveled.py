"""A table of upserts kept in runs of several levels, with a manifest and a change feed.

A batch is one run: its rows, the last of each key, in folders by key bucket. When a level holds ``FANOUT`` runs they are merged into one of
the next, so a table of any number of batches has few runs, and a row is rewritten once a level. A manifest names the runs that count; it
is replaced as a whole by a rename, so a reader sees a batch fully or not at all, and what a writer lost on the way leaves is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.latest import last_wins

#: Runs of a level that are merged, and buckets of keys.
FANOUT, BUCKETS = 4, 16


class LeveledTable:
    """Rows by key, the last write of each counts; of a batch's rows with one key the greatest by ``order``."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str] = (), buckets: int = BUCKETS, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), list(keys), list(order)
        self.buckets, self.fanout = buckets, fanout

    def _folder(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest manifest: its version, the last batch, and the runs with level, batches and rows."""
        folder, files = self._folder("manifest")
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        versions = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."]
        if not versions:
            return {"version": -1, "last": -1, "runs": []}
        path, files = self._folder(f"manifest/{max(versions)}.json")
        stream = files.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, before: dict, last: int, runs: list[dict]) -> None:
        """Write the next manifest; of two writers that start from one version the later one fails."""
        new = {"version": before["version"] + 1, "last": last, "runs": runs}
        draft, files = self._folder(f"manifest/.{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        final, _ = self._folder(f"manifest/{new['version']}.json")
        try:
            done = files.rename(draft, final) if not files.exists(final) else False
        except Py4JJavaError:
            done = False
        if not done:
            files.delete(draft, False)
            raise RuntimeError(f"version {new['version']} of {self.path} was written by another writer")

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write_run(self, rows: DataFrame, level: int, low: int, high: int) -> dict:
        name = f"runs/{level}-{low}-{high}-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        return {"path": name, "level": level, "low": low, "high": high, "schema": rows.schema.json()}

    def _rows(self, runs: Sequence[dict], buckets: Sequence[int] | None = None) -> DataFrame:
        from pyspark.sql.types import IntegerType, StructType

        out = None
        for run in runs:
            schema = StructType.fromJson(json.loads(run["schema"])).add("_bucket", IntegerType())
            rows = self.spark.read.schema(schema).parquet(f"{self.path}/{run['path']}")
            rows = rows if buckets is None else rows.where(F.col("_bucket").isin(list(buckets)))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def write(self, rows: DataFrame, batch: int) -> None:
        """Add a batch; batches come in order, and one that is there already, as after a lost commit of its writer, changes nothing."""
        now = self.manifest()
        if batch <= now["last"]:
            return
        # After the order all other columns decide, so that the last row does not depend on how rows come.
        rest = [f.name for f in rows.schema.fields if f.name not in (*self.keys, *self.order) and f.dataType.typeName() not in ("map", "variant")]
        last = last_wins(rows, self.keys, [*self.order, *rest] or self.keys).withColumn("_batch", F.lit(batch).cast("long"))
        runs = [*now["runs"], self._write_run(last, 0, batch, batch)]
        level = 0
        while len(full := [r for r in runs if r["level"] == level]) >= self.fanout:
            merged = last_wins(self._rows(full).drop("_bucket"), self.keys, ["_batch", *self.order])
            one = self._write_run(merged, level + 1, min(r["low"] for r in full), max(r["high"] for r in full))
            runs = [r for r in runs if r["level"] != level] + [one]
            level += 1
        self._commit(now, batch, runs)

    def read(self) -> DataFrame:
        """The last version of every key."""
        return last_wins(self._rows(self.manifest()["runs"]), self.keys, ["_batch", *self.order]).drop("_batch", "_bucket")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The last version of the wanted keys; files of other buckets are not opened."""
        some = wanted.select(*self.keys).distinct()
        buckets = [r["b"] for r in some.select(self._bucket().alias("b")).distinct().collect()]
        rows = self._rows(self.manifest()["runs"], buckets).join(some, self.keys, "left_semi")
        return last_wins(rows, self.keys, ["_batch", *self.order]).drop("_batch", "_bucket")

    def changes(self, after: int) -> DataFrame:
        """Keys written in batches after a number, with their last version and ``batch``; runs without such batches are not opened."""
        newer = [r for r in self.manifest()["runs"] if r["high"] > after]
        rows = self._rows(newer or self.manifest()["runs"][:1]).where(F.col("_batch") > after)
        return last_wins(rows, self.keys, ["_batch", *self.order]).withColumnRenamed("_batch", "batch").drop("_bucket")

    def vacuum(self) -> int:
        """Delete runs that no manifest of the newest version names; gives their number. For times without readers of older versions."""
        folder, files = self._folder("runs")
        named = {r["path"].split("/")[-1] for r in self.manifest()["runs"]}
        gone = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName() not in named] if files.exists(folder) else []
        for path in gone:
            files.delete(path, True)
        return len(gone)
