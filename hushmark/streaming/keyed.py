"""A table by key that a stream keeps up to date in plain Parquet folders.

Every micro-batch adds one run: its rows, dealt to buckets by the hash of the key, and a Bloom filter per bucket. Runs of one tier are
merged into one of the next as soon as there are ``fan`` of them, so a reader opens a number of runs that grows with the logarithm of the
batches, and a row is rewritten as often. A manifest names the runs that count. It is written last and never changed, so a
writer that dies at any point leaves the table as it was; what it wrote is named by nothing. A batch that is tried again adds nothing if its run counts
already. There is one writer at a time, the stream's driver; a second one fails on the manifest's number.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType


#: Bits of one block of a filter, the size of Spark's bitmaps, and bits a key.
BLOCK, BITS_A_KEY = 32_768, 16
#: Manifests, and runs that were merged, stay so many commits longer for those who still read them.
GRACE = 8


class KeyedLog:
    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 16, fan: int = 4, newest: bool = True, lookups: bool = True):
        """``newest``: of rows with one key only that of the last batch counts; otherwise all do. Without ``lookups`` no filters are kept."""
        self.spark, self.folder, self.keys, self.buckets, self.fan, self.newest, self.lookups = spark, folder, keys, buckets, fan, newest, lookups
        self.opened: list[str] = []
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self._files, self._path = path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    # --- the manifest ------------------------------------------------------------------------

    def _numbers(self) -> list[int]:
        at = self._path(f"{self.folder}/manifest")
        if not self._files.exists(at):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "runs": [], "done": {}, "retired": []}
        file = self._files.open(self._path(f"{self.folder}/manifest/{numbers[-1]:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def _commit(self, state: dict) -> None:
        number = state["number"] = state["number"] + 1
        gone = [r for r in state["retired"] if r["at"] + GRACE <= number]
        state["retired"] = [r for r in state["retired"] if r not in gone]
        name, hidden = self._path(f"{self.folder}/manifest/{number:012d}.json"), self._path(f"{self.folder}/manifest/.{uuid.uuid4().hex}")
        out = self._files.create(hidden, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._files.exists(name) or not self._files.rename(hidden, name):
            raise RuntimeError(f"another writer has committed {name}")
        for run in gone:
            for kind in ("rows", "filters"):
                self._files.delete(self._path(f"{self.folder}/{kind}/{run['name']}"), True)
        for old in self._numbers():
            if old + GRACE <= number:
                self._files.delete(self._path(f"{self.folder}/manifest/{old:012d}.json"), False)

    # --- writing -----------------------------------------------------------------------------

    def finished(self, writer: str, batch: int) -> bool:
        return self.manifest()["done"].get(writer, -1) >= batch

    def append(self, rows: DataFrame, writer: str, batch: int) -> None:
        """The rows of one micro-batch; those of a batch that counts already are left alone."""
        state = self.manifest()
        if state["done"].get(writer, -1) >= batch:
            return
        run = self._write(rows.withColumn("_order", F.lit(state["number"])), 0)
        state["runs"] += [run] if run["rows"] else []
        state["done"][writer] = batch
        self._commit(state)
        self._merge()

    def _write(self, rows: DataFrame, tier: int) -> dict:
        name = uuid.uuid4().hex
        bucketed = rows.withColumn("bucket", F.expr(f"CAST(pmod({self._hash()}, {self.buckets}) AS INT)"))
        # A bucket is written by several tasks where the session has more partitions than buckets, so no task holds a share that only grows.
        parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        bucketed.repartition(self.buckets * parts, "bucket", F.expr(f"pmod(xxhash64({self._hash()}, 'part'), {parts})")).write.partitionBy("bucket").parquet(f"{self.folder}/rows/{name}")
        run = {"name": name, "tier": tier, "rows": 0, "blocks": 1, "schema": rows.schema.json()}
        if any(s.getPath().getName().startswith("bucket=") for s in self._files.listStatus(self._path(f"{self.folder}/rows/{name}"))):
            run["rows"] = self._read([run]).count()
        if not self.lookups or not run["rows"]:
            return run
        while run["blocks"] * BLOCK * self.buckets < run["rows"] * BITS_A_KEY:
            run["blocks"] *= 2
        keys = self._read([run]).select(*self.keys, "bucket")
        keys.selectExpr("bucket", f"{self._place(run['blocks'])} AS place").groupBy("bucket", F.expr(f"CAST(place DIV {BLOCK} AS INT)").alias("block")).agg(
            F.expr(f"bitmap_construct_agg(place % {BLOCK})").alias("bits")).coalesce(1).write.parquet(f"{self.folder}/filters/{name}")
        return run

    def _merge(self) -> None:
        """Put the last runs together while there are enough of one tier; the manifest changes only when the new run is there."""
        while True:
            state = self.manifest()
            last = state["runs"][-self.fan :]
            if len(last) < self.fan or len({r["tier"] for r in last}) > 1:
                return
            rows = self._read(last)
            run = self._write((self._newest(rows) if self.newest else rows).drop("bucket"), last[0]["tier"] + 1)
            state["runs"][-self.fan :] = [run]
            state["retired"] += [{"name": r["name"], "at": state["number"] + 1} for r in last]
            self._commit(state)

    # --- reading -----------------------------------------------------------------------------

    def _hash(self) -> str:
        return f"xxhash64({', '.join(self.keys)})"

    def _place(self, blocks: int) -> str:
        # Bits apart from those that choose the bucket.
        return f"pmod(xxhash64({self._hash()}), {blocks * BLOCK}L)"

    def _read(self, runs: list[dict]) -> DataFrame:
        self.opened = [r["name"] for r in runs]
        parts = [self.spark.read.schema(StructType.fromJson(json.loads(r["schema"])).add("bucket", IntegerType())).parquet(f"{self.folder}/rows/{r['name']}") for r in runs]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_order").alias("_r")).select(*self.keys, "_r.*")

    def rows(self) -> DataFrame | None:
        """All rows that count; None before the first."""
        runs = self.manifest()["runs"]
        if not runs:
            return None
        rows = self._read(runs)
        return (self._newest(rows) if self.newest else rows).drop("bucket", "_order")

    def may_hold(self, keys: DataFrame) -> list[tuple[str, int]]:
        """(run, bucket) of those files of which the filter does not exclude every key; runs times buckets at most."""
        runs = self.manifest()["runs"]
        if not runs:
            return []
        if not self.lookups:
            raise ValueError("this table keeps no filters")
        place = f"CAST(place % {BLOCK} AS INT)"
        listed = f"(CAST(conv(hex(substring(bits, {place} DIV 8 + 1, 1)), 16, 10) AS INT) & shiftleft(1, {place} % 8)) <> 0"
        found = []
        for blocks in sorted({r["blocks"] for r in runs}):  # powers of two: a few sizes at most
            parts = [self.spark.read.schema("bucket int, block int, bits binary").parquet(f"{self.folder}/filters/{r['name']}").withColumn("run", F.lit(r["name"])) for r in runs if r["blocks"] == blocks]
            filters = reduce(DataFrame.unionByName, parts)
            asked = keys.selectExpr(f"CAST(pmod({self._hash()}, {self.buckets}) AS INT) AS bucket", f"{self._place(blocks)} AS place").selectExpr(
                "bucket", f"CAST(place DIV {BLOCK} AS INT) AS block", "place").distinct()
            found += asked.join(filters, ["bucket", "block"]).where(listed).select("run", "bucket").distinct().collect()
        return sorted((r["run"], r["bucket"]) for r in found)

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """The rows whose key is among ``keys``; only files that may hold one are opened."""
        places = self.may_hold(keys)
        self.opened = [f"{run}/bucket={bucket}" for run, bucket in places]
        if not places:
            return None
        schemas = {r["name"]: StructType.fromJson(json.loads(r["schema"])) for r in self.manifest()["runs"]}
        parts = [self.spark.read.schema(schemas[run]).parquet(f"{self.folder}/rows/{run}/bucket={bucket}") for run, bucket in places]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        rows = self._among(rows, keys, "left_semi")
        return (self._newest(rows) if self.newest else rows).drop("_order")

    def absent(self, frame: DataFrame) -> DataFrame:
        """The rows of a frame whose key the table does not hold."""
        there = self.lookup(frame.select(*self.keys))
        return frame if there is None else self._among(frame, there, "left_anti")

    def _among(self, rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        """Rows whose key is, or is not, among others; null is a key like any other."""
        asked = keys.selectExpr(*[f"{k} AS _k{i}" for i, k in enumerate(self.keys)]).distinct()
        return rows.join(asked, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]), how)


