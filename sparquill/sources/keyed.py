"""A keyed table in files: updates rewrite only the hash buckets that they touch, and take effect by one rename.

A table is a folder: ``data/<version>/bucket=<n>`` has Parquet files, ``heads/<version>.json`` says which version each
bucket is at. An update reads the touched buckets, writes them under a new version, and then moves the new head into
place; readers see the old head or the new one, never a part. An update that failed before the move leaves the table as it
was, and doing it again gives the same table. One writer at a time; old versions stay until ``vacuum``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparquill.operators import relational as R


class KeyedTable:
    """Keys equal each other also where they are null; ``schema`` has the keys and all other columns, none named ``bucket``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = StructType.fromDDL(schema)

    # ---- heads

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        system, at = self._at(folder)
        return sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []

    def _head(self) -> tuple[int, dict[str, int]]:
        """(version, bucket -> version of its files)"""
        heads = [n for n in self._names("heads") if n.endswith(".json")]
        if not heads:
            return 0, {}
        rows = self.spark.read.text(f"{self.path}/heads/{heads[-1]}", wholetext=True).first()
        return int(heads[-1].partition(".")[0]), json.loads(rows[0])

    def _set_head(self, version: int, head: dict[str, int]) -> None:
        system, at = self._at(f"heads/{version:012d}.tmp")
        out = system.create(at, True)
        out.write(bytearray(json.dumps(head).encode()))
        out.close()
        if not system.rename(at, self._at(f"heads/{version:012d}.json")[1]):
            raise OSError(f"version {version} of {self.path} is there already: another writer was first")

    # ---- rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, head: dict[str, int], only: set[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/data/{v:012d}/bucket={b}" for b, v in head.items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        return self._read(self._head()[1])

    def _rewrite(self, touched: set[int], make) -> int:
        """Replace the touched buckets by ``make(their rows)``; returns how many there were."""
        if not touched:
            return 0
        version, head = self._head()
        new = version + 1
        made = make(self._read(head, touched)).select(*self.schema.names).withColumn("bucket", self._bucket())
        made.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{new:012d}")
        full = {int(n.partition("=")[2]) for n in self._names(f"data/{new:012d}") if n.startswith("bucket=")}
        kept = {b: v for b, v in head.items() if int(b) not in touched}
        self._set_head(new, kept | {str(b): new for b in sorted(full)})
        return len(touched)

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()}  # as many as there are buckets

    def upsert(self, new: DataFrame, *newest: Column | str) -> int:
        """Rows of ``new`` replace those of equal keys; of several the first in ``newest`` counts. Returns the number of buckets rewritten."""
        new = new.select(*self.schema.names)
        return self._rewrite(self._touched(new), lambda old: R.upsert(old, new, self.keys, *newest))

    def insert_absent(self, new: DataFrame) -> int:
        """Only rows whose keys are not there yet."""
        new = new.select(*self.schema.names)
        return self._rewrite(self._touched(new), lambda old: R.insert_absent(old, new, self.keys))

    def delete(self, keys: DataFrame) -> int:
        """Rows with the keys of ``keys`` go."""
        gone = keys.select(*self.keys).distinct()

        def rest(old: DataFrame) -> DataFrame:
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"g.{k}")) for k in self.keys]
            return old.alias("o").join(gone.alias("g"), same, "left_anti")

        return self._rewrite(self._touched(gone), rest)

    def vacuum(self) -> None:
        """Delete the files and heads that the current head doesn't name; running readers of older versions lose them."""
        version, head = self._head()
        used = {(v, int(b)) for b, v in head.items()}
        for folder in self._names("data"):
            for part in self._names(f"data/{folder}"):
                if part.startswith("bucket=") and (int(folder), int(part.partition("=")[2])) not in used:
                    system, at = self._at(f"data/{folder}/{part}")
                    system.delete(at, True)
        for name in self._names("heads"):
            if name != f"{version:012d}.json":
                system, at = self._at(f"heads/{name}")
                system.delete(at, False)
