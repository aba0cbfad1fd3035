"""A bounded replay log in files, and a streaming source that follows it from any event on.

The log is a folder of Parquet files with consecutive offsets. An append writes its files with Spark and then one small
head file with the first retained and the next offset; what no head names is not there yet, so readers never see half of an
append, and an append that failed is written over by the next one. Trimming is a new head, after which files that lie
wholly before it are deleted. One writer appends at a time.

The source (``spark.readStream.format("replay_log")`` after ``register``) has the log's offsets as its own: a query that is
restarted goes on after its checkpoint. Its first batch starts after the event that option ``after`` names, or with the
earliest retained one if there is no such event; a reader that fell behind the retained part goes on at its beginning.
Each file is a partition of a batch, read as Arrow batches on the executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from sparquill.sources.scratch import place_of

OFFSET = "log_offset"


def _files(path: str, sub: str, ending: str) -> list[str]:
    system, root = place_of(path)
    found = system.get_file_info(fs.FileSelector(f"{root}/{sub}", allow_not_found=True, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(ending) and "/_" not in f.path[len(root) + 1 + len(sub) :])


def head(path: str) -> dict:
    """{"first": earliest retained offset, "next": the offset of the next event}, zeros for a log without events."""
    heads = _files(path, "heads", ".json")
    if not heads:
        return {"first": 0, "next": 0}
    with place_of(path)[0].open_input_stream(heads[-1]) as f:
        return json.loads(f.read())


def _set_head(path: str, state: dict) -> None:
    system, root = place_of(path)
    system.create_dir(f"{root}/heads", recursive=True)
    name = f"{root}/heads/{len(_files(path, 'heads', '.json')):012d}"
    with system.open_output_stream(f"{name}.tmp") as f:
        f.write(json.dumps(state).encode())
    system.move(f"{name}.tmp", f"{name}.json")


def append(df: DataFrame, path: str, order: str, most: int | None = None) -> dict:
    """Append the rows of ``df`` in the order of a column; with ``most`` only so many events stay in the log. Returns the new head."""
    now = head(path)
    cut = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    part = cut.withColumn("_nth", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    folder = f"{path}/data/{now['next']:020d}"
    part.write.mode("overwrite").parquet(f"{folder}-unnumbered")
    part = df.sparkSession.read.schema(part.schema).parquet(f"{folder}-unnumbered")
    sizes, starts = {r["_part"]: r["count"] for r in part.groupBy("_part").count().collect()}, []  # a row a partition
    at = now["next"]
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    state = {"first": now["first"] if most is None else max(now["first"], at - most), "next": at}
    if starts:
        where = df.sparkSession.createDataFrame(starts, "_part int, _start long")
        numbered = part.join(F.broadcast(where), "_part").withColumn(OFFSET, F.col("_start") + F.col("_nth"))
        numbered.select(OFFSET, *df.columns).write.mode("overwrite").parquet(folder)
        _set_head(path, state)
    system, root = place_of(path)
    system.delete_dir(f"{root}/data/{now['next']:020d}-unnumbered")
    for f in _files(path, "data", ".parquet"):
        low, high = _range(system, f)
        if high < state["first"]:
            system.delete_file(f)
    return state


def _range(system: fs.FileSystem, file: str) -> tuple[int, int]:
    """The least and greatest offset of a file, from its footer; (0, -1) without rows."""
    with system.open_input_file(file) as f:
        meta = pq.ParquetFile(f).metadata
    groups = [meta.row_group(i).column(0).statistics for i in range(meta.num_row_groups) if meta.row_group(i).num_rows]
    return (min(s.min for s in groups), max(s.max for s in groups)) if groups else (0, -1)


class _Slice(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.id_col, self.after = options["path"], options.get("id", "id"), options.get("after")
        self.names = schema.names

    def _numbered(self) -> list[str]:
        return [f for f in _files(self.path, "data", ".parquet") if "-unnumbered/" not in f]

    def initialOffset(self) -> dict:  # noqa: N802
        state = head(self.path)
        if self.after is not None:
            system, _ = place_of(self.path)
            for f in self._numbered():
                with system.open_input_file(f) as source:
                    table = pq.read_table(source, columns=[OFFSET, self.id_col])
                hits = table.filter(pc.equal(table[self.id_col].cast(pa.string()), self.after))[OFFSET]
                found = [o for o in hits.to_pylist() if state["first"] <= o < state["next"]]
                if found:
                    return {"next": min(found) + 1}
        return {"next": state["first"]}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"next": head(self.path)["next"]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = max(start["next"], head(self.path)["first"]), end["next"]
        system, _ = place_of(self.path)
        out = []
        for f in self._numbered() if low < high else []:
            a, b = _range(system, f)
            if a < high and b >= low:
                out.append(_Slice(f, low, high))
        return out

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        system, _ = place_of(self.path)
        with system.open_input_file(partition.file) as source:
            for batch in pq.ParquetFile(source).iter_batches(columns=self.names):
                offset = batch.column(OFFSET)
                yield batch.filter(pc.and_(pc.greater_equal(offset, partition.start), pc.less(offset, partition.end))).select(self.names)


class ReplayLog(DataSource):
    """Options: ``path``; ``after``, the id to start after, and ``id``, the column that has it."""

    @classmethod
    def name(cls) -> str:
        return "replay_log"

    def schema(self) -> StructType:
        raise ValueError("name the log's schema, the offset with it: spark.readStream.schema(...)")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReplayLog)


def follow(spark: SparkSession, path: str, schema: str, after: str | None = None, id_col: str = "id") -> DataFrame:
    """The log as a stream: ``log_offset`` and the columns of ``schema``."""
    register(spark)
    reader = spark.readStream.format("replay_log").schema(f"{OFFSET} long, {schema}").option("path", path).option("id", id_col)
    return (reader if after is None else reader.option("after", after)).load()
