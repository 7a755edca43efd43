"""A streaming data source for a folder of Parquet files that grows, with offsets from which a stream goes on.

A file's place is its time and name. An offset is the place of the last file that a batch has;
a batch is the files after one offset up to another, so a batch that is run again has the
same rows, and a stream that starts again goes on behind the last one it had committed.
Files aren't changed once they are there. This module imports nothing of the package,
since Spark's planning processes get it by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Rows that a reading task gives at once, and bytes of a column that it reads at once.
ROWS, BUFFERED = 512, 1 << 20


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class RowGroups(InputPartition):
    """Some row groups of a file."""

    def __init__(self, name: str, first: int, last: int):
        self.name, self.first, self.last = name, first, last


class CorpusReader(DataSourceStreamReader):
    def __init__(self, options: dict, columns: list[str]):
        self.folder, self.columns = options["path"].rstrip("/"), columns
        self.groups = max(1, int(options.get("rowGroups", "1")))

    def _files(self) -> list[tuple[int, str]]:
        """(time, path) of the files in order; files whose names begin with . or _ aren't whole yet."""
        from pyarrow import fs

        where, path = _fs(self.folder)
        found = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted((f.mtime_ns or 0, f.path) for f in found if f.is_file and f.base_name.endswith(".parquet") and f.base_name[0] not in "._")

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        files = self._files()
        return {"time": files[-1][0], "name": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[RowGroups]:
        import pyarrow.parquet as pq

        where, _ = _fs(self.folder)
        place = lambda x: (x["time"], x["name"])
        out = []
        for time, name in self._files():
            if place(start) < (time, name) <= place(end):
                with where.open_input_file(name) as f:
                    n = pq.ParquetFile(f).num_row_groups
                out += [RowGroups(name, a, min(a + self.groups, n)) for a in range(0, n, self.groups)]
        return out

    def read(self, partition: RowGroups):
        import pyarrow.parquet as pq

        where, _ = _fs(self.folder)
        with where.open_input_file(partition.name) as f:
            # Whole row groups in memory would make a task as large as the writer's files.
            yield from pq.ParquetFile(f, pre_buffer=False, buffer_size=BUFFERED).iter_batches(ROWS, row_groups=range(partition.first, partition.last), columns=self.columns)

    def commit(self, end: dict) -> None:
        pass


class CorpusSource(DataSource):
    """``spark.readStream.format("corpus").schema(...).load(folder)``: the columns of the schema, by name."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def streamReader(self, schema) -> CorpusReader:
        return CorpusReader(dict(self.options), list(schema.names))


def corpus_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all files of ``folder``, and of those that come, as a stream."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(CorpusSource)
    return spark.readStream.format("corpus").schema(schema).load(folder)
