"""A streaming source over a log of numbered files, with a start position.

``spark.readStream.format("play_log")`` reads the lines of the files in the folders ``<path>/chunk=0``, ``chunk=1`` and so on, one
file in each, as (position, value). Every file but the last holds ``rows`` lines, as ``sinks.chunk_json`` writes them, so a
position gives the file and only the last one is ever counted. Options: ``path``; ``rows``; ``start``, "earliest" for the oldest
line or "latest" for those that come after the query's first start; ``per_fetch``, the most lines of a micro-batch (100 by
default); ``checkpoint``, the query's checkpoint folder, where the start position is kept and the last batch is looked up.
A query that starts again on its checkpoint goes on behind its last batch, whatever ``start`` says.
"""

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# The reader travels with the query, so its processes need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "position bigint, value string"
PER_FETCH = 100


def _opened(path: str) -> tuple[FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return FileSystem.from_uri(path)


class Span(InputPartition):
    """Lines ``first`` to ``last`` (exclusive, counted within the file) of one file; ``position`` is that of the first."""

    def __init__(self, file: str, first: int, last: int, position: int):
        self.file, self.first, self.last, self.position = file, first, last, position


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.rows, self.start = options["path"], int(options["rows"]), options.get("start", "latest")
        self.per_fetch = int(options.get("per_fetch", PER_FETCH))
        if self.start not in ("latest", "earliest"):
            raise ValueError(f"start must be latest or earliest, not {self.start}")
        self.checkpoint = options["checkpoint"]
        self.upto: int | None = None
        self.files: list[str] = []

    def _files(self) -> list[str]:
        """The files by number, up to the first that is missing. Only the folders themselves are looked into: a writer's
        temporary ones below ``path`` hold files of the same names, half written, that vanish when it is done."""
        fs, base = _opened(self.path)
        while found := [f.path for f in fs.get_file_info(FileSelector(f"{base}/chunk={len(self.files)}", allow_not_found=True))
                        if f.type == FileType.File and f.base_name.startswith("part-")]:
            self.files.append(found[0])
        return self.files

    def _end(self) -> int:
        files = self._files()
        if not files:
            return 0
        with _opened(self.path)[0].open_input_stream(files[-1]) as f:
            return (len(files) - 1) * self.rows + sum(part.count(b"\n") for part in iter(lambda: f.read(1 << 20), b""))

    def _kept(self, name: str) -> str | None:
        fs, base = _opened(self.checkpoint)
        if fs.get_file_info(f"{base}/{name}").type != FileType.File:
            return None
        with fs.open_input_stream(f"{base}/{name}") as f:
            return f.read().decode()

    def initialOffset(self) -> dict:
        kept = self._kept("log_start")
        if kept is None:
            kept = str(0 if self.start == "earliest" else self._end())
            fs, base = _opened(self.checkpoint)
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(f"{base}/log_start") as f:
                f.write(kept.encode())
        return {"position": int(kept)}

    def _last_batch(self) -> int:
        """Where the last batch ended, by the query's offset log, or the start position."""
        fs, base = _opened(self.checkpoint)
        batches = [int(f.base_name) for f in fs.get_file_info(FileSelector(f"{base}/offsets", allow_not_found=True))
                   if f.base_name.isdigit()]
        if batches:
            return json.loads(self._kept(f"offsets/{max(batches)}").split("\n")[-1])["position"]
        return self.initialOffset()["position"]

    def latestOffset(self) -> dict:
        """At most ``per_fetch`` lines beyond the last batch."""
        if self.upto is None:
            self.upto = self._last_batch()
        self.upto = max(self.upto, min(self._end(), self.upto + self.per_fetch))
        return {"position": self.upto}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        """One for each file that holds lines of the batch."""
        first, last, files = start["position"], end["position"], self._files()
        spans = []
        for n in range(first // self.rows, -(-last // self.rows)):
            low, high = max(first, n * self.rows), min(last, (n + 1) * self.rows)
            if low < high:
                spans.append(Span(files[n], low - n * self.rows, high - n * self.rows, low))
        return spans

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        with _opened(self.path)[0].open_input_stream(partition.file) as f:
            lines = f.read().split(b"\n")[partition.first:partition.last]
        positions = range(partition.position, partition.position + len(lines))
        yield pa.RecordBatch.from_arrays([pa.array(positions, pa.int64()), pa.array(
            [x.decode("utf-8", "replace") for x in lines], pa.string())], ["position", "value"])


class PlayLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "play_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


def read_log(spark: SparkSession, path: str, rows: int, checkpoint: str, start: str = "latest",
             per_fetch: int = PER_FETCH) -> DataFrame:
    """Stream (position, value) of a log folder of ``rows`` lines to a file into a query with that ``checkpoint``."""
    spark.dataSource.register(PlayLog)
    reader = spark.readStream.format("play_log").option("path", path).option("rows", rows).option("checkpoint", checkpoint)
    return reader.option("start", start).option("per_fetch", per_fetch).load()
