"""A streaming source of logs that are still written to: whole lines that were appended, by byte offsets per file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "appended_lines"
SCHEMA = "path string, start long, stop long, line string"
#: Bytes that one task reads; a line belongs to the range that it starts in.
RANGE = 64 << 20
CHUNK = 1 << 20


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, whole: int):
        self.path, self.start, self.stop, self.whole = path, start, stop, whole


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.suffix = options["path"], options.get("suffix", "")
        self.range = int(options.get("rangebytes", RANGE))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """Each file's bytes up to its last line break: what follows is an incomplete tail and waits."""
        store, root = fs.FileSystem.from_uri(self.folder)
        files = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        found = {f.path: self._whole(store, f.path, f.size) for f in files if f.type == fs.FileType.File and f.path.endswith(self.suffix)}
        return {path: n for path, n in sorted(found.items()) if n}

    @staticmethod
    def _whole(store: fs.FileSystem, path: str, size: int) -> int:
        with store.open_input_file(path) as f:
            while size > 0:
                a = max(0, size - CHUNK)
                f.seek(a)
                at = f.read(size - a).rfind(b"\n")
                if at >= 0:
                    return a + at + 1
                size = a
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        """Ranges of what was appended. A file that has become shorter is left alone until it is longer than it was."""
        out = []
        for path, whole in end.items():
            out += [Range(path, a, min(a + self.range, whole), whole) for a in range(start.get(path, 0), whole, self.range)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        with store.open_input_file(part.path) as f:
            at, rest = part.start, b""
            if at > 0:
                # a line that started in the range before is read there
                f.seek(at - 1)
                while (i := (piece := f.read(CHUNK)).find(b"\n")) < 0 and piece and f.tell() < part.whole:
                    pass
                at = f.tell() - len(piece) + i + 1 if i >= 0 else part.whole
            f.seek(at)
            done = at >= part.stop
            while not done and (piece := f.read(min(CHUNK, part.whole - f.tell()))):
                *lines, rest = (rest + piece).split(b"\n")
                rows = []
                for line in lines:
                    if at >= part.stop:
                        done = True
                        break
                    rows.append((at, at + len(line) + 1, line))
                    at += len(line) + 1
                if rows:
                    a, b, text = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(rows)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([x.decode("utf-8", "replace") for x in text])], names=["path", "start", "stop", "line"])
                done = done or at >= part.stop

    def commit(self, end: dict) -> None:
        """Nothing to release: offsets are in the checkpoint."""


class AppendedLines(DataSource):
    """``path, start, stop, line``: the whole lines of a folder's files as they are appended, with their bytes.

    Only appended bytes are read; an incomplete last line waits for its break; a restart goes on from the
    offsets in the checkpoint. Options: ``path`` (any URI that pyarrow opens), ``suffix`` of the file names,
    ``rangebytes`` a task. The offset holds a number for each file of the folder.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Reader:  # noqa: N802
        return Reader({k.lower(): v for k, v in self.options.items()})


def lines(spark: SparkSession, folder: str, suffix: str = "", range_bytes: int = RANGE) -> DataFrame:
    """The folder's appended lines as a stream."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format(NAME).option("suffix", suffix).option("rangebytes", str(range_bytes)).load(folder)


def progress(rows: DataFrame) -> DataFrame:
    """Of each log: bytes of whole lines, records, the digest of the last one, and whether a line isn't a JSON object."""
    record = F.trim("line") != ""
    malformed = record & ~F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False))
    last = F.max_by(F.sha2(F.encode("line", "UTF-8"), 256), F.when(record, F.col("start")))
    return rows.groupBy("path").agg(F.max("stop").alias("complete_size"), F.count_if(record).alias("n_records"), last.alias("last_record_sha256"), F.bool_or(malformed).alias("malformed"))
