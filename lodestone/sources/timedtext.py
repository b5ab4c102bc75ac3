"""Files of timed text as a data source: spark.read.format("timed_text").load(folder).

The driver lists names and sizes only; tasks read and decode. Each partition is a run of files of about
`bytesPerPartition` bytes. The text is decoded by its mark (UTF-8 or UTF-16), else as UTF-8, else as Windows
text, else as Latin text, which any bytes are. The format is told by the name, or by the header of script files.
Folders that only Spark's own readers can open: `subtitles.read_texts`.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .subtitles import SUBTITLES, parse_ass, parse_srt


def decoded(raw: bytes) -> tuple[str, str]:
    """The name of the encoding, and the text."""
    marks = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
    for name in (*(n for mark, n in marks if raw.startswith(mark)), "utf-8", "cp1252"):
        try:
            return name, raw.decode(name)
        except UnicodeError:
            continue
    return "latin-1", raw.decode("latin-1")


def format_of(path: str, text: str) -> str:
    ext = path.rpartition(".")[2].lower()
    return "ass" if ext in ("ass", "ssa") or "[Script Info]" in text[:200] else "vtt" if ext == "vtt" else "srt"


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TimedTextReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("bytesPerPartition", 32 << 20))

    def _store(self):
        return fs.FileSystem.from_uri(self.path if "://" in self.path or not self.path.startswith("file:") else "file://" + self.path.removeprefix("file:"))

    def partitions(self) -> list[Files]:
        store, root = self._store()
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.rpartition(".")[2].lower() in SUBTITLES)
        groups: list[list[str]] = [[]]
        size = 0
        for path, n in files:
            if groups[-1] and size + n > self.size:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = self._store()
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                raw = f.read()
            name, text = decoded(raw)
            yield path, format_of(path, text), name, len(raw), text


class TimedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "timed_text"

    def schema(self) -> str:
        return "path string, format string, encoding string, size long, raw string"

    def reader(self, schema) -> TimedTextReader:
        return TimedTextReader(self.options)


def read_files(spark: SparkSession, folder: str, bytes_per_partition: int = 32 << 20) -> DataFrame:
    """path, format (srt, vtt, ass), encoding, size and raw of the subtitle files below a folder; none: no rows."""
    spark.dataSource.register(TimedText)
    return spark.read.format("timed_text").option("bytesPerPartition", bytes_per_partition).load(folder)


def read_cues(spark: SparkSession, folder: str, bytes_per_partition: int = 32 << 20) -> DataFrame:
    """path, start, end and text of each cue in the subtitle files below a folder."""
    files = read_files(spark, folder, bytes_per_partition)
    return parse_srt(files.where("format != 'ass'"), "path").unionByName(parse_ass(files.where("format = 'ass'"), "path"))
