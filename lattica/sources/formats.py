"""Documents of several formats as a data source of Spark's: spark.read.format("lattica_files").load(path), or in SQL by USING.

Files are listed and read through Arrow's file systems, so paths may be local (a folder that all executors share) or in an
object store. What a file's bytes become is looked up by its extension, and formats can be added.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lattica.session import ship
from lattica.sources.readers import docx_text, pdf_text

#: Bytes of files that a task reads, about; a larger file is a task of its own.
TASK_BYTES = 64 << 20

Converter = Callable[[bytes, str], str]


def _plain(content: bytes, joiner: str) -> str:
    return content.decode("utf-8", "replace")


FORMATS: dict[str, Converter] = {".txt": _plain, ".md": _plain, ".markdown": _plain, ".mdx": _plain, ".docx": docx_text, ".pdf": pdf_text}


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, path: str, pattern: str, joiner: str, formats: dict[str, Converter]):
        self.path, self.pattern, self.joiner, self.formats = path, pattern, joiner, formats

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = self._system()
        top = system.get_file_info(root)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        known = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and os.path.splitext(f.path)[1].lower() in self.formats and fnmatch.fnmatch(f.base_name, self.pattern))
        out, held, size = [], [], 0
        for path, n in known:
            if held and size + n > TASK_BYTES:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, Files(tuple(held))]

    def read(self, partition: Files) -> Iterator[tuple[str, str, str]]:
        system, _ = self._system()
        for path in partition.names:
            with system.open_input_stream(path) as f:
                yield path, self.formats[os.path.splitext(path)[1].lower()](f.read(), self.joiner), os.path.basename(path)


def register_formats(spark: SparkSession, name: str = "lattica_files", more: dict[str, Converter] | None = None) -> None:
    """Registers the data source (path, text, filename) under a name; more: functions (bytes, joiner) -> text by further extensions.

    Options: path, a file or a folder with all below it; pattern, of file names, '*' by default; joiner, between the
    paragraphs or pages of a document, a line break by default. Files of other extensions are passed over.
    """
    ship(spark)
    formats = {**FORMATS, **{k.lower(): f for k, f in (more or {}).items()}}

    class Documents(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "path string, text string, filename string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(self.options["path"], self.options.get("pattern", "*"), self.options.get("joiner", "\n"), formats)

    spark.dataSource.register(Documents)
