"""Collections of JSON lines, Markdown reports, CSV lines and sitemaps as sources and sinks of Spark.

`register(spark)` makes the formats known: evidence (read and write), report, csvlines and sitemap (write).

Readers deal files out to partitions in groups of about `groupBytes`; a line that is no row of the schema is kept in the
column `_corrupt`, if the schema has one, with all else null, and left out if not. With the option
`pushdown` equal-to filters are applied while reading; Spark wants spark.sql.python.filterPushdown.enabled for it.

Writers: a task writes its parts to a folder `_writing-...` of the target, of which readers know nothing; when all tasks are
done the driver moves the parts to their place, so a failed job or task leaves nothing visible, and one that runs
twice leaves one copy. `mode("overwrite")` removes the old parts after the new ones are complete. Paths are any that
pyarrow reaches (local or mounted folders, hdfs, s3), the same from all executors.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType


def _at(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (FileSystem.from_uri(f"file://{path}"))


def _files(path: str, suffix: str) -> list[tuple[str, int]]:
    files, top = _at(path)
    found = files.get_file_info(FileSelector(top, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == FileType.File and f.base_name.endswith(suffix) and f.base_name[0] not in "._")


@dataclass
class FileGroup(InputPartition):
    paths: list[str]


_FITS = {LongType: lambda v: type(v) is int, DoubleType: lambda v: type(v) in (int, float), StringType: lambda v: isinstance(v, str), BooleanType: lambda v: isinstance(v, bool)}


class EvidenceReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.path = schema, options["path"]
        self.size = int(options.get("groupBytes", 1 << 26))
        self.wanted: dict[str, object] = {}
        for f in schema.fields:
            if type(f.dataType) not in _FITS:
                raise ValueError(f"{f.name}: long, double, string and boolean columns can be read")

    def partitions(self) -> list[FileGroup]:
        groups, held = [FileGroup([])], 0
        for path, size in _files(self.path, ".jsonl"):
            if held and held + size > self.size:
                groups.append(FileGroup([]))
                held = 0
            groups[-1].paths.append(path)
            held += size
        return groups

    def read(self, partition: FileGroup) -> Iterator[tuple]:
        files, _ = _at(self.path)
        names = [f.name for f in self.schema.fields]
        fits = {f.name: _FITS[type(f.dataType)] for f in self.schema.fields if f.name != "_corrupt"}
        for path in partition.paths:
            with files.open_input_stream(path) as raw:
                for line in io.TextIOWrapper(raw, "utf-8", errors="replace", newline="\n"):
                    text = line.rstrip("\n")
                    if not text:
                        continue
                    try:
                        row = json.loads(text)
                        ok = isinstance(row, dict) and all(row.get(n) is None or fit(row[n]) for n, fit in fits.items())
                    except ValueError:
                        ok = False
                    if not ok:
                        row = {"_corrupt": text}
                    if (ok or "_corrupt" in names) and all(row.get(n) == v for n, v in self.wanted.items()):
                        yield tuple(float(row[f.name]) if isinstance(f.dataType, DoubleType) and row.get(f.name) is not None else row.get(f.name) for f in self.schema.fields)


class FilteringReader(EvidenceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1:
                self.wanted[f.attribute[0]] = f.value
            yield f  # Spark filters again, which is cheap on what is left


@dataclass
class Parts(WriterCommitMessage):
    names: list[str]


class PartWriter(DataSourceWriter):
    """Parts of at most `most` rows each; formats say how a part begins and ends, and what a row is."""

    suffix, most = ".txt", 1 << 62

    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool) -> None:
        self.names, self.options, self.overwrite = [f.name for f in schema.fields], options, overwrite
        self.path = options["path"].rstrip("/")
        self.staging = f"_writing-{uuid.uuid4().hex}"
        self.most = int(options.get("rowsPerFile", self.most))
        files, top = _at(self.path)
        files.create_dir(f"{top}/{self.staging}", recursive=True)

    def begin(self) -> str:
        return ""

    def end(self) -> str:
        return ""

    def line(self, row: Row) -> str:
        raise NotImplementedError

    def write(self, rows: Iterator[Row]) -> Parts:
        files, top = _at(self.path)
        task, names, out, n = TaskContext.get(), [], None, 0
        for row in rows:
            if out is None or n == self.most:
                if out is not None:
                    out.write(self.end().encode())
                    out.close()
                names.append(f"part-{task.partitionId():05}-{len(names):05}-{self.staging[-8:]}{self.suffix}")
                # attempts of one task have names of their own until one of them is committed
                out, n = files.open_output_stream(f"{top}/{self.staging}/{task.taskAttemptId()}-{names[-1]}"), 0
                out.write(self.begin().encode())
            out.write(self.line(row).encode())
            n += 1
        if out is not None:
            out.write(self.end().encode())
            out.close()
        return Parts([f"{task.taskAttemptId()}-{x}" for x in names])

    def commit(self, messages: list[Parts | None]) -> None:
        files, top = _at(self.path)
        old = [p for p, _ in _files(self.path, self.suffix)] if self.overwrite else []
        made = [x for m in messages if m for x in m.names]
        for x in made:
            files.move(f"{top}/{self.staging}/{x}", f"{top}/{x.split('-', 1)[1]}")
        for p in old:
            files.delete_file(p)
        self.finish([x.split("-", 1)[1] for x in made])
        files.delete_dir(f"{top}/{self.staging}")

    def finish(self, names: list[str]) -> None:
        """What is written last, when all parts are in their place."""

    def abort(self, messages: list[Parts | None]) -> None:
        files, top = _at(self.path)
        files.delete_dir(f"{top}/{self.staging}")


class EvidenceWriter(PartWriter):
    suffix = ".jsonl"

    def line(self, row: Row) -> str:
        return json.dumps(dict(zip(self.names, row, strict=True)), ensure_ascii=False) + "\n"


class ReportWriter(PartWriter):
    """Rows of a Markdown table, a column each, under the table's head."""

    suffix = ".md"

    def begin(self) -> str:
        title = self.options.get("title")
        return (f"# {title}\n\n" if title else "") + f"| {' | '.join(self.names)} |\n|{'---|' * len(self.names)}\n"

    def line(self, row: Row) -> str:
        return "| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in row) + " |\n"


class CsvLinesWriter(PartWriter):
    """Rows of differing width: a column of arrays of texts, each quoted."""

    suffix = ".csv"

    def line(self, row: Row) -> str:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n").writerow(row[0] or [])
        return out.getvalue()


class SitemapWriter(PartWriter):
    """(loc, lastmod, priority) as parts of at most 50,000 addresses each, and an index of the parts; option `base` is the address of the folder."""

    suffix, most = ".xml", 50_000
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'

    def begin(self) -> str:
        return f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset {self.space}>\n'

    def end(self) -> str:
        return "</urlset>\n"

    def line(self, row: Row) -> str:
        return "<url>" + "".join(f"<{n}>{escape(str(v), quote=False)}</{n}>" for n, v in zip(self.names, row, strict=True) if v is not None) + "</url>\n"

    def finish(self, names: list[str]) -> None:
        files, top = _at(self.path)
        base = self.options.get("base", "").rstrip("/")
        listed = sorted(p.rsplit("/", 1)[1] for p, _ in _files(self.path, self.suffix) if "/part-" in p)
        body = "".join(f"<sitemap><loc>{escape(f'{base}/{n}', quote=False)}</loc></sitemap>\n" for n in listed)
        with files.open_output_stream(f"{top}/sitemap_index.xml") as out:
            out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex {self.space}>\n{body}</sitemapindex>\n'.encode())


def _sink(format_name: str, made: type[PartWriter]) -> type[DataSource]:
    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return made(schema, self.options, overwrite)

    return Sink


class Evidence(_sink("evidence", EvidenceWriter)):
    def schema(self) -> str:
        return "id long, seq long, tag string, payload string, _corrupt string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else EvidenceReader)(schema, self.options)


Report, CsvLines, Sitemap = _sink("report", ReportWriter), _sink("csvlines", CsvLinesWriter), _sink("sitemap", SitemapWriter)


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session: evidence, report, csvlines, sitemap."""
    for source in (Evidence, Report, CsvLines, Sitemap):
        spark.dataSource.register(source)
