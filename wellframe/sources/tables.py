"""Small tables of many file kinds as Spark data sources: ``spark.read.format("sheet")`` and ``("reference")``.

``sheet`` reads .xlsx, .tsv, .tab and .csv files: the first row that isn't blank names the columns, which are strings.
``reference`` reads .yaml, .yml and .json files of records: a list of mappings, or a mapping of names to mappings, whose names
become the column of the option ``key`` (default "name"); nested values are JSON text.  Both take ``path``: a file, a folder or a
pattern, on any file system that pyarrow opens; every file is a partition.  Columns that a file lacks are null there.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType


def _files(path: str, endings: tuple[str, ...]) -> list[str]:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)
    scheme = path[: path.index(":")] if re.match(r"[a-z0-9]+:/", path) else "file"
    folder, pattern = (root.rstrip("/"), "*") if "*" not in root else root.rsplit("/", 1)
    info = system.get_file_info(folder)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(folder)) if info.type == fs.FileType.Directory else []
    names = sorted(i.path for i in found if i.is_file and i.path.lower().endswith(endings) and (info.is_file or fnmatch.fnmatch(i.base_name, pattern)))
    if not names:
        raise FileNotFoundError(f"no {'/'.join(endings)} file at {path}")
    return [f"{scheme}://{n}" for n in names]


def _content(uri: str) -> bytes:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as f:
        return f.read()


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _text(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter() if _tag(t) == "t")


def xlsx_rows(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a workbook's first sheet, or the one of this name, as text; cells that are not stored are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [_text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _tag(e) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = {e.get("name"): next(v for k, v in e.attrib.items() if k.endswith("}id")) for e in book.iter() if _tag(e) == "sheet"}
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet!r} among {list(sheets)}")
        target = targets[sheets[sheet] if sheet is not None else next(iter(sheets.values()))]
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if _tag(row) != "row":
                    continue
                out: list[str | None] = []
                for cell in row:
                    column = 0
                    for letter in re.match("[A-Z]*", cell.get("r", ""))[0]:
                        column = 26 * column + ord(letter) - 64
                    out += [None] * (max(column, len(out) + 1) - len(out))
                    value = next((v.text for v in cell if _tag(v) == "v"), None)
                    kind = cell.get("t")
                    out[(column or len(out)) - 1] = _text(cell) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value is not None else value
                row.clear()
                yield out


def rows_of(uri: str, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a file that aren't blank."""
    content = _content(uri)
    if uri.lower().endswith(".xlsx"):
        rows = xlsx_rows(content, sheet)
    else:
        rows = csv.reader(io.StringIO(content.decode("utf-8-sig")), delimiter="," if uri.lower().endswith(".csv") else "\t")
    return (r for r in rows if any(c is not None and c.strip() for c in r))


def records_of(uri: str, key: str) -> Iterator[dict[str, str | None]]:
    """The records of a YAML or JSON file, all values as text."""
    content = _content(uri)
    if uri.lower().endswith(".json"):
        data = json.loads(content)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ImportError("YAML files need the yaml package; JSON files don't") from e
        data = yaml.safe_load(content)
    if isinstance(data, dict):
        data = [{key: k, **(v if isinstance(v, dict) else {"value": v})} for k, v in data.items()]
    for record in data or []:
        if not isinstance(record, dict):
            raise ValueError(f"{uri}: a record is no mapping: {record!r}")
        yield {str(k): v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str) for k, v in record.items()}


class _File(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class _Reader(DataSourceReader):
    def __init__(self, source: _Tables, schema: StructType):
        self.source, self.names = source, schema.names

    def partitions(self) -> list[InputPartition]:
        return [_File(u) for u in self.source.files()]

    def read(self, partition: _File) -> Iterator[tuple]:
        for r in self.source.records(partition.uri):
            yield tuple(r.get(n) for n in self.names)


class _Tables(DataSource):
    endings: tuple[str, ...] = ()

    def files(self) -> list[str]:
        if "path" not in self.options:
            raise ValueError("a path is needed")
        return _files(self.options["path"], self.endings)

    def schema(self) -> StructType:
        """The columns of the first file, as strings."""
        return StructType([StructField(n, StringType()) for n in self.columns(self.files()[0])])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self, schema)


class Sheet(_Tables):
    endings = (".xlsx", ".tsv", ".tab", ".csv")

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def columns(self, uri: str) -> list[str]:
        return [h.strip() for h in next(rows_of(uri, self.options.get("sheet")), []) if h and h.strip()]

    def records(self, uri: str) -> Iterator[dict[str, str | None]]:
        rows = rows_of(uri, self.options.get("sheet"))
        names = [(h or "").strip() for h in next(rows, [])]
        return (dict(zip(names, r, strict=False)) for r in rows)


class Reference(_Tables):
    endings = (".yaml", ".yml", ".json")

    @classmethod
    def name(cls) -> str:
        return "reference"

    def columns(self, uri: str) -> list[str]:
        return list(dict.fromkeys(n for r in self.records(uri) for n in r))

    def records(self, uri: str) -> Iterator[dict[str, str | None]]:
        return records_of(uri, self.options.get("key", "name"))


def register(spark: SparkSession) -> None:
    """Make both sources known to a session."""
    spark.dataSource.register(Sheet)
    spark.dataSource.register(Reference)
