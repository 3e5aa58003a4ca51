"""Result pages of job searches as data sources (SC9, SC10).

``spark.read.format("stepstone").load(folder)`` reads answers that were landed
as ``keyword=<slug>/page=<n>/<any file>``, or below a further folder
``place=<slug>``, and gives their postings.  A folder of its own for each answer
is for few of them: the driver lists every name.  Many are landed in Parquet
files (keyword, page, html, perhaps place), each row one answer and each file a
bounded number of them, since a file is read by one task.  The options ``keywords`` (a JSON
list), ``place``, ``first_page`` and ``last_page`` choose among them before a
file is opened; what remains is dealt into ``numPartitions`` tasks (200) at most.

The choice is made by options and not by ``pushFilters``: a filter pushed into
a Python source stays with the loaded relation (Spark 4.1), so a later query
over the same DataFrame would miss rows.

As a stream, answers come in order of their file names, whatever their folder:
an offset is the last name that was read, so a new name must be greater than
all that have been there (one that begins with a time or a counter is).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.dom import parse
from ..operators.extract import LAYOUTS, read
from .json_export import file_system

SCHEMA = "keyword string, place string, page int, pos int, title string, company string, location string, url string, source string"
#: Where the addresses of a search's postings begin, and the name of the source.
SITES = {"stepstone": ("https://www.stepstone.de", "stepstone.de"), "karriere": ("https://www.karriere.at", "karriere.at")}


@dataclass(frozen=True)
class Answers:
    """The landed answers of one keyword, place and page (0 is the first)."""

    keyword: str
    place: str | None
    page: int
    files: tuple[str, ...]


@dataclass(frozen=True)
class Table:
    """A Parquet file of answers, of which each row is one."""

    file: str


@dataclass
class Some(InputPartition):
    """What one task reads."""

    answers: list[Answers | Table]


def dealt(answers: list[Answers | Table], tasks: int) -> list[Some]:
    size = max(1, -(-len(answers) // tasks))
    return [Some(answers[i : i + size]) for i in range(0, max(1, len(answers)), size)]


def _parts(name: str) -> dict[str, str]:
    return {k: unquote(v) for k, v in re.findall(r"(?:^|/)(keyword|place|page)=([^/]*)", name)}


def _is_answer(parts: dict[str, str]) -> bool:
    return "keyword" in parts and parts.get("page", "").isdigit()


def _is_table(name: str) -> bool:
    return name.endswith(".parquet") and not _is_answer(_parts(name))


def _listing(path: str) -> list[str]:
    """Names of the answers below a folder; a file whose path names no keyword and page is none, unless it is a table of them.

    The part of a path that is given (the folder) doesn't count.
    """
    fs, at = file_system(path)
    infos = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    hidden = lambda n: any(p.startswith(("_", ".")) for p in n.split("/"))
    names = (i.path[len(at) :].lstrip("/") for i in infos if i.type == pafs.FileType.File)
    return sorted(n for n in names if not hidden(n) and (_is_table(n) or _is_answer(_parts(n))))


def _name(path: str) -> str:
    return path.rpartition("/")[2]


def grouped(path: str, names: Iterable[str]) -> list[Answers | Table]:
    found: dict[tuple, list[str]] = {}
    tables: list[Answers | Table] = []
    for n in names:
        if _is_table(n):
            tables.append(Table(f"{path.rstrip('/')}/{n}"))
            continue
        p = _parts(n)
        found.setdefault((p["keyword"], p.get("place"), int(p["page"])), []).append(f"{path.rstrip('/')}/{n}")
    return tables + [Answers(*key, tuple(files)) for key, files in sorted(found.items(), key=lambda x: (x[0][0], x[0][1] or "", x[0][2]))]


def _texts(files: Iterable[str]) -> Iterator[str]:
    for name in files:
        fs, at = file_system(name)
        with fs.open_input_stream(at) as f:
            yield f.read().decode("utf-8", "replace")


def postings(site: str, keyword: str, place: str | None, page: int, texts: Iterable[str | None]) -> Iterator[tuple]:
    """The postings of one page of results, text after text."""
    base, source = SITES[site]
    found = (p for html in texts for p in read(parse(html), base, LAYOUTS[site]))
    for pos, p in enumerate(found):
        yield (keyword, place, page, pos, p["title"], p["company"] or "Unknown", p["location"], p["url"], source)


#: Rows of a table of answers that a task holds at a time.
ROWS = 64


@dataclass(frozen=True)
class Choice:
    """Which answers are read; None: any."""

    keywords: frozenset[str] | None = None
    place: str | None = None
    first_page: int = 0
    last_page: int | None = None

    @classmethod
    def of(cls, options) -> Choice:
        words, last = options.get("keywords"), options.get("last_page")
        return cls(None if words is None else frozenset(json.loads(words)), options.get("place"), int(options.get("first_page", 0)), None if last is None else int(last))

    def fits(self, a: Answers | Table) -> bool:
        """Whether a task reads it; rows of a table are chosen as they are read."""
        if isinstance(a, Table):
            return True
        page = self.first_page <= a.page and (self.last_page is None or a.page <= self.last_page)
        return page and (self.keywords is None or a.keyword in self.keywords) and (self.place is None or a.place == self.place)

    def rows(self, table: Table) -> Iterator[dict]:
        """The chosen answers of a table; null pages and keywords are none."""
        fs, at = file_system(table.file)
        data = ds.dataset(at, format="parquet", filesystem=fs)
        where = (ds.field("page") >= self.first_page) & ds.field("keyword").is_valid()
        if self.last_page is not None:
            where &= ds.field("page") <= self.last_page
        if self.keywords is not None:
            where &= ds.field("keyword").isin(pa.array(sorted(self.keywords), pa.string()))
        placed = "place" in data.schema.names
        if self.place is not None:
            where &= ds.field("place") == self.place if placed else ds.scalar(False)
        columns = ["keyword", "page", "html", *(["place"] if placed else [])]
        for batch in data.to_batches(columns=columns, filter=where, batch_size=ROWS, batch_readahead=1, fragment_readahead=1):
            yield from batch.to_pylist()

    def postings(self, site: str, a: Answers | Table) -> Iterator[tuple]:
        if isinstance(a, Answers):
            yield from postings(site, a.keyword, a.place, a.page, _texts(a.files))
        else:
            for r in self.rows(a):
                yield from postings(site, r["keyword"], r.get("place"), int(r["page"]), [r["html"]])


class _Reader(DataSourceReader):
    def __init__(self, site: str, path: str, tasks: int, choice: Choice):
        self.site, self.path, self.tasks, self.choice = site, path, tasks, choice

    def partitions(self) -> list[Some]:
        return dealt(list(filter(self.choice.fits, grouped(self.path, _listing(self.path)))), self.tasks)

    def read(self, partition: Some) -> Iterator[tuple]:
        for a in partition.answers:
            yield from self.choice.postings(self.site, a)


class _Stream(DataSourceStreamReader):
    def __init__(self, site: str, path: str, tasks: int, choice: Choice):
        self.site, self.path, self.tasks, self.choice = site, path, tasks, choice

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(map(_name, _listing(self.path)), default="")}

    def partitions(self, start: dict, end: dict) -> list[Some]:
        fresh = [n for n in _listing(self.path) if start["after"] < _name(n) <= end["after"]]
        return dealt(list(filter(self.choice.fits, grouped(self.path, fresh))), self.tasks)

    def read(self, partition: Some) -> Iterator[tuple]:
        for a in partition.answers:
            yield from self.choice.postings(self.site, a)

    def commit(self, end: dict) -> None:
        """Answers stay where they are."""


class _Search(DataSource):
    def _asked(self) -> tuple:
        return self.name(), self.options["path"], int(self.options.get("numPartitions", 200)), Choice.of(self.options)

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(*self._asked())

    def streamReader(self, schema: StructType) -> _Stream:
        return _Stream(*self._asked())


class Stepstone(_Search):
    """SC9."""

    @classmethod
    def name(cls) -> str:
        return "stepstone"


class Karriere(_Search):
    """SC10."""

    @classmethod
    def name(cls) -> str:
        return "karriere"


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    for source in (Stepstone, Karriere):
        spark.dataSource.register(source)
