"""Table functions for SQL text, whose columns follow their arguments, and the registry of functions by name.

    SELECT * FROM chunks(TABLE(docs), 'text', 800, 100)
    SELECT * FROM matches(TABLE(docs) PARTITION BY (lang), 'text', 'term', 5)
    SELECT * FROM markdown_tables(TABLE(docs), 'text', 'name,nation')

Each takes any table: the other columns of its rows come with what is found in them. Rows of a partition are
streamed; ``matches`` holds its best rows of one partition, ``most`` of them at a time.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DataType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from brambling.operators.retrieval import SEPARATORS, split_text

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass
class _With(AnalyzeResult):
    """The columns that are passed on, and the text column's name."""

    kept: tuple[str, ...] = ()
    text: str = ""


def _analyzed(rows: AnalyzeArgument, text: AnalyzeArgument, found: list[StructField], keep_text: bool = False) -> _With:
    if not rows.isTable or not isinstance(rows.dataType, StructType):
        raise ValueError("the first argument must be a table: TABLE(name)")
    if not text.isConstantExpression or text.value not in rows.dataType.names:
        raise ValueError(f"the second argument must name a column of the table: {', '.join(rows.dataType.names)}")
    new = {f.name for f in found}
    kept = [f for f in rows.dataType.fields if (keep_text or f.name != text.value) and f.name not in new]  # found columns win over those of their names
    return _With(StructType([StructField(f.name, f.dataType) for f in kept] + found), kept=tuple(f.name for f in kept), text=text.value)


def _constant(argument: AnalyzeArgument, kind: type, name: str) -> object:
    if not argument.isConstantExpression or not isinstance(argument.value, kind):
        raise ValueError(f"{name} must be a constant {kind.__name__}")
    return argument.value


@udtf
class Chunks:
    """The chunks of every row's text: chunk_no (from 0) and chunk. ``cuts``: separators, the best first, between spaces' escapes ``\\s`` and ``\\n``."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument, plain: AnalyzeArgument | None = None) -> AnalyzeResult:
        if _constant(size, int, "size") < 1 or not 0 <= _constant(overlap, int, "overlap") < size.value:
            raise ValueError("size must be positive, and overlap less than size")
        return _analyzed(rows, text, [StructField("chunk_no", IntegerType()), StructField("chunk", StringType())])

    def __init__(self, analyzed: _With) -> None:
        self.analyzed = analyzed

    def eval(self, row, text, size, overlap, plain=False):
        kept = [row[c] for c in self.analyzed.kept]
        for k, chunk in enumerate(split_text(row[self.analyzed.text] or "", size, overlap, [""] if plain else SEPARATORS)):
            yield (*kept, k, chunk)


@udtf
class Matches:
    """Of every partition the rows whose text has a term most often, whatever its case: hits and place (from 1); ties go to the earlier row
    by its first column."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, term: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if not _constant(term, str, "term") or _constant(most, int, "most") < 1:
            raise ValueError("term must not be empty, and most must be positive")
        return _analyzed(rows, text, [StructField("hits", LongType()), StructField("place", IntegerType())])

    def __init__(self, analyzed: _With) -> None:
        self.analyzed, self.best, self.most, self.seen = analyzed, [], 0, 0

    def eval(self, row, text, term, most):
        hits = (row[self.analyzed.text] or "").lower().count(term.lower())
        self.most, self.seen = most, self.seen + 1
        if hits:
            first = row[0]
            rank = (hits, _Last(first), -self.seen)
            push = heapq.heappush if len(self.best) < most else heapq.heappushpop
            push(self.best, (rank, tuple(row[c] for c in self.analyzed.kept)))

    def terminate(self):
        for place, (rank, kept) in enumerate(sorted(self.best, reverse=True), 1):
            yield (*kept, rank[0], place)


class _Last:
    """Orders the other way round, nulls last."""

    def __init__(self, value: object) -> None:
        self.value = value

    def __lt__(self, other: _Last) -> bool:
        if self.value is None or other.value is None:
            return self.value is None and other.value is not None
        return self.value > other.value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Last) and self.value == other.value


_ROW = re.compile(r"^\|.*\|\s*$")
_DIVIDER = re.compile(r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?$")


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip()[1:-1].split("|")]


@udtf
class MarkdownTables:
    """The rows of the pipe tables in every row's text: table_no and row_no (from 0), and a column for each name of a list, null where
    the table doesn't have it. Tables without any of the names are passed over."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, names: AnalyzeArgument) -> AnalyzeResult:
        wanted = [n.strip() for n in _constant(names, str, "names").split(",")]
        if not all(NAME.fullmatch(n) for n in wanted) or len({n.lower() for n in wanted}) < len(wanted):
            raise ValueError("names must be different identifiers, separated by commas")
        return _analyzed(rows, text, [StructField("table_no", IntegerType()), StructField("row_no", IntegerType())] + [StructField(n, StringType()) for n in wanted])

    def __init__(self, analyzed: _With) -> None:
        self.analyzed = analyzed

    def eval(self, row, text, names):
        kept, wanted = [row[c] for c in self.analyzed.kept], [n.strip().lower() for n in names.split(",")]
        lines, k, code, table = re.split(r"\r\n?|\n", row[self.analyzed.text] or ""), 0, False, 0
        while k < len(lines):
            code ^= lines[k].startswith("```")
            if code or not _ROW.match(lines[k]) or k + 1 == len(lines) or not _DIVIDER.match(lines[k + 1]):
                k += 1
                continue
            head, k, n = [c.lower() for c in _cells(lines[k])], k + 2, 0
            at = [head.index(w) if w in head else None for w in wanted]
            while k < len(lines) and _ROW.match(lines[k]):
                cells = _cells(lines[k])
                if any(a is not None for a in at):
                    yield (*kept, table, n, *[cells[a] if a is not None and a < len(cells) else None for a in at])
                k, n = k + 1, n + 1
            table += 1


TABLE_FUNCTIONS = {"chunks": Chunks, "matches": Matches, "markdown_tables": MarkdownTables}


class Registry:
    """Functions by name: a table function, or a scalar function of Python with its type; registering a name again replaces it."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._described: dict[str, dict] = {}

    def table(self, name: str, function: object, description: str = "") -> None:
        self.spark.udtf.register(name, function)
        self._described[name] = {"name": name, "kind": "table", "description": description, "returns": None}

    def scalar(self, name: str, function: Callable, returns: DataType | str, description: str = "") -> None:
        """``function``: a Python function of one value, or a pandas or Arrow function, which is taken as it is."""
        wrapped = getattr(function, "returnType", None) is not None
        self.spark.udf.register(name, function) if wrapped else self.spark.udf.register(name, function, returns)
        self._described[name] = {"name": name, "kind": "scalar", "description": description, "returns": str(returns)}

    def names(self) -> list[str]:
        return sorted(self._described)

    def schema(self, name: str) -> dict:
        """What is known of a function; a name that isn't registered is an error."""
        return dict(self._described[name])


def registered(spark: SparkSession) -> Registry:
    """A registry with the table functions of this module."""
    registry = Registry(spark)
    for name, function in TABLE_FUNCTIONS.items():
        registry.table(name, function, function.func.__doc__ or "")
    return registry
