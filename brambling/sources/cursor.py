"""A log that is polled by its cursor, as a streaming source: pages of ids, read by tasks, at least once."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from brambling.sources.uploads import file_system

PARTS = 8


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class CursorReader(DataSourceStreamReader):
    """Offsets are ids; a page ends ``size`` ids further on. The driver reads the greatest id from the statistics of new files only.
    Files are read through Arrow's file systems, so the log may lie in any store that they know."""

    def __init__(self, schema, options: dict[str, str]) -> None:
        self.names = [f.name for f in schema]
        self.path, self.cursor = options["path"], options["cursor"]
        self.seen: dict[tuple[str, int], int] = {}
        self.first, self.size = int(options.get("after", "0")), int(options.get("size", "1000"))
        self.at = self.first

    def initialOffset(self) -> dict:
        return {"id": self.first}

    def _dataset(self):
        import pyarrow.dataset as ds

        fs, path = file_system(self.path)
        return ds.dataset(path, format="parquet", filesystem=fs)

    def _last(self) -> int:
        """The greatest id of all files; a file is looked at once. One without statistics of the cursor is an error, as its rows would be passed over."""
        last, dataset = self.at, self._dataset()
        infos = {x.path: x.size for x in dataset.filesystem.get_file_info(dataset.files)}
        for piece in dataset.get_fragments():
            known = (piece.path, infos[piece.path])
            if known not in self.seen:
                column = piece.metadata.schema.names.index(self.cursor)
                groups = [piece.metadata.row_group(k) for k in range(piece.metadata.num_row_groups)]
                found = [g.column(column).statistics for g in groups if g.num_rows]
                if any(s is None or not (s.has_min_max or s.null_count == s.num_values + s.null_count) for s in found):
                    raise ValueError(f"{piece.path}: no statistics of {self.cursor}, so the log can't be polled by it")
                self.seen[known] = max((s.max for s in found if s.has_min_max), default=last)
            last = max(last, self.seen[known])
        return last

    def latestOffset(self) -> dict:
        self.at = max(self.at, min(self.at + self.size, self._last()))
        return {"id": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = start["id"], end["id"]
        self.at = max(self.at, high)
        step = max(1, -(-(high - low) // PARTS))
        return [_Range(x, min(x + step, high)) for x in range(low, high, step)] or [_Range(low, low)]

    def read(self, partition: _Range) -> Iterator:
        import pyarrow.dataset as ds

        key = ds.field(self.cursor)
        rows = self._dataset().scanner(columns=self.names, filter=(key > partition.low) & (key <= partition.high))
        yield from (b for b in rows.to_batches() if b.num_rows)

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end["id"])


class CursorSource(DataSource):
    """Format ``cursor_log``; options path, cursor (a column of ids), after (the cursor to begin with), size (ids of a page)."""

    @classmethod
    def name(cls) -> str:
        return "cursor_log"

    def schema(self) -> str:
        return "event_id bigint"

    def streamReader(self, schema) -> CursorReader:
        return CursorReader(schema, dict(self.options))
