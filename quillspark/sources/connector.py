"""Connectors to record stores as a Spark data source, for batch and streaming reads.

A connector validates its relation and reads the records of a key range, a key being (updated_at, external_id). Two are here: files (a Parquet folder or
file on any file system that Arrow opens by its URI) and databases with a DB-API (a query of one's own, wrapped as a subquery). The data source ``records``
splits the range by time into partitions that are read on executors, a batch at a time; as a stream, its offset is the last key, so a restart goes
on behind what was committed. The strategy ``cursor`` starts behind the checkpoint given, ``full_scan`` from the beginning.

    spark.dataSource.register(RecordSource)
    spark.read.format("records").option("path", folder).option("partitions", 8).load()
    spark.readStream.format("records").option("connector", "quillspark.sources.connector:SqlConnector").option("database", file).option("query", sql).load()

Options: connector (module:Class; default FileConnector), strategy, updated_at and external_id (the checkpoint), partitions, batch_size, and the connector's own.
Rows that come later with a key at or before the checkpoint aren't seen by a cursor; a full scan finds them. Rows without a key are no records: validation
refuses the relation that has one first, and reads leave them out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "external_id string, title string, body_text string, source_uri string, updated_at timestamp, metadata_json string, summary string, published_at timestamp"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
REQUIRED = {"external_id": str, "title": str, "body_text": str, "source_uri": str, "updated_at": datetime}
BATCH_ROWS, PARTITIONS = 1000, 8
#: Bytes of a column of a file that are read at once.
READ_BYTES = 1 << 20
#: A key; either None for the beginning.
Key = tuple[datetime, str]


def instant(value: object) -> datetime | None:
    """A time in UTC; text is ISO 8601, and without a zone means UTC."""
    if value is None or isinstance(value, datetime) and value.tzinfo is not None:
        return value
    value = datetime.fromisoformat(value) if isinstance(value, str) else value
    return value if value.tzinfo is not None else value.replace(tzinfo=timezone.utc)


class Connector:
    """What a store must do. Records are tuples of COLUMNS; ranges are open below and closed above, None meaning no bound."""

    def __init__(self, options: dict):
        self.options = options

    def first(self) -> dict | None:
        """Any record by column, or None if there is none."""
        raise NotImplementedError

    def last_key(self, after: Key | None) -> Key | None:
        """The greatest key behind ``after``."""
        raise NotImplementedError

    def times(self, after: Key | None, upto: Key | None) -> tuple[datetime, datetime] | None:
        """Least and greatest time of the range, or bounds of them; None if it is empty."""
        raise NotImplementedError

    def fetch_batch(self, after: Key | None, limit: int, upto: Key | None = None) -> list[tuple]:
        """The first records of the range by key."""
        raise NotImplementedError

    def validate(self) -> None:
        """An error if the relation lacks a column, or its first record has another type there."""
        row = self.first()
        for name, kind in REQUIRED.items() if row is not None else ():
            if name not in row:
                raise ValueError(f"the relation has no column {name}")
            value = instant(row[name]) if kind is datetime and isinstance(row[name], str) else row[name]
            if not isinstance(value, kind):
                raise ValueError(f"{name} is {type(row[name]).__name__}, not {kind.__name__}")

    def read(self, after: Key | None, upto: Key | None, batch_rows: int = BATCH_ROWS) -> Iterator[tuple]:
        """All records of a range, batch after batch."""
        while batch := self.fetch_batch(after, batch_rows, upto):
            yield from batch
            after = key_of(batch[-1])

    def read_batches(self, after: Key | None, upto: Key | None, batch_rows: int = BATCH_ROWS) -> Iterator:
        """The same for Spark: tuples, or Arrow batches of COLUMNS."""
        return self.read(after, upto, batch_rows)


def key_of(record: tuple) -> Key:
    return record[COLUMNS.index("updated_at")], record[COLUMNS.index("external_id")]


def _record(row: dict) -> tuple:
    return tuple(instant(row.get(c)) if c in ("updated_at", "published_at") else "{}" if c == "metadata_json" and row.get(c) is None else row.get(c) for c in COLUMNS)


class FileConnector(Connector):
    """A Parquet file or folder (option ``path``). Ranges reach the scan as filters; a batch keeps only its own rows."""

    def _dataset(self):
        import pyarrow.dataset as ds
        from pyarrow import fs

        path = self.options["path"]
        if "://" not in path and not path.startswith("file:"):
            return ds.dataset(path, format="parquet", exclude_invalid_files=True)
        store, inside = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
        return ds.dataset(inside, filesystem=store, format="parquet", exclude_invalid_files=True)

    @staticmethod
    def _range(data, after: Key | None, upto: Key | None):
        import pyarrow as pa
        import pyarrow.compute as pc

        ts, key = pc.field("updated_at"), pc.field("external_id")
        kind = data.schema.field("updated_at").type
        at = lambda t: pa.scalar(t if getattr(kind, "tz", None) else t.replace(tzinfo=None), kind)
        out = ts.is_valid() & key.is_valid()
        if after is not None:
            out &= (ts > at(after[0])) | ((ts == at(after[0])) & (key > after[1]))
        if upto is not None:
            out &= (ts < at(upto[0])) | ((ts == at(upto[0])) & (key <= upto[1]))
        return out

    def first(self) -> dict | None:
        table = next(self._tables(None, None, 1, every=True), None)
        return table.to_pylist()[0] if table is not None else None

    def times(self, after: Key | None, upto: Key | None) -> tuple[datetime, datetime] | None:
        import pyarrow.compute as pc

        data, found = self._dataset(), []
        for batch in data.to_batches(columns=["updated_at"], filter=self._range(data, after, upto), batch_readahead=1, fragment_readahead=1):
            if batch.num_rows:
                found.append(pc.min_max(batch.column(0)).as_py())
        return (instant(min(x["min"] for x in found)), instant(max(x["max"] for x in found))) if found else None

    def last_key(self, after: Key | None) -> Key | None:
        times = self.times(after, None)
        if times is None:
            return None
        import pyarrow as pa
        import pyarrow.compute as pc

        data = self._dataset()
        kind = data.schema.field("updated_at").type
        last = pa.scalar(times[1] if getattr(kind, "tz", None) else times[1].replace(tzinfo=None), kind)
        rows = self._range(data, after, None) & (pc.field("updated_at") == last)
        return times[1], max(pc.max(b.column(0)).as_py() for b in data.to_batches(columns=["external_id"], filter=rows) if b.num_rows)

    def fetch_batch(self, after: Key | None, limit: int, upto: Key | None = None) -> list[tuple]:
        data = self._dataset()
        columns = [c for c in COLUMNS if c in data.schema.names]
        rows = (_record(r) for b in data.to_batches(columns=columns, filter=self._range(data, after, upto)) for r in b.to_pylist())
        return heapq.nsmallest(limit, rows, key=key_of)

    def read(self, after: Key | None, upto: Key | None, batch_rows: int = BATCH_ROWS) -> Iterator[tuple]:
        """One scan of the range; the order of a partition's records doesn't matter to Spark."""
        for table in self._tables(after, upto, batch_rows):
            yield from map(_record, table.to_pylist())

    def _tables(self, after: Key | None, upto: Key | None, batch_rows: int, every: bool = False) -> Iterator:
        """File by file, batch_rows rows of it at a time: no row group and no other file is held meanwhile. Row groups outside of the range aren't read. ``every``: all rows, without a look at their keys."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        data = self._dataset()
        columns, rows = [c for c in COLUMNS if c in data.schema.names], None if every else self._range(data, after, upto)
        for fragment in data.get_fragments(filter=rows):
            groups = [g.id for g in (fragment if every else fragment.subset(filter=rows)).row_groups]
            if not groups:
                continue
            with fragment.filesystem.open_input_file(fragment.path) as source:
                file = pq.ParquetFile(source, buffer_size=READ_BYTES, pre_buffer=False)
                own = [c for c in columns if c in file.schema_arrow.names]
                for batch in file.iter_batches(batch_rows, row_groups=groups, columns=own, use_threads=False):
                    arrays = [(batch.column(c) if c in own else pa.nulls(len(batch))).cast(data.schema.field(c).type) for c in columns]
                    table = pa.table(arrays, names=columns)
                    table = table if every else table.filter(rows)
                    if len(table):
                        yield table

    def read_batches(self, after: Key | None, upto: Key | None, batch_rows: int = BATCH_ROWS) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def column(table, name: str):
            kind = pa.timestamp("us", "UTC") if name in ("updated_at", "published_at") else pa.string()
            if name not in table.column_names:
                own = pa.nulls(len(table), kind)
            elif pa.types.is_timestamp(kind) and not pa.types.is_timestamp(table.schema.field(name).type):
                own = pa.array([instant(v) for v in table.column(name).to_pylist()], kind)
            else:
                own = table.column(name).cast(kind, safe=False).combine_chunks()
            return pc.fill_null(own, "{}") if name == "metadata_json" else own

        for table in self._tables(after, upto, batch_rows):
            arrays = [column(table, c) for c in COLUMNS]
            yield from pa.table(arrays, names=COLUMNS).to_batches()


class SqlConnector(Connector):
    """A query (option ``query``) on a database of a DB-API module (option ``module``; default sqlite3) opened with option ``database``. Times are ISO 8601 text in UTC, as
    that module's; parameters are written ? or what option ``mark`` says."""

    def _rows(self, sql: str, values: list) -> list[dict]:
        connection = import_module(self.options.get("module", "sqlite3")).connect(self.options["database"])
        try:
            cursor = connection.cursor()
            cursor.execute(sql, values)
            names = [d[0] for d in cursor.description]
            return [dict(zip(names, row, strict=True)) for row in cursor.fetchall()]
        finally:
            connection.close()

    def _where(self, after: Key | None, upto: Key | None) -> tuple[str, list]:
        mark, said, values = self.options.get("mark", "?"), ["updated_at IS NOT NULL", "external_id IS NOT NULL"], []
        for key, below, rest in ((after, ">", ">"), (upto, "<", "<=")):
            if key is not None:
                ts = key[0].astimezone(timezone.utc).isoformat(sep=" ")
                said.append(f"(updated_at {below} {mark} OR (updated_at = {mark} AND external_id {rest} {mark}))")
                values += [ts, ts, key[1]]
        return f"FROM ({self.options['query']}) AS records_of_source WHERE " + " AND ".join(said), values

    def first(self) -> dict | None:
        rows = self._rows(f"SELECT * FROM ({self.options['query']}) AS records_of_source LIMIT 1", [])
        return rows[0] if rows else None

    def times(self, after: Key | None, upto: Key | None) -> tuple[datetime, datetime] | None:
        where, values = self._where(after, upto)
        row = self._rows(f"SELECT min(updated_at) AS a, max(updated_at) AS b {where}", values)[0]
        return (instant(row["a"]), instant(row["b"])) if row["a"] is not None else None

    def last_key(self, after: Key | None) -> Key | None:
        where, values = self._where(after, None)
        rows = self._rows(f"SELECT updated_at, external_id {where} ORDER BY updated_at DESC, external_id DESC LIMIT 1", values)
        return (instant(rows[0]["updated_at"]), rows[0]["external_id"]) if rows else None

    def fetch_batch(self, after: Key | None, limit: int, upto: Key | None = None) -> list[tuple]:
        where, values = self._where(after, upto)
        return [_record(r) for r in self._rows(f"SELECT * {where} ORDER BY updated_at, external_id LIMIT {int(limit)}", values)]


def connector_of(options: dict) -> Connector:
    module, _, name = options.get("connector", f"{__name__}:FileConnector").partition(":")
    return getattr(import_module(module), name)(dict(options))


@dataclass
class Range(InputPartition):
    after: Key | None
    upto: Key | None


#: No text is greater than this, as keys go.
_LAST_ID = "\U0010ffff" * 8


def ranges(connector: Connector, after: Key | None, upto: Key | None, n: int) -> list[Range]:
    """The range in up to n parts of equal time."""
    times = connector.times(after, upto)
    if times is None:
        return []
    step = (times[1] - times[0]) / n
    cuts = [] if step < timedelta(microseconds=1) else [(times[0] + k * step, _LAST_ID) for k in range(1, n)]
    return [Range(a, b) for a, b in zip([after, *cuts], [*cuts, upto], strict=True)]


class _Read:
    def __init__(self, options: dict):
        self.options = dict(options)
        self.connector = connector_of(self.options)
        self.connector.validate()
        strategy = self.options.get("strategy", "cursor")
        if strategy not in ("cursor", "full_scan"):
            raise ValueError(f"unknown strategy {strategy}")
        told = self.options.get("updated_at") if strategy == "cursor" else None
        self.start = (instant(told), self.options.get("external_id", "")) if told else None
        self.n, self.batch_rows = int(self.options.get("partitions", PARTITIONS)), int(self.options.get("batch_size", BATCH_ROWS))

    def read(self, partition: Range | None) -> Iterator:
        """Of an empty range Spark makes one partition, None."""
        return iter(()) if partition is None else self.connector.read_batches(partition.after, partition.upto, self.batch_rows)


class RecordReader(_Read, DataSourceReader):
    def partitions(self) -> list[Range]:
        last = self.connector.last_key(self.start)  # what comes meanwhile belongs to the next read
        return ranges(self.connector, self.start, last, self.n) if last else []


def offset_of(key: Key | None) -> dict:
    return {"updated_at": key[0].astimezone(timezone.utc).isoformat() if key else None, "external_id": key[1] if key else None}


def key_at(offset: dict) -> Key | None:
    return (instant(offset["updated_at"]), offset["external_id"]) if offset["updated_at"] is not None else None


class RecordStream(_Read, DataSourceStreamReader):
    """The offset is the last key that was read."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.known = self.start

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return offset_of(self.start)

    def latestOffset(self) -> dict:  # noqa: N802
        self.known = self.connector.last_key(self.known) or self.known
        return offset_of(self.known)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if start == end:
            return []
        return ranges(self.connector, key_at(start), key_at(end), self.n)

    def commit(self, end: dict) -> None:
        self.known = key_at(end) or self.known


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)

    def streamReader(self, schema) -> RecordStream:  # noqa: N802
        return RecordStream(self.options)
