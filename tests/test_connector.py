import sqlite3
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quillspark.sources import connector as C

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def records(a, b):
    # Three records share each time; ids don't rise with it.
    return [(f"id{(i * 7) % 1000:04d}", f"title {i}", f"body {i}", f"doc://{i}", T0 + timedelta(minutes=i // 3), None if i % 4 else '{"k": 1}', None, None) for i in range(a, b)]


def as_files(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, C.SCHEMA).repartition(2).write.mode(mode).parquet(path)
    return {"path": path}


def as_database(rows, path):
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE IF NOT EXISTS t (external_id TEXT, title TEXT, body_text TEXT, source_uri TEXT, updated_at TEXT, metadata_json TEXT, summary TEXT, published_at TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?, ?, ?)", [(*r[:4], r[4].isoformat(sep=" "), *r[5:]) for r in rows])
    db.close()
    return {"connector": "quillspark.sources.connector:SqlConnector", "database": str(path), "query": "SELECT * FROM t"}


@pytest.fixture
def session(spark):
    spark.dataSource.register(C.RecordSource)
    return spark


def plain(df):
    return sorted((r.updated_at, r.external_id, r.title, r.metadata_json) for r in df.collect())


def wanted(rows):
    return sorted((r[4].replace(tzinfo=None), r[0], r[1], r[5] or "{}") for r in rows)


@pytest.mark.parametrize("kind", ["files", "database"])
def test_batches_by_key(session, tmp_path, kind):
    rows = records(0, 100)
    options = as_files(session, rows, str(tmp_path / "t")) if kind == "files" else as_database(rows, tmp_path / "t.db")
    source = C.connector_of(options)
    source.validate()
    seen, after = [], None
    while batch := source.fetch_batch(after, 7):
        seen, after = seen + batch, C.key_of(batch[-1])
    assert [C.key_of(r) for r in seen] == sorted((r[4], r[0]) for r in rows) and after == source.last_key(None)
    assert source.last_key(after) is None and source.times(after, None) is None
    assert len(list(source.read(C.key_of(seen[9]), C.key_of(seen[40]), 5))) == 31


@pytest.mark.parametrize("kind", ["files", "database"])
@pytest.mark.parametrize("partitions", [1, 5])
def test_a_batch_read_has_every_row_once(session, tmp_path, kind, partitions):
    rows = records(0, 200)
    options = as_files(session, rows, str(tmp_path / "t")) if kind == "files" else as_database(rows, tmp_path / "t.db")
    reader = session.read.format("records").options(**options, partitions=partitions, batch_size=9)
    assert plain(reader.load()) == wanted(rows)
    at = sorted((r[4], r[0]) for r in rows)[49]
    behind = reader.option("updated_at", at[0].isoformat()).option("external_id", at[1])
    assert plain(behind.load()) == wanted(r for r in rows if (r[4], r[0]) > at)
    assert plain(behind.option("strategy", "full_scan").load()) == wanted(rows)
    nothing = reader.option("strategy", "cursor").option("updated_at", "2030-01-01T00:00:00+00:00").option("external_id", "")
    assert nothing.load().count() == 0


@pytest.mark.parametrize("kind", ["files", "database"])
def test_a_stream_goes_on_behind_its_last_key(session, tmp_path, kind):
    add = (lambda rows: as_files(session, rows, str(tmp_path / "t"))) if kind == "files" else (lambda rows: as_database(rows, tmp_path / "t.db"))
    options = add(records(0, 90))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = session.readStream.format("records").options(**options, partitions=3).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        return plain(session.read.parquet(out))

    assert run() == wanted(records(0, 90))
    add(records(90, 150))
    assert run() == wanted(records(0, 150)) == plain(session.read.format("records").options(**options).load())
    assert run() == wanted(records(0, 150))


def test_relations_that_are_no_records(session, tmp_path):
    session.range(3).withColumn("title", F.lit("x")).write.parquet(str(tmp_path / "a"))
    with pytest.raises(ValueError, match="external_id"):
        C.connector_of({"path": str(tmp_path / "a")}).validate()
    as_files(session, records(0, 3), str(tmp_path / "b"))
    session.read.parquet(str(tmp_path / "b")).withColumn("updated_at", F.lit(5)).write.parquet(str(tmp_path / "c"))
    with pytest.raises(ValueError, match="updated_at"):
        C.connector_of({"path": str(tmp_path / "c")}).validate()
    with pytest.raises(Exception, match="strategy"):
        session.read.format("records").options(path=str(tmp_path / "b"), strategy="odd").load().count()
    as_files(session, [], str(tmp_path / "d"))
    assert session.read.format("records").options(path=f"file://{tmp_path}/d").load().count() == 0
    none = [(None, "t", "b", "u", T0, None, None, None), ("x", "t", "b", "u", None, None, None, None), ("y", "t", "b", "u", T0, None, None, None)]
    as_files(session, none, str(tmp_path / "e"))
    source = C.connector_of({"path": str(tmp_path / "e")})
    assert [r[0] for r in source.fetch_batch(None, 10)] == ["y"] == [r[0] for r in source.read(None, None)]


def test_a_large_file_is_read_in_parts(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 20_000
    times = pa.array([T0.replace(tzinfo=None) + timedelta(minutes=i) for i in range(n)], pa.timestamp("us"))
    text = lambda p: pa.array([f"{p}{i:05d}" for i in range(n)])
    rows = pa.table({"external_id": text("i"), "title": text("t"), "body_text": pa.array([f"{i} " * 1_000 for i in range(n)]), "source_uri": text("u"), "updated_at": times})
    pq.write_table(rows, str(tmp_path / "one.parquet"), row_group_size=n)
    source = C.connector_of({"path": str(tmp_path / "one.parquet")})
    start = pa.total_allocated_bytes()
    seen, most = 0, 0
    for batch in source.read_batches((T0, "i00000"), None, 500):
        seen, most = seen + len(batch), max(most, pa.total_allocated_bytes() - start)
        assert isinstance(batch, pa.RecordBatch) and batch.schema.names == C.COLUMNS and len(batch) <= 500
        assert set(batch.column(5).to_pylist()) == {"{}"} and batch.column(7).null_count == len(batch)
    assert seen == n - 1 and most < rows.nbytes / 4
