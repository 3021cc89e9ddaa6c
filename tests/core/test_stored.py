"""Stored tables that are changed while they are read, rules of their rows, and the drained outbox."""

import pytest
from pyspark.sql import functions as F

from packlens.operators import constraints
from packlens.operators.constraints import Rule
from packlens.sources.stored import Conflict, Rejected, StoredTable
from packlens.streaming import outbox

SCHEMA = "id long, name string, score int"


@pytest.fixture
def table(spark, tmp_path):
    t = StoredTable(spark, f"{tmp_path}/t", SCHEMA, "id", rules=[Rule("name", required=True, trim=True), Rule("score", default=0, least=0, most=100)], buckets=4)
    t.insert(rows(spark, *[(i, f" n{i} ", i) for i in range(20)]))
    return t


def rows(spark, *values, schema=SCHEMA):
    return spark.createDataFrame(values, schema)


def now(t, version=None):
    return {r.id: (r.name, r.score) for r in t.read(version).collect()}


def test_changes_of_the_table_that_is_read(spark, table):
    t = table
    assert now(t) == {i: (f"n{i}", i) for i in range(20)}
    t.update(t.read().where("id < 3").select("id", (F.col("score") + 50).alias("score")))
    t.delete(t.read().where("id >= 15").select("id"))
    t.upsert(rows(spark, (0, "zero", None), (99, "new", 1)))
    want = {i: (f"n{i}", i + 50 * (i < 3)) for i in range(15)} | {0: ("zero", 0), 99: ("new", 1)}
    assert now(t) == want and len(now(t, 1)) == 20 and t.versions() == [1, 2, 3, 4]
    t.reseed(t.read().where("id = 99"))
    assert now(t) == {99: ("new", 1)} and now(t, 4) == want


def test_a_failed_write_leaves_the_old_version(spark, table):
    t, before = table, now(table)
    for bad in [rows(spark, (1, "again", 1)), rows(spark, (50, "  ", 1)), rows(spark, (50, "x", 101)), rows(spark, (None, "x", 1)), rows(spark, (50, "x", 1), (50, "y", 1))]:
        with pytest.raises(Rejected):
            t.insert(bad)
    with pytest.raises(Rejected, match="score: min"):
        t.update(rows(spark, (1, -5), schema="id long, score int"))
    with pytest.raises(Exception, match="half way"):
        t.upsert(rows(spark, (60, "x", 1)).withColumn("name", F.when(F.col("id") == 60, F.raise_error(F.lit("half way"))).otherwise(F.col("name"))))
    assert now(t) == before and t.versions() == [1] and t.store.names("staged") == []


def test_the_second_of_two_writers_fails(spark, table):
    last, at = table.now()
    assert table.switched(last, at) == 2
    with pytest.raises(Conflict):
        table.switched(last, at)
    assert table.versions() == [1, 2] and not [n for n in table.store.names("") if n.startswith(".new")]


def test_only_touched_buckets_are_written(spark, table):
    before = table.folders()
    one = rows(spark, (3, "three", 3))
    bucket = table.touched(one)
    table.upsert(one)
    after = table.folders()
    assert {k for k in after if after[k] != before.get(k)} == bucket and len(bucket) == 1
    table.insert(rows(spark, (1000, "x", 1)))
    assert sum(len(v) for v in table.folders().values()) == sum(len(v) for v in after.values()) + 1


def test_vacuum_and_empty_table(spark, table, tmp_path):
    table.upsert(rows(spark, (3, "three", 3)))
    table.delete(table.read().select("id"))
    assert now(table) == {} and table.vacuum(keep=1) > 0 and now(table) == {}
    with pytest.raises(ValueError):
        table.read(1)
    empty = StoredTable(spark, f"{tmp_path}/e", SCHEMA, "id")
    assert empty.read().count() == 0 and empty.versions() == []
    empty.insert(rows(spark, (1, None, None)))
    assert now(empty) == {1: (None, None)}


def test_rules(spark):
    schema = "who struct<name:string,age:int>, kind string, n double, x string"
    df = spark.createDataFrame([((" a ", 3), " B ", 5.0, "keep"), ((None, 1), "c", None, "k"), (None, "b", -1.0, "k"), ((" ", 1), None, 11.0, "k")], schema)
    rules = [Rule("who.name", required=True, trim=True), Rule("kind", default="b", trim=True, lower=True, one_of=("b",)), Rule("n", least=0, most=10), Rule("gone", required=True), Rule("late", default="d")]
    got = constraints.evaluated(df, rules).collect()
    assert [[(b.column, b.broken) for b in r.broken] for r in got] == [[("gone", "required")], [("who.name", "required"), ("kind", "enum"), ("gone", "required")], [("who.name", "required"), ("n", "min"), ("gone", "required")], [("who.name", "required"), ("n", "max"), ("gone", "required")]]
    assert (got[0].who.name, got[0].kind, got[0].late, got[2].who, got[3].kind) == ("a", "b", "d", None, "b")
    good, bad = constraints.constrained(df, rules[:3])
    assert [r.x for r in good.collect()] == ["keep"] and bad.count() == 3
    assert constraints.constrained(df.limit(0), rules)[1].count() == 0


def test_a_batch_does_not_grow_with_those_before(spark, tmp_path):
    """Each batch reads its own rows only; ids are state; late and repeated rows come once."""
    schema = "id long, created_at timestamp, synced boolean"
    log = outbox.Progress()
    spark.streams.addListener(log)
    try:
        for i in range(4):
            own = [(10 * i + j, j % 3 == 0) for j in range(10)] + [(1, False), (10 * i + 2, False)]
            spark.createDataFrame(own, "id long, synced boolean").select("id", F.current_timestamp().alias("created_at"), "synced").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            q = outbox.drained(outbox.landed(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/check", f"drain{i}")
            q.awaitTermination()
            assert log.settled(q)
    finally:
        spark.streams.removeListener(log)
    sent = spark.read.schema(schema).parquet(*[f"{tmp_path}/out/batch={i}" for i in range(4)])
    assert sorted(r.id for r in sent.collect()) == [10 * i + j for i in range(4) for j in range(10) if j % 3]
    assert log.write(spark, f"{tmp_path}/progress") > 0 and log.write(spark, f"{tmp_path}/progress") == 0
    rows = spark.read.parquet(f"{tmp_path}/progress")
    batches = {r.name: (r.n, r.kept) for r in rows.where("stage = 'addBatch'").groupBy("name").agg(F.sum("n_rows").alias("n"), F.max("state_rows").alias("kept")).collect()}
    assert batches == {f"drain{i}": (12, 6 * (i + 1)) for i in range(4)}
    assert {r.stage for r in rows.collect()} >= {"started", "ended", "triggerExecution"}


def test_a_failed_drain_says_so(spark, tmp_path):
    log = outbox.Progress()
    spark.createDataFrame([(1, False)], "id long, synced boolean").write.parquet(f"{tmp_path}/in")
    spark.streams.addListener(log)
    try:
        stream = outbox.landed(spark, f"{tmp_path}/in", "id long, synced boolean").withColumn("x", F.raise_error(F.lit("cut off")))
        q = outbox.drained(stream, f"{tmp_path}/out", f"{tmp_path}/check")
        with pytest.raises(Exception, match="cut off"):
            q.awaitTermination()
        assert log.settled(q) and any(r[3] == "failed" and "cut off" in r[7] for r in log.rows)
    finally:
        spark.streams.removeListener(log)
