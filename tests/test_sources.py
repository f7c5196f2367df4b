import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import readers as R
from tessera.sources import sinks as K
from tessera.sources.store import Store
from tessera.streaming import incremental as I


def test_json_array_lands_as_text(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"customerId": "1", "optIn": True, "n": 1.5}, {"customerId": None}]))
    df = R.json_array(spark, str(tmp_path / "c.json"), {"customerId": "customer_id", "optIn": "opt_in", "n": "n"})
    assert sorted(map(str, ((r.customer_id, r.opt_in, r.n) for r in df.collect()))) == sorted(map(str, [("1", "true", "1.5"), (None, None, None)]))
    out = R.with_provenance(df.drop("_src_file"), "CRM", "b1", "c1", F.lit(None).cast("timestamp")).first()
    assert set(json.loads(out.src_payload)) == {"customer_id", "n", "opt_in"} and len(out._row_hash) == 32


def test_json_records_keep_corrupt_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": {"b": 5}}\n{broken\n')
    rows = R.json_records(spark, str(tmp_path / "a.json"), {"b": "$.a.b"}).collect()
    assert sorted((str(r.b), str(r._corrupt_record)) for r in rows) == [("5", "None"), ("None", "{broken")]


def test_csv_and_markdown(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c\n 1 ,"x, y",N/A\n2\n')
    assert sorted(map(str, (tuple(r) for r in R.csv(spark, str(tmp_path / "x.csv"), ["a", "b", "c"]).collect()))) == ["('1', 'x, y', None)", "('2', None, None)"]
    (tmp_path / "k.md").write_text("---\narticle_id: KB-1\ntitle: Late: or not\n---\n\n# Head\n\nBody --- text\n")
    (tmp_path / "p.md").write_text("plain")
    out = {r.article_id: (r.title, r.body) for r in R.markdown(spark, str(tmp_path / "*.md"), ["article_id", "title"]).collect()}
    assert out == {"KB-1": ("Late: or not", "# Head\n\nBody --- text"), None: (None, "plain")}


def test_sinks(spark, tmp_path):
    day = lambda d, v: spark.createDataFrame([(d, v)], "day string, v int")
    path = str(tmp_path / "days")
    K.replace_days(day("2024-01-01", 1), path, "day")
    K.replace_days(day("2024-01-02", 2), path, "day")
    K.replace_days(day("2024-01-02", 3), path, "day")
    assert sorted((str(r.day), r.v) for r in spark.read.parquet(path).collect()) == [("2024-01-01", 1), ("2024-01-02", 3)]
    with pytest.raises(ValueError):
        K.append(day("x", 1), "other", path)
    with pytest.raises(RuntimeError):
        K.logged(spark, str(tmp_path / "log"), "step", lambda: (_ for _ in ()).throw(RuntimeError("no")))
    K.logged(spark, str(tmp_path / "log"), "step", lambda: 3)
    assert sorted(r.status for r in spark.read.parquet(str(tmp_path / "log")).collect()) == ["FAILED", "SUCCESS"]
    store = Store(spark, str(tmp_path / "tables"))
    for v in (1, 2):
        K.refresh(day("2024-01-01", v), store, "days")
    assert [r.v for r in store.read("days").collect()] == [2] and [r.v for r in store.read("days", 1).collect()] == [1]


def test_catalogue_lists_columns(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS catalogue_test")
    spark.range(1).selectExpr("id AS a", "'x' AS b").write.mode("overwrite").saveAsTable("catalogue_test.t")
    assert sorted(tuple(r) for r in R.catalogue(spark, "catalogue_test").collect()) == [("t", "a", "bigint", True), ("t", "b", "string", True)]
    spark.sql("DROP DATABASE catalogue_test CASCADE")


def test_upsert(spark):
    t = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2")], "k int, v string, h string")
    c = spark.createDataFrame([(2, "B", "h2"), (1, "A", "h9"), (3, "c", "h3")], "k int, v string, h string")
    assert sorted(tuple(r) for r in K.upsert(t, c, "k", "h").collect()) == [(1, "A", "h9"), (2, "b", "h2"), (3, "c", "h3")]


def test_stream_into_dimension(spark, tmp_path):
    source, dim, state = (str(tmp_path / x) for x in ("in", "dim", "state"))
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v string, at timestamp").write.mode("append").parquet(source)
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    rows(("a", "x", at), ("b", "x", at))
    schema = spark.read.parquet(source).schema
    empty = spark.createDataFrame([], "k string, v string, row_hash string, valid_from timestamp, valid_to timestamp, is_current boolean, version int, change_type string")
    prepare = lambda b: b.groupBy("k").agg(F.max_by("v", "at").alias("v"), F.max("at").alias("updated_at")).select("k", "v", F.md5("v").alias("row_hash"), "updated_at",
        F.lit(None).cast("timestamp").alias("created_at"), F.lit("PASS").alias("dq_status"))
    run = lambda: I.load_dimension(I.arrivals(spark, source, schema), dim, state, "k", empty, prepare).awaitTermination()
    run()
    run()
    rows(("a", "y", at + dt.timedelta(days=1)))
    run()
    assert sorted((r.k, r.v, r.version, r.is_current) for r in I.current(spark, dim).collect()) == [("a", "x", 1, False), ("a", "y", 2, True), ("b", "x", 1, True)]
    store = Store(spark, dim)
    assert store.versions() == [1, 2]
    changed = [n for n, t in store.head().tables.items() if t != store.manifest(1).tables.get(n)]
    assert len(changed) == 1  # the second load wrote the bucket of its one key only
    assert I.current(spark, dim, 1).count() == 2
    store.vacuum(keep=1)
    assert sum(len(store.files.names(f"{dim}/data/dimension/{r}")) > 0 for r in store.files.names(f"{dim}/data/dimension")) == 2
    assert I.current(spark, dim).count() == 3
    state = str(tmp_path / "new state")  # the checkpoint is lost: all is read again, and changes nothing
    run()
    assert sorted((r.k, r.v, r.version, r.is_current) for r in I.current(spark, dim).collect()) == [("a", "x", 1, False), ("a", "y", 2, True), ("b", "x", 1, True)]
