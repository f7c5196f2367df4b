"""Versioned tables, commits with marks, and builds that fail and go on."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.build import BuildError, Step, run
from tessera.sources.store import Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_readers_keep_what_they_read(spark, store):
    store.replace("t", spark.range(3))
    old = store.read("t")
    store.replace("t", spark.range(5))
    assert (old.count(), store.read("t").count(), store.read("t", 1).count()) == (3, 5, 3)
    assert store.vacuum(1) and store.versions() == [2] and store.read("t").count() == 5


def test_a_commit_is_whole_or_nothing(spark, store, monkeypatch):
    """A failure between the files and the manifest leaves neither rows nor mark, and the retry has both once."""
    src = spark.createDataFrame([(k, k // 3) for k in range(9)], "id long, at long")
    assert store.advance("t", "s", src.where("at < 1"), "at", ["id"]) == 3 and store.head().marks == {"s": "0"}
    monkeypatch.setattr(Store, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        store.advance("t", "s", src, "at", ["id"])
    monkeypatch.undo()
    assert store.head().marks == {"s": "0"} and store.read("t").count() == 3
    assert store.advance("t", "s", src, "at", ["id"]) == 6 and store.head().marks == {"s": "2"}
    assert store.advance("t", "s", src, "at", ["id"]) == 0 and store.head().version == 2
    late = src.union(spark.createDataFrame([(99, 2), (98, 1)], src.schema))  # more at the mark is read, below it isn't
    assert store.advance("t", "s", late, "at", ["id"]) == 1
    assert values(store.read("t")) == [*((k, k // 3) for k in range(9)), (99, 2)]


def test_rows_from_the_mark_on_are_pushed_to_the_scan(spark, store, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    plans = []
    see = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    store.advance("e", "events", events.where("ts < '2024-01-10'"), "ts", ["event_id"])
    store.advance("e", "events", events, "ts", ["event_id"], see)
    assert "GreaterThanOrEqual(ts" in plans[0]
    assert store.read("e").count() == events.count() and store.read("e").select("event_id").distinct().count() == events.count()


def test_two_writers(spark, store):
    """Commits on other tables go through, those on the same table or mark are conflicts; a number is taken once."""
    store.replace("t", spark.range(1))
    base = store.head()
    store.replace("t", spark.range(2))
    store.replace("u", spark.range(4))
    r = store.begin()
    with pytest.raises(Conflict):
        store.commit(r, {"t": store.write(spark.range(9), "t", r)}, base=base)
    assert store.commit(r, {"v": store.write(spark.range(9), "v", r)}, base=base).version == 4
    assert not store.files.put_new(f"{store.root}/_log/{4:020d}.json", "{}") and store.read("v").count() == 9
    assert store.commit(r, {"v": {}}).version == 4  # the same run again changes nothing
    with pytest.raises(Conflict):
        store.commit(store.begin(), {}, {"s": "2"}, base) if store.commit(store.begin(), {}, {"s": "1"}, base) else None


def test_vacuum_leaves_runs_under_way(spark, store):
    r = store.begin()
    entry = store.write(spark.range(2), "t", r)
    assert store.vacuum() == []
    store.commit(r, {"t": entry})
    gone = store.begin()
    store.write(spark.range(2), "t", gone)
    store.abandon(gone)
    assert len(store.vacuum()) == 1 and store.read("t").count() == 2


def chain(spark, calls, fail=()):
    def make(name, f):
        def inner(*tables):
            calls.append(name)
            if name in fail:
                raise ValueError(f"{name} is broken")
            return f(*tables)

        return inner

    return [
        Step("sum", make("sum", lambda a, b: a.union(b).groupBy().agg(F.sum("id").alias("s"))), ("left", "right")),
        Step("raw", make("raw", lambda: spark.range(10))),
        Step("left", make("left", lambda r: r.where("id < 5")), ("raw",)),
        Step("right", make("right", lambda r: r.where("id >= 5")), ("raw",)),
        Step("alone", make("alone", lambda: spark.range(2))),
        Step("after", make("after", lambda s: s), ("sum",)),
    ]


def test_a_build_goes_on_where_it_stopped(spark, store):
    calls = []
    with pytest.raises(BuildError) as e:
        run(store, chain(spark, calls, {"right"}), "day-1")
    assert {o.name: o.state for o in e.value.outcomes} == {"sum": "skipped", "raw": "done", "left": "done", "right": "failed", "alone": "done", "after": "skipped"}
    assert "right is broken" in str(e.value) and store.head().version == 0
    calls.clear()
    out = run(store, chain(spark, calls), "day-1", {"s": "7"})
    assert calls[0] == "right" and calls == ["right", "sum", "after"]
    assert {o.name: (o.state, o.rows) for o in out} == {"sum": ("done", 1), "raw": ("reused", 10), "left": ("reused", 5), "right": ("done", 5), "alone": ("reused", 2), "after": ("done", 1)}
    assert store.head().version == 1 and store.head().marks == {"s": "7"} and store.read("sum").first().s == 45
    calls.clear()
    assert {o.state for o in run(store, chain(spark, calls), "day-1")} == {"reused"} and not calls
    assert run(store, chain(spark, calls), "day-2") and len(calls) == 6 and store.head().version == 2


def test_half_written_tables_are_written_again(spark, store):
    store.begin("day")
    spark.range(99).write.parquet(f"{store.root}/data/raw/day")  # a killed try: files, but no marker
    run(store, chain(spark, []), "day")
    assert store.read("raw").count() == 10


def test_graphs_that_make_no_sense(spark, store):
    for steps in ([Step("a", None, ("b",))], [Step("a", None), Step("a", None)], [Step("a", None, ("b",)), Step("b", None, ("a",))]):
        with pytest.raises(ValueError):
            run(store, steps, "x")


def test_the_whole_build(spark, store, small, monkeypatch):
    """Every table of the build is computed once, from at most one scan of a given table in each step; a killed build goes on; readers see all tables of one run."""
    from tessera.plans import pipeline as L

    steps = L.steps(spark, small)
    broken = [Step(x.name, (lambda *t: 1 / 0) if x.name == "combined" else x.make, x.needs) for x in steps]
    with pytest.raises(BuildError) as e:
        run(store, broken, "night")
    states = {o.name: o.state for o in e.value.outcomes}
    assert states.pop("combined") == "failed" and [n for n, x in states.items() if x == "skipped"] == ["customer_360", "features", "churn_score"]
    assert store.head().version == 0
    plans = {}

    def seen(x):
        def make(*tables):
            df = x.make(*tables)
            plans[x.name] = df._jdf.queryExecution().executedPlan().toString()
            return df

        return Step(x.name, make, x.needs)

    again = {o.name: o.state for o in run(store, [seen(x) for x in steps], "night")}
    assert set(plans) == {"combined", "customer_360", "features", "churn_score"} and {n for n, x in again.items() if x == "done"} == set(plans)
    for x in steps:
        plan = plans.get(x.name) or x.make(*(store.read(n) for n in x.needs))._jdf.queryExecution().executedPlan().toString()
        assert plan.count(small) <= 1, x.name
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan, x.name
        if x.needs and not x.name.startswith("order_summary"):  # the star join reads orders for their lines once more
            assert plan.count("FileScan") <= len(x.needs) + 1, (x.name, plan.count("FileScan"))
    assert {n for n in store.head().tables} == {x.name for x in steps}
    assert store.read("customer_360").count() == store.read("features").count() == store.read("combined").count()


def test_rules_leave_views_alone(spark):
    from tessera.operators import quality as Q

    spark.range(3).createOrReplaceTempView("orders")
    rules = [Q.Rule("A", "WARNING", 0, "orders", "SELECT count(*) FROM orders o WHERE EXISTS (SELECT 1 FROM others x WHERE x.id = o.id)"), Q.Rule("B", "WARNING", 0, "orders", where="id > 7")]
    out = {r.rule_id: (r.rows_failed, r.rows_evaluated) for r in Q.run(spark, rules, {"orders": spark.range(9), "others": spark.range(2)}).collect()}
    assert out == {"A": (2, 9), "B": (1, 9)} and spark.table("orders").count() == 3
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("rules_") or t.name == "others"]
    spark.catalog.dropTempView("orders")
