"""Objects in text, lineage, queues, alerts and branches against brute force, replays and failures."""

import datetime as dt
import json
import random
import time
import uuid
from collections import deque

import pytest
from pyspark.sql import functions as F

from tessera.functions import objects as O
from tessera.operators import insight, lineage, operations, serving
from tessera.sources.store import Store
from tessera.streaming import alerts

# --- objects in text ------------------------------------------------------------------------------


def balanced(text):
    """The first balanced object, character by character."""
    start = (text or "").find("{")
    if start < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for k in range(start, len(text)):
        c = text[k]
        if escaped:
            escaped = False
        elif quoted and c == "\\":
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == "{") - (c == "}")
            if depth == 0:
                return text[start : k + 1]
    return None


def test_first_object_by_brute_force(spark):
    rng = random.Random(1)
    parts = ["{", "}", '"', "\\", '\\"', "a", " ", "\n", '{"k": 1}', '"}"', "é漢𝒜", "[", ":"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [None, "", "no object", "{", "}{}", 'x {"a": "' + "\\n}" * 20_000 + '"} y', "{" * 5000 + "}" * 5000, '{"open', "{" + "x" * 200_000 + "}"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert {r.k: r.o for r in df.select("k", O.first_object(F.col("t")).alias("o")).collect()} == {k: balanced(t) for k, t in enumerate(texts)}


def test_closed_choice(spark):
    texts = ['So: {"action": "A", "x": {"y": "}"}} and more }', '{"action": "Z"}', '{"other": 1}', '{"action": null}', "{'action': 'A'}", '{"action": "A"', "nothing", None]
    out = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", O.closed_choice(F.col("t"), "action", ["A", "B"], "NONE").alias("o")).orderBy("k").collect()
    assert [(r.o.choice, r.o.suppressed) if r.o else None for r in out] == [("A", None), ("NONE", "Z"), ("NONE", None), ("NONE", None), None, None, None, None]


def test_object_of_pairs(spark):
    lists = [[("a", "1"), ("b", "2"), ("a", "3")], [], None, [(None, "x"), ("k", None), ("k", "v"), ("k", None)]]
    df = spark.createDataFrame(list(enumerate(lists)), "k int, p array<struct<key: string, value: string>>")
    got = {r.k: r.o for r in df.select("k", O.object_of(F.col("p")).alias("o")).collect()}
    assert got == {k: None if x is None else {a: b for a, b in x if a is not None} for k, x in enumerate(lists)}
    assert list(got[0]) == ["a", "b"]


def test_parts_like_slices(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in range(6)] + [(None,)], "a array<int>")
    for start in (None, -7, -2, -1, 0, 1, 3, 9):
        for stop in (None, -7, -2, -1, 0, 2, 5, 9):
            for r in df.select("a", O.part(F.col("a"), start, stop).alias("p")).collect():
                assert r.p == (None if r.a is None else r.a[start:stop]), (r.a, start, stop)


def test_named_uuids(spark):
    names = ["", "a", "é漢", "customer/1", None, "x" * 5000]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for space in (uuid.NAMESPACE_DNS, uuid.NAMESPACE_URL):
        assert [r.u for r in df.select(O.named_uuid(space, F.col("n")).alias("u")).collect()] == [None if n is None else str(uuid.uuid5(space, n)) for n in names]


# --- lineage --------------------------------------------------------------------------------------


def walked(edges, seeds):
    """Shortest paths from each seed, of those the first in order, by breadth-first search."""
    out = {}
    for s in seeds:
        best, todo = {s: [s]}, deque([s])
        while todo:
            u = todo.popleft()
            for v in sorted({b for a, b in edges if a == u}):
                path = [*best[u], v]
                if v not in best:
                    best[v] = path
                    todo.append(v)
                elif len(best[v]) == len(path):
                    best[v] = min(best[v], path)
        out |= {(s, v): p for v, p in best.items() if v != s}
    return out


def test_reached_by_brute_force(spark):
    rng = random.Random(8)
    for _ in range(2):
        edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)]
        seeds = ["n1", "n2", "n29", "alone"]
        df = spark.createDataFrame([*edges, edges[0], (None, "n1"), ("n1", None)], "source string, target string")
        got = {(r.origin, r.node): r.path for r in lineage.reached(df, spark.createDataFrame([(s,) for s in [*seeds, None]], "node string")).collect()}
        want = walked(set(edges), seeds)
        assert set(got) == set(want) and {k: len(p) for k, p in got.items()} == {k: len(p) for k, p in want.items()}
        assert all(len(set(p)) == len(p) and all(e in set(edges) for e in zip(p, p[1:])) for p in got.values()) and got == want


def test_long_paths_are_an_error(spark):
    chain = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(6)], "source string, target string")
    seed = spark.createDataFrame([("000",)], "node string")
    assert lineage.reached(chain, seed, most=6).count() == 6
    with pytest.raises(ValueError):
        lineage.reached(chain, seed, most=5)


# --- queues ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_review_queue_by_brute_force(spark, seed):
    rng = random.Random(seed)
    zero = dt.datetime(2024, 1, 1)
    rows = []
    for _ in range(80):
        a = zero + dt.timedelta(hours=rng.randrange(24 * 20), minutes=rng.randrange(60))
        rows.append((rng.choice("qr"), a, rng.choice([None, a, a + dt.timedelta(hours=rng.randrange(200)), a - dt.timedelta(hours=1)] if seed > 1 else [a + dt.timedelta(hours=rng.randrange(90))])))
    rows.append(("q", None, zero))
    until = dt.date(2024, 1, 24)
    got = {(r.queue, r.day): (r.opened, r.closed, r.depth, r.oldest)
        for r in operations.review_queue(spark.createDataFrame(rows, "queue string, opened_at timestamp, closed_at timestamp"), F.lit(until)).collect()}
    want = {}
    for q in "qr":
        own = [(a, b) for x, a, b in rows if x == q and a and (b is None or b >= a)]
        day = min(a for a, _ in own).date()
        while day <= until:
            live = [a for a, b in own if a.date() <= day and (b is None or b.date() > day)]
            want[q, day] = (sum(a.date() == day for a, _ in own), sum(b is not None and b.date() == day for _, b in own), len(live), min(live, default=None))
            day += dt.timedelta(days=1)
    assert got == want


def test_actions_and_calls(spark):
    at = dt.datetime(2024, 1, 1, 5)
    audit = spark.createDataFrame([(at, "a", 1.25, False, 0.5, "X"), (at, "a", 2.0, True, None, "X"), (at + dt.timedelta(days=1), "b", 0.0, False, 1.0, None)],
        "at timestamp, client string, cost double, blocked boolean, groundedness double, action string")
    assert sorted(tuple(r) for r in operations.calls(audit).collect()) == [(dt.date(2024, 1, 1), 2, 1, 3.25, 0.5, 0.5), (dt.date(2024, 1, 2), 1, 1, 0.0, 0.0, 1.0)]
    assert [tuple(r) for r in operations.actions(audit).collect()] == [("X", 2, 1.0)]


# --- alerts ---------------------------------------------------------------------------------------


def day(k):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=k)


def test_alerts_once_although_batches_repeat(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    batch = lambda *r: spark.createDataFrame([(a, day(k), s) for a, k, s in r], "rule_id string, at timestamp, status string")
    batches = [
        batch(("A", 0, "FAIL"), ("A", 1, "FAIL"), ("B", 0, "PASS"), ("B", 1, "WARN")), batch(("A", 2, "FAIL"), ("B", 2, "FAIL"), ("B", 3, "PASS"), ("B", 4, "FAIL")),
        batch(("A", 3, "PASS"), ("B", 5, "FAIL"), ("C", 0, "FAIL"), ("B", 1, "FAIL")), batch(("A", 4, "FAIL")),
    ]
    added = [alerts.alert(store, batches[n], n) for n in (0, 0, 1, 1, 0, 2, 2, 3, 1)]
    assert added == [1, 0, 2, 0, 0, 1, 0, 1, 0]  # a result older than its rule's state (B, 1) raises nothing
    assert sorted((r.rule_id, r.at, r.before) for r in store.read("alerts").collect()) == [("A", day(0), None), ("A", day(4), "PASS"), ("B", day(2), "WARN"),
        ("B", day(4), "PASS"), ("C", day(0), None)]
    assert {r.rule_id: r.status for r in store.read("states").collect()} == {"A": "FAIL", "B": "FAIL", "C": "FAIL"}


def test_a_failure_between_alerts_and_states_leaves_neither(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([("A", day(0), "FAIL")], "rule_id string, at timestamp, status string")
    monkeypatch.setattr(Store, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        alerts.alert(store, one, 0)
    monkeypatch.undo()
    assert store.head().tables == {} and alerts.alert(store, one, 0) == 1 and store.read("alerts").count() == 1


def test_a_stream_of_results(spark, tmp_path):
    store, source = Store(spark, str(tmp_path / "s")), str(tmp_path / "in")
    schema = "rule_id string, at timestamp, status string"
    put = lambda *r: spark.createDataFrame([("A", day(k), s) for k, s in r], schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda state: alerts.watch(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / state)).awaitTermination()
    put((0, "PASS"), (1, "FAIL"))
    run("one")
    put((2, "FAIL"))
    run("one")
    put((3, "PASS"), (4, "FAIL"))
    run("one")
    run("lost")  # a new checkpoint gives all of it again, as batch 0
    assert sorted((r.at, r.before) for r in store.read("alerts").collect()) == [(day(1), "PASS"), (day(4), "PASS")]


# --- branches -------------------------------------------------------------------------------------


def test_branches_fail_alone(spark, tmp_path):
    """A corrupt file, a cast error under ANSI, a plan that can't be made and a read that takes too long; an empty read is no failure."""
    store = Store(spark, str(tmp_path / "s"))
    good = spark.createDataFrame([(1, dt.date(2024, 1, k), k, "x" if k % 2 else "1", 1.0) for k in range(1, 9)], "customer long, order_date date, order_id long, status string, net double")
    broken = tmp_path / "broken"
    good.coalesce(1).write.parquet(str(broken))
    for f in broken.glob("*.parquet"):
        f.write_bytes(f.read_bytes()[:40] + b"\0" * 300)
    for f in broken.glob(".*.crc"):
        f.unlink()
    slow = lambda: good.where("order_id = 1").withColumn("status", F.expr("CASE WHEN java_method('java.lang.Thread', 'sleep', 20000L) IS NULL THEN '1' ELSE '2' END"))
    began = time.time()
    read, failed = serving.branches(
        store,
        {"good": lambda: good, "empty": lambda: good.where("false"), "corrupt": lambda: spark.read.schema(good.schema).parquet(str(broken)),
            "cast": lambda: good.withColumn("status", F.col("status").cast("int")), "unknown": lambda: good.select("nothing"), "slow": slow},
        seconds=12, needed=("good",),
    )
    assert set(failed) == {"corrupt", "cast", "unknown", "slow"} and all(read[n] is None for n in failed), failed
    assert time.time() - began < 19 and "Timeout" in failed["slow"] and "CAST_INVALID_INPUT" in failed["cast"]
    assert read["good"].count() == 8 and read["empty"].count() == 0
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        serving.branches(store, {"cast": lambda: good.withColumn("status", F.col("status").cast("int"))}, needed=("cast",))


def test_documents_of_branches(spark):
    whole = spark.createDataFrame([(1, "Ann", 50.0, "CRM,OMS"), (2, "Bo", 10.0, "CRM")], "customer long, full_name string, data_completeness_score double, contributing_sources string")
    orders = spark.createDataFrame([(1, dt.date(2024, 1, k), k, "OPEN", 1.0) for k in range(1, 30)], "customer long, order_date date, order_id long, status string, net double")
    plan = serving.nested(whole, orders, None, None, None, 3)
    rows = {r.customer: r.document for r in plan.collect()}
    assert [o.order_id for o in rows[1].orders] == [29, 28, 27] and rows[2].orders == [] and rows[1].support == [] and rows[1].churnRisk is None
    assert rows[1].partial and rows[1].degradedFields == ["cases", "churn"]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text or text.index("row_number") > text.index("collect_list")  # rows are cut before they are put together
    plain = {r.customer: json.loads(r.document) for r in serving.documents(whole, orders, 2).collect()}
    assert [o["order_id"] for o in plain[1]["orders"]] == [29, 28] and plain[2]["orders"] == []


def test_views_without_personal_fields(spark):
    row = {"customer": 1, "customer_sk": "s", "full_name": "Ann Lee", "email": "a@b.co", "phone": "1", "birth_date": None, "segment": "PREMIUM",
        "customer_status": "ACTIVE", "value_tier": "LOW", "loyalty_tier": "GOLD", "loyalty_points_balance": 5, "data_completeness_score": 50.0, "tenure_days": 4,
        "total_cases": 0, "band": "LOW", "city": "X", "postal_code": "1"}
    whole = spark.createDataFrame([row], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in row.items()))
    shop, model = serving.store_view(whole, False), serving.model_view(whole, ["customer", "segment", "band"])
    assert not set(shop.columns) & {"email", "phone", "birth_date"} and not set(serving.MODEL_CONTEXT) & set(serving.PERSONAL) and model.columns == ["customer", "segment", "band"]
    with pytest.raises(ValueError):
        serving.model_view(whole, ["customer", "email"])
    assert (shop.first().display_name, shop.first().vip, shop.first().masked) == ("Ann L**", True, True)
    assert serving.store_view(whole, True).first().display_name == "Ann Lee"


# --- text -----------------------------------------------------------------------------------------


def test_explanations_quote_what_is_there(spark):
    rows = spark.createDataFrame(
        [(1, "HIGH", 0.55, ["PURCHASE_RECENCY", "LOW_SATISFACTION", "NEW_KIND"], 300, 2.5), (2, None, None, ["PURCHASE_RECENCY", "DECLINING_ORDER_TREND"], None, None),
            (3, "LOW", 0.1, [], 1, 5.0), (4, "LOW", 0.1, None, 1, 5.0)],
        "customer int, band string, probability double, drivers array<string>, days_since_last_order int, avg_csat double",
    ).selectExpr("*", "cast(null as double) order_trend_ratio", "2 cases_last_90d", "7.5D engagement_score", "0 negative_signals_90d")
    out = {r.customer: r.explanation for r in insight.churn_explanation(rows).collect()}
    assert out[1] == "Churn risk is HIGH with a probability of 0.55. The main reasons are that they have not ordered for 300 days; their average satisfaction score is 2.5; new kind."
    assert out[2] == "Churn risk is unclassified with a probability of n/a. The main reasons are that they have no recent purchase activity; their recent order rate has fallen."
    assert out[3] == "No churn drivers were supplied, so no explanation can be given." and out[4] in (out[3], None)


def test_what_columns_hold(spark):
    rows = [(1, "a@b.co", "plain words in a long sentence, and more of them", True, None, "x"),
        (2, "c@d.org", "another one that is long as well and has blanks", False, None, "5"), (3, None, "and a third sentence of the same kind of text", None, None, "6")]
    df = spark.createDataFrame(rows, "id int, mail string, note string, flag boolean, nothing string, mixed string")
    out = {r.column_name: (r.n_rows, r.null_share, r.n_distinct, r.content) for r in insight.described(df, "t").collect()}
    assert out == {"id": (3, 0.0, 3, "NUMBER"), "mail": (3, 0.333333, 2, "EMAIL"), "note": (3, 0.0, 3, "FREE_TEXT"), "flag": (3, 0.333333, 2, "FLAG"),
        "nothing": (3, 1.0, 0, "EMPTY"), "mixed": (3, 0.0, 3, "TEXT")}
