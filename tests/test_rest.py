"""Paged REST collections against a local server."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tessera.sources import readers
from tessera.sources.rest import RestPages
from tessera.sources.store import Store
from tessera.streaming.incremental import unique_events  # noqa: F401  named in the source's notes


class Stub:
    def __init__(self):
        self.rows, self.asked, self.faults = [], [], []


@pytest.fixture
def server(spark):
    stub = Stub()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
            stub.asked.append(q)
            if stub.faults:
                self.send_error(stub.faults.pop())
                return
            rows = [r for r in stub.rows if all(r.get(c) == q[c] for c in ("status", "customerId") if c in q) and (r.get("updatedAt") or "") >= q.get("updatedSince", "")]
            a, n = int(q["offset"]), int(q["limit"])
            body = json.dumps({"data": rows[a : a + n], "total": len(rows)}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    stub.url = f"http://127.0.0.1:{httpd.server_port}/api/v1/orders"
    stub.rows = [{"orderId": f"o{k}", "status": "OPEN" if k % 3 else "DONE", "customerId": f"c{k % 5}", "updatedAt": f"2024-01-{1 + k % 28:02d}", "lines": [{"sku": k}],
        "note": None} for k in range(57)]
    spark.dataSource.register(RestPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield stub
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    httpd.shutdown()


def pages(spark, stub, limit=10):
    return spark.read.format("rest_pages").options(path=stub.url, fields="orderId,status,customerId,updatedAt,lines,note", limit=limit, equals="status,customerId",
        since="updatedAt=updatedSince").load()


def test_a_partition_for_each_page(spark, server):
    df = pages(spark, server)
    assert df.rdd.getNumPartitions() == 6
    rows = {r.orderId: r for r in df.collect()}
    assert len(rows) == 57 and rows["o7"].lines == '[{"sku": 7}]' and rows["o7"].note is None
    server.rows = []
    assert pages(spark, server).count() == 0


def test_filters_reach_the_server(spark, server):
    want = {r["orderId"] for r in server.rows if r["status"] == "DONE" and r["updatedAt"] >= "2024-01-20"}
    got = readers.since(pages(spark, server), "updatedAt", "2024-01-20").where("status = 'DONE'")
    assert {r.orderId for r in got.collect()} == want
    assert server.asked and all((q["status"], q["updatedSince"]) == ("DONE", "2024-01-20") for q in server.asked)
    server.asked.clear()
    got = pages(spark, server).where("updatedAt > '2024-01-20' AND customerId = 'c1' AND note IS NULL").collect()  # the bound itself is left out by Spark
    assert {r.orderId for r in got} == {r["orderId"] for r in server.rows if r["customerId"] == "c1" and r["updatedAt"] > "2024-01-20"}
    assert all((q["customerId"], q["updatedSince"]) == ("c1", "2024-01-20") for q in server.asked)


def test_a_busy_server_is_asked_again(spark, server):
    server.faults = [503, 429]
    assert pages(spark, server, 1000).count() == 57
    server.faults = [404]
    with pytest.raises(Exception, match="404"):
        pages(spark, server, 1000).count()


def test_loads_through_the_mark(spark, server, tmp_path):
    """Each load asks for what came since the mark that was committed with the rows before."""
    store = Store(spark, str(tmp_path / "s"))
    all_ = server.rows
    server.rows = [r for r in all_ if r["updatedAt"] < "2024-01-15"]
    first = store.advance("orders", "oms", pages(spark, server), "updatedAt", ["orderId"])
    server.rows = all_
    server.asked.clear()
    assert store.advance("orders", "oms", pages(spark, server), "updatedAt", ["orderId"]) == 57 - first
    assert {q["updatedSince"] for q in server.asked} == {"2024-01-14"}
    assert store.head().marks == {"oms": "2024-01-28"} and store.read("orders").select("orderId").distinct().count() == store.read("orders").count() == 57


def test_a_stream_of_pages(spark, server, tmp_path):
    """Batches go on from the last mark; rows at the mark come again and are dropped by key."""
    all_ = server.rows
    server.rows = all_[:20]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        s = spark.readStream.format("rest_pages").options(path=server.url, fields="orderId,updatedAt", limit=7, mark="updatedAt", since="updatedAt=updatedSince").load()
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    run()
    assert spark.read.parquet(out).count() == 20
    server.rows = all_[:20] + [{"orderId": "late", "updatedAt": "2024-01-20"}, {"orderId": "new", "updatedAt": "2024-02-01"}, {"orderId": "old", "updatedAt": "2023-01-01"}]
    server.asked.clear()
    run()
    got = spark.read.parquet(out)
    assert {r.orderId for r in got.collect()} == {f"o{k}" for k in range(20)} | {"late", "new"}
    assert got.groupBy("orderId").count().where(F.col("count") > 1).count() == 1  # the row at the mark
    assert "2024-01-20" in {q.get("updatedSince") for q in server.asked}
