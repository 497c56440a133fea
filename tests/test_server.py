"""The HTTP front."""

import json
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from basalt.plans.engine import Engine
from basalt.plans.server import QueryServer


@pytest.fixture(scope="module")
def server(spark):
    engine = Engine(spark)
    engine.register("t", spark.range(50).withColumn("g", F.col("id") % 3))
    made = QueryServer(engine, token="Secret", max_rows=20).start()
    yield made
    made.stop()


def call(server, path, body=None, token="Secret"):
    data = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
    request = urllib.request.Request(f"http://127.0.0.1:{server.port}{path}", data, {"Authorization": f"Bearer {token}"})
    try:
        with urllib.request.urlopen(request) as answer:
            return answer.status, json.loads(answer.read())
    except urllib.error.HTTPError as why:
        return why.code, json.loads(why.read())


def test_query(server):
    status, got = call(server, "/v1/query", {"sql": "SELECT g, COUNT(*) AS n FROM t GROUP BY g ORDER BY g", "workers": 2})
    assert status == 200 and got["columns"] == ["g", "n"] and got["rows"] == [[0, 17], [1, 17], [2, 16]] and not got["cut"]
    status, got = call(server, "/v1/query", {"sql": "SELECT id FROM t"})
    assert len(got["rows"]) == 20 and got["cut"]
    assert call(server, "/metrics")[1]["queries"] == 2 and call(server, "/health", token="x") == (200, {"status": "ok"})


def test_refusals(server):
    assert call(server, "/v1/query", {"sql": "SELECT id FROM t"}, token="secret")[0] == 401
    assert call(server, "/v1/query", b"{")[0] == 400 and call(server, "/v1/query", {"workers": 1})[0] == 400
    assert call(server, "/v1/query", {"sql": "SELECT id FROM t OFFSET 3", "strict": True})[0] == 400
    assert call(server, "/v1/query", {"sql": "SELECT nothing FROM t"})[0] == 400
    assert call(server, "/nowhere")[0] == 404 and call(server, "/nowhere", {})[0] == 404
