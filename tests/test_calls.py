"""A fake service that answers, fails, drops connections and says 'later'."""

import json
import threading
import time
from collections import Counter
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

import pytest
from loomgraph.functions.text import retry_seconds
from loomgraph.operators import calls
from loomgraph.operators.providers import annotated
from pyspark.sql import functions as F

NOW = datetime(2024, 5, 6, 7, 8, 9, tzinfo=UTC)


@pytest.fixture()
def service():
    seen, times = Counter(), []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            _, kind, text = (unquote(x) for x in self.path.split("/"))
            seen[text] += 1
            times.append((text, time.monotonic()))
            n, code, body, after = seen[text], 200, json.dumps({"label": f"{kind} of {text}"}), None
            if text == "fails once" and n == 1:
                code = 500
            elif text == "later" and n == 1:
                code, after = 429, "2"
            elif text == "none":
                code = 404
            elif text == "always fails":
                code = 500
            elif text == "drops" and n == 1:
                self.connection.close()
                return
            self.send_response(code)
            if after:
                self.send_header("Retry-After", after)
            self.end_headers()
            self.wfile.write(body.encode() if code == 200 else b"")

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/{{kind}}/{{text}}", seen, times
    server.shutdown()


def test_answers_are_asked_once(spark, service, tmp_path):
    url, seen, times = service
    p = calls.Calling(spark, f"file://{tmp_path}/a", calls.http(url), per_second=50, tasks=2, attempts=2)
    texts = ["plain", "fails once", "later", "none", "always fails", "drops", "ça/&?", "plain", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3)
    got = {r["k"]: r["x"] and r["x"]["label"] for r in annotated(rows, p, "name", F.col("text"), "label string", "x").collect()}
    said = lambda t: f"name of {t}"
    assert got == {0: said("plain"), 1: said("fails once"), 2: said("later"), 3: None, 4: None, 5: said("drops"), 6: said("ça/&?"), 7: said("plain"), 8: None}
    assert seen == {"plain": 1, "fails once": 2, "later": 2, "none": 1, "always fails": 2, "drops": 2, "ça/&?": 1}
    later = [t for x, t in times if x == "later"]
    assert later[1] - later[0] >= 2
    seen.clear()
    more = rows.unionByName(spark.createDataFrame([(9, "new")], "k int, text string"))
    again = {r["k"]: r["x"] and r["x"]["label"] for r in annotated(more, p, "name", F.col("text"), "label string", "x").collect()}
    assert again == got | {9: "name of new"} and seen == {"always fails": 2, "new": 1}  # only what isn't known
    assert annotated(rows.limit(0), p, "name", F.col("text"), "label string", "x").count() == 0


def test_rate(spark, service, tmp_path):
    url, seen, times = service
    p = calls.Calling(spark, f"file://{tmp_path}/a", calls.http(url), per_second=10, tasks=2)
    p.answers(spark.range(20).select(F.col("id").alias("key"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("input")), "k", "label string")
    at = sorted(t for _, t in times)
    assert len(at) == 20 and at[-1] - at[0] >= 1.0  # some 10 for each of two tasks, 0.2 s apart


def test_waits(spark):
    headers = ["7", "0", "-3", "Mon, 06 May 2024 07:08:39 GMT", "Mon, 06 May 2024 07:00:00 GMT", "soon", "", None]
    rows = spark.createDataFrame([(h,) for h in headers], "h string").select("h", retry_seconds(F.col("h"), F.lit("2024-05-06 07:08:09").cast("timestamp")).alias("s")).collect()
    assert [calls.wait_seconds(h, NOW) for h in headers] == [7, 0, 0, 30, 0, 0, 0, 0]
    assert [max(0, r["s"]) for r in rows] == [7, 0, 0, 30, 0, 0, 0, 0]
    slept = []
    tries = iter([(429, {"retry-after": "9999"}, ""), (0, {}, ""), (200, {}, "x")])
    assert calls.asked(lambda k, t: next(tries), "k", "t", 5, 60.0, slept.append) == (True, "x") and slept == [60.0, 1.0]
    assert calls.asked(lambda k, t: (_ for _ in ()).throw(OSError()), "k", "t", 3, 60.0, slept.append) == (False, None)
