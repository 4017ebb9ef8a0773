"""Providers that call out: a service is asked once for each text, and its answers are kept.

Texts without a kept answer are dealt to a few tasks, each of which asks at its share of the allowed rate, waits as long
as the service says and tries again after failures. What was answered, also with 'there is none', goes to a table of
answers; what failed is asked again the next time. A task that is lost asks again for its own texts only."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import json_reply
from loomgraph.operators.commits import Folder

ANSWERS = "kind string, digest string, reply string"
#: Status, headers by lower-case name and body of a request for (kind, text).
Request = Callable[[str, str], tuple[int, dict, str]]
#: Statuses by which a service says 'later'.
LATER = (429, 503)


def wait_seconds(header: str | None, now: datetime) -> float:
    """A retry-after header in seconds: a number, or the time until a date; 0 where it is neither."""
    try:
        return max(0.0, float(int(header)))
    except (TypeError, ValueError):
        pass
    try:
        return max(0.0, (parsedate_to_datetime(header) - now).total_seconds())
    except (TypeError, ValueError):
        return 0.0


def http(url: str, timeout: float = 30.0, headers: dict | None = None) -> Request:
    """GET of an address with {kind} and {text} in it, quoted."""

    def get(kind: str, text: str) -> tuple[int, dict, str]:
        at = url.format(kind=urllib.parse.quote(kind, safe=""), text=urllib.parse.quote(text, safe=""))
        try:
            with urllib.request.urlopen(urllib.request.Request(at, headers=headers or {}), timeout=timeout) as r:
                return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, {k.lower(): v for k, v in e.headers.items()}, ""

    return get


def asked(request: Request, kind: str, text: str, attempts: int, longest: float, sleep: Callable[[float], None] = time.sleep) -> tuple[bool, str | None]:
    """(whether it was answered, the reply): 200 is the reply, other 4xx say that there is none; 'later' waits as the
    service says; exceptions and other statuses wait half a second, then twice as long each time."""
    for k in range(attempts):
        wait = min(longest, 0.5 * 2**k)
        try:
            status, headers, body = request(kind, text)
        except OSError:
            status, headers, body = 0, {}, ""
        if status == 200:
            return True, body
        if status in LATER:
            wait = min(longest, wait_seconds(headers.get("retry-after"), datetime.now(UTC)) or wait)
        elif 400 <= status < 500:
            return True, None
        if k + 1 < attempts:
            sleep(wait)
    return False, None


class Calling:
    """A provider of JSON replies by requests, with a table of answers at `path`.

    per_second: requests of all tasks together; attempts and longest: tries of a text, and seconds of a wait, at most."""

    def __init__(self, spark: SparkSession, path: str, request: Request, per_second: float = 5.0, tasks: int = 4, attempts: int = 5, longest: float = 300.0):
        self.spark, self.path, self.request = spark, path.rstrip("/"), request
        self.pause, self.tasks, self.attempts, self.longest = tasks / per_second, tasks, attempts, longest

    def known(self, kind: str) -> DataFrame:
        """Kept answers of a kind: digest, reply (null: there is none)."""
        parts = [f"{self.path}/{x}" for x in Folder(self.spark, self.path).names() if x.startswith("answers-")]
        rows = self.spark.read.schema(ANSWERS).parquet(*parts) if parts else self.spark.createDataFrame([], ANSWERS)
        return rows.filter(F.col("kind") == kind).groupBy("digest").agg(F.max("reply").alias("reply"))

    def _asking(self, kind: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        request, pause, attempts, longest = self.request, self.pause, self.attempts, self.longest

        def of(batches):
            free = 0.0
            for b in batches:
                rows = []
                for digest, text in zip(b["digest"], b["input"]):
                    time.sleep(max(0.0, free - time.monotonic()))
                    free = time.monotonic() + pause
                    done, reply = asked(request, kind, text, attempts, longest)
                    if done:
                        rows.append((kind, digest, reply))
                yield pd.DataFrame(rows, columns=["kind", "digest", "reply"], dtype=object)

        return of

    def answers(self, inputs: DataFrame, kind: str, schema: str) -> DataFrame:
        """inputs (key, input) -> key, input, answer (struct of the schema, null where there is none or none yet). Null inputs
        aren't asked."""
        rows = inputs.withColumn("digest", F.sha2("input", 256))
        new = rows.filter("input is not null").select("digest", "input").dropDuplicates(["digest"]).join(self.known(kind), "digest", "left_anti")
        new.repartition(self.tasks, "digest").mapInPandas(self._asking(kind), ANSWERS).write.parquet(f"{self.path}/answers-{uuid.uuid4().hex}")
        return rows.join(self.known(kind), "digest", "left").select("key", "input", json_reply(F.col("reply"), schema).alias("answer"))
