import hashlib
import hmac
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from revlake.functions.signing import signature_is_valid
from revlake.operators import intake as W
from revlake.streaming import streams as T

SECRET = "hook secret"


def signed(body, secret=SECRET):
    return "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def payload(**changes):
    fields = {
        "action": "opened", "pull_request": {"number": 7, "title": "Añadir"},
        "repository": {"full_name": "o/r"}, "installation": {"id": 5},
    }
    fields.update(changes)
    return json.dumps(fields, ensure_ascii=False)


CASES = [
    (payload(), True, "enqueued"),
    (payload(action="synchronize", pull_request={"number": 8}), True, "enqueued"),
    (payload(action="closed"), True, "ignored"),
    (payload(action=None), True, "ignored"),
    ("{broken", True, "malformed"),
    (payload(installation={"id": 0}), True, "invalid"),
    (payload(repository={"full_name": ""}), True, "invalid"),
    (payload(pull_request={}), True, "invalid"),
    (payload(), False, "unauthorized"),
    (payload(action="closed"), False, "unauthorized"),
]


def deliveries(spark):
    rows = [
        (str(i), datetime(2024, 1, 1, 0, i), signed(body) if good else signed(body, "other"), body)
        for i, (body, good, _) in enumerate(CASES)
    ]
    return spark.createDataFrame(rows, "delivery_id string, received_at timestamp, signature string, body string")


@pytest.mark.parametrize("secret", [SECRET, "", "long" * 40, "clé"])
def test_signature_equals_hmac(spark, secret):
    bodies = ["", "{}", payload(), "x" * 5000]
    rows = [(b, signed(b, secret), True) for b in bodies]
    rows += [(b, signed(b, "wrong"), False) for b in bodies]
    rows += [("{}", "", False), ("{}", None, False), ("{}", signed("{}", secret).replace("sha256", "sha1"), False)]
    df = spark.createDataFrame(rows, "body string, signature string, good boolean")
    checked = df.select("good", signature_is_valid(F.col("body"), F.col("signature"), secret).alias("ok"))
    assert all(r.good == r.ok for r in checked.collect())


def test_dispositions(spark):
    rows = W.classified(deliveries(spark), SECRET).orderBy(F.col("delivery_id").cast("int")).collect()
    assert [r.disposition for r in rows] == [d for _, _, d in CASES]
    assert set(W.HTTP_STATUS) >= {r.disposition for r in rows}
    counts = {r.disposition: r.deliveries for r in W.disposition_counts(deliveries(spark), SECRET).collect()}
    assert counts == {"enqueued": 2, "ignored": 2, "malformed": 1, "invalid": 3, "unauthorized": 2}


def test_jobs_are_queued_with_repeatable_ids(spark):
    first = W.jobs_from_deliveries(deliveries(spark), SECRET).orderBy("pr_number").collect()
    again = W.jobs_from_deliveries(deliveries(spark), SECRET).orderBy("pr_number").collect()
    assert first == again
    assert [(j.status, j.pr_number, j.pr_title, j.installation_id) for j in first] == [
        ("queued", 7, "Añadir", 5), ("queued", 8, "", 5),
    ]


def test_current_jobs_resolve_ties(spark):
    t0, t1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    events = spark.createDataFrame(
        [("a", 1, "queued", None, t0), ("a", 2, "failed", "boom", t1), ("a", 3, "processing", None, t1),
         ("b", 9, "complete", None, t0), ("b", 1, "queued", None, t1)],
        "task_id string, seq long, status string, error_message string, ts timestamp",
    )
    rows = {r.task_id: r for r in W.current_jobs(events).collect()}
    assert (rows["a"].status, rows["a"].error_message) == ("processing", None)
    assert rows["b"].status == "queued" and rows["b"].created_at == t0


def test_jobs_by_task(spark):
    jobs = spark.createDataFrame([("t1", "queued")], "celery_task_id string, status string")
    tasks = spark.createDataFrame([("t1",), ("t2",)], "task_id string")
    assert {r.task_id: r.status for r in W.jobs_by_task(jobs, tasks).collect()} == {"t1": "queued", "t2": None}


def test_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    deliveries(spark).repartition(3).write.parquet(source)
    jobs = T.job_stream(T.delivery_stream(spark, source, max_files=1), SECRET)
    T.append_stream(jobs, out, str(tmp_path / "state"), available_now=True).awaitTermination()
    batch = W.jobs_from_deliveries(deliveries(spark), SECRET)
    streamed = spark.read.schema(batch.schema).parquet(out)
    assert streamed.exceptAll(batch).count() == 0 and streamed.count() == batch.count() == 2
    # A restarted stream finds nothing new.
    T.append_stream(jobs, out, str(tmp_path / "state"), available_now=True).awaitTermination()
    assert spark.read.schema(batch.schema).parquet(out).count() == 2


def test_redeliveries_can_be_dropped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    deliveries(spark).union(deliveries(spark)).repartition(2).write.parquet(source)
    jobs = T.job_stream(T.delivery_stream(spark, source), SECRET, dedupe_within="1 hour")
    T.append_stream(jobs, out, str(tmp_path / "state"), available_now=True).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_notifications_and_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "pr_number long, status string").write.parquet(source)
    stream = spark.readStream.schema("pr_number long, status string").parquet(source)
    messages = T.notification_stream(stream)
    T.append_stream(messages, str(tmp_path / "m"), str(tmp_path / "s1"), True, "json").awaitTermination()
    sent = spark.read.json(str(tmp_path / "m"))
    noise = sent.union(spark.createDataFrame([("k", '{"event":"other"}'), ("k", "broken")], sent.schema))
    assert {r.pr_number for r in T.update_events(noise).collect()} == {1, 2, 3}
    counts = T.status_counts(stream, "status")
    T.versioned_stream(counts, str(tmp_path / "v"), str(tmp_path / "s2"), True).awaitTermination()
    from revlake.sources.sinks import latest_version

    latest = latest_version(spark.read.parquet(str(tmp_path / "v")))
    assert {(r.status, r.n) for r in latest.collect()} == {("a", 2), ("b", 1)}
