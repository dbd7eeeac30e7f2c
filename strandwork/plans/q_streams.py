"""Structured Streaming jobs over the event and line tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwork.operators.iterate import ancestors
from strandwork.plans.registry import query
from strandwork.session import materialize
from strandwork.sources import derived as D
from strandwork.streaming import appends, jobs, readers
from strandwork.streaming.common import drain, drain_last, folder, source


def events(spark, d):
    """The event stream with an event-time column of the type watermarks need."""
    return source(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("n1_resumed_record_stream", "SELECT event_type, count(*) AS records FROM events GROUP BY event_type")
def resumed_stream(spark, d):
    """Records read as a stream; the checkpoint is the place to resume from."""
    got = drain(source(spark, d, "events", 1), "records")
    return got.groupBy("event_type").agg(F.count("*").alias("records"))


@query("n2_complete_files", """
SELECT l_orderkey AS file, max(l_linenumber)::BIGINT AS chunks, CASE WHEN count(*) > count(DISTINCT l_linenumber) THEN 'disagrees' ELSE 'complete' END AS status
FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) = max(l_linenumber)""")
def complete_files(spark, d):
    """Orders as files of numbered chunks, emitted when every chunk is in."""
    size = D.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").cast("long").alias("chunk_count"))
    chunks = source(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("chunk_index")).join(size, "l_orderkey").select(
        F.col("l_orderkey").alias("file"), "chunk_index", "chunk_count")
    return drain(appends.complete_files(chunks), "files")


@query("n3_idempotent_appends", "SELECT user_id * 10 + length(event_type) AS request_key, 1::BIGINT AS n FROM events GROUP BY ALL")
def idempotent_appends(spark, d):
    stream = events(spark, d).select((F.col("user_id") * 10 + F.length("event_type")).alias("request_key"), "ts", "event_id")
    stored = appends.append_once(stream, "request_key", "appends")
    return stored.groupBy("request_key").agg(F.count("*").alias("n"))


@query("n4_optimistic_actions", """
WITH RECURSIVE a AS (SELECT user_id, event_id, length(event_type) + event_id % 7 AS jitter, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s(user_id, i, view, seq, status) AS (SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, -1::BIGINT, '' FROM events UNION ALL
 SELECT a.user_id, a.i, s.view + (a.event_id % 3 < 2)::BIGINT, a.event_id, CASE WHEN a.event_id % 3 < 2 THEN 'applied' ELSE 'stale_view' END FROM s JOIN a ON a.user_id = s.user_id AND a.i = s.i + 1)
SELECT user_id AS reader, seq, status, view FROM s WHERE i > 0""")
def optimistic_actions(spark, d):
    """Actions that expect the view of their reader: two of three do, the third names another one."""

    ok = (F.col("event_id") % 3 < 2).cast("long")
    from strandwork.operators.order_stats import running

    # What each action expects is known ahead of the stream: the views made by the fitting actions before it.
    ahead = running(D.table(spark, d, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], {"made": ok}).select(
        F.col("event_id").alias("seq"), F.when(ok == 1, F.col("made") - 1).otherwise(-1).alias("expected"))
    acts = readers.actions(source(spark, d, "events")).join(ahead, "seq")
    return drain(readers.optimistic(acts), "views")


@query("n5_expansion_sets", """
WITH x AS (SELECT user_id, event_id, event_type, 'n:' || (event_id % 25) AS node FROM events),
o AS (SELECT user_id, node, max(event_id) AS at FROM x WHERE event_type = 'view' GROUP BY ALL), c AS (SELECT user_id, node, max(event_id) AS at FROM x WHERE event_type = 'click' GROUP BY ALL),
r AS (SELECT user_id, max(event_id) AS at FROM x WHERE event_type = 'signup' GROUP BY ALL)
SELECT o.user_id AS reader, o.node FROM o LEFT JOIN c ON c.user_id = o.user_id AND c.node = o.node LEFT JOIN r ON r.user_id = o.user_id
WHERE (c.at IS NULL OR c.at < o.at) AND (r.at IS NULL OR r.at < o.at)""")
def expansion_sets(spark, d):
    touch = drain_last(readers.last_touch(readers.actions(source(spark, d, "events"))), "touch")
    scopes = D.scopes(spark, d).select(F.col("scope_id").alias("node"), "parent")
    return readers.expansion_sets(touch, ancestors(scopes))


@query("n6_job_life_cycles")
def job_life_cycles(spark, d):
    """Events of a user's hour as one job; the transition rules are checked in tests."""
    e = source(spark, d, "events").select(
        (F.col("user_id") * 1000 + F.hour("ts")).alias("job"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"),
        F.when(F.col("event_id") % 5 == 0, F.lit(-2)).otherwise(F.col("user_id")).alias("actor"))
    return drain(jobs.life_cycles(e), "jobs")


@query("n7_compare_and_swap", """
SELECT user_id AS slot, event_id AS seq, CASE WHEN event_id = min(CASE WHEN event_id % 4 = 0 THEN event_id END) OVER (PARTITION BY user_id) THEN 'published' ELSE 'stale_base' END AS outcome FROM events""")
def compare_and_swap(spark, d):
    """Publication requests; a request on the current base wins its slot, the rest of the batch is stale."""
    requests = source(spark, d, "events").select(F.col("user_id").alias("slot"), F.col("event_id").alias("seq"), (F.col("event_id") % 4).alias("base"))
    return appends.publish_if_current(requests, "swap")


@query("n8_exposure_windows", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS exposures, round(sum(value), 2) AS amount FROM events GROUP BY ALL""")
def exposure_windows(spark, d):
    """Hourly exposures; the running result is complete, so windows still open at the end count too."""
    return drain_last(readers.exposure_windows(events(spark, d)), "windows")


@query("n8_closed_windows", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS exposures FROM events
WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""")
def closed_windows(spark, d):
    """Only windows that the watermark has passed are appended."""
    return drain(readers.exposure_windows(events(spark, d)), "closed").select("start", "event_type", "exposures")


@query("n9_sibling_group_jobs")
def sibling_group_jobs(spark, d):
    """Group jobs of users: creations on a base and drafts by index; the rules are checked in tests."""
    e = source(spark, d, "events").select(
        F.col("user_id").alias("parent"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "create").otherwise("accept").alias("kind"),
        F.lit(0).cast("long").alias("base"), (F.col("event_id") % 3).alias("index"), F.lit(3).cast("long").alias("size"))
    return drain(jobs.sibling_groups(e), "groups")


PARTS = 4


def arrivals(spark, d, name):
    """(k, stream) as the events come into an inbox in ``PARTS`` parts: a stream of its own for each run.

    Between two runs nothing is left but the inbox and what the run before has kept in its place.
    """
    inbox = folder(spark, f"{name}-inbox")
    rows = D.table(spark, d, "events")
    for k in range(PARTS):
        rows.where(F.col("event_id") % PARTS == k).write.mode("append").parquet(inbox)
        yield k, spark.readStream.schema(rows.schema).parquet(inbox)


@query("n1_stopped_and_resumed", """
SELECT event_type, k.k AS runs, count(*) FILTER (event_id % 4 <= k.k) AS records FROM events, (VALUES (0), (1), (2), (3)) k(k) GROUP BY ALL
HAVING count(*) FILTER (event_id % 4 <= k.k) > 0""")
def stopped_and_resumed(spark, d):
    """Records after each of four runs of one stream: every run reads what is new since the last one."""
    place = folder(spark, "resumed")
    seen = None
    for k, stream in arrivals(spark, d, "resumed"):
        now = drain(stream, "resumed", place=place).groupBy("event_type").agg(F.lit(k).alias("runs"), F.count("*").alias("records"))
        now = materialize(now)
        seen = now if seen is None else seen.unionAll(now)
    return seen


@query("n3_appends_across_restarts", """
SELECT user_id * 10 + length(event_type) AS request_key, min(event_id % 4)::INTEGER AS run, 1::BIGINT AS n FROM events GROUP BY 1""")
def appends_across_restarts(spark, d):
    """Requests of four runs, each stored once, by the first run that had it."""
    place = folder(spark, "restarts")
    for _, stream in arrivals(spark, d, "restarts"):
        stored = appends.append_once(stream.select((F.col("user_id") * 10 + F.length("event_type")).alias("request_key"), (F.col("event_id") % PARTS).cast("int").alias("run")),
                                     "request_key", "restarts", place)
    return stored.groupBy("request_key").agg(F.min("run").alias("run"), F.count("*").alias("n"))


@query("n7_publication_rounds", """
WITH RECURSIVE asked AS (SELECT user_id % 50 AS slot, event_id AS seq, event_id % 3 AS base, event_id % 4 AS k FROM events),
head(slot, k, head) AS (SELECT DISTINCT slot, 0::BIGINT, 0::BIGINT FROM asked
  UNION ALL SELECT h.slot, h.k + 1, h.head + (f.slot IS NOT NULL)::BIGINT FROM head h
  LEFT JOIN (SELECT DISTINCT slot, k, base FROM asked) f ON f.slot = h.slot AND f.k = h.k AND f.base = h.head WHERE h.k < 3)
SELECT a.slot, a.seq, CASE WHEN a.base = h.head AND a.seq = min(a.seq) FILTER (a.base = h.head) OVER (PARTITION BY a.slot, a.k) THEN 'published' ELSE 'stale_base' END AS outcome
FROM asked a JOIN head h ON h.slot = a.slot AND h.k = a.k""")
def publication_rounds(spark, d):
    """Requests of four runs against the manifest that the runs before have published."""
    place = folder(spark, "rounds")
    for _, stream in arrivals(spark, d, "rounds"):
        judged = appends.publish_if_current(stream.select((F.col("user_id") % 50).alias("slot"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("base")), "rounds", place)
    return judged
