"""Queries that run streams to their end: a consumer over a recorded topic, messages written and read back, a change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans import feeds
from tidewatch.plans.common import ORACLE_SQL, POSTS_SQL, posts, query
from tidewatch.sources import logs
from tidewatch.sources.scratch import scratch_path
from tidewatch.sources.tables import driver_table, duckdb_ctes, table
from tidewatch.sources.topics import to_messages
from tidewatch.streaming import counters, fetches, jobs, notify
from tidewatch.streaming.consumer import Consumer, read_dead_letters
from tidewatch.streaming.feed import ChangeFeed

_COMMENT = "post_id string, floor int, author string, lsn long"


@query(feeds._MESSAGES_SQL + """, told AS (
  SELECT m.topic, m."partition", row_number() OVER (PARTITION BY m."partition" ORDER BY m."offset") - 1 AS "offset", k, v, c.post_id, c.floor, c.author, c.lsn,
    CASE WHEN v IS NULL THEN 'tombstone' WHEN c.lsn % 97 = 0 THEN 'json' WHEN c.floor > 45 THEN 'floor' END AS error
  FROM messages m JOIN comments_cdc c ON c.lsn = m."offset")
SELECT post_id, floor, arg_max(author, lsn) AS author, max(lsn) AS lsn, NULL::INT AS "partition", NULL::BIGINT AS "offset", NULL AS error, NULL AS payload_b64 FROM told WHERE error IS NULL GROUP BY 1, 2
UNION ALL SELECT NULL, NULL, NULL, NULL, "partition", "offset", error, to_base64(encode(v)) FROM told WHERE error IS NOT NULL""")
def topic_consumer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded topic consumed in batches of a quarter, stopped and started again between them.

    The newest comments by post and floor, and the messages that couldn't be taken with where they lay.
    """
    logs.register(spark)
    folder = scratch_path(spark, "consumer")
    # a partition's messages are written in their order, so that its offsets count them
    given = feeds.messages(spark, sf_dir).repartition("partition").sortWithinPartitions("partition", "offset")
    given.select("partition", "timestamp", "key", "value").write.format("topic_log").option("path", f"{folder}/topic").mode("append").save()
    waiting = sum(logs.Log(f"{folder}/topic").ends().values())
    table = jobs.BucketTable(f"{folder}/comments", ["post_id", "floor"], spark.createDataFrame([], _COMMENT), buckets=8)
    newest = jobs.merge_latest(table, ["lsn"])
    rule = F.when(F.col("row.floor") > 45, "floor")
    consumer = Consumer(_COMMENT, lambda rows, number: newest(rows.select(*table.empty.columns), number), f"{folder}/dead", rule)

    def messages() -> DataFrame:
        options = {"path": f"{folder}/topic", "topic": "comments", "limit": str(waiting // 4 + 1), "progress": f"{folder}/progress"}
        return spark.readStream.format("topic_log").options(**options).load()

    for _ in range(2):  # a batch each, then stopped
        consumer.start(messages(), f"{folder}/checkpoint", availableNow=True).awaitTermination()
    rest = consumer.start(messages(), f"{folder}/checkpoint")
    rest.processAllAvailable()
    rest.stop()
    none = {"partition": "int", "offset": "long", "error": "string", "payload_b64": "string"}
    rows = table.read(spark).withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    return rows.unionByName(read_dead_letters(spark, f"{folder}/dead").select(*none), allowMissingColumns=True)


@query("""SELECT CAST(user_id AS VARCHAR) AS key, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value, (user_id % 12)::INT AS "partition" FROM events""")
def topic_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a stream written to a topic as keyed messages, and read back from it."""
    logs.register(spark)
    folder = scratch_path(spark, "written")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, as a stream of files doesn't take one file's name
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")
    sent = to_messages(events, "events", F.col("user_id"), F.col("user_id") % 12, ["event_id", "event_type"])
    out = sent.writeStream.format("topic_log").option("path", f"{folder}/topic").option("checkpointLocation", f"{folder}/checkpoint")
    out.trigger(availableNow=True).start().awaitTermination()
    back = spark.read.format("topic_log").option("path", f"{folder}/topic").load()
    return back.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "partition")


_POST = "post_id board author title content url push_count boo_count comment_count created_at crawled_at is_deleted".split()
_CHANGING = "title content push_count boo_count comment_count".split()
_BATCHES = 3


def _feed_sql() -> str:
    """One merge after the other; a change is numbered by its batch, then by its key."""
    parts = [f"merged0 AS (SELECT {', '.join(_POST)} FROM posts)"]
    for i in range(_BATCHES):
        differs = " OR ".join(f"p.{c} IS DISTINCT FROM s.{c}" for c in _CHANGING)
        new = "CASE WHEN a IN ('insert', 'update') THEN"
        columns = {c: f"CASE WHEN a = 'insert' THEN s.{c} ELSE p.{c} END" for c in _POST} | {c: f"{new} s.{c} ELSE p.{c} END" for c in _CHANGING}
        columns |= {"crawled_at": "CASE WHEN a = 'keep' THEN p.crawled_at ELSE s.crawled_at END", "is_deleted": f"{new} false WHEN a = 'delete' THEN true ELSE p.is_deleted END"}
        parts.append(f"""snap{i} AS (SELECT * EXCLUDE (r) FROM (SELECT * EXCLUDE (max_floor), max_floor AS comment_count, row_number() OVER (PARTITION BY post_id ORDER BY crawled_at DESC) AS r
  FROM snapshots WHERE epoch_us(crawled_at) // 1000000 % {_BATCHES} = {i}) WHERE r = 1),
acted{i} AS (SELECT p, s, CASE WHEN p.post_id IS NULL THEN CASE WHEN s.is_deleted THEN 'none' ELSE 'insert' END
  WHEN s.post_id IS NOT NULL AND p.crawled_at < s.crawled_at AND NOT s.is_deleted AND (p.is_deleted OR {differs}) THEN 'update'
  WHEN s.post_id IS NOT NULL AND p.crawled_at < s.crawled_at AND s.is_deleted AND NOT p.is_deleted THEN 'delete' ELSE 'keep' END AS a
  FROM merged{i} p FULL JOIN snap{i} s ON s.post_id = p.post_id),
taken{i} AS (SELECT a, p, {', '.join(f'{v} AS {c}' for c, v in columns.items())} FROM acted{i} WHERE a <> 'none'),
merged{i + 1} AS (SELECT {', '.join(_POST)} FROM taken{i}),
changes{i} AS (SELECT {i + 1} AS batch, post_id, CASE a WHEN 'insert' THEN 'c' ELSE 'u' END AS op, p.title AS title_before, p.push_count AS push_before, p.is_deleted AS deleted_before,
  title AS title_after, push_count AS push_after, is_deleted AS deleted_after, crawled_at AS crawled_after FROM taken{i} WHERE a <> 'keep')""")
    every = " UNION ALL ".join(f"SELECT * FROM changes{i}" for i in range(_BATCHES))
    return f"{duckdb_ctes('posts_cdc', 'snapshots')}{POSTS_SQL}, {', '.join(parts)} SELECT row_number() OVER (ORDER BY batch, post_id) - 1 AS change, * FROM ({every})"


@query(_feed_sql())
def merge_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots merged in three batches, the second of them twice: all changes by number, with the rows before and after."""
    folder = scratch_path(spark, "merged")
    snaps = table(spark, sf_dir, "snapshots").withColumn("comment_count", F.col("max_floor"))
    old = posts(spark, sf_dir).select(*_POST)
    kept = jobs.BucketTable(f"{folder}/posts", ["post_id"], old.limit(0), buckets=8)
    kept.change(old, 0, lambda _: old)
    feed = ChangeFeed(f"{folder}/changes", ["post_id"])
    step = jobs.merge_snapshots(kept, feed)
    for number in (1, 2, 2, 3):
        step(snaps.where(F.floor(F.unix_micros("crawled_at") / 1_000_000) % _BATCHES == number - 1), number)
    return feed.read(spark).select(
        "change", "batch", "post_id", "op",
        *[F.col(f"before.{c}").alias(f"{n}_before") for c, n in (("title", "title"), ("push_count", "push"), ("is_deleted", "deleted"))],
        *[F.col(f"after.{c}").alias(f"{n}_after") for c, n in (("title", "title"), ("push_count", "push"), ("is_deleted", "deleted"), ("crawled_at", "crawled"))],
    )


_OUTCOME = "CASE WHEN chat_id % 11 = 0 THEN 'forbidden' WHEN chat_id % 7 = 0 THEN 'refused' ELSE 'sent' END"


# a stream sends every version of an alert to those who want it, not the last one only
@query(f"SELECT DISTINCT alert_id, chat_id, {_OUTCOME} AS outcome FROM ({ORACLE_SQL['recipients'].replace('WHERE r = 1)', ')')})")
def alert_fan_out_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sending a stream of alerts to those who want them comes to, each message once.

    At the first attempt of a batch a third of the chats can't be reached, so that every batch is
    sent in part and tried again.
    """
    logs.register(spark)
    folder = scratch_path(spark, "notified")
    alerts = table(spark, sf_dir, "alerts")
    schema = alerts.schema
    told = alerts.select(F.col("alert_id").alias("key"), F.to_json(F.struct(*alerts.columns)).alias("value"), F.col("created_at").alias("timestamp"))
    told.repartition("key").sortWithinPartitions("key", "timestamp").write.format("topic_log").options(path=f"{folder}/topic", partitions="4").mode("append").save()
    read = F.from_json(F.col("value").cast("string"), schema)
    stream = spark.readStream.format("topic_log").option("path", f"{folder}/topic").load().select(read.alias("a")).select("a.*")
    allowed = table(spark, sf_dir, "subscriptions").where("chat_id <= 60")
    wanted = lambda a: notify.recipients(a, allowed, table(spark, sf_dir, "chat_settings"), table(spark, sf_dir, "muted_posts"))

    def send(rows: list[dict], attempt: int) -> list[str]:
        late = lambda c: attempt == 0 and c % 3 == 0
        return ["again" if late(c) else "forbidden" if c % 11 == 0 else "refused" if c % 7 == 0 else "sent" for c in (r["chat_id"] for r in rows)]

    log = jobs.BucketTable(f"{folder}/log", notify.KEYS, spark.createDataFrame([], notify.SENT), buckets=8)
    sender = notify.retried(notify.Sender(log, f"{folder}/attempts", send), 3, lambda s: None)
    out = notify.messages(stream, wanted).writeStream.foreachBatch(sender).option("checkpointLocation", f"{folder}/checkpoint")
    out.trigger(availableNow=True).start().awaitTermination()
    return log.read(spark)


@query(duckdb_ctes("comments_cdc") + """
SELECT board, make_timestamp(w * 21600000000) AS "start", make_timestamp(w * 21600000000 + 86400000000) AS "end", count(*) AS n
FROM (SELECT board, unnest(range(epoch_us(changed_at) // 21600000000 - 3, epoch_us(changed_at) // 21600000000 + 1)) AS w FROM comments_cdc WHERE op = 'c') GROUP BY ALL""")
def window_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New comments of each board by days that start every six hours, counted by a stream under a watermark.

    The stream comes in four batches and changes its counts as they grow; the newest are kept.
    """
    logs.register(spark)
    folder = scratch_path(spark, "counted")
    new = table(spark, sf_dir, "comments_cdc").where("op = 'c'")
    told = new.select(F.col("board").alias("key"), F.lit("").alias("value"), F.col("changed_at").alias("timestamp"))
    told.repartitionByRange("timestamp").sortWithinPartitions("timestamp").write.format("topic_log").options(path=f"{folder}/topic", partitions="4").mode("append").save()
    waiting = sum(logs.Log(f"{folder}/topic").ends().values())
    options = {"path": f"{folder}/topic", "limit": str(waiting // 4 + 1), "progress": f"{folder}/progress"}
    rows = spark.readStream.format("topic_log").options(**options).load().select(F.col("key").cast("string").alias("board"), F.col("timestamp").alias("changed_at"))
    # the partitions of the topic are read at one pace, by counts, so that they drift apart by some days at most
    counted = counters.sliding_counters(rows, ["board"], width="24 hours", step="6 hours", delay="60 days")
    kept = jobs.BucketTable(f"{folder}/counts", ["board", "start"], spark.createDataFrame([], "board string, start timestamp, end timestamp, n long"), buckets=4)
    out = counted.writeStream.outputMode("update").foreachBatch(jobs.merge_latest(kept, ["n"])).option("checkpointLocation", f"{folder}/checkpoint")
    running = out.start()
    running.processAllAvailable()
    running.stop()
    return kept.read(spark)


_FETCHES = "SELECT event_type AS site, event_id AS seq, user_id % 4 <> 0 AS failed FROM {events}"


@query(f"""WITH f AS ({_FETCHES.format(events="events")}), g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY site ORDER BY seq) - CASE WHEN failed THEN 0 ELSE 1 END AS k FROM f),
n AS (SELECT *, count(*) FILTER (WHERE failed) OVER (PARTITION BY site, k ORDER BY seq) AS c FROM g)
SELECT site, seq, CASE WHEN failed THEN 'unreachable' ELSE 'recovered' END AS change, c AS failures FROM n WHERE CASE WHEN failed THEN c = 5 ELSE c >= 5 END""")
def fetch_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where five fetches of a site have failed in a row, and where a success ends such a streak."""
    return fetches.streaks(spark.sql(_FETCHES, events=driver_table(spark, sf_dir, "events")), 5)
