"""Windows over the comment stream, merges of snapshots, and rules of the stream jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import heat, latest, merge, windows
from tidewatch.plans.common import BETWEEN_SQL, COMMENTS_SQL, POSTS_SQL, between, comments, posts, query
from tidewatch.sources.tables import duckdb_ctes, table

_COUNTS_SQL = duckdb_ctes("comments_cdc") + """
, counts AS (SELECT board, epoch_us(changed_at) // 3600000000 AS bucket, count(*) AS n FROM comments_cdc WHERE op = 'c' AND coalesce(deleted, 'false') <> 'true' GROUP BY ALL)
, grid AS (SELECT b.board, b.bucket, coalesce(c.n, 0) AS n FROM (SELECT board, unnest(range(min(bucket), max(bucket) + 1)) AS bucket FROM counts GROUP BY board) b LEFT JOIN counts c USING (board, bucket))
"""  # fmt: skip


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "comments_cdc").where((F.col("op") == "c") & (F.coalesce("deleted", F.lit("false")) != "true"))
    return windows.bucket_counts(new, ["board"], F.col("changed_at"), 3600)


@query(_COUNTS_SQL + "SELECT board, bucket, n, sum(n) OVER (PARTITION BY board ORDER BY bucket RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)::BIGINT AS total FROM counts")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding(hourly(spark, sf_dir), ["board"], 6)


@query(_COUNTS_SQL + "SELECT board, bucket, n FROM grid")
def gap_filled_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.grid(hourly(spark, sf_dir), ["board"], 1440)


_EWMA_SQL = _COUNTS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """
, series AS (SELECT board, bucket, n, row_number() OVER (PARTITION BY board ORDER BY bucket) AS i FROM grid)
, fold AS (SELECT board, bucket, i, n::DOUBLE AS x, n::DOUBLE AS m, (n * n)::DOUBLE AS s, NULL::DOUBLE AS z FROM series WHERE i = 1
  UNION ALL SELECT f.board, t.bucket, t.i, t.n, f.m * (1 - 0.05::DOUBLE) + t.n * 0.05::DOUBLE, f.s * (1 - 0.05::DOUBLE) + t.n::DOUBLE * t.n * 0.05::DOUBLE,
    (t.n - f.m) / greatest(sqrt(greatest(f.s - f.m * f.m, 0)), 1) FROM fold f JOIN series t ON t.board = f.board AND t.i = f.i + 1)
"""  # fmt: skip


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.ewma(windows.grid(hourly(spark, sf_dir), ["board"], 1440), ["board"], "n", 0.05, 1.0)


@query(_EWMA_SQL + "SELECT board, bucket, m AS mean, greatest(s - m * m, 0) AS var FROM fold")
def ewma_board_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines(spark, sf_dir).select("board", "bucket", "mean", "var")


@query(_EWMA_SQL + "SELECT board, bucket, x, z FROM fold WHERE i > 60 AND z >= 1.5")
def zscore_board_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours after a warm-up whose count stands out by the baseline before them."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("board").orderBy("bucket"))
    return baselines(spark, sf_dir).withColumn("i", i).where("i > 60 AND z >= 1.5").select("board", "bucket", "x", "z")


#: Thresholds for the driver's thin stream; the defaults suit a busy one.
HEAT = heat.SurgeRules(window=120, longest_delay=120, least_board=4, least_post=2, least_z=1.5, quiet=240, warmup=240)


@query()
def heat_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the whole stream; the fold is sequential by board, so SQL can't express it."""
    return heat.alerts(heat.detect(table(spark, sf_dir, "comments_cdc"), HEAT), HEAT)


_SNAP_SQL = duckdb_ctes("posts_cdc", "snapshots", "comments_cdc") + COMMENTS_SQL + POSTS_SQL + """
, snap AS (SELECT *, max_floor AS comment_count FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY crawled_at DESC) AS r FROM snapshots) WHERE r = 1)
, both_ AS (SELECT coalesce(p.post_id, s.post_id) AS post_id, p.post_id IS NOT NULL AS has_p, s.post_id IS NOT NULL AS has_s,
    p.board AS p_board, s.board AS s_board, p.author AS p_author, s.author AS s_author, p.title AS p_title, s.title AS s_title, p.content AS p_content, s.content AS s_content,
    p.url AS p_url, s.url AS s_url, p.push_count AS p_push, s.push_count AS s_push, p.boo_count AS p_boo, s.boo_count AS s_boo, p.comment_count AS p_n, s.comment_count AS s_n,
    p.created_at AS p_created, s.created_at AS s_created, p.crawled_at AS p_crawled, s.crawled_at AS s_crawled, p.is_deleted AS p_del, s.is_deleted AS s_del
  FROM posts p FULL JOIN snap s ON s.post_id = p.post_id)
, acted AS (SELECT *, CASE WHEN NOT has_p THEN CASE WHEN s_del THEN 'none' ELSE 'insert' END
    WHEN has_s AND p_crawled < s_crawled AND NOT s_del AND (p_del OR p_title IS DISTINCT FROM s_title OR p_content IS DISTINCT FROM s_content OR p_push IS DISTINCT FROM s_push
      OR p_boo IS DISTINCT FROM s_boo OR p_n IS DISTINCT FROM s_n) THEN 'update'
    WHEN has_s AND p_crawled < s_crawled AND s_del AND NOT p_del THEN 'delete' ELSE 'keep' END AS action FROM both_)
, merged AS (SELECT post_id, CASE WHEN action = 'insert' THEN s_board ELSE p_board END AS board, CASE WHEN action = 'insert' THEN s_author ELSE p_author END AS author,
    CASE WHEN action IN ('insert', 'update') THEN s_title ELSE p_title END AS title, CASE WHEN action IN ('insert', 'update') THEN s_content ELSE p_content END AS content,
    CASE WHEN action = 'insert' THEN s_url ELSE p_url END AS url, CASE WHEN action IN ('insert', 'update') THEN s_push ELSE p_push END AS push_count,
    CASE WHEN action IN ('insert', 'update') THEN s_boo ELSE p_boo END AS boo_count, CASE WHEN action IN ('insert', 'update') THEN s_n ELSE p_n END AS comment_count,
    CASE WHEN action = 'insert' THEN s_created ELSE p_created END AS created_at, CASE WHEN action = 'keep' THEN p_crawled ELSE s_crawled END AS crawled_at,
    CASE WHEN action IN ('insert', 'update') THEN false WHEN action = 'delete' THEN true ELSE p_del END AS is_deleted, action FROM acted WHERE action <> 'none')
, targets AS (SELECT s.* FROM snap s JOIN merged m ON m.post_id = s.post_id WHERE NOT s.is_deleted AND m.crawled_at <= s.crawled_at)
, fresh AS (SELECT post_id, unnest(range(1, max_floor + 1))::INT AS floor FROM snap)
, old AS (SELECT post_id, floor, type, author, content, commented_at FROM comments WHERE NOT is_deleted)
, synced AS (SELECT coalesce(o.post_id, f.post_id) AS post_id, coalesce(o.floor, f.floor) AS floor,
    CASE WHEN o.post_id IS NULL THEN 'insert' WHEN t.post_id IS NOT NULL AND o.floor > t.max_floor THEN 'delete'
      WHEN f.post_id IS NOT NULL AND (o.type IS DISTINCT FROM 'push' OR o.author IS DISTINCT FROM 'snap' OR o.content IS DISTINCT FROM 'c' || o.floor OR o.commented_at IS NOT NULL) THEN 'update' ELSE 'keep' END AS action
  FROM old o FULL JOIN (SELECT f.* FROM fresh f JOIN targets t USING (post_id)) f ON f.post_id = o.post_id AND f.floor = o.floor
  LEFT JOIN targets t ON t.post_id = coalesce(o.post_id, f.post_id))
"""  # fmt: skip


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    snaps = merge.newest_snapshots(table(spark, sf_dir, "snapshots")).withColumn("comment_count", F.col("max_floor"))
    old = posts(spark, sf_dir).drop("lsn")
    return merge.merge_posts(old, snaps.select(*old.columns)), snaps


def _synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged, snaps = _merged(spark, sf_dir)
    targets = merge.sync_targets(merged, snaps)
    fresh = snaps.where("max_floor > 0").select("post_id", F.explode(F.sequence(F.lit(1), F.col("max_floor"))).alias("floor")).select(
        "post_id", "floor", F.lit("push").alias("type"), F.lit("snap").alias("author"),
        F.concat(F.lit("c"), F.col("floor").cast("string")).alias("content"), F.lit(None).cast("timestamp").alias("commented_at"),
    )
    old = latest.live(comments(spark, sf_dir)).select("post_id", "floor", "type", "author", "content", "commented_at")
    return merge.sync_comments(old, targets.select("post_id", "max_floor"), fresh)


@query(_SNAP_SQL + "SELECT * FROM merged")
def merge_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0]


@query(_SNAP_SQL + "SELECT post_id, crawled_at FROM merged WHERE action = 'delete'")
def merge_mark_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0].where("action = 'delete'").select("post_id", "crawled_at")


@query(_SNAP_SQL + "SELECT post_id, floor, action FROM synced")
def merge_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir).select("post_id", "floor", "action")


@query(_SNAP_SQL + """
SELECT 'post' AS kind, post_id, 0 AS floor, CASE action WHEN 'insert' THEN 'c' ELSE 'u' END AS op FROM merged WHERE action <> 'keep'
UNION ALL SELECT 'comment', post_id, floor, CASE action WHEN 'insert' THEN 'c' WHEN 'delete' THEN 'd' ELSE 'u' END FROM synced WHERE action <> 'keep'""")
def merge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change rows of a merge. A post marked deleted is an update of its row."""
    moved = _merged(spark, sf_dir)[0].withColumn("action", F.when(F.col("action") == "delete", "update").otherwise(F.col("action")))
    p = merge.change_rows(moved, ["post_id"]).select(F.lit("post").alias("kind"), "post_id", F.lit(0).alias("floor"), "op")
    c = merge.change_rows(_synced(spark, sf_dir), ["post_id", "floor"]).select(F.lit("comment").alias("kind"), "post_id", "floor", "op")
    return p.unionByName(c)


@query(_SNAP_SQL + "SELECT count(*) FILTER (WHERE action = 'insert') AS inserted, count(*) FILTER (WHERE action = 'update') AS updated, count(*) FILTER (WHERE action = 'delete') AS marked FROM merged")
def merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda a, name: F.count_if(F.col("action") == a).alias(name)
    return _merged(spark, sf_dir)[0].agg(n("insert", "inserted"), n("update", "updated"), n("delete", "marked"))


@query(duckdb_ctes("snapshots") + " SELECT post_id, crawled_at, title, is_deleted FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY crawled_at DESC) AS r FROM snapshots) WHERE r = 1")
def batch_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.newest_snapshots(table(spark, sf_dir, "snapshots")).select("post_id", "crawled_at", "title", "is_deleted")


_COLLAPSE_SQL = duckdb_ctes("post_events") + """
, last AS (SELECT batch, post_id, arg_max(text_hash, seq) AS text_hash, bool_or(op = 'c') AS created FROM post_events GROUP BY ALL)
"""  # fmt: skip


def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By batch and post the last text and whether the post was created in it."""
    return table(spark, sf_dir, "post_events").groupBy("batch", "post_id").agg(
        F.max_by("text_hash", "seq").alias("text_hash"), F.bool_or(F.col("op") == "c").alias("created")
    )


@query(_COLLAPSE_SQL + "SELECT * FROM last")
def batch_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(spark, sf_dir)


@query(_COLLAPSE_SQL + """
SELECT batch, post_id, text_hash FROM (SELECT *, lag(text_hash) OVER (PARTITION BY post_id ORDER BY batch) AS known FROM last) WHERE known IS DISTINCT FROM text_hash""")
def hash_dedupe_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches in which a post's text has to be inferred: it is new or differs from what was inferred last."""
    from pyspark.sql import Window

    known = F.lag("text_hash").over(Window.partitionBy("post_id").orderBy("batch"))
    return collapsed(spark, sf_dir).where("true").withColumn("known", known).where(~F.col("known").eqNullSafe(F.col("text_hash"))).select("batch", "post_id", "text_hash")


_BACKFILL_SQL = duckdb_ctes("posts_cdc", "predictions") + POSTS_SQL + """
SELECT q.post_id, sha256(coalesce(p.title, '') || chr(10) || coalesce(p.content, '')) AS text_hash FROM
 (SELECT post_id FROM (SELECT post_id, arg_max(text_hash, struct_pack(a := predicted_at, b := model_version)) AS h FROM predictions GROUP BY 1) WHERE h = '') q
 JOIN posts p ON p.post_id = q.post_id WHERE NOT p.is_deleted"""


@query(_BACKFILL_SQL)
def missing_hash_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes for posts whose newest prediction has none, of the text as it is now."""
    newest = table(spark, sf_dir, "predictions").groupBy("post_id").agg(F.max_by("text_hash", F.struct("predicted_at", "model_version")).alias("h"))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")))
    live = posts(spark, sf_dir).where(~F.col("is_deleted")).select("post_id", F.sha2(text, 256).alias("text_hash"))
    return newest.where("h = ''").select("post_id").join(live, "post_id")


@query(duckdb_ctes("predictions", "posts_cdc") + POSTS_SQL + """
SELECT post_id, model_version, predicted_at, CASE WHEN q.text_hash = '' THEN coalesce(sha256(p.title || chr(10) || p.content), '') ELSE q.text_hash END AS text_hash FROM predictions q LEFT JOIN posts p USING (post_id)""")
def backfill_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with empty hashes filled in; doing it twice changes nothing."""
    text = F.sha2(F.concat("title", F.lit("\n"), "content"), 256)
    filled = table(spark, sf_dir, "predictions").join(posts(spark, sf_dir).select("post_id", text.alias("new")), "post_id", "left")
    return filled.select("post_id", "model_version", "predicted_at", F.coalesce(F.nullif("text_hash", F.lit("")), "new", F.lit("")).alias("text_hash"))


@query("""SELECT event_id, event_type, greatest(coalesce(epoch_us(ts) - max(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY event_id % 1000, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) / 2000000.0::DOUBLE AS delay_s FROM events""")
def replay_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits that replay a shuffled recording at double speed."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withColumn("o", F.struct(F.col("event_id") % 1000, "event_id"))
    return windows.replay_delays(events, ["event_type"], "ts", "o", 2.0).select("event_id", "event_type", "delay_s")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id, CAST(value AS INT) ORDER BY event_id) - 1 AS occurrence FROM events")
def occurrence_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("v", F.rint("value").cast("int"))
    return windows.numbered(events, ["event_type", "user_id", "v"], "event_id").select("event_id", F.col("occurrence").cast("long").alias("occurrence"))


@query(duckdb_ctes("comments_cdc") + " SELECT DISTINCT post_id FROM (SELECT post_id, epoch_us(lead(changed_at, 3) OVER (PARTITION BY post_id ORDER BY changed_at, lsn)) - epoch_us(changed_at) AS d FROM comments_cdc) WHERE d < 86400000000")
def burst_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with four comments within a day."""
    return windows.bursts(table(spark, sf_dir, "comments_cdc"), ["post_id"], "changed_at", 4, 86_400)


@query(duckdb_ctes("post_events") + " SELECT post_id, max(seq) AS last_seen FROM post_events GROUP BY post_id ORDER BY last_seen DESC LIMIT 200")
def lru_cache_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of 200 least recently used posts holds at the end."""
    return table(spark, sf_dir, "post_events").groupBy("post_id").agg(F.max("seq").alias("last_seen")).orderBy(F.desc("last_seen")).limit(200)


@query(duckdb_ctes("predictions") + """
, batches AS (SELECT model_version, date_trunc('hour', predicted_at) AS hour, count(*) AS n FROM predictions GROUP BY ALL)
, gaps AS (SELECT model_version, n, epoch(hour - lag(hour) OVER (PARTITION BY model_version ORDER BY hour)) AS gap FROM batches)
SELECT model_version, quantile_disc(gap, 0.5) AS p50, max(gap) AS longest, count(gap) AS n FROM gaps WHERE n >= 2 AND gap IS NOT NULL GROUP BY model_version""")
def batch_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds between a model's batches, over batches of some size."""
    from pyspark.sql import Window

    made = table(spark, sf_dir, "predictions").groupBy("model_version", F.date_trunc("hour", "predicted_at").alias("at")).agg(F.count("*").alias("n"))
    gap = F.unix_seconds("at") - F.lag(F.unix_seconds("at")).over(Window.partitionBy("model_version").orderBy("at"))
    gaps = made.withColumn("gap", gap.cast("double")).where("n >= 2 AND gap IS NOT NULL")
    return gaps.groupBy("model_version").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gap)").alias("p50"), F.max("gap").alias("longest"), F.count("*").alias("n"))


@query(duckdb_ctes("comments_cdc") + f" SELECT post_id, floor, lsn FROM comments_cdc WHERE changed_at {BETWEEN_SQL}")
def recorded_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording of the stream between two moments, both included."""
    return table(spark, sf_dir, "comments_cdc").where(between("changed_at")).select("post_id", "floor", "lsn")
