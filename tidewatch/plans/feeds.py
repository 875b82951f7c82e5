"""Messages of topics, checks of labels and examples, models by their figures, and reading back listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import stats
from tidewatch.operators import curation
from tidewatch.plans.common import ORACLE_SQL, POSTS_SQL, RANGE, as_of, at, moment, posts, query
from tidewatch.plans.compare import exported
from tidewatch.sources import topics
from tidewatch.sources.tables import driver_table, duckdb_ctes, table

# change rows as JSON, some of them cut, some empty
_MESSAGES = """SELECT 'comments' AS topic, CAST(lsn % 6 AS INT) AS partition, lsn AS "offset", changed_at AS "timestamp", post_id AS k,
  CASE WHEN lsn % 89 = 0 THEN NULL ELSE substr('{"post_id":"' || post_id || '","floor":' || CAST(floor AS VARCHAR(9)) || ',"author":"' || author || '","more":1,"lsn":' || CAST(lsn AS VARCHAR(20)) || '}', 1, CASE WHEN lsn % 97 = 0 THEN 30 ELSE 999 END) END AS v FROM {comments}"""
_MESSAGES_SQL = duckdb_ctes("comments_cdc") + ", messages AS (" + _MESSAGES.replace("{comments}", "comments_cdc") + ")"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change rows as a topic's messages."""
    # braces of the JSON aren't places for names
    sql = _MESSAGES.replace("{comments}", "@").replace("{", "{{").replace("}", "}}").replace("@", "{comments}").replace('"offset"', "`offset`").replace('"timestamp"', "`timestamp`")
    got = spark.sql(sql, comments=table(spark, sf_dir, "comments_cdc"))
    return got.withColumn("key", F.col("k").cast("binary")).withColumn("value", F.col("v").cast("binary")).drop("k", "v")


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.decode_json(messages(spark, sf_dir), "post_id string, floor int, author string, lsn long, content string")


@query(_MESSAGES_SQL + " SELECT post_id, floor, author, lsn, NULL::VARCHAR AS content FROM comments_cdc WHERE lsn % 89 <> 0 AND lsn % 97 <> 0")
def topic_change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read from a topic's JSON; fields that no column has are skipped, missing ones null."""
    return topics.good(decoded(spark, sf_dir))


@query(_MESSAGES_SQL + """ SELECT topic, "partition", "offset", CASE WHEN v IS NULL THEN 'tombstone' ELSE 'json' END AS error, to_base64(encode(k)) AS key_b64, to_base64(encode(v)) AS payload_b64
FROM messages WHERE v IS NULL OR "offset" % 97 = 0""")
def topic_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that can't be read, with where they lay and what they held."""
    return topics.dead_letters(decoded(spark, sf_dir))


@query(_MESSAGES_SQL + f""", begins AS (SELECT "partition", min("offset") AS b FROM messages WHERE "timestamp" >= TIMESTAMP '{RANGE[0]}' GROUP BY 1),
ends AS (SELECT m."partition", min(m."offset") AS e FROM messages m JOIN begins USING ("partition") WHERE m."offset" >= b AND m."timestamp" > TIMESTAMP '{RANGE[1]}' GROUP BY 1)
SELECT m."partition", m."offset" FROM messages m JOIN begins USING ("partition") LEFT JOIN ends USING ("partition") WHERE m."offset" >= b AND (e IS NULL OR m."offset" < e)""")
def topic_between_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording: by partition from the first message of a time to the first one past another."""
    return topics.between_times(messages(spark, sf_dir), at(RANGE[0]), at(RANGE[1])).select("partition", "offset")


@query("""SELECT 'events' AS topic, CAST(user_id AS VARCHAR) AS key, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","note":' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE '"n"' END || '}' AS value, (user_id % 12)::INT AS "partition" FROM events""")
def topic_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as keyed messages with partitions of their own, as a writer takes them."""
    events = driver_table(spark, sf_dir, "events")
    rows = events.select("event_id", "event_type", F.when(F.col("event_id") % 5 != 0, "n").alias("note"), "user_id")
    return topics.to_messages(rows, "events", F.col("user_id"), F.col("user_id") % 12, ["event_id", "event_type", "note"])


_LINES = "SELECT CAST(floor(event_id / 8.0) AS BIGINT) AS batch, event_id AS line, CAST(user_id % 60 AS VARCHAR(9)) AS post_id, CASE WHEN event_id % 43 = 0 THEN 'unsure' WHEN event_id % 2 = 0 THEN 'positive' ELSE 'neutral' END AS polarity FROM {events}"
_ALLOWED = "SELECT DISTINCT CAST(floor(event_id / 8.0) AS BIGINT) AS batch, CAST(user_id % 60 AS VARCHAR(9)) AS post_id FROM {events} WHERE user_id % 31 <> 0"
_CHECKED_SQL = f"""WITH lines AS ({_LINES.format(events='events')}), allowed AS ({_ALLOWED.format(events='events')}),
checked AS (SELECT batch, line, post_id, polarity, CASE WHEN NOT valid THEN 'class' WHEN NOT there THEN 'unknown' WHEN line > min(CASE WHEN valid AND there THEN line END) OVER (PARTITION BY batch, post_id) THEN 'twice' END AS error
  FROM (SELECT l.*, polarity <> 'unsure' AS valid, a.post_id IS NOT NULL AS there FROM lines l LEFT JOIN allowed a ON a.batch = l.batch AND a.post_id = l.post_id))
"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = driver_table(spark, sf_dir, "events")
    return curation.import_errors(spark.sql(_LINES, events=events), spark.sql(_ALLOWED, events=events), stats.CLASSES)


@query(_CHECKED_SQL + "SELECT batch, line, error FROM checked WHERE error IS NOT NULL")
def label_import_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of hand-made labels that can't be taken, and why."""
    return _checked(spark, sf_dir).where("error IS NOT NULL").select("batch", "line", "error")


@query(_CHECKED_SQL + "SELECT batch, line, post_id, polarity FROM checked WHERE batch NOT IN (SELECT batch FROM checked WHERE error IS NOT NULL)")
def label_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-made labels of batches in which no line is wrong."""
    return curation.import_whole(_checked(spark, sf_dir))


@query(duckdb_ctes("labels_log") + " SELECT post_id, arg_max(polarity, (labeled_at, version, coalesce(target, ''))) AS polarity FROM labels_log WHERE labeler = 'second' GROUP BY post_id")
def human_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last label of each post; annotators may change their minds."""
    log = table(spark, sf_dir, "labels_log").where("labeler = 'second'")
    return log.groupBy("post_id").agg(F.max_by("polarity", F.struct("labeled_at", "version", F.coalesce("target", F.lit("")).alias("t"))).alias("polarity"))


_QUOTAS = {"click": 3, "view": 1_000_000_000, "error": 20, "nowhere": 1}


@query(duckdb_ctes("posts_cdc") + POSTS_SQL + f"SELECT q.board, q.wanted::BIGINT AS wanted, count(p.post_id) AS found FROM (VALUES {', '.join(f'({b!r}, {n})' for b, n in _QUOTAS.items())}) q(board, wanted) LEFT JOIN posts p ON p.board = q.board GROUP BY 1, 2 HAVING count(p.post_id) < max(q.wanted)")
def unfilled_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas of a test set that the boards' posts can't fill."""
    return curation.quota_shortfalls(posts(spark, sf_dir), "board", _QUOTAS)


_EXPORTED_SQL = ORACLE_SQL["export_training_set"]


@query(f"""WITH e AS (SELECT * FROM ({_EXPORTED_SQL})), n AS (
  SELECT 'blank' AS fault, count(*) FILTER (WHERE trim(title) = '') AS n FROM e
  UNION ALL SELECT 'unknown', count(*) FILTER (WHERE polarity NOT IN ('positive', 'negative', 'neutral')) FROM e
  UNION ALL SELECT 'few ' || c, greatest(0, 5000000 - count(e.polarity)) FROM (VALUES ('positive'), ('negative'), ('neutral')) t(c) LEFT JOIN e ON e.polarity = c GROUP BY c)
SELECT fault, n FROM n WHERE n > 0""")
def example_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps the exported examples from being used for training, were five million a class needed."""
    return curation.example_faults(exported(spark, sf_dir).select(F.col("title").alias("text"), "polarity"), stats.CLASSES, 5_000_000)


_FIGURES = """SELECT event_type AS model, CASE WHEN user_id % 2 = 0 THEN 'exact' ELSE 'small' END AS kind, CAST(count(CASE WHEN event_id % 7 < 5 THEN 1 END) AS DOUBLE) / count(*) AS f1,
  CAST(max(user_id) % 40 AS DOUBLE) AS p50, CAST(max(user_id) % 70 AS DOUBLE) AS slowest, CAST(max(user_id) % 900 + 500 AS DOUBLE) AS memory_mb FROM {events} GROUP BY 1, 2"""
_PICKED_SQL = f"""WITH f AS ({_FIGURES.format(events='events')}), w AS (
  SELECT e.model, CASE WHEN e.f1 - s.f1 <= 0.02::DOUBLE AND s.p50 < e.p50 THEN 'small' ELSE 'exact' END AS kind FROM f e JOIN f s ON s.model = e.model AND s.kind = 'small' WHERE e.kind = 'exact'),
picked AS (SELECT f.* FROM f JOIN w ON w.model = f.model AND w.kind = f.kind)
"""


def _picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.pick_kinds(spark.sql(_FIGURES, events=driver_table(spark, sf_dir, "events")))


@query(_PICKED_SQL + "SELECT * FROM picked")
def model_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By model the small kind if it loses little and is faster."""
    return _picked(spark, sf_dir)


@query(_PICKED_SQL + "SELECT *, p50 < 30 AND slowest <= 60 AND memory_mb <= 1200 AS passes FROM picked ORDER BY (max(f1) OVER () - f1 < 0.01::DOUBLE AND model = 'view') DESC, f1 DESC, model LIMIT 1")
def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the models, a preferred one among those that are nearly as good, and whether it may run."""
    return curation.choose_model(_picked(spark, sf_dir), "view")


_BATCHES = "SELECT event_type, CAST(floor(event_id / 64.0) AS BIGINT) AS batch, max(value) AS seconds, count(*) AS posts FROM {events} GROUP BY 1, 2"


@query(f"""WITH b AS ({_BATCHES.format(events='events')}), t AS (SELECT *, seconds / posts * 1000 AS ms FROM (SELECT *, min(batch) OVER (PARTITION BY event_type) AS f FROM b) WHERE batch > f),
p AS (SELECT *, sum(posts) OVER (PARTITION BY event_type ORDER BY ms) AS upto, sum(posts) OVER (PARTITION BY event_type) AS n FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY seconds) AS r, count(*) OVER (PARTITION BY event_type) AS c FROM p)
SELECT event_type, count(*) AS batches, sum(posts)::BIGINT AS posts, min(seconds) FILTER (WHERE r >= ceil(c * 0.5)) AS batch_p50_s, max(seconds) AS batch_max_s,
  min(ms) FILTER (WHERE upto >= ceil(n * 0.5)) AS post_p50_ms, min(ms) FILTER (WHERE upto >= ceil(n * 0.95)) AS post_p95_ms FROM r GROUP BY event_type""")
def inference_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long batches and their posts took, without the first batch of each kind."""
    return curation.runtime_stats(spark.sql(_BATCHES, events=driver_table(spark, sf_dir, "events")), "event_type")


@query(duckdb_ctes("posts_cdc") + POSTS_SQL + """
, s AS (SELECT board, created_at, row_number() OVER (PARTITION BY board ORDER BY created_at DESC, post_id) AS r FROM posts),
g AS (SELECT board, ceil(r / 20)::BIGINT AS page, min(created_at) AS oldest FROM s WHERE r <= 1601 GROUP BY 1, 2),
e AS (SELECT *, coalesce(min(CASE WHEN oldest <= (SELECT max(ts) FROM events) - INTERVAL '25 days' THEN page END) OVER (PARTITION BY board), max(page) OVER (PARTITION BY board)) AS last FROM g),
t AS (SELECT board, ceil(page / 3)::BIGINT AS task, last, min(page) AS first_page, max(page) AS last_page, min(oldest) AS oldest FROM e WHERE page <= last AND page <= 80 GROUP BY 1, 2, 3)
SELECT board, task, first_page, last_page, oldest, CASE WHEN last_page = last THEN false WHEN last_page < 80 THEN true END AS goes_on FROM t""")
def backfill_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that read listings back over 25 days: three pages each, eighty a board at most."""
    from datetime import timedelta

    return curation.backfill_tasks(posts(spark, sf_dir), moment(as_of(spark, sf_dir), timedelta(days=25)))


@query(duckdb_ctes("labels_log") + " SELECT post_id, labeled_at, regexp_replace(labeler || '/' || version || ' x', '[^a-zA-Z0-9.-]', '-', 'g') || '-' || version || '-' || strftime(labeled_at, '%Y%m%d%H%M') AS name FROM labels_log WHERE target IS NULL")
def dataset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of exports; what isn't a letter, digit, dot or dash becomes a dash."""
    log = table(spark, sf_dir, "labels_log").where("target IS NULL")
    safe = F.regexp_replace(F.concat("labeler", F.lit("/"), "version", F.lit(" x")), r"[^\p{L}\p{N}.-]", "-")
    return log.select("post_id", "labeled_at", F.concat_ws("-", safe, "version", F.date_format("labeled_at", "yyyyMMddHHmm")).alias("name"))


@query("""SELECT '{"event_type":"' || event_type || '","n":' || count(*) || ',"most":' || max(event_id) || '}' AS line FROM events WHERE event_id >= 100 AND event_type <> 'error' GROUP BY event_type""")
def rows_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query with typed parameters, its rows as JSON lines."""
    sql = "SELECT event_type, count(*) AS n, max(event_id) AS most FROM {events} WHERE event_id >= :least AND event_type <> :without GROUP BY event_type"
    return curation.rows_as_json(spark, sql, {"least": 100, "without": "error"}, events=driver_table(spark, sf_dir, "events"))
