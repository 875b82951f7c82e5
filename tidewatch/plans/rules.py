"""Parsing, validation, pairing and watchdog rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import expressions as X
from tidewatch.functions.parsing import parse_pages
from tidewatch.operators import textmodel, windows
from tidewatch.plans.common import POSTS_SQL, posts, query
from tidewatch.sources.tables import SITE, duckdb_ctes, table


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FEED_SQL = duckdb_ctes("comments_cdc") + """
, early AS (SELECT post_id, floor, lsn, changed_at FROM comments_cdc WHERE lsn % 3 = 0), late AS (SELECT post_id, floor, lsn, changed_at FROM comments_cdc WHERE lsn % 3 = 1)
, e AS (SELECT *, row_number() OVER (PARTITION BY post_id, floor ORDER BY lsn) - 1 AS i FROM early), l AS (SELECT *, row_number() OVER (PARTITION BY post_id, floor ORDER BY lsn) - 1 AS i FROM late)
, paired AS (SELECT e.post_id, e.floor, e.i, e.changed_at AS a, l.changed_at AS b FROM e LEFT JOIN l USING (post_id, floor, i))
"""  # fmt: skip


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds of the same comments, paired by key and occurrence."""
    every = table(spark, sf_dir, "comments_cdc").select("post_id", "floor", "lsn", "changed_at")
    feed = lambda k, name: windows.numbered(every.where(F.col("lsn") % 3 == k), ["post_id", "floor"], "lsn", "i").select("post_id", "floor", "i", F.col("changed_at").alias(name))
    return feed(0, "a").join(feed(1, "b"), ["post_id", "floor", "i"], "left")


@query(_FEED_SQL + "SELECT count(*) AS n, count(b) AS matched, 1 - count(b) / count(*) AS unmatched_ratio FROM paired")
def feed_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(spark, sf_dir).agg(F.count("*").alias("n"), F.count("b").alias("matched"), (1 - F.try_divide(F.count("b"), F.count("*"))).alias("unmatched_ratio"))


@query(_FEED_SQL + "SELECT post_id, floor, i, u, greatest(u - 60, 0) AS l, u - 30 AS e FROM (SELECT *, (epoch_us(b) - epoch_us(date_trunc('minute', a))) / 1e6 AS u FROM paired WHERE b IS NOT NULL)")
def delay_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper, lower and middle estimates of a delay of which only the minute is known."""
    u = (F.unix_micros("b") - F.unix_micros(F.date_trunc("minute", "a"))) / 1e6
    told = paired(spark, sf_dir).where("b IS NOT NULL").withColumn("u", u)
    return told.select("post_id", "floor", F.col("i").cast("long").alias("i"), "u", F.greatest(F.col("u") - 60, F.lit(0.0)).alias("l"), (F.col("u") - 30).alias("e"))


@query(_FEED_SQL + "SELECT floor % 3 AS phase, count(*) AS n, count(DISTINCT post_id) AS posts FROM paired WHERE b IS NOT NULL GROUP BY 1")
def phase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = paired(spark, sf_dir).where("b IS NOT NULL")
    return matched.groupBy((F.col("floor") % 3).alias("phase")).agg(F.count("*").alias("n"), F.countDistinct("post_id").alias("posts"))


@query(duckdb_ctes("alerts") + """
, hourly AS (SELECT DISTINCT unit_key, date_trunc('day', created_at) AS day FROM alerts), days AS (SELECT DISTINCT day FROM hourly)
, keys AS (SELECT DISTINCT unit_key FROM hourly), state AS (SELECT k.unit_key, d.day, h.unit_key IS NOT NULL AS raised FROM keys k CROSS JOIN days d LEFT JOIN hourly h ON h.unit_key = k.unit_key AND h.day = d.day)
SELECT unit_key, day, raised FROM (SELECT *, lag(raised, 1, false) OVER (PARTITION BY unit_key ORDER BY day) AS b FROM state) WHERE b <> raised""")
def alert_state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a unit's alert is raised or cleared: what is raised now less what was, and back.

    A unit's raised days are a set; a day follows another if no check day lies between.
    """
    raised = table(spark, sf_dir, "alerts").select("unit_key", F.date_trunc("day", "created_at").alias("day")).distinct()
    from pyspark.sql import Window

    # check days are numbered, so that runs of a unit's days show as equal differences
    days = raised.select("day").distinct().withColumn("k", F.dense_rank().over(Window.orderBy("day")))
    w = Window.partitionBy("unit_key").orderBy("k")
    known = raised.join(F.broadcast(days), "day").withColumn("before", F.lag("k").over(w)).withColumn("after", F.lead("k").over(w))
    starts = known.where("before IS NULL OR before < k - 1").select("unit_key", "k", F.lit(True).alias("raised"))
    ends = known.where("after IS NULL OR after > k + 1").select("unit_key", (F.col("k") + 1).alias("k"), F.lit(False).alias("raised"))
    return starts.unionAll(ends).join(F.broadcast(days), "k").select("unit_key", "day", "raised")


@query(duckdb_ctes("comments_cdc") + """
, gaps AS (SELECT board, lsn, changed_at, epoch_us(changed_at) - epoch_us(lag(changed_at) OVER (PARTITION BY board ORDER BY lsn)) > 5400000000 AS stale FROM comments_cdc)
SELECT board, lsn, stale FROM (SELECT *, coalesce(stale, false) AS s, lag(coalesce(stale, false), 1, false) OVER (PARTITION BY board ORDER BY lsn) AS b FROM gaps) WHERE b <> s""")
def freshness_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a board's stream turns stale, more than an hour and a half after the row before, and fresh again."""
    from pyspark.sql import Window

    before = F.lag(F.unix_micros("changed_at")).over(Window.partitionBy("board").orderBy("lsn"))
    stale = F.coalesce(F.unix_micros("changed_at") - before > 5_400_000_000, F.lit(False))
    seen = table(spark, sf_dir, "comments_cdc").select("board", "lsn", stale.alias("stale"))
    return windows.transitions(seen, ["board"], "lsn", "stale")


_TASK = "CASE WHEN event_id % 23 = 0 THEN 'FAILED' WHEN event_id % 31 = 0 THEN 'PAUSED' ELSE 'RUNNING' END"


@query(f"SELECT user_id, count(*) > 0 AND bool_and(s = 'RUNNING') AS running, bool_or(s = 'FAILED') AS failed FROM (SELECT user_id, {_TASK} AS s FROM events) GROUP BY user_id")
def connector_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A connector runs if all its tasks do and has failed if any has."""
    state = _read(spark, sf_dir, "events").select("user_id", F.expr(_TASK).alias("s"))
    return state.groupBy("user_id").agg(F.bool_and(F.col("s") == "RUNNING").alias("running"), F.bool_or(F.col("s") == "FAILED").alias("failed"))


_PUSH = "CASE event_id % 8 WHEN 0 THEN '' WHEN 1 THEN '爆' WHEN 2 THEN 'XX' WHEN 3 THEN 'X' || CAST(event_id % 10 AS VARCHAR(9)) WHEN 4 THEN ' ' || CAST(event_id % 97 AS VARCHAR(9)) || ' ' WHEN 5 THEN '?' WHEN 6 THEN '1.5' ELSE CAST(event_id % 50 AS VARCHAR(9)) END"


@query(f"""SELECT event_id, CASE WHEN t = '' THEN 0 WHEN regexp_full_match(t, '[0-9]+') THEN t::INT WHEN t = '爆' THEN 100 WHEN t = 'XX' THEN -100
  WHEN regexp_full_match(t, 'X[0-9]') THEN -10 * substr(t, 2)::INT END AS list_push FROM (SELECT event_id, trim({_PUSH}) AS t FROM events)""")
def list_push_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", X.list_push(F.expr(_PUSH)).alias("list_push"))


@query("""SELECT event_id, make_timestamp(2024, CASE WHEN event_id % 40 = 0 THEN NULL ELSE month(t) END, day(t), hour(t), minute(t), second(t)) - INTERVAL '8 hours' AS at FROM (SELECT event_id, date_trunc('second', ts) AS t FROM events)""")
def article_time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written without a locale, some of them with a month that there isn't."""
    shown = F.date_format(F.col("ts").cast("timestamp"), "EEE MMM d HH:mm:ss yyyy")
    broken = F.when(F.col("event_id") % 40 == 0, F.regexp_replace(shown, "^(...) ...", "$1 Abc")).otherwise(shown)
    return _read(spark, sf_dir, "events").select("event_id", X.article_time(broken).alias("at"))


@query("""SELECT event_id, make_timestamp(CASE WHEN month(said) < month(posted) THEN year(posted) + 1 ELSE year(posted) END, month(said), day(said), hour(said), minute(said), 0) - INTERVAL '8 hours' AS at
FROM (SELECT event_id, ts + INTERVAL '8 hours' - to_days(CAST(event_id % 90 AS INT)) AS posted, ts AS said FROM events)""")
def comment_time_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment times without a year, placed by the time of their post."""
    ts = F.col("ts").cast("timestamp")
    posted = F.timestamp_micros(F.unix_micros(ts) - (F.col("event_id") % 90) * 86_400_000_000)
    text = F.concat(F.lit("203.0.113.9 "), F.date_format(ts, "MM/dd HH:mm"))
    return _read(spark, sf_dir, "events").select("event_id", X.comment_time(text, posted).alias("at"))


_RISKY = "CASE event_id % 6 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN 'a=' ELSE '' END || event_type"


@query(f"SELECT event_id, CASE WHEN substr(t, 1, 1) IN ('=', '+', '-', '@') THEN '''' || t ELSE t END AS cell FROM (SELECT event_id, {_RISKY} AS t FROM events)")
def csv_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", X.csv_safe(F.expr(_RISKY)).alias("cell"))


@query(duckdb_ctes("posts_cdc") + POSTS_SQL + f"SELECT post_id, CASE WHEN starts_with(url, '{SITE}') THEN url ELSE '' END AS url FROM posts")
def url_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).select("post_id", X.allowed_url(F.col("url"), SITE).alias("url"))


@query(duckdb_ctes("posts_cdc") + POSTS_SQL + "SELECT post_id, trim(trim(coalesce(title, '')) || chr(10) || substr(trim(coalesce(content, '')), 1, 6), ' ' || chr(10)) AS text, sha256(coalesce(title, '')) AS title_hash FROM posts")
def post_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the models read of a post, and a digest."""
    text = X.post_text(F.col("title"), F.col("content"), 6)
    return posts(spark, sf_dir).select("post_id", text.alias("text"), F.sha2(F.coalesce("title", F.lit("")), 256).alias("title_hash"))


@query("SELECT page_id, base64(encode(url)) AS payload, url AS back FROM pages")
def recording_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as a recording keeps them, and decoded again."""
    payload = X.base64(F.encode("url", "UTF-8"))
    return _read(spark, sf_dir, "pages").select("page_id", payload.alias("payload"), F.decode(F.unbase64(payload), "UTF-8").alias("back"))


_UUID_SQL = """SELECT event_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' ||
  CASE ('0x' || substr(d, 17, 1))::INT % 4 WHEN 0 THEN '8' WHEN 1 THEN '9' WHEN 2 THEN 'a' ELSE 'b' END || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS id
FROM (SELECT event_id, sha1(unhex('6f1f0b8e6c554c1e9a432d7f1b0c9a51') || encode('post|' || event_type || event_id)) AS d FROM events)"""


@query(_UUID_SQL)
def alert_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based ids, so that an alert that is sent again has the same one."""
    from tidewatch.operators.heat import NAMESPACE

    name = F.concat(F.lit("post|"), "event_type", F.col("event_id").cast("string"))
    return _read(spark, sf_dir, "events").select("event_id", X.uuid5(NAMESPACE, name).alias("id"))


_BAD_SQL = """CASE WHEN NOT regexp_matches(post_id, '^[A-Za-z0-9_-]+\\.M\\.[0-9]+\\.A\\.[0-9A-F]{3}$') THEN 'post_id'
  WHEN floor < 1 THEN 'floor' WHEN type NOT IN ('push', 'boo', 'arrow') THEN 'type' WHEN commented_at IS NULL THEN 'time' WHEN op NOT IN ('c', 'u', 'd', 'r') THEN 'op' END"""


@query(duckdb_ctes("comments_cdc") + f" SELECT post_id, floor, lsn, {_BAD_SQL} AS rule FROM (SELECT * REPLACE (CASE WHEN lsn % 37 = 0 THEN 'bad id' ELSE post_id END AS post_id, CASE WHEN lsn % 41 = 0 THEN 0 ELSE floor END AS floor) FROM comments_cdc) WHERE {_BAD_SQL} IS NOT NULL")
def dlq_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a rule, with the first one that they break; the others go on."""
    from tidewatch.streaming.jobs import broken_rule

    rows = table(spark, sf_dir, "comments_cdc").withColumns(
        {"post_id": F.when(F.col("lsn") % 37 == 0, "bad id").otherwise(F.col("post_id")), "floor": F.when(F.col("lsn") % 41 == 0, 0).otherwise(F.col("floor"))}
    )
    return rows.withColumn("rule", broken_rule()).where("rule IS NOT NULL").select("post_id", "floor", "lsn", "rule")


_TOPICS = "SELECT 'topic-' || CAST(n_nationkey AS VARCHAR(9)) AS name, n_nationkey % 4 + 1 AS partitions FROM {0} WHERE n_nationkey % 5 <> 0"
_EXISTING = "SELECT 'topic-' || CAST(n_nationkey AS VARCHAR(9)) AS name, n_nationkey % 3 + 1 AS had FROM {0} WHERE n_nationkey % 7 <> 0"


@query(f"SELECT name, CASE WHEN had IS NULL THEN 'create' WHEN partitions > had THEN 'grow' WHEN partitions < had THEN 'error' END AS change FROM ({_TOPICS.format('nation')}) LEFT JOIN ({_EXISTING.format('nation')}) USING (name) WHERE had IS NULL OR partitions <> had")
def topic_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to be done for topics to be as wished; fewer partitions than there are is an error."""
    nation = _read(spark, sf_dir, "nation")
    wished, there = spark.sql(_TOPICS.format("{n}"), n=nation), spark.sql(_EXISTING.format("{n}"), n=nation)
    change = F.when(F.col("had").isNull(), "create").when(F.col("partitions") > F.col("had"), "grow").when(F.col("partitions") < F.col("had"), "error")
    return wished.join(there, "name", "left").select("name", change.alias("change")).where("change IS NOT NULL")


@query(duckdb_ctes("comments_cdc") + " SELECT post_id, lsn FROM (SELECT post_id, lsn, floor % 4 AS n, lag(floor % 4) OVER (PARTITION BY post_id ORDER BY lsn) AS b FROM comments_cdc) WHERE b IS DISTINCT FROM n")
def fetch_if_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List entries whose count differs from the one seen before, which alone are fetched."""
    from pyspark.sql import Window

    before = F.lag(F.col("floor") % 4).over(Window.partitionBy("post_id").orderBy("lsn"))
    return table(spark, sf_dir, "comments_cdc").withColumn("b", before).where(~F.col("b").eqNullSafe(F.col("floor") % 4)).select("post_id", "lsn")


@query(duckdb_ctes("crawl_state", "posts_cdc") + POSTS_SQL + "SELECT c.post_id FROM crawl_state c WHERE NOT EXISTS (SELECT 1 FROM posts p WHERE p.post_id = c.post_id AND p.crawled_at > c.next_crawl_at)")
def pending_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose post wasn't fetched after they were sent."""
    tasks = table(spark, sf_dir, "crawl_state").alias("c")
    done = posts(spark, sf_dir).select(F.col("post_id").alias("p"), "crawled_at")
    return tasks.join(done, (F.col("post_id") == F.col("p")) & (F.col("crawled_at") > F.col("next_crawl_at")), "left_anti").select("post_id")


@query()
def page_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, headings, links and text of all pages; HTML can't be parsed in SQL."""
    return parse_pages(_read(spark, sf_dir, "pages"))


@query()
def tfidf_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline classifier over all documents, each scored by a model of the other half's labelled ones."""
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    known = _read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(label).alias("polarity"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id").join(known, "doc_id", "left")  # a file may be one part
    return textmodel.held_out(docs, "doc_id").select("doc_id", "polarity", "predicted", "scores")
