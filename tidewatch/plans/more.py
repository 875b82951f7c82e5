"""Commands, messages that go out once, forum pages, and readings of loosely written values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import expressions as X
from tidewatch.functions import parsing
from tidewatch.operators import commands
from tidewatch.plans import chat
from tidewatch.plans.common import COMMENTS_SQL, ORACLE_SQL, POSTS_SQL, comments, posts, query
from tidewatch.sources.tables import SITE, driver_table, duckdb_ctes, table


@query("""
SELECT event_id, CASE WHEN first <= seen + INTERVAL '1 day' THEN first WHEN later AND same <= seen + INTERVAL '1 day' THEN same END AS at FROM (
  SELECT event_id, seen, month(said) < month(posted) AS later,
    make_timestamp(year(posted) + (month(said) < month(posted))::INT, month(said), day(said), hour(said), minute(said), 0) - INTERVAL '8 hours' AS first,
    make_timestamp(year(posted), month(said), day(said), hour(said), minute(said), 0) - INTERVAL '8 hours' AS same
  FROM (SELECT event_id, ts AS said, ts + INTERVAL '8 hours' + to_days(CAST(event_id % 60 AS INT)) AS posted, ts + to_days(CAST(event_id % 3 AS INT)) - INTERVAL '1 day' AS seen FROM events))""")
def comment_time_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment times without a year, none of them in the future of when they were seen."""
    ts = F.col("ts").cast("timestamp")
    shift = lambda days: F.timestamp_micros(F.unix_micros(ts) + days * 86_400_000_000)
    text = F.date_format(ts, "MM/dd HH:mm")
    at = X.comment_time(text, shift(F.col("event_id") % 60), shift(F.col("event_id") % 3 - 1))
    return driver_table(spark, sf_dir, "events").select("event_id", at.alias("at"))


@query(f"SELECT alert_id, chat_id FROM (SELECT DISTINCT * FROM ({ORACLE_SQL['recipients']})) WHERE NOT (chat_id % 4 = 0 AND alert_id < '8')")
def alert_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of all alerts; what chats divisible by four were sent before is left out."""
    told = chat.recipients(spark, sf_dir)
    sent = told.where("chat_id % 4 = 0 AND alert_id < '8'")
    return commands.fan_out(table(spark, sf_dir, "alerts"), told, sent)


_COMMANDS = """SELECT user_id % 40 AS chat_id, CASE WHEN event_id % 41 = 0 THEN NULL ELSE event_type END AS unit_key,
  CASE WHEN event_id % 41 = 0 THEN 'forget' WHEN event_id % 5 = 0 THEN 'unsubscribe' WHEN event_id % 3 = 0 THEN 'toggle' ELSE 'subscribe' END AS command, event_id AS seq FROM {events}"""


@query(f"""WITH log AS ({_COMMANDS.format(events='events')}),
own AS (SELECT l.* FROM log l LEFT JOIN (SELECT chat_id, max(seq) AS w FROM log WHERE command = 'forget' GROUP BY 1) f ON f.chat_id = l.chat_id
  WHERE l.command <> 'forget' AND (f.w IS NULL OR l.seq > f.w)),
last AS (SELECT o.chat_id, o.unit_key, max(o.seq) FILTER (WHERE command <> 'toggle') AS at FROM own o GROUP BY 1, 2)
SELECT chat_id, unit_key FROM (
  SELECT l.chat_id, l.unit_key, count(*) FILTER (WHERE o.command = 'toggle' AND o.seq > coalesce(l.at, -1)) + count(*) FILTER (WHERE o.command = 'subscribe' AND o.seq = l.at) AS n
  FROM last l JOIN own o ON o.chat_id = l.chat_id AND o.unit_key = l.unit_key GROUP BY 1, 2) WHERE n % 2 = 1""")
def subscription_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is subscribed to what after all commands."""
    return commands.subscribed(spark.sql(_COMMANDS, events=driver_table(spark, sf_dir, "events")))


_MUTES = """SELECT user_id % 40 AS chat_id, CAST(event_id % 23 AS VARCHAR(20)) AS post_id,
  CASE WHEN event_id % 4 = 1 THEN 'unmute' ELSE 'mute' END AS command, event_id AS seq, ts AS at FROM {events}"""


@query(f"""WITH log AS ({_MUTES.format(events='events')}),
gone AS (SELECT chat_id, post_id, max(seq) AS s FROM log WHERE command = 'unmute' GROUP BY 1, 2)
SELECT l.chat_id, l.post_id, arg_min(l.at, l.seq) AS muted_at FROM log l LEFT JOIN gone g ON g.chat_id = l.chat_id AND g.post_id = l.post_id
WHERE command = 'mute' AND (g.s IS NULL OR l.seq > g.s) GROUP BY 1, 2 HAVING arg_min(l.at, l.seq) >= (SELECT max(ts) FROM events) - INTERVAL '7 days'""")
def muted_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that chats muted, after all commands and the drop of what is a week older than the newest event."""
    events = driver_table(spark, sf_dir, "events")
    newest = events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] or 0
    log = spark.sql(_MUTES, events=events).withColumn("at", F.col("at").cast("timestamp"))
    return commands.purged(commands.muted(log), F.timestamp_micros(F.lit(newest - 7 * 86_400_000_000)))


_TOGGLES = "SELECT user_id % 40 AS chat_id, CASE WHEN event_id % 3 = 0 THEN 'post' ELSE 'board' END AS unit_type FROM {events} WHERE event_type = 'click'"


@query(f"""SELECT chat_id, count(*) FILTER (WHERE unit_type = 'post') % 2 = 0 AS post_alerts, count(*) FILTER (WHERE unit_type = 'board') % 2 = 0 AS board_alerts
FROM ({_TOGGLES.format(events='events')}) GROUP BY chat_id""")
def notification_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kinds of alerts chats left on."""
    return commands.preferences(spark.sql(_TOGGLES, events=driver_table(spark, sf_dir, "events")))


_REQUESTS = """SELECT event_id AS request_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'b' || CAST(user_id % 97 AS VARCHAR(20)) END AS board,
  CASE WHEN event_id % 3 = 0 THEN 'create' ELSE 'patch' END AS kind FROM {events} WHERE event_id % 10 < 5"""


@query(duckdb_ctes("boards") + f""", requests AS ({_REQUESTS.format(events='events')})
SELECT request_id, board, CASE kind WHEN 'create' THEN CASE WHEN there THEN 409 ELSE 201 END ELSE CASE WHEN there THEN 200 ELSE 404 END END AS status FROM (
  SELECT *, board IN (SELECT board FROM boards) OR coalesce(min(CASE WHEN kind = 'create' THEN request_id END) OVER (PARTITION BY board) < request_id, false) AS there FROM requests)""")
def board_request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests to create and change boards come to, one after the other."""
    requests = spark.sql(_REQUESTS, events=driver_table(spark, sf_dir, "events"))
    return commands.board_requests(requests, table(spark, sf_dir, "boards"))


_SCORE = "CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN '' WHEN 2 THEN '0.25' ELSE '1e-1' END"


@query(f"SELECT event_id, coalesce(TRY_CAST({_SCORE} AS DOUBLE), 0.5) AS least FROM events")
def score_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds that users wrote, one half where they aren't numbers."""
    return driver_table(spark, sf_dir, "events").select("event_id", X.number_or(F.expr(_SCORE), 0.5).alias("least"))


@query(duckdb_ctes("posts_cdc") + POSTS_SQL + f"SELECT post_id, '{SITE}bbs/' || board || '/index.html' AS board_url, '{SITE}bbs/' || board || '/' || post_id || '.html' AS post_url FROM posts")
def forum_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = F.concat(F.lit(f"{SITE}bbs/"), "board", F.lit("/"))
    return posts(spark, sf_dir).select("post_id", F.concat(board, F.lit("index.html")).alias("board_url"), F.concat(board, "post_id", F.lit(".html")).alias("post_url"))


@query("""SELECT doc_id, concat_ws('|', lang, substr(sha1(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f]+', ' ', 'g'), ' ')), 1, 16)) AS key FROM documents""")
def pairing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys under which whole texts of two feeds meet, white space made even."""
    return driver_table(spark, sf_dir, "documents").select("doc_id", X.pairing_key(F.col("lang"), F.col("text")).alias("key"))


_ISO_SQL = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+08:00' WHEN 2 THEN '' ELSE ' UTC' END"


@query(f"SELECT event_id, {_ISO_SQL} AS shown, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL '8 hours' END AS at FROM events")
def zoned_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants with an offset; those without one are refused."""
    tail = F.expr("CASE event_id % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+08:00' WHEN 2 THEN '' ELSE ' UTC' END")
    shown = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), tail)
    return driver_table(spark, sf_dir, "events").select("event_id", shown.alias("shown"), X.zoned_time(shown).alias("at"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 3 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS at FROM events""")
def written_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written in several ways, null where in none of them."""
    ts = F.col("ts").cast("timestamp")
    as_ = lambda form: F.date_format(ts, form)
    k = F.col("event_id") % 5
    shown = F.when(k == 0, as_("yyyy-MM-dd'T'HH:mm:ssXXX")).when(k == 1, as_("yyyy-MM-dd HH:mm:ss")).when(k == 2, as_("yyyy/MM/dd HH:mm:ss")).when(k == 3, as_("yyyy-MM-dd")).otherwise("soon")
    return driver_table(spark, sf_dir, "events").select("event_id", X.some_time(shown).alias("at"))


@query(duckdb_ctes("predictions") + " SELECT post_id, model_version, predicted_at, greatest(positive, negative, neutral) AS score FROM predictions")
def largest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest value of each prediction's map of scores."""
    scores = F.create_map(*[c for k in ("positive", "negative", "neutral") for c in (F.lit(k), F.col(k))])
    told = table(spark, sf_dir, "predictions").withColumn("scores", scores)
    return told.select("post_id", "model_version", "predicted_at", F.array_max(F.map_values("scores")).alias("score"))


@query(duckdb_ctes("posts_cdc") + POSTS_SQL + "SELECT DISTINCT board FROM posts ORDER BY board")
def board_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).select("board").distinct().orderBy("board")


@query(duckdb_ctes("posts_cdc", "labels_log") + POSTS_SQL + """
, firsts AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY md5(post_id), post_id) AS r FROM posts)
SELECT post_id, board, place FROM (SELECT post_id, board, row_number() OVER (PARTITION BY board ORDER BY r) AS place FROM firsts
  WHERE r <= 25 AND post_id NOT IN (SELECT post_id FROM labels_log WHERE labeler = 'second')) WHERE place <= 10""")
def sample_without_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten posts a board of the first 25 by hash, without those that the second labeller has."""
    told = table(spark, sf_dir, "labels_log").where("labeler = 'second'")
    found = commands.ranked_after_exclusion(posts(spark, sf_dir).withColumn("h", F.md5("post_id")), "board", ["h", "post_id"], 10, 15, told, "post_id")
    return found.select("post_id", "board", F.col("place").cast("long").alias("place"))


@query(duckdb_ctes("posts_cdc") + """
, started AS (SELECT board, max(changed_at) - INTERVAL '2 days' AS at FROM posts_cdc WHERE op = 'c' GROUP BY board)
SELECT p.post_id, p.version FROM posts_cdc p JOIN started s ON s.board = p.board WHERE p.created_at >= s.at""")
def fresh_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that aren't older than the last start of their board's listing."""
    tasks = table(spark, sf_dir, "posts_cdc")
    started = tasks.where("op = 'c'").groupBy("board").agg((F.max("changed_at") - F.expr("INTERVAL 2 DAYS")).alias("at"))
    # as many rows as boards
    return tasks.join(started, "board").where(F.col("created_at") >= F.col("at")).select("post_id", "version")


_MARKS = "CASE type WHEN 'push' THEN '推' WHEN 'boo' THEN '噓' ELSE '→' END"


@query(duckdb_ctes("comments_cdc") + COMMENTS_SQL + """
SELECT post_id, row_number() OVER (PARTITION BY post_id ORDER BY floor)::INT AS floor, type, author, content FROM comments WHERE NOT is_deleted""")
def forum_post_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments read back from pages in a forum's layout, numbered as they stand there."""
    shown = F.format_string(
        '<div class="push"><span class="push-tag">%s </span><span class="push-userid">%s</span><span class="push-content">: %s</span><span class="push-ipdatetime">10/07 12:35\n</span></div>',
        F.expr(_MARKS), "author", "content",
    )
    alive = comments(spark, sf_dir).where("NOT is_deleted")
    pages = alive.groupBy("post_id").agg(F.sort_array(F.collect_list(F.struct("floor", shown.alias("html")))).alias("all"))
    html = F.concat(F.lit('<div id="main-content" class="bbs-screen main-content">text\n--\nsignature'), F.array_join("all.html", ""), F.lit("</div>"))
    numbered = pages.select("post_id", F.xxhash64("post_id").alias("page_id"), html.alias("html"))
    read = parsing.parse_posts(numbered).select("page_id", F.inline("comments"))
    return read.join(numbered.select("page_id", "post_id"), "page_id").select("post_id", "floor", "type", "author", "content")


@query(duckdb_ctes("posts_cdc") + POSTS_SQL + """
SELECT board, CASE WHEN is_deleted THEN NULL ELSE '/bbs/' || board || '/' || post_id || '.html' END AS url, trim(coalesce(title, '')) AS title, author, push_count::VARCHAR AS push, is_deleted FROM posts""")
def forum_list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries read back from list pages in a forum's layout; what stands below the line is left out."""
    title = F.coalesce("title", F.lit(""))
    link = F.when(F.col("is_deleted"), title).otherwise(F.concat(F.lit('<a href="/bbs/'), "board", F.lit("/"), "post_id", F.lit('.html">'), title, F.lit("</a>")))
    entry = F.format_string('<div class="r-ent"><div class="nrec"><span>%s</span></div><div class="title">%s</div><div class="meta"><div class="author">%s</div></div></div>', F.col("push_count").cast("string"), link, "author")
    cut = F.pmod(F.xxhash64("post_id"), F.lit(8))
    pages = posts(spark, sf_dir).groupBy("board", cut.alias("part")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("all"))
    html = F.concat(F.lit('<div class="r-list-container">'), "all", F.lit('<div class="r-list-sep"></div><div class="r-ent"><div class="title">pinned</div></div></div>'))
    numbered = pages.select("board", F.xxhash64("board", "part").alias("page_id"), html.alias("html"))
    read = parsing.parse_lists(numbered).select("page_id", F.inline("entries"))
    return read.join(numbered.select("page_id", "board"), "page_id").select("board", "url", "title", "author", "push", "is_deleted")
