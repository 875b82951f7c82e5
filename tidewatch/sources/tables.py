"""Domain tables derived from the driver's tables by rules that both Spark and DuckDB can run.

Each rule is one SELECT over driver tables. Three macros stand for what the engines spell
differently: ``@us(x)`` is a timestamp's microseconds since 1970, ``@ts(x)`` the timestamp of
such a number, and ``@hex(x)`` three hexadecimal digits.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_US = 1704067200000000
SITE = "https://forum.example/"

_POST_ID = "event_type || '.M.' || CAST(1704067200 + user_id * 600 AS VARCHAR(20)) || '.A.' || @hex(user_id % 4096)"

RULES: dict[str, str] = {
    # one change row per event: boards are event types, posts pairs of board and user
    "comments_cdc": f"""
        SELECT {_POST_ID} AS post_id, event_type AS board, CAST(k % 50 + 1 AS INT) AS floor,
          CASE WHEN k % 10 < 6 THEN 'push' WHEN k % 10 < 8 THEN 'boo' ELSE 'arrow' END AS type,
          'u' || CAST(user_id AS VARCHAR(20)) AS author, 'c' || CAST(k AS VARCHAR(20)) AS content,
          CASE WHEN event_id % 29 = 0 THEN NULL ELSE @ts(us - k * 60000000) END AS commented_at,
          CASE WHEN event_id % 11 = 0 THEN 'u' WHEN event_id % 13 = 0 THEN 'r' ELSE 'c' END AS op,
          CASE WHEN event_id % 17 = 0 THEN 'true' WHEN event_id % 19 = 0 THEN NULL ELSE 'false' END AS deleted,
          event_id AS lsn, @ts(us) AS changed_at
        FROM (SELECT event_id, user_id, event_type, @us(ts) AS us, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {{events}}) AS e""",
    # up to three versions of each post that has comments
    "posts_cdc": f"""
        SELECT {_POST_ID} AS post_id, event_type AS board, 'a' || CAST(user_id % 23 AS VARCHAR(20)) AS author,
          CASE WHEN user_id % 9 = 0 THEN NULL ELSE ' [' || event_type || '] topic ' || CAST(user_id AS VARCHAR(20)) || CASE WHEN v > 1 THEN ' edited ' ELSE '' END END AS title,
          CASE WHEN user_id % 14 = 0 THEN NULL ELSE 'body ' || CAST(n + (CASE WHEN user_id % 3 = 0 THEN v ELSE 0 END) AS VARCHAR(20)) END AS content,
          CASE WHEN user_id % 8 = 0 THEN 'http://elsewhere.example/' ELSE '{SITE}' END || CAST(user_id AS VARCHAR(20)) AS url,
          CAST((user_id * 7 + v * 3 * (user_id % 2)) % 60 AS INT) AS push_count, CAST((user_id * 5 + v) % 30 AS INT) AS boo_count,
          CAST(n AS INT) AS comment_count,
          @ts(first_us - 3600000000) AS created_at, @ts(first_us + v * 600000000) AS crawled_at,
          (user_id + v) % 13 = 0 AS is_deleted, CASE WHEN v = 1 THEN 'c' ELSE 'u' END AS op,
          user_id * 100 + v AS lsn, @ts(first_us + v * 600000000 + 1000) AS changed_at, v AS version
        FROM (SELECT event_type, user_id, COUNT(*) AS n, MIN(@us(ts)) AS first_us FROM {{events}} GROUP BY event_type, user_id) AS e
        CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 UNION ALL SELECT 3) AS t
        WHERE v = 1 OR (user_id + v) % 3 <> 0""",
    # predictions of two models at two times; scores are three shares of one
    "predictions": f"""
        SELECT post_id, model_version, predicted_at, p / (p + n + u) AS positive, n / (p + n + u) AS negative, u / (p + n + u) AS neutral,
          CASE WHEN p >= n AND p >= u THEN 'positive' WHEN n >= u THEN 'negative' ELSE 'neutral' END AS polarity, text_hash
        FROM (
          SELECT {_POST_ID} AS post_id, 'model-' || m AS model_version,
            @ts(first_us + 7200000000 * w + (user_id % 60) * 1000000 + (CASE WHEN m = 'b' THEN 500000 ELSE 0 END)) AS predicted_at,
            CAST((user_id * 7 + w * 13 + (CASE WHEN m = 'b' THEN 3 ELSE 0 END)) % 41 + 1 AS DOUBLE) AS p,
            CAST((user_id * 11 + w * 5) % 37 + 1 AS DOUBLE) AS n, CAST((user_id * 3 + w) % 61 + 1 AS DOUBLE) AS u,
            CASE WHEN user_id % 6 = 0 THEN '' ELSE md5(CAST(user_id * 10 + w AS VARCHAR(20))) END AS text_hash
          FROM (SELECT event_type, user_id, MIN(@us(ts)) AS first_us FROM {{events}} GROUP BY event_type, user_id) AS e
          CROSS JOIN (SELECT 1 AS w UNION ALL SELECT 2) AS t CROSS JOIN (SELECT 'a' AS m UNION ALL SELECT 'b') AS s
          WHERE user_id % 5 <> 0 AND (m = 'a' OR user_id % 7 <> 0)
        ) AS q""",
    # labels of two annotators, repeated and with targets
    "labels_log": f"""
        SELECT {_POST_ID} AS post_id, labeler, 'v' || CAST(w AS VARCHAR(20)) AS version, @ts(first_us + 86400000000 * w + x * 1000000) AS labeled_at,
          CASE WHEN x = 2 THEN 'target' ELSE NULL END AS target,
          CASE (user_id * 5 + floor(user_id / 7.0) + w * 2 + x + (CASE WHEN labeler = 'second' AND user_id % 4 = 0 THEN 1 ELSE 0 END)) % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS polarity
        FROM (SELECT event_type, user_id, MIN(@us(ts)) AS first_us FROM {{events}} GROUP BY event_type, user_id) AS e
        CROSS JOIN (SELECT 1 AS w UNION ALL SELECT 2) AS t CROSS JOIN (SELECT 'first' AS labeler UNION ALL SELECT 'second') AS s
        CROSS JOIN (SELECT 0 AS x UNION ALL SELECT 1 UNION ALL SELECT 2) AS y
        WHERE user_id % 3 <> 1 AND (labeler = 'first' OR user_id % 5 <> 0)""",
    # alerts, some sent twice under one id
    "alerts": f"""
        SELECT md5(CAST(event_id - event_id % 2 AS VARCHAR(20))) AS alert_id, CASE WHEN event_id % 4 < 2 THEN 'post' ELSE 'board' END AS unit_type,
          CASE WHEN event_id % 4 < 2 THEN {_POST_ID} ELSE event_type END AS unit_key, event_type AS board,
          CAST(event_id % 70 + 10 AS INT) AS value, CAST(event_id % 9 AS DOUBLE) / 4 AS baseline, CAST(event_id % 50 AS DOUBLE) / 8 AS zscore, @ts(@us(ts)) AS created_at
        FROM {{events}} WHERE event_id % 20 < 2""",
    # page snapshots that the merge takes in: newer, older, deleted and repeated ones
    "snapshots": f"""
        SELECT {_POST_ID} AS post_id, event_type AS board, 'b' || CAST(user_id AS VARCHAR(20)) AS author,
          CASE WHEN user_id % 4 = 0 THEN 'title ' || CAST(user_id + r AS VARCHAR(20)) ELSE NULL END AS title, 'body ' || CAST(n AS VARCHAR(20)) AS content,
          '{SITE}' || CAST(user_id AS VARCHAR(20)) AS url, CAST((user_id * 7) % 60 AS INT) AS push_count, CAST((user_id * 5 + 1) % 30 AS INT) AS boo_count,
          @ts(first_us) AS created_at, @ts(first_us + (user_id % 6) * 400000000 + r * 1000000) AS crawled_at,
          user_id % 10 = 3 AS is_deleted, CAST(user_id % 8 AS INT) AS max_floor
        FROM (SELECT event_type, user_id, COUNT(*) AS n, MIN(@us(ts)) AS first_us FROM {{events}} GROUP BY event_type, user_id) AS e
        CROSS JOIN (SELECT 1 AS r UNION ALL SELECT 2) AS t
        WHERE user_id % 3 <> 2 OR r = 1
        UNION ALL
        SELECT 'new.M.' || CAST(1704067200 + n_nationkey AS VARCHAR(20)) || '.A.' || @hex(n_nationkey), 'new', 'n', n_name, NULL, '{SITE}new', 1, 0,
          @ts({BASE_US}), @ts({BASE_US} + 1000000), n_nationkey % 5 = 0, 2 FROM {{nation}}""",
    # a post's text after each change, for skipping what has been inferred already
    "post_events": f"""
        SELECT {_POST_ID} AS post_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'c' ELSE 'u' END AS op,
          sha256_hex('text ' || CAST(user_id AS VARCHAR(20)) || ' ' || CAST(k % 3 AS VARCHAR(20))) AS text_hash, CAST(floor(event_id / 500.0) AS BIGINT) AS batch
        FROM (SELECT event_id, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {{events}}) AS e""",
    "boards": """
        SELECT event_type AS board, event_type <> 'error' AS enabled, CAST(length(event_type) AS INT) AS recrawl_min_push FROM {events} GROUP BY event_type
        UNION ALL SELECT 'empty', true, 3""",
    "crawl_state": f"""
        SELECT {_POST_ID} AS post_id, @ts(first_us + (user_id % 40) * 3600000000 - 36000000000) AS next_crawl_at
        FROM (SELECT event_type, user_id, MIN(@us(ts)) AS first_us FROM {{events}} GROUP BY event_type, user_id) AS e WHERE user_id % 3 <> 0""",
    "subscriptions": "SELECT c_custkey AS chat_id, 'board' AS unit_type, CASE c_custkey % 6 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error' WHEN 3 THEN 'purchase' ELSE 'signup' END AS unit_key FROM {customer}",
    "chat_settings": "SELECT c_custkey AS chat_id, c_custkey % 4 <> 0 AS post_alerts, c_custkey % 5 <> 0 AS board_alerts FROM {customer} WHERE c_custkey % 3 <> 0",
    "muted_posts": f"SELECT CAST(user_id % 100 + 1 AS BIGINT) AS chat_id, {_POST_ID} AS post_id FROM {{events}} WHERE event_id % 7 = 0 GROUP BY event_type, user_id",
}

_SPARK = {"us": r"unix_micros(CAST(\1 AS TIMESTAMP))", "ts": r"timestamp_micros(CAST(\1 AS BIGINT))", "hex": r"lpad(hex(\1), 3, '0')"}
_DUCK = {"us": r"epoch_us(\1)", "ts": r"make_timestamp(CAST(\1 AS BIGINT))", "hex": r"printf('%03X', CAST(\1 AS BIGINT))"}


def _expand(sql: str, macros: dict[str, str]) -> str:
    """Replace the macros, innermost first; their arguments may hold balanced brackets."""
    while m := list(re.finditer(r"@(us|ts|hex)\(", sql)):
        start, at, depth = m[-1], m[-1].end(), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        inner = sql[start.end() : at - 1]
        sql = sql[: start.start()] + macros[start[1]].replace(r"\1", inner) + sql[at:]
    return sql


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table by name."""
    rule = _expand(RULES[name], _SPARK).replace("sha256_hex(", "sha2(").replace(" || CAST(k % 3 AS VARCHAR(20)))", " || CAST(k % 3 AS VARCHAR(20)), 256)")
    needed = set(re.findall(r"\{(\w+)\}", rule))
    return spark.sql(rule, **{t: driver_table(spark, sf_dir, t) for t in needed})


def duckdb_ctes(*names: str) -> str:
    """``WITH`` and the named derived tables as common table expressions."""
    parts = []
    for n in names:
        rule = re.sub(r"\{(\w+)\}", r"\1", _expand(RULES[n], _DUCK)).replace("sha256_hex(", "sha256(")
        parts.append(f"{n} AS ({rule})")
    return "WITH " + ",\n".join(parts)
