"""The same answers computed by DuckDB from the plain tables.

The SQL builds no feed: it states what each query has to return for a row of `events`,
defects included. Rows whose document is malformed or has no id are not loaded, and rows
that are delivered twice count twice. The rules are stated here anew, so that a slip in
the feed shows.
"""

from __future__ import annotations

KIND = (
    "CASE event_type WHEN 'click' THEN 'edit' WHEN 'signup' THEN 'new' WHEN 'view' THEN 'categorize' "
    "WHEN 'error' THEN 'log' WHEN 'purchase' THEN 'external' END"
)
ACTION = "CASE event_id % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'move' ELSE 'delete' END"
LINK = "'[[:Category:C' || user_id || ']]'"
COMMENT = (
    f"CASE event_id % 4 WHEN 0 THEN {LINK} || ' added to category' "
    f"WHEN 1 THEN {LINK} || ' removed from category' WHEN 2 THEN 'Added nothing, it''s all' END"
)
LOG_PARAMS = (
    "CASE event_id % 17 WHEN 1 THEN '[]' WHEN 2 THEN 'null' WHEN 3 THEN NULL ELSE "
    "'{\"count\":{\"files\":' || (event_id % 9) || '},\"duration\":\"infinity\",\"target\":\"T' || user_id || '\"}' END"
)
# Parameters can only be looked up where they are an object.
HAS_PARAMS = "type = 'log' AND event_id % 17 NOT IN (1, 2, 3)"
TIME = "strftime({}, '%Y-%m-%dT%H:%M:%S')"
DT_TEXT = (
    f"CASE event_id % 5 WHEN 2 THEN {TIME.format('dt + INTERVAL 2 HOUR')} || '+02:00' "
    f"WHEN 3 THEN {TIME.format('dt')} ELSE {TIME.format('dt')} || 'Z' END"
)
ID_TEXT = """
    CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 107 = 0 THEN '"id":null,'
      WHEN event_id % 103 = 0 THEN '"id":' || event_id || '.0000000001,'
      WHEN event_id % 7 = 3 THEN '"id":"' || event_id || '",'
      WHEN event_id % 11 = 5 THEN '"id":' || event_id || '.0,' ELSE '"id":' || event_id || ',' END"""
TITLE = "CASE WHEN event_id % 13 = 0 THEN 'Pägé \"日本\" \\ ' ELSE 'Page ' END || user_id"

# The values of every document, before defects.
VALUES = f"""
values_of AS (
  SELECT event_id, ts, event_type,
    CASE WHEN event_id % 107 <> 0 AND event_id % 103 <> 0 THEN event_id END AS id,
    CAST(event_id % 16 AS VARCHAR) AS namespace,
    {KIND} AS type,
    {TITLE} AS title,
    {COMMENT} AS comment,
    'u' || user_id AS "user",
    user_id % 3 = 0 AS bot,
    event_id % 2 = 0 AS minor,
    event_id * 10 + user_id AS revision_new,
    CASE WHEN event_type <> 'signup' THEN event_id * 10 END AS revision_old,
    event_id % 5000 AS length_new,
    CASE WHEN event_type <> 'signup' THEN event_id * 7 % 5000 END AS length_old,
    'https://d' || (user_id % 7) || '.example.org/' || event_id AS uri,
    'd' || (user_id % 7) || '.example.org' AS domain,
    date_trunc('second', ts) AS dt,
    CASE WHEN event_type IN ('click', 'signup') THEN event_id % 5 = 0 END AS patrolled,
    CASE WHEN event_type = 'error' THEN {ACTION} END AS log_type,
    CASE WHEN event_type = 'error' THEN {ACTION} END AS log_action,
    CASE WHEN event_type = 'error' THEN {LOG_PARAMS} END AS log_params,
    user_id
  FROM events
)"""
# Every document's text, as the feed writes it before it cuts some.
TEXTS = f"""
texts AS (
  SELECT *, '{{' || {ID_TEXT}
    || '"namespace":' || namespace || ',"type":"' || type || '","title":"'
    || replace(replace(title, '\\', '\\\\'), '"', '\\"') || '"'
    || coalesce(',"comment":"' || comment || '"', '')
    || ',"user":"' || "user" || '","bot":' || CAST(bot AS VARCHAR) || ',"minor":' || CAST(minor AS VARCHAR)
    || ',"revision":{{"new":' || revision_new || coalesce(',"old":' || revision_old, '') || '}}'
    || ',"length":{{"new":' || length_new || coalesce(',"old":' || length_old, '') || '}}'
    || ',"meta":{{"uri":"' || uri || '","domain":"' || domain || '","dt":"' || {DT_TEXT} || '"}}'
    || coalesce(',"patrolled":' || CAST(patrolled AS VARCHAR), '')
    || coalesce(',"log_type":"' || log_type || '","log_action":"' || log_action || '"', '')
    || CASE WHEN event_type <> 'error' OR event_id % 17 = 3 THEN ''
       WHEN event_id % 17 = 1 THEN ',"log_params":[]' WHEN event_id % 17 = 2 THEN ',"log_params":null'
       ELSE ',"log_params":{{"duration":"infinity","target":"T' || user_id || '","count":{{"files":' || (event_id % 9) || '}}}}' END
    || '}}' AS whole
  FROM values_of
), sent AS (
  SELECT *, CASE WHEN event_id % 89 = 0 THEN left(whole, length(whole) - 1)
    WHEN event_id % 83 = 0 THEN replace(whole, '"', '''')
    WHEN event_id % 79 = 0 THEN replace(whole, '"user":"', '"user":"' || chr(9)) ELSE whole END AS data
  FROM texts
), delivered AS (
  SELECT * FROM sent UNION ALL SELECT * FROM sent WHERE event_id % 50 = 0
)"""
WHOLE, KEYED = "event_id % 89 <> 0 AND event_id % 83 <> 0 AND event_id % 79 <> 0", "event_id % 97 <> 0"
LOADED = f"""
loaded AS (
  SELECT * FROM values_of WHERE {WHOLE} AND {KEYED}
  UNION ALL
  SELECT * FROM values_of WHERE {WHOLE} AND {KEYED} AND event_id % 50 = 0
)"""
FIRST_PART, SECOND_PART = "ts < TIMESTAMP '2024-01-16'", "ts >= TIMESTAMP '2024-01-16'"
FRAME = "'event: message' || chr(10) || 'id: ' || event_id || chr(10) || 'data: ' || data"
MINUTE = "strftime(dt, '%Y/%m/%d %H:%M')"


def _sent(select: str) -> str:
    return f"WITH {VALUES}, {TEXTS} {select}"


def _loaded(select: str) -> str:
    return f"WITH {VALUES}, {LOADED} {select}"


def _missing(*conditions: str) -> str:
    return " + ".join(f"CASE WHEN {condition} THEN 1 ELSE 0 END" for condition in conditions)


QUALITY = f"""
SELECT *, CASE WHEN missing_key_parts > 0 OR incomplete > 0 THEN 'warning' ELSE 'info' END AS severity
FROM (
  SELECT count(*) AS seen,
    CAST(sum(CASE WHEN {WHOLE} THEN parts ELSE 0 END) AS BIGINT) AS missing_key_parts,
    count(*) FILTER (WHERE {WHOLE} AND parts > 0) AS missing_key_events,
    count(*) FILTER (WHERE NOT ({WHOLE})) AS incomplete
  FROM (SELECT *, {_missing(f"NOT ({KEYED})", "patrolled IS NULL")} AS parts FROM delivered)
)"""
TOPIC_LOADED = f"""{WHOLE} AND CASE event_type
    WHEN 'click' THEN {KEYED}
    WHEN 'signup' THEN {KEYED} AND patrolled IS NOT NULL
    WHEN 'view' THEN {KEYED} AND comment IS NOT NULL
    WHEN 'error' THEN {KEYED} AND event_id % 17 <> 3
    ELSE true END"""
LOG_PARAM_COLUMNS = f"""
  CAST(NULL AS VARCHAR) AS img_timestamp,
  CASE WHEN {HAS_PARAMS} THEN '"infinity"' END AS duration,
  CAST(NULL AS VARCHAR) AS flags, CAST(NULL AS VARCHAR) AS sitewide,
  CASE WHEN {HAS_PARAMS} THEN '"T' || user_id || '"' END AS target,
  CAST(NULL AS VARCHAR) AS noredir, CAST(NULL AS VARCHAR) AS ofield, CAST(NULL AS VARCHAR) AS nfield,
  CAST(NULL AS VARCHAR) AS olduser, CAST(NULL AS VARCHAR) AS newuser, CAST(NULL AS VARCHAR) AS movepages,
  CAST(NULL AS VARCHAR) AS suppressredirects, CAST(NULL AS VARCHAR) AS edits, CAST(NULL AS VARCHAR) AS derived,
  CAST(NULL AS VARCHAR) AS interwiki, CAST(NULL AS VARCHAR) AS oldtitle,
  CASE WHEN {HAS_PARAMS} THEN CAST(event_id % 9 AS VARCHAR) END AS files,
  CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS cascade, CAST(NULL AS VARCHAR) AS expiry,
  CAST(NULL AS VARCHAR) AS dest, CAST(NULL AS VARCHAR) AS mergepoint"""
OBJECT = f"CASE event_id % 4 WHEN 0 THEN {LINK} WHEN 1 THEN {LINK} WHEN 2 THEN '' END AS object"
ACTION_TYPE = "CASE event_id % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' END AS action_type_en"
LOG_COUNTS = f"""
SELECT domain, log_action, {MINUTE} AS minute, count(*) AS count_actions
FROM loaded WHERE type = 'log' GROUP BY ALL"""
BOT_COUNTS = f"""
SELECT {MINUTE} AS minute, bot, count(*) AS count_actions
FROM loaded WHERE type IN ('edit', 'new') GROUP BY ALL"""

BOTH_REPORTS = f"""
SELECT 'logs' AS report, minute, domain, log_action, CAST(NULL AS BOOLEAN) AS bot, count_actions FROM ({LOG_COUNTS})
UNION ALL SELECT 'bots', minute, NULL, NULL, bot, count_actions FROM ({BOT_COUNTS})"""
ALL_COLUMNS = (
    'id, namespace, type, title, comment, "user", bot, minor, revision_new, revision_old, length_new, length_old, '
    "uri, domain, dt, patrolled, log_type, log_action, log_params"
)

ORACLE: dict[str, str] = {
    "src_sse_frames": _sent(f"SELECT {FRAME} AS value FROM delivered"),
    "src_new_files_since": _sent(f"SELECT {FRAME} AS value FROM delivered WHERE {SECOND_PART}"),
    "src_relation": _sent(f"SELECT data AS event FROM delivered WHERE {WHOLE} AND {KEYED}"),
    "sse_parse": _sent("SELECT data FROM delivered"),
    "utf8_quarantine": _sent(f"SELECT event_id, event_id % 101 <> 0 AS decodable FROM delivered"),
    "json_valid_filter": _sent(f"SELECT data FROM delivered WHERE {WHOLE}"),
    "pk_presence_filter": _sent(f"SELECT data FROM delivered WHERE {WHOLE} AND {KEYED} AND comment IS NOT NULL"),
    "load_quality_counts": _sent(QUALITY),
    "json_array_explode": """
        SELECT '{"id":' || event_id || ',"n":' || n || '}' AS event
        FROM events, range(0, 4) numbers(n) WHERE n < event_id % 4""",
    "bronze_append": _sent(
        f"SELECT data AS event, CASE WHEN {FIRST_PART} THEN 'first' ELSE 'second' END AS load_id "
        f"FROM delivered WHERE {WHOLE} AND {KEYED}"
    ),
    "multi_topic_load": _sent(
        f"SELECT event_type AS topic, count(*) AS seen, count(*) FILTER (WHERE {TOPIC_LOADED}) AS loaded "
        "FROM delivered GROUP BY event_type"
    ),
    "json_path_bigint": _loaded("SELECT id, revision_new, revision_old, length_new, length_old FROM loaded"),
    "json_path_boolean": _loaded("SELECT id, bot, minor, patrolled FROM loaded"),
    "json_path_timestamp": _loaded("SELECT id, dt FROM loaded"),
    "json_extract_string": _loaded(
        'SELECT namespace, type, title, comment, "user", uri, domain, log_type, log_action FROM loaded'
    ),
    "json_subdocument": _loaded("SELECT id, log_params FROM loaded"),
    "json_path_json": _loaded(f"SELECT id, {LOG_PARAM_COLUMNS} FROM loaded"),
    "project_rename": _loaded("SELECT id, title, domain, length_new AS length FROM loaded"),
    "arith_difference": _loaded(
        "SELECT id, revision_new - revision_old AS revision_global_offset, "
        "length_new - length_old AS length_difference FROM loaded"
    ),
    "regexp_extract_link": _loaded(f"SELECT id, {OBJECT} FROM loaded"),
    "case_contains": _loaded(f"SELECT id, {ACTION_TYPE} FROM loaded"),
    "minute_format": _loaded(f"SELECT id, {MINUTE} AS minute FROM loaded"),
    "filter_event_type": _loaded("SELECT id, type, \"user\" FROM loaded WHERE type = 'categorize'"),
    "keyed_anti_join": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
        WHERE NOT EXISTS (
          SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderdate >= TIMESTAMP '1998-01-01')""",
    "count_by_domain_action_minute": _loaded(LOG_COUNTS),
    "count_by_minute_bool": _loaded(BOT_COUNTS),
    "sort_multi_key": _loaded(f"SELECT log_action, {MINUTE} AS minute, id FROM loaded ORDER BY minute, log_action, id"),
    "union_all": _loaded(
        f"SELECT {MINUTE} AS minute, bot FROM loaded WHERE type = 'edit' "
        f"UNION ALL SELECT {MINUTE} AS minute, bot FROM loaded WHERE type = 'new'"
    ),
    "silver_recentchange": _loaded(
        f"SELECT {ALL_COLUMNS} FROM loaded"
    ),
    "silver_new": _loaded(
        'SELECT id, namespace, title, comment, "user", bot, minor, length_new AS length, uri, domain, dt, patrolled '
        "FROM loaded WHERE type = 'new'"
    ),
    "silver_edit": _loaded(
        'SELECT id, namespace, title, comment, "user", bot, minor, revision_new - revision_old AS '
        "revision_global_offset, length_new - length_old AS length_difference, uri, domain, dt, patrolled "
        "FROM loaded WHERE type = 'edit'"
    ),
    "silver_categorize": _loaded(
        f'SELECT id, namespace, title, comment, {OBJECT}, {ACTION_TYPE}, "user", bot, minor, uri, domain, dt '
        "FROM loaded WHERE type = 'categorize'"
    ),
    "silver_log": _loaded(
        f'SELECT id, namespace, title, comment, "user", bot, minor, uri, domain, dt, log_type, log_action, '
        f"{LOG_PARAM_COLUMNS} FROM loaded WHERE type = 'log'"
    ),
    "gold_logs_per_domain_and_min": _loaded(f"{LOG_COUNTS} ORDER BY minute, domain, log_action"),
    "gold_human_vs_bot": _loaded(f"{BOT_COUNTS} ORDER BY minute, bot"),
    "incremental_delete_insert": """
        WITH batch AS (
          SELECT * REPLACE ('R' AS o_orderstatus) FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'
          UNION ALL SELECT * REPLACE (-o_orderkey - 1 AS o_orderkey) FROM orders WHERE o_orderpriority = '1-URGENT'
          UNION ALL SELECT * REPLACE (-o_orderkey - 1 AS o_orderkey) FROM orders WHERE o_orderpriority = '1-URGENT')
        SELECT * FROM orders o WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.o_orderkey = o.o_orderkey)
        UNION ALL SELECT * FROM batch""",
    "incremental_append": _loaded(
        f"SELECT {ALL_COLUMNS}, CASE WHEN {FIRST_PART} THEN 'first' ELSE 'second' END AS load_id FROM loaded"
    ),
    "run_models": _loaded(f"""
        SELECT type AS model,
               count(*) AS n, CAST(NULL AS BIGINT) AS total
        FROM loaded WHERE type IN ('edit', 'new', 'log', 'categorize') GROUP BY ALL
        UNION ALL SELECT 'logs_per_domain_and_min', count(*), CAST(sum(count_actions) AS BIGINT) FROM ({LOG_COUNTS})
        UNION ALL SELECT 'human_vs_bot_new_and_edit_actions', count(*), CAST(sum(count_actions) AS BIGINT) FROM ({BOT_COUNTS})
        UNION ALL SELECT 'log_actions', count(DISTINCT log_action), count(*) FROM loaded WHERE type = 'log'"""),
    "user_sql_model": _loaded(
        'SELECT "user", count(*) AS edits, CAST(sum(length_new - length_old) AS BIGINT) AS growth, max(dt) AS last_dt '
        "FROM loaded WHERE type = 'edit' GROUP BY ALL"
    ),
    "land_raw_frames": _sent(f"SELECT 'recentchange' AS topic, {FRAME} AS value FROM delivered"),
    "gold_csv_export": _loaded(BOTH_REPORTS),
    "stream_once": _loaded(BOTH_REPORTS),
    "stream_continuous": _loaded(BOTH_REPORTS),
    "multi_topic_cycle": _loaded("""
        SELECT domain, count(*) AS events, count(log_action) AS log_events FROM loaded GROUP BY domain
        UNION ALL SELECT 'bronze', count(*) FILTER (event_type <> 'error'), count(*) FILTER (event_type = 'error') FROM loaded"""),
    "load_all": _sent(f"SELECT event_type AS topic, data AS event FROM delivered WHERE {TOPIC_LOADED}"),
    "cast_rejects": _loaded("""
        SELECT count(*) FILTER (event_id % 103 = 0 AND event_id % 107 <> 0) AS id, 0 AS bot, 0 AS minor, 0 AS revision_new,
          0 AS revision_old, 0 AS length_new, 0 AS length_old, 0 AS dt, 0 AS patrolled FROM loaded"""),
    "stream_checkpoint": _loaded(
        f"SELECT CASE WHEN {FIRST_PART} THEN 0 ELSE 1 END AS batch, count(*) AS events FROM loaded GROUP BY ALL"
    ),
    "stream_minute_counts": _loaded(LOG_COUNTS),
}
