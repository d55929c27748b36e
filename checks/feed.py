"""A feed derived from an ``events`` table, for tests, checks and benchmarks.

Every row becomes one JSON document and one frame. Rules by number put defects in, as a
real feed has them: documents that are cut, written with single quotes or with a raw
control character, without an ``id``, with an ``id`` of another JSON type, or delivered
twice; times with offsets, escaped and non-ASCII text, and log parameters of all kinds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import storage
from millrace.sources.frames import FRAME_END

# Fixed values of the feed: the types, the log actions and the rules.
FEED_TYPES = {"click": "edit", "signup": "new", "view": "categorize", "error": "log", "purchase": "external"}
LOG_ACTIONS = ("block", "move", "delete")
CUT_EVERY, KEYLESS_EVERY, TWICE_EVERY, UNDECODABLE_EVERY = 89, 97, 50, 101
SINGLE_QUOTED_EVERY, CONTROL_EVERY, NULL_ID_EVERY, INEXACT_ID_EVERY = 83, 79, 107, 103

_KIND = "CASE event_type " + " ".join(f"WHEN '{event}' THEN '{kind}'" for event, kind in FEED_TYPES.items()) + " END"
_ACTION = "CASE event_id % 3 " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(LOG_ACTIONS)) + " END"
_ID = f"""
CASE WHEN event_id % {KEYLESS_EVERY} = 0 THEN ''
  WHEN event_id % {NULL_ID_EVERY} = 0 THEN '"id":null,'
  WHEN event_id % {INEXACT_ID_EVERY} = 0 THEN concat('"id":', event_id, '.0000000001,')
  WHEN event_id % 7 = 3 THEN concat('"id":"', event_id, '",')
  WHEN event_id % 11 = 5 THEN concat('"id":', event_id, '.0,')
  ELSE concat('"id":', event_id, ',') END"""
_TIME = "replace(substr(cast({} AS STRING), 1, 19), ' ', 'T')"
_DT = f"""
CASE event_id % 5
  WHEN 2 THEN concat({_TIME.format("ts + INTERVAL 2 HOURS")}, '+02:00')
  WHEN 3 THEN {_TIME.format("ts")}
  ELSE concat({_TIME.format("ts")}, 'Z') END"""
_LOG_PARAMS = """
CASE WHEN kind <> 'log' OR event_id % 17 = 3 THEN ''
  WHEN event_id % 17 = 1 THEN ',"log_params":[]'
  WHEN event_id % 17 = 2 THEN ',"log_params":null'
  ELSE concat(',"log_params":', to_json(named_struct(
    'duration', 'infinity',
    'target', concat('T', user_id),
    'count', named_struct('files', event_id % 9)))) END"""
# A member whose value is NULL is left out of the text.
_REST = f"""
to_json(named_struct(
  'namespace', event_id % 16,
  'type', kind,
  'title', concat(CASE WHEN event_id % 13 = 0 THEN 'Pägé "日本" \\\\ ' ELSE 'Page ' END, user_id),
  'comment', CASE event_id % 4
    WHEN 0 THEN concat('[[:Category:C', user_id, ']] added to category')
    WHEN 1 THEN concat('[[:Category:C', user_id, ']] removed from category')
    WHEN 2 THEN 'Added nothing, it''s all' END,
  'user', concat('u', user_id),
  'bot', user_id % 3 = 0,
  'minor', event_id % 2 = 0,
  'revision', named_struct(
    'new', event_id * 10 + user_id,
    'old', CASE WHEN kind <> 'new' THEN event_id * 10 END),
  'length', named_struct(
    'new', event_id % 5000,
    'old', CASE WHEN kind <> 'new' THEN event_id * 7 % 5000 END),
  'meta', named_struct(
    'uri', concat('https://', domain, '/', event_id),
    'domain', domain,
    'dt', {_DT}),
  'patrolled', CASE WHEN kind IN ('edit', 'new') THEN event_id % 5 = 0 END,
  'log_type', CASE WHEN kind = 'log' THEN {_ACTION} END,
  'log_action', CASE WHEN kind = 'log' THEN {_ACTION} END))"""
_DOCUMENT = f"concat('{{', {_ID}, substr(rest, 2, length(rest) - 2), {_LOG_PARAMS}, '}}')"
_SENT = f"""
CASE WHEN event_id % {CUT_EVERY} = 0 THEN left(json, length(json) - 1)
  WHEN event_id % {SINGLE_QUOTED_EVERY} = 0 THEN translate(json, '"', '\\'')
  WHEN event_id % {CONTROL_EVERY} = 0 THEN replace(json, '"user":"', '"user":"\\t')
  ELSE json END"""
_FRAME = f"concat('event: message\\nid: ', event_id, '\\ndata: ', {_SENT})"
_COPIES = f"CASE WHEN event_id % {TWICE_EVERY} = 0 THEN 2 ELSE 1 END"


def documents(events: DataFrame) -> DataFrame:
    """The intact JSON documents: ``event_id``, ``ts``, ``event_type`` and ``json``."""
    named = events.selectExpr("*", f"{_KIND} AS kind", "concat('d', user_id % 7, '.example.org') AS domain")
    named = named.selectExpr("*", f"{_REST} AS rest")
    return named.selectExpr("event_id", "ts", "event_type", f"{_DOCUMENT} AS json")


def frames(events: DataFrame) -> DataFrame:
    """The feed's frames with all defects: ``event_id``, ``ts``, ``event_type``, ``value``."""
    return documents(events).selectExpr(
        "event_id", "ts", "event_type", f"explode(array_repeat({_FRAME}, {_COPIES})) AS value"
    )


def undecodable(framed: DataFrame) -> DataFrame:
    """The same frames, some of them with two bytes that are not UTF-8 at their end."""
    broken = F.concat(F.encode("value", "UTF-8"), F.unhex(F.lit("FFFE"))).cast("string")
    return framed.withColumn("value", F.when(F.col("event_id") % UNDECODABLE_EVERY == 0, broken).otherwise(F.col("value")))


def write_queue(framed: DataFrame, path: str, stamp: int) -> None:
    """Write frames as queue files ``<stamp>.<part>.bin``, one per partition."""
    spark = framed.sparkSession
    staged = f"{path}/_staged-{stamp}"
    framed.select("value").write.option("lineSep", FRAME_END).text(staged)
    for part, name in enumerate(storage.part_files(spark, staged)):
        storage.rename(spark, f"{staged}/{name}", f"{path}/{stamp}.{part:05d}.bin")
    storage.delete(spark, staged)
