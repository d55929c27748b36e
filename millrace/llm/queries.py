"""One query per corpus operator, over the whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table
from millrace.llm.decontam import contamination
from millrace.llm.exact_dedup import exact_groups
from millrace.llm.fingerprints import FLOOR, FRACTION, SIZE, compare_neighbours, threshold
from millrace.llm.line_dedup import apply_bitmaps, keep_bitmaps
from millrace.llm.lm_scores import lm_scores
from millrace.llm.mixing import mix
from millrace.llm.near_dedup import near_duplicates
from millrace.llm.prefix_trie import prefix_trie
from millrace.llm.quality import fit, quality_scores
from millrace.llm.repair import repair
from millrace.llm.secret_scan import scan_secrets
from millrace.llm.sharding import kd_shards
from millrace.llm.token_files import token_digests

# Parameters of the queries.
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SHARDS = 40
WINDOW = 10
MIX_SEED = 20
MIX_SIZE = 1.0


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kd_shards(table(spark, sf_dir, "documents"), shards=SHARDS)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return rows.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bitmaps = keep_bitmaps(docs, min_docs=10, min_chars=1, keep_first=False)
    return apply_bitmaps(docs, bitmaps, digest=True).withColumnRenamed("text", "kept_sha256")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), size=MIX_SIZE, seed=MIX_SEED, by_text=True)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), WINDOW).drop("content")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), order=3, leave_out=True).drop("content")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_secret_scan": op2_secret_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_token_files": op5_token_files,
    "op6_decontamination": op6_decontamination,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_lm_scores": op8_lm_scores,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality": op10_quality,
    "op11_fingerprints": op11_fingerprints,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_repair": op13_repair,
}

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM parts),
keyed AS (SELECT *, {LOWERED.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT *, key IN (SELECT key FROM common) AS dropped FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP4_SQL = f"""
WITH RECURSIVE sizes AS (SELECT source, sum(strlen(text)) AS bytes FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE * (SELECT sum(bytes) FROM sizes)::DOUBLE
                 * {MIX_SIZE}::DOUBLE / bytes::DOUBLE AS rate FROM sizes),
draws AS (SELECT source, greatest(1, ceil(rate / 32))::INT AS draws, rate / greatest(1, ceil(rate / 32)) AS mean FROM rates),
steps AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM draws
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM steps WHERE k < ceil(mean + 14 * sqrt(mean) + 40)
),
points AS (SELECT doc_id, source, unnest(range(1, draws + 1)) AS draw FROM documents JOIN draws USING (source)),
uniform AS (SELECT doc_id, source,
                   ('0x' || substr(md5('{MIX_SEED}|' || doc_id || '|' || draw), 1, 13))::BIGINT / 16.0::DOUBLE ** 13 AS u FROM points),
drawn AS (SELECT doc_id, count(*) AS n FROM uniform JOIN steps ON uniform.source = steps.source AND c <= u GROUP BY doc_id),
copies AS (SELECT doc_id, n::INT AS n_copies, unnest(range(1, n + 1))::INT AS copy_no FROM drawn)
SELECT documents.*, copy_no, n_copies, md5('{MIX_SEED}/order|' || doc_id || '|' || copy_no) AS shuffle_key
FROM documents JOIN copies USING (doc_id)
"""

OP6_SQL = f"""
WITH RECURSIVE doc_words AS (
  SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT item_id, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS s, w FROM item_words WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS phrase FROM item_windows),
lengths AS (SELECT DISTINCT n FROM windows),
doc_places AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM doc_words, lengths WHERE len(w) >= n),
doc_windows AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase FROM doc_places),
matches AS (SELECT doc_id, item_id, s, n FROM doc_windows JOIN windows USING (n, phrase)),
hits AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS pos FROM matches),
n_hits AS (SELECT doc_id, count(*) AS n_hit FROM hits GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
          FROM matches GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM doc_words LEFT JOIN n_hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP9_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWERED.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END AS g FROM words),
grams AS (SELECT DISTINCT doc_id, unnest(g) AS g FROM runs),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * k >= 80 * (s.n + t.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON edges.x = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _sketch_sql(text: str) -> str:
    words = f"string_split_regex(trim({text}, {SPACE}), '[\\x20\\x09-\\x0D]+')"
    runs = f"CASE WHEN len(w) < {SIZE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {SIZE - 2}), lambda i: array_to_string(w[i : i + {SIZE - 1}], ' ')) END"
    hashes = f"list_sort(list_distinct(list_transform({runs}, lambda x: substr(md5(x), 1, 12))))"
    return (
        f"SELECT row, CASE WHEN trim({text}, {SPACE}) = '' THEN [] WHEN len(below) >= {FLOOR} THEN below ELSE hashes[1 : {FLOOR}] END AS s "
        f"FROM (SELECT row, {text}, hashes, list_filter(hashes, lambda x: x < '{threshold(FRACTION)}') AS below "
        f"FROM (SELECT row, {text}, {hashes} AS hashes FROM (SELECT row, {text}, {words} AS w FROM edits)))"
    )


def _near_sql(a: str, b: str) -> str:
    limit = lambda x: f"CASE WHEN len({x}) < {FLOOR} THEN 'g' ELSE greatest({x}[-1], '{int(threshold(FRACTION), 16) - 1:012x}') END"
    count = lambda x: f"len(list_filter({x}, lambda x: x <= least({limit(a)}, {limit(b)})))"
    least = f"least({count(a)}, {count(b)})"
    return f"CASE WHEN {a} = {b} THEN 1 WHEN {least} = 0 THEN 0 ELSE {count(f'list_intersect({a}, {b})')}::DOUBLE / {least} END::DOUBLE"


OP11_SQL = f"""
WITH rows AS (SELECT row_number() OVER (ORDER BY doc_id) AS row, doc_id, coalesce(text, '') AS text FROM documents),
edits AS (SELECT a.row, b.row AS next_row, a.doc_id, a.text, length(a.text) AS n,
                 substr(a.text, 1, n - n // 2) || substr(b.text, 1, n // 2) AS edited
          FROM rows a JOIN rows b ON b.row = a.row % (SELECT count(*) FROM rows) + 1),
own AS ({_sketch_sql("text")}),
other AS ({_sketch_sql("edited")})
SELECT edits.doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(own.s, '') AS fingerprint,
       array_to_string(other.s, '') AS edited_fingerprint, {_near_sql("own.s", "other.s")} AS near_edited, {_near_sql("own.s", "nexts.s")} AS near_next
FROM edits JOIN own USING (row) JOIN other USING (row) JOIN own nexts ON nexts.row = next_row
"""



def _crc32_sql(text: str) -> str:
    """Of ASCII text; DuckDB has no such function."""
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295)"


OP12_SQL = f"""
WITH clean AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, count(*) AS n, {_crc32_sql("conv_id::VARCHAR")} % 4 AS h, conv_id - conv_id % 20 AS head FROM clean GROUP BY conv_id),
begun AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM convs c LEFT JOIN convs b ON b.conv_id = c.head),
turns AS (SELECT begun.conv_id, pos AS depth, role, text FROM begun JOIN clean ON clean.conv_id = begun.head AND pos <= taken
          UNION ALL SELECT conv_id, pos - h + taken, role, text FROM begun JOIN clean USING (conv_id) WHERE pos > h),
paths AS (SELECT conv_id, depth, text, list([role, text]) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM turns
          UNION ALL SELECT conv_id, 0, '', [] FROM convs),
passed AS (SELECT conv_id, depth, text, sha256(to_json(path)::VARCHAR) AS node, sha256(to_json(path[: depth - 1])::VARCHAR) AS parent FROM paths),
nodes AS (SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(text) AS text
          FROM passed GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
worth AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children,
                 (n_convs - 1) * len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS saved FROM nodes LEFT JOIN children USING (node)),
totals AS (SELECT passed.node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
           FROM worth JOIN passed ON passed.conv_id = worth.conv_id AND passed.depth <= worth.depth GROUP BY passed.node),
ends AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
         FROM (SELECT conv_id, arg_max(node, depth) AS node FROM passed GROUP BY conv_id) GROUP BY node)
SELECT worth.conv_id, worth.depth, up.conv_id AS parent_conv_id, worth.n_convs, worth.n_children, n_leaves, saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM worth JOIN totals USING (node) LEFT JOIN ends USING (node) LEFT JOIN nodes up ON up.node = worth.parent AND worth.depth > 0
"""

OP13_SQL = f"""
WITH RECURSIVE codes AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code FROM conversations),
damaged AS (
  SELECT conv, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy FROM codes WHERE code <> 0),
placed AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, copy) AS pos FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS again, trim(text, {SPACE}) AS bare,
                initial || lead(initial) OVER (PARTITION BY conv ORDER BY pos) AS pair FROM placed),
faults AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
           FROM seen),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY conv),
follows(a, role, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
one AS (SELECT a, b FROM follows WHERE role <> 's'),
inserts AS (SELECT a, a AS b, '' AS letters, 0 AS price FROM (SELECT unnest(range(4)) AS a) UNION ALL SELECT a, b, 'I', 5 FROM one
            UNION ALL SELECT x.a, y.b, 'II', 10 FROM one x JOIN one y ON x.b = y.a),
edits AS (
  SELECT conv, pos, a, a AS b, 'D' AS letter, 2 AS price FROM faults, (SELECT unnest(range(4)) AS a)
  UNION ALL SELECT conv, pos, a, b, 'K', CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END
            FROM faults JOIN follows ON follows.role = initial WHERE fault IS NULL OR fault = 'truncated'
  UNION ALL SELECT conv, pos, a, b, 'R', CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END
            FROM faults, one WHERE fault IS NULL OR fault = 'truncated'),
steps AS (SELECT conv, pos, inserts.a, edits.b, letters || letter AS letters, inserts.price + edits.price AS price
          FROM edits JOIN inserts ON inserts.b = edits.a),
best(conv, pos, state, path) AS (
  SELECT conv, 0::BIGINT, 0::BIGINT, {{'cost': 0::BIGINT, 'audit': ''}} FROM counts
  UNION ALL
  SELECT best.conv, best.pos + 1, steps.b::BIGINT, min({{'cost': best.path.cost + steps.price, 'audit': best.path.audit || steps.letters}})
  FROM best JOIN steps ON steps.conv = best.conv AND steps.pos = best.pos + 1 AND steps.a = best.state GROUP BY best.conv, best.pos, steps.b),
chosen AS (SELECT conv, min({{'cost': path.cost + price, 'audit': path.audit || letters}}) AS path
           FROM best JOIN counts USING (conv) JOIN inserts ON inserts.a = state WHERE pos = n AND inserts.b IN (0, 3) GROUP BY conv),
letters AS (SELECT conv, unnest(string_split(path.audit, '')) AS letter, generate_subscripts(string_split(path.audit, ''), 1) AS place FROM chosen),
aligned AS (SELECT conv, place, letter, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv ORDER BY place) AS pos FROM letters),
kept AS (SELECT aligned.*, row_number() OVER (PARTITION BY conv ORDER BY place) AS nth FROM aligned WHERE letter <> 'D'),
lines AS (SELECT kept.*, role, initial, CASE WHEN letter = 'I' THEN '' ELSE text END AS text,
                 first_value(letter = 'K' AND initial = 's') OVER (PARTITION BY conv ORDER BY place) AS system_first
          FROM kept LEFT JOIN placed USING (conv, pos)),
repaired AS (SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth - system_first::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                     || ':' || text, chr(10) ORDER BY place) AS whole FROM lines GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(path.cost, 0) AS cost, coalesce(path.audit, '') AS audit,
       sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv FROM conversations)
LEFT JOIN counts USING (conv) LEFT JOIN chosen USING (conv) LEFT JOIN repaired USING (conv)
"""

ORACLE: dict[str, str] = {
    "op3_line_dedup": OP3_SQL,
    "op4_mixing": OP4_SQL,
    "op6_decontamination": OP6_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op9_near_dedup": OP9_SQL,
    "op11_fingerprints": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_repair": OP13_SQL,
}
