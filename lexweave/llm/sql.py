"""The same results in plain SQL, where it can express them over whole tables."""

from __future__ import annotations

from lexweave.llm.lookalikes import statement

_COUNTS = """
SELECT cand_match AS term, count(*) AS n_rows, count(DISTINCT file_name) AS n_files,
  CASE WHEN count(DISTINCT file_name) <= 2 THEN 'rare'
       WHEN count(DISTINCT file_name) > 0.01 * (SELECT count(DISTINCT file_name) FROM instances) THEN 'common' END AS mark
FROM instances WHERE cand_match IS NOT NULL AND file_name IS NOT NULL GROUP BY cand_match"""

_DROP = r"[\p{P}\s!-/:-@\[-`{-~\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

_COPIES = rf"""
WITH lines AS (
  SELECT post_id, post_txt, lemmas,
    list_filter(string_split_regex(coalesce(post_txt, ''), '[\n\r]+'), lambda x: length(trim(x)) > 0) AS tl,
    list_filter(string_split_regex(coalesce(lemmas, ''), '[\n\r]+'), lambda x: length(trim(x)) > 0) AS ll FROM posts),
keyed AS (
  SELECT post_id, CASE WHEN len(tl) >= 4 AND len(list_filter(tl, lambda x: NOT regexp_matches(x, '^\s*[^:\n]{{0,40}}\p{{L}}[^:\n]{{0,40}}:'))) = 0
    THEN 'F' || array_to_string(list_sort(list_filter(list_transform(tl, lambda x: lower(regexp_replace(x, '{_DROP}', '', 'g'))), lambda x: x <> '')), chr(10)) || chr(1)
             || array_to_string(list_sort(list_filter(list_transform(ll, lambda x: lower(regexp_replace(x, '{_DROP}', '', 'g'))), lambda x: x <> '')), chr(10))
    ELSE 'N' || lower(regexp_replace(coalesce(post_txt, ''), '{_DROP}', '', 'g')) || chr(1) || lower(regexp_replace(coalesce(lemmas, ''), '{_DROP}', '', 'g')) END AS k
  FROM lines)
"""

_NUMBER = r"try_cast(nullif(regexp_extract(file_name, '(?i)(?:^|[^a-z0-9]){0}(\d{{1,18}})(?:$|[^a-z0-9])', 1), '') AS BIGINT)"

#: Reachability by steps between authors and threads; for small tables only, as it lists the pairs of each group.
_GROUPS = f"""
WITH RECURSIVE files AS (SELECT DISTINCT file_name, {_NUMBER.format('u')} AS a, {_NUMBER.format('t')} AS t FROM posts WHERE file_name IS NOT NULL),
edges AS (SELECT DISTINCT a * 2 AS x, t * 2 + 1 AS y FROM files WHERE a IS NOT NULL AND t IS NOT NULL),
both_ways AS (SELECT x, y FROM edges UNION ALL SELECT y, x FROM edges),
reach(x, y) AS (SELECT x, x FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
least AS (SELECT x, min(y // 2) AS g FROM reach WHERE y % 2 = 0 GROUP BY x)
@"""
_GROUP_OF_FILE = "SELECT file_name, coalesce(g, a) AS group_author FROM files LEFT JOIN least ON x = coalesce(t * 2 + 1, a * 2) WHERE coalesce(g, a) IS NOT NULL"
#: A spanning tree has one edge less than nodes.
_TREES = "SELECT g AS group_author, count(*) AS n_nodes, count(*) - 1 AS n_edges FROM least GROUP BY g"

_FORM = {t: statement().replace("FROM b)", f"FROM (SELECT {k} AS k, {x} AS x FROM {t}))").replace("FROM b\n", f"FROM (SELECT {k} AS k, {x} AS x FROM {t})\n") for t, k, x in (("posts", "post_id", "post_txt"), ("instances", "inst_id", "cand_match"))}

SQL = {
    "p3_found": f"SELECT DISTINCT 'post_txt' AS field_name, k AS row_id FROM ({_FORM['posts']}) WHERE odd UNION ALL SELECT DISTINCT 'cand_match', k FROM ({_FORM['instances']}) WHERE odd",
    "p3_posts": f"SELECT k AS row_id, y AS text, odd FROM ({_FORM['posts']})",
    "p3_mentions": f"SELECT k AS row_id, y AS text, odd FROM ({_FORM['instances']})",
    "p6_found": _GROUPS.replace("@", _GROUP_OF_FILE),
    "p6_forest": _GROUPS.replace("@", _TREES),
    "p6_check": "SELECT count(DISTINCT file_name) AS n_files, CAST(0 AS BIGINT) AS n_torn FROM posts",
    "p8_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_check": "SELECT count(DISTINCT doc_id) AS n_docs, CAST(0 AS BIGINT) AS n_cut, CAST(0 AS BIGINT) AS n_overfull FROM documents",
    "p7_counts": _COUNTS,
    "p7_found": f"SELECT term, mark FROM ({_COUNTS}) WHERE mark IS NOT NULL",
    "p2_found": _COPIES + "SELECT first_id, post_id AS copy_id FROM (SELECT post_id, min(post_id) OVER (PARTITION BY k) AS first_id FROM keyed) WHERE post_id <> first_id",
    "p2_collapsed": _COPIES + "SELECT min(post_id) AS first_id, count(*) AS n_copies FROM keyed GROUP BY k",
}
