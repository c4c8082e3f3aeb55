"""Queries of problem 1 (core), and their twins by the JSON functions of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexweave.operators import nested
from lexweave.sources.tables import table


def _indexed(spark: SparkSession, root: str, fields: bool = True) -> DataFrame:
    return nested.index_matches(table(spark, root, "post_matches"), fields=fields)


QUERIES = {
    "p1_found": lambda s, d: nested.occurrences_table(_indexed(s, d, fields=False)),
    "p1_records": lambda s, d: nested.records_table(_indexed(s, d, fields=False)),
    "p1_matches": lambda s, d: nested.matches_table(_indexed(s, d)),
    "p1_alternatives": lambda s, d: nested.alternatives_table(_indexed(s, d)),
    "p1_sources": lambda s, d: nested.sources_table(_indexed(s, d)),
    "p1_members": lambda s, d: nested.members_table(_indexed(s, d)),
    "p1_nodes": lambda s, d: nested.nodes_table(table(s, d, "post_matches")),
}

_OPEN = "CASE WHEN json_valid({0}) THEN CASE WHEN json_type({0}) = 'VARCHAR' THEN {0}->>'$' ELSE {0} END END"
#: The last delivery of each record, opened where it is a JSON string; ``tree`` has every value of the readable ones.
_TREE = f"""WITH RECURSIVE last AS (SELECT rec_id, matches_found AS j FROM post_matches WHERE rec_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY loaded_at DESC) = 1),
  once AS (SELECT rec_id, {_OPEN.format('j')} AS j FROM last), twice AS (SELECT rec_id, {_OPEN.format('j')} AS j FROM once), recs AS (SELECT rec_id, CASE WHEN json_valid(j) AND trim(j) <> 'nan' AND json_type(j) <> 'VARCHAR' THEN j END AS j FROM twice),
  tree AS (SELECT rec_id, t.id, t.parent, t.key, t.type, t.atom FROM recs, json_tree(recs.j) t WHERE j IS NOT NULL),
  m AS (SELECT rec_id, id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY id) AS INTEGER) AS match_no FROM (SELECT DISTINCT rec_id, parent AS id FROM tree WHERE key IN ('cand_match', 'umls_match', 'all_match_occ'))),
  o(rec_id, match_no, id, type, atom) AS (SELECT t.rec_id, match_no, t.id, t.type, atom FROM tree t JOIN m ON m.rec_id = t.rec_id AND m.id = t.parent WHERE key = 'all_match_occ'
    UNION ALL SELECT t.rec_id, match_no, t.id, t.type, t.atom FROM tree t JOIN o ON o.rec_id = t.rec_id AND o.id = t.parent WHERE o.type = 'ARRAY' OR t.key IN ('start', 'occ')),
  places AS (SELECT rec_id, match_no, CAST(row_number() OVER (PARTITION BY rec_id, match_no ORDER BY id) AS INTEGER) AS occ_no, try_cast(trim(atom->>'$') AS BIGINT) AS occ FROM o WHERE type IN ('UBIGINT', 'BIGINT') OR (type = 'VARCHAR' AND regexp_full_match(atom->>'$', '\\s*-?\\d+\\s*')))"""
_TEXT = "(SELECT any_value(atom->>'$') FROM tree x WHERE x.rec_id = {0}.rec_id AND x.parent = {0}.id AND x.key = '{1}' AND x.type NOT IN ('OBJECT', 'ARRAY', 'NULL'))"
_BELOW = """{0} AS (SELECT p.rec_id, {1}, i.id, CAST(row_number() OVER (PARTITION BY p.rec_id, p.id ORDER BY i.id) AS INTEGER) AS {2} FROM {3} p JOIN tree a ON a.rec_id = p.rec_id AND a.parent = p.id AND a.key = '{4}' AND a.type = 'ARRAY'
    JOIN tree i ON i.rec_id = a.rec_id AND i.parent = a.id AND i.type = 'OBJECT')"""
_ALTS = _BELOW.format("alts", "match_no", "alt_no", "m", "alternatives")
_SOURCES = _BELOW.format("srcs", "match_no, alt_no", "source_no", "alts", "sources")
_NAMED = "'cand_match', 'umls_match', 'cui', 'match_eng', 'hebrew_key', 'match_tui', 'semantic_type', 'curr_occurence_offset', 'sim', 'all_match_occ', 'alternatives'"

SQL = {
    "p1_found": f"{_TREE} SELECT rec_id, match_no, occ_no, CAST(occ AS INTEGER) AS occ_start FROM places WHERE occ BETWEEN -2147483648 AND 2147483647",
    "p1_records": f"{_TREE} SELECT rec_id, j IS NOT NULL AS readable, CAST((SELECT count(*) FROM m WHERE m.rec_id = recs.rec_id) AS INTEGER) AS n_matches, CAST((SELECT count(*) FROM places p WHERE p.rec_id = recs.rec_id AND occ NOT BETWEEN -2147483648 AND 2147483647) AS INTEGER) AS n_unfit FROM recs",
    "p1_matches": f"""{_TREE}, {_ALTS} SELECT rec_id, match_no, {', '.join(f"{_TEXT.format('m', c)} AS {c}" for c in nested.MATCHES.texts if c != 'curr_occurence_offset')}, CAST({_TEXT.format('m', 'sim')} AS DOUBLE) AS sim, try_cast({_TEXT.format('m', 'curr_occurence_offset')} AS INTEGER) AS curr_occurence_offset,
    CAST((SELECT count(*) FROM places p WHERE p.rec_id = m.rec_id AND p.match_no = m.match_no) AS INTEGER) AS n_occ, CAST((SELECT count(*) FROM alts a WHERE a.rec_id = m.rec_id AND a.match_no = m.match_no) AS INTEGER) AS n_alternatives FROM m""",
    "p1_alternatives": f"{_TREE}, {_ALTS}, {_SOURCES} SELECT rec_id, match_no, alt_no, {_TEXT.format('alts', 'cui')} AS cui, CAST({_TEXT.format('alts', 'sim')} AS DOUBLE) AS sim, CAST((SELECT count(*) FROM srcs s WHERE s.rec_id = alts.rec_id AND s.match_no = alts.match_no AND s.alt_no = alts.alt_no) AS INTEGER) AS n_sources FROM alts",
    "p1_sources": f"{_TREE}, {_ALTS}, {_SOURCES} SELECT rec_id, match_no, alt_no, source_no, {_TEXT.format('srcs', 'stt')} AS stt, try_cast({_TEXT.format('srcs', 'rank')} AS INTEGER) AS rank FROM srcs",
    "p1_members": f"{_TREE} SELECT t.rec_id, match_no, key, CASE WHEN type = 'NULL' THEN NULL ELSE atom->>'$' END AS value FROM tree t JOIN m ON m.rec_id = t.rec_id AND m.id = t.parent WHERE key NOT IN ({_NAMED})",
    "p1_nodes": f"""{_TREE}, n AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY id) AS no FROM tree)
  SELECT n.rec_id, CAST(n.no AS INTEGER) AS node_no, CAST(p.no AS INTEGER) AS parent_no, CASE WHEN p.type = 'OBJECT' THEN n.key END AS key, CASE WHEN p.type = 'ARRAY' THEN CAST(n.key AS INTEGER) END AS item_no,
    CASE WHEN n.type = 'OBJECT' THEN 'object' WHEN n.type = 'ARRAY' THEN 'array' WHEN n.type = 'VARCHAR' THEN 'string' WHEN n.type = 'BOOLEAN' THEN 'boolean' WHEN n.type = 'NULL' THEN 'null' ELSE 'number' END AS kind,
    CASE WHEN n.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN n.atom->>'$' END AS value FROM n LEFT JOIN n p ON p.rec_id = n.rec_id AND p.id = n.parent""",
}
