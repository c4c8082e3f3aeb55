"""The linking queries in plain SQL, where it can express them over whole tables."""

from __future__ import annotations

from lexweave.config import CHEMICAL_TUIS, DISORDER_TUIS
from lexweave.functions.text import TOKEN_CLASSES, digraphs
from lexweave.plans.matching_sql import GRAMS as _GRAMS
from lexweave.plans.matching_sql import RELOCATED, gestalt, matches
from lexweave.plans.matching_sql import blank as _blank

_TYPE = f"CASE WHEN tui IN ({', '.join(repr(t) for t in DISORDER_TUIS)}) THEN 'Disorder' WHEN tui IN ({', '.join(repr(t) for t in CHEMICAL_TUIS)}) THEN 'Chemical or drug' END"
_COMMUNITY = "nullif(lower(regexp_extract({}, '(?i)(sclerosis|diabetes|depression)', 1)), '')"
_CURRENT = "cur AS (SELECT * FROM instances QUALIFY row_number() OVER (PARTITION BY inst_id ORDER BY loaded_at DESC) = 1)"
_TOKENS = "toks AS (SELECT post_id, list_filter(string_split(replace(tokenized_text, '.', ' '), ' '), lambda w: length(w) >= 2 OR regexp_matches(w, '^\\d+$')) AS l FROM posts WHERE tokenized_text IS NOT NULL)"
_ANNS = """anns AS (SELECT DISTINCT file_name, CAST(i - 1 AS INTEGER) AS ann_no, lower(trim(a.term)) AS term, a.start_offset AS start_offset, a.end_offset AS end_offset, a.label AS label
  FROM (SELECT file_name, unnest(merged_inner_and_outer) AS a, unnest(range(1, len(merged_inner_and_outer) + 1)) AS i FROM gold_labels WHERE file_name IS NOT NULL)
  WHERE a IS NOT NULL AND a.term IS NOT NULL AND a.start_offset IS NOT NULL)"""
_GOLD = f"{_ANNS}, gold AS (SELECT *, concat_ws('#', file_name, ann_no, start_offset, term) AS gold_id, {_COMMUNITY.format('file_name')} AS community FROM anns), texts AS (SELECT file_name, min(text) AS text FROM gold_labels WHERE file_name IS NOT NULL GROUP BY file_name)"
_PRED = f"""{_CURRENT}, pred AS (SELECT inst_id AS pred_id, inst_id AS ann_no, file_name, lower(cand_match) AS term, curr_occurence_offset AS start_offset, curr_occurence_offset + length(cand_match) AS end_offset, semantic_type AS label, {_COMMUNITY.format('file_name')} AS community
  FROM cur WHERE pred_10_window > 0.3 AND file_name IS NOT NULL AND cand_match IS NOT NULL AND curr_occurence_offset IS NOT NULL AND file_name IN (SELECT file_name FROM gold_labels))"""
_SCORED = f"{_CURRENT}, scored AS (SELECT {_COMMUNITY.format('file_name')} AS community, semantic_type, yi, pred_10_window AS score, CAST(pred_10_window > 0.5 AS INTEGER) AS hard FROM cur WHERE yi IS NOT NULL AND pred_10_window IS NOT NULL)"


def _bio(name: str, spans: str) -> str:
    return f"""{name}_s AS (SELECT s.file_name, s.ann_no, s.label, replace(trim(s.term, ' '), '-', ' ') AS term, string_split({_blank('t.text')}, ' ') AS w,
    length(substr({_blank('t.text')}, 1, s.start_offset + 1)) - length(replace(substr({_blank('t.text')}, 1, s.start_offset + 1), ' ', '')) AS first FROM {spans} s JOIN texts t USING (file_name)),
  {name}_n AS (SELECT *, len(list_filter(string_split(term, ' '), lambda x: x <> '')) AS n FROM {name}_s),
  {name}_p AS (SELECT *, term AS x, array_to_string(w[first + 1 : first + n], ' ') AS y FROM {name}_n WHERE n > 0 AND first + n <= len(w)),
  {gestalt(f'{name}_g', f'{name}_p')},
  {name}_ok AS (SELECT * FROM {name}_p JOIN {name}_g USING (x, y) WHERE ratio >= 0.72::DOUBLE),
  {name}_t AS (SELECT file_name, ann_no, first + i AS idx, (CASE WHEN i = 0 THEN 'B-' ELSE 'I-' END) || substr(label, 1, 1) AS tag FROM (SELECT *, unnest(range(n)) AS i FROM {name}_ok)),
  {name}_l AS (SELECT file_name, idx, arg_max(tag, ann_no) AS tag FROM {name}_t GROUP BY file_name, idx),
  {name} AS (SELECT k.file_name, CAST(k.idx AS INTEGER) AS idx, k.w, coalesce(l.tag, 'O') AS tag FROM
    (SELECT file_name, unnest(string_split({_blank('text')}, ' ')) AS w, unnest(range(len(string_split({_blank('text')}, ' ')))) AS idx FROM texts) k LEFT JOIN {name}_l l USING (file_name, idx))"""


_CONFUSION = f"WITH RECURSIVE {_GOLD}, {_PRED}, {_bio('gb', 'gold')}, {_bio('pb', 'pred')}, conf AS (SELECT gb.tag AS true_tag, pb.tag AS pred_tag, count(*) AS n FROM gb JOIN pb USING (file_name, idx) GROUP BY ALL)"
_COMPARED = f"""  near AS (SELECT gold_id, pred_id, g.term AS gt, p.term AS pt FROM gold g JOIN pred p ON g.file_name = p.file_name AND g.label = p.label AND abs(g.start_offset - p.start_offset) <= 2),
  both_ways AS (SELECT gt AS x, pt AS y FROM near UNION SELECT pt, gt FROM near),
  {gestalt('ratios', 'both_ways')},
  gold_hits AS (SELECT gold_id FROM near JOIN ratios ON x = gt AND y = pt WHERE ratio > 0.8::DOUBLE),
  pred_hits AS (SELECT pred_id FROM near JOIN ratios ON x = pt AND y = gt WHERE ratio > 0.8::DOUBLE),
  errors AS (SELECT community, file_name, label, term, start_offset, CASE WHEN gold_id IN (SELECT gold_id FROM gold_hits) THEN 'TP' ELSE 'FN' END AS kind FROM gold
    UNION ALL SELECT community, file_name, label, term, start_offset, 'FP' FROM pred WHERE pred_id NOT IN (SELECT pred_id FROM pred_hits))"""
_ERRORS = f"WITH RECURSIVE {_GOLD}, {_PRED}, {_COMPARED}"
_BASELINE = f"WITH RECURSIVE {_GOLD}, {_PRED.replace('pred_10_window > 0.3 AND', '')}, {_COMPARED}"
_METRICS = "k AS (SELECT {0}, count(*) FILTER (kind = 'TP') AS tp, count(*) FILTER (kind = 'FP') AS fp, count(*) FILTER (kind = 'FN') AS fn FROM errors GROUP BY ALL), r AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, 2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0) AS f1 FROM k)"
_LABELS = f"""WITH RECURSIVE {_ANNS}, {_CURRENT},
  near AS (SELECT i.inst_id, i.file_name, a.ann_no, a.term, a.label, a.start_offset, lower(i.cand_match) AS cand, lower(i.umls_match) AS kb FROM cur i JOIN anns a ON a.file_name = i.file_name
    AND abs(i.curr_occurence_offset - a.start_offset) <= @chars AND abs(i.curr_occurence_offset + length(i.cand_match) - a.end_offset) <= @chars),
  pairs AS (SELECT term AS x, cand AS y FROM near UNION SELECT term, kb FROM near),
  {gestalt('ratios', 'pairs')},
  fits AS (SELECT near.* FROM near LEFT JOIN ratios a ON a.x = term AND a.y = cand LEFT JOIN ratios b ON b.x = term AND b.y = kb WHERE @fits),
  best AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY inst_id ORDER BY ann_no DESC, start_offset DESC, term DESC) = 1),
  labelled AS (SELECT cur.inst_id, cur.file_name, CAST(best.inst_id IS NOT NULL AS INTEGER) AS yi, best.ann_no, best.term, best.label FROM cur LEFT JOIN best USING (inst_id)),
  left_over AS (SELECT * FROM anns WHERE NOT EXISTS (SELECT 1 FROM labelled l WHERE l.yi = 1 AND l.file_name = anns.file_name AND l.ann_no = anns.ann_no))"""
_LABELS_CAND = _LABELS.replace("@chars", "3").replace("@fits", "a.ratio >= 0.8::DOUBLE")
_LABELS_LEMMA = _LABELS.replace("@chars", "4").replace("@fits", "greatest(a.ratio, coalesce(b.ratio, 0)) > 0.8::DOUBLE")
_BINARY = """CAST(sum(CASE WHEN yi = 1 AND {h} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN yi = 0 AND {h} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN yi = 1 AND {h} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN yi = 0 AND {h} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn"""
_RATES = """(tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1"""
_SWEEP = f"""WITH {_SCORED}, grid AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold),
  counts AS (SELECT semantic_type, threshold, {_BINARY.format(h='CAST(score > threshold AS INTEGER)')} FROM scored, grid GROUP BY semantic_type, threshold),
  sweep AS (SELECT *, {_RATES} FROM counts)"""
_LATTICE = "SELECT post_id, unnest(words_and_lemmas) AS x, unnest(range(len(words_and_lemmas))) AS i FROM posts WHERE words_and_lemmas IS NOT NULL"
_WORDROWS = "wl AS (SELECT post_id, CAST(i AS INTEGER) AS pos, substr(x, instr(x, ' ') + 1) AS word, coalesce(nullif(string_split(x, ' ')[1], ''), substr(x, instr(x, ' ') + 1)) AS lemma, CAST(i % 12 + 1 AS INTEGER) AS num FROM (" + _LATTICE + "))"
_SENTENCE = _WORDROWS + ", st AS (SELECT *, CAST(num = 1 AND coalesce(lag(num) OVER (PARTITION BY post_id ORDER BY pos) <> 1, true) AS INTEGER) AS b FROM wl), sn AS (SELECT *, CAST(sum(b) OVER (PARTITION BY post_id ORDER BY pos) AS BIGINT) AS sentence FROM st)"
_DICT = "dict AS (SELECT lower(match_eng) AS term, arg_max(relatedness, (inst_id, relatedness)) AS score FROM instances WHERE match_eng IS NOT NULL AND relatedness IS NOT NULL AND NOT isnan(relatedness) GROUP BY lower(match_eng))"
_TRIPLES = """words AS (SELECT list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
  tri AS (SELECT w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3, count(*) AS n FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3) GROUP BY ALL),
  lm AS (SELECT w1, w2, w3, n::DOUBLE / sum(n) OVER (PARTITION BY w1, w2) AS p FROM tri)"""
_SPLIT_PARTS = "string_split(lower(post_txt), lower(cand_match))"
_OFFSETS = f"CASE WHEN length(cand_match) > 0 AND len({_SPLIT_PARTS}) > 1 THEN list_transform(range(1, len({_SPLIT_PARTS})), lambda i: CAST(list_sum(list_transform({_SPLIT_PARTS}[1:i], lambda x: length(x))) + (i - 1) * length(cand_match) AS INTEGER)) ELSE [] END"
_CLASS = " ".join(f"WHEN regexp_full_match(token, {chr(39)}{p.replace(chr(39), chr(39) * 2)}{chr(39)}) THEN '{n}'" for n, p in TOKEN_CLASSES[:-1])
_TOKEN = (r"\s+|" + "|".join(p for _, p in TOKEN_CLASSES)).replace("'", "''")
_COSINE = f"""WITH c AS (SELECT gram, len(string_split(gram, ' ')) AS n, {_GRAMS.format('gram')} AS b FROM (SELECT DISTINCT lower(cand_match) AS gram FROM instances WHERE cand_match IS NOT NULL) WHERE len(string_split(gram, ' ')) <= 3),
  t AS (SELECT term, {_GRAMS.format('term')} AS b FROM (SELECT DISTINCT term FROM (SELECT heb AS term FROM lexicon UNION ALL SELECT lower(str) FROM lexicon) WHERE term IS NOT NULL AND term <> '')),
  o AS (SELECT gram, term, count(*) AS overlap FROM (SELECT gram, unnest(b) AS g FROM c) JOIN (SELECT term, unnest(b) AS g FROM t) USING (g) GROUP BY gram, term),
  s AS (SELECT gram, CAST(c.n AS INTEGER) AS n, term, CAST(overlap AS INTEGER) AS overlap, CAST(overlap * overlap AS DOUBLE) / (len(c.b) * len(t.b)) AS r, len(c.b) * len(t.b) AS sizes FROM o JOIN c USING (gram) JOIN t USING (term))
  SELECT gram, n, term, overlap FROM s WHERE CAST(overlap * overlap AS DOUBLE) >= (CASE WHEN n = 1 THEN 0.78::DOUBLE * 0.78::DOUBLE ELSE 0.83::DOUBLE * 0.83::DOUBLE END) * CAST(sizes AS DOUBLE)
  QUALIFY row_number() OVER (PARTITION BY gram ORDER BY r DESC, term) = 1"""
_MORPHOLOGY = f"""WITH RECURSIVE {_CURRENT}, files AS (SELECT file_name, arg_min(words_and_lemmas, post_id) AS wl FROM posts WHERE file_name IS NOT NULL AND words_and_lemmas IS NOT NULL GROUP BY file_name),
  rows AS (SELECT file_name, CAST(i AS INTEGER) AS pos, substr(x, instr(x, ' ') + 1) AS word, coalesce(nullif(string_split(x, ' ')[1], ''), substr(x, instr(x, ' ') + 1)) AS lemma FROM (SELECT file_name, unnest(wl) AS x, unnest(range(len(wl))) AS i FROM files)),
  context AS (SELECT *, lag(word) OVER w AS before, lead(word) OVER w AS after, lead(word, 2) OVER w AS after2 FROM rows WINDOW w AS (PARTITION BY file_name ORDER BY pos)),
  i AS (SELECT inst_id, file_name, cand_match, string_split(cand_match, ' ')[1] AS head, len(string_split(cand_match, ' ')) AS n, len(all_match_occ) AS n_occ, coalesce(list_position(all_match_occ, curr_occurence_offset), 0) AS k FROM cur WHERE file_name IS NOT NULL AND cand_match IS NOT NULL),
  all_pairs AS (SELECT * FROM i JOIN context USING (file_name)),
  heads AS (SELECT word AS x, head AS y FROM all_pairs UNION SELECT lemma, head FROM all_pairs), {gestalt('head_ratio', 'heads')},
  by_word AS (SELECT *, count(*) OVER (PARTITION BY inst_id) AS hits, row_number() OVER (PARTITION BY inst_id ORDER BY pos) AS place FROM all_pairs JOIN head_ratio ON x = word AND y = head WHERE ratio > 0.88::DOUBLE),
  by_lemma AS (SELECT *, count(*) OVER (PARTITION BY inst_id) AS hits, row_number() OVER (PARTITION BY inst_id ORDER BY pos) AS place FROM all_pairs JOIN head_ratio ON x = lemma AND y = head WHERE ratio > 0.88::DOUBLE),
  said AS (SELECT *, CASE WHEN n = 1 THEN before || word ELSE before || word || ' ' || after END AS spelled, CASE WHEN n = 1 THEN word WHEN n = 2 THEN concat_ws(' ', word, after) ELSE concat_ws(' ', word, after, after2) END AS follows FROM by_word),
  follow_pairs AS (SELECT follows AS x, cand_match AS y FROM said), {gestalt('follow_ratio', 'follow_pairs')},
  ways AS (SELECT inst_id, pos, word, lemma, fs, CASE WHEN hits = n_occ AND place = k THEN 1 WHEN spelled = cand_match THEN 3 WHEN fs > 0.88::DOUBLE THEN 4 END AS step FROM (SELECT s.*, f.ratio AS fs FROM said s JOIN follow_ratio f ON f.x = s.follows AND f.y = s.cand_match)
    UNION ALL SELECT inst_id, pos, word, lemma, 0, 2 FROM by_lemma WHERE hits = n_occ AND place = k),
  sure AS (SELECT inst_id, pos, step, word, lemma FROM ways WHERE step IS NOT NULL QUALIFY row_number() OVER (PARTITION BY inst_id ORDER BY step, CASE WHEN step = 4 THEN -fs ELSE 0 END, pos) = 1),
  rest AS (SELECT inst_id, pos, 5 AS step, word, lemma FROM all_pairs JOIN head_ratio ON x = word AND y = head WHERE inst_id NOT IN (SELECT inst_id FROM sure) QUALIFY row_number() OVER (PARTITION BY inst_id ORDER BY ratio DESC, pos) = 1)
  SELECT inst_id, pos, step, word, lemma FROM sure UNION ALL SELECT inst_id, pos, step, word, lemma FROM rest"""
_WINDOW_WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"
_WINDOWS = f"""WITH {_CURRENT}, words AS (SELECT doc_id, {_WINDOW_WORDS.format(_blank('text'))} AS w FROM documents WHERE text IS NOT NULL),
  flat AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM words),
  totals AS (SELECT word, count(*) AS total FROM flat GROUP BY word),
  near AS (SELECT b.i - a.i AS distance, a.word AS before, b.word AS term, count(*) AS n FROM (SELECT * FROM flat SEMI JOIN (SELECT cand_match AS word FROM cur) c USING (word)) b JOIN flat a ON a.doc_id = b.doc_id AND a.i BETWEEN b.i - 10 AND b.i - 1 GROUP BY ALL),
  lm AS (SELECT distance, before, term, n::DOUBLE / total AS p FROM near JOIN totals ON word = before),
  asked AS (SELECT inst_id, cand_match AS term, unnest(['3', '6', '10']) AS size, unnest([{', '.join(_WINDOW_WORDS.format(f'match_{k}_window') for k in (3, 6, 10))}]) AS w FROM cur),
  each AS (SELECT inst_id, size, term, w[i] AS before, len(w) - i + 1 AS distance FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM asked)),
  p AS (SELECT inst_id, size, sum(power(0.5::DOUBLE, distance) * coalesce(p, 0)) / sum(power(0.5::DOUBLE, distance)) AS p FROM each LEFT JOIN lm USING (distance, before, term) GROUP BY ALL)
  SELECT c.inst_id, coalesce(a.p, 0) AS pred_3_window, coalesce(b.p, 0) AS pred_6_window, coalesce(d.p, 0) AS pred_10_window FROM cur c LEFT JOIN p a ON a.inst_id = c.inst_id AND a.size = '3' LEFT JOIN p b ON b.inst_id = c.inst_id AND b.size = '6' LEFT JOIN p d ON d.inst_id = c.inst_id AND d.size = '10'"""

_STOP = "regexp_matches({}, '^[!|.?]')"
_SENTENCES = f"""WITH x AS (SELECT post_id, list_filter(string_split_regex(tokenized_text, '\\s+'), lambda w: w <> '') AS w FROM posts WHERE tokenized_text IS NOT NULL),
  e AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: {_STOP.format('w[i]')} AND (i = len(w) OR NOT {_STOP.format('w[i + 1]')})) AS ends FROM x),
  s AS (SELECT post_id, w, ends, unnest(list_concat([0], ends)) AS b, unnest(list_concat(ends, [len(w)])) AS e, unnest(range(1, len(ends) + 2)) AS j FROM e),
  c AS (SELECT *, CASE WHEN j <= len(ends) AND e - b > 150 THEN CAST(ceil((e - b - 150) / 140.0) AS BIGINT) + 1 ELSE 1 END AS many FROM s WHERE e > b),
  k AS (SELECT *, unnest(range(1, many + 1)) AS k FROM c)
  SELECT post_id, CAST(row_number() OVER (PARTITION BY post_id ORDER BY b, k) - 1 AS INTEGER) AS sentence_no, array_to_string(w[b + (k - 1) * 140 + 1 : CASE WHEN k = many THEN e ELSE b + k * 140 END], ' ') AS sentence FROM k"""


def _replaced(x: str) -> str:
    for a, b in (*digraphs().items(), ("\u200d", "")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _letters_in(window: str) -> str:
    return f"CASE WHEN {window} IS NULL OR cand_match IS NULL THEN 0.0::DOUBLE ELSE coalesce(list_sum(list_transform(string_split(cand_match, ''), lambda c: CASE WHEN contains({window}, c) THEN 1 ELSE 0 END)), 0)::DOUBLE / greatest(1, length(cand_match)) END"


SQL = {
    "sentences": _SENTENCES,
    "one_spelling": f"SELECT post_id, {_replaced('post_txt')} AS t FROM posts",
    "window_probability": f"WITH {_CURRENT} SELECT inst_id, {', '.join(f'{_letters_in(f"match_{k}_window")} AS pred_{k}_window' for k in (3, 6, 10))} FROM cur",
    "post_matches_located": f"{matches(_TYPE.replace('tui', 'm.tui'))} SELECT * FROM matches",
    "post_matches_relocated": RELOCATED,
    "matches_by_community": f"{matches(_TYPE.replace('tui', 'm.tui'))} SELECT community, semantic_type, count(*) AS n_matches, count(DISTINCT cui) AS n_concepts, count(DISTINCT post_id) AS n_posts FROM matches JOIN posts USING (post_id) GROUP BY community, semantic_type",
    "morphology_row": _MORPHOLOGY,
    "window_features": _WINDOWS,
    "blank_punctuation": f"SELECT post_id, {_blank('post_txt')} AS t FROM posts",
    "english_text": "SELECT post_id, array_to_string(list_transform(list_filter(string_split(post_txt, ' '), lambda w: length(w) > 2 AND regexp_matches(w, '[A-Za-z]')), lambda w: lower(w)), ' ') AS t FROM posts",
    "cleaned_text": r"SELECT post_id, regexp_replace(regexp_replace(translate(post_txt, chr(10) || chr(13), '  '), '[^א-ת\s.,!?a-zA-Z]', ' ', 'g'), '  +', ' ', 'g') AS t FROM posts",
    "parser_input": "SELECT post_id, translate(post_txt, chr(10) || '.,', '   ') AS t FROM posts",
    "display_words": "SELECT post_id, CAST(i AS INTEGER) AS pos, CASE WHEN regexp_matches(w, '[A-Za-z]') THEN lower(w) ELSE w END AS w FROM (SELECT post_id, unnest(string_split(tokenized_text, ' ')) AS w, unnest(range(len(string_split(tokenized_text, ' ')))) AS i FROM posts WHERE tokenized_text IS NOT NULL)",
    "usable_tokens": f"WITH {_TOKENS} SELECT post_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS token FROM toks",
    "classed_tokens": rf"WITH x AS (SELECT post_id, list_filter(regexp_extract_all(post_txt, '{_TOKEN}'), lambda t: NOT regexp_matches(t, '^\s+$')) AS l FROM posts WHERE post_txt IS NOT NULL) SELECT post_id, CAST(i AS INTEGER) AS pos, CASE {_CLASS} ELSE 'JUNK' END AS class, token FROM (SELECT post_id, unnest(l) AS token, unnest(range(len(l))) AS i FROM x)",
    "post_ngrams": f"WITH {_TOKENS}, g AS (SELECT post_id, list_concat(l, ['PAD', 'PAD']) AS p, unnest(range(len(l))) AS i FROM toks) SELECT post_id, CAST(i AS INTEGER) AS pos, CAST(n AS INTEGER) AS n, array_to_string(p[i + 1 : i + n], ' ') AS gram FROM g, (SELECT unnest([1, 2, 3]) AS n)",
    "semantic_types": f"SELECT lex_idx, tui, {_TYPE} AS semantic_type FROM lexicon",
    "lexicon_union": "SELECT row_number() OVER (ORDER BY CASE source_file WHEN 'kb' THEN 0 WHEN 'acronyms' THEN 1 ELSE 2 END, lex_idx) - 1 AS lex_idx, cui, str, heb FROM lexicon WHERE source_file IN ('kb', 'acronyms', 'not_in_kb')",
    "lexicon_priority_heb": "SELECT heb AS form, cui, lex_idx FROM lexicon WHERE heb IS NOT NULL QUALIFY row_number() OVER (PARTITION BY heb ORDER BY CASE WHEN stt = 'PF' THEN 0 ELSE 1 END, lex_idx) = 1",
    "lexicon_priority_eng": "SELECT lower(str) AS form, cui, lex_idx FROM lexicon WHERE str IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(str) ORDER BY lex_idx) = 1",
    "sample_terms": f"SELECT semantic_type, lex_idx, str FROM (SELECT *, {_TYPE} AS semantic_type FROM lexicon WHERE str IS NOT NULL) WHERE semantic_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY semantic_type ORDER BY md5(concat_ws(':', lex_idx, str)), lex_idx) <= 100",
    "cosine_match": _COSINE,
    "occurrences": f"WITH {_CURRENT}, o AS (SELECT inst_id, {_OFFSETS} AS l FROM cur WHERE post_txt IS NOT NULL AND cand_match IS NOT NULL) SELECT inst_id, CAST(unnest(range(len(l))) AS INTEGER) AS k, unnest(l) AS start_offset FROM o",
    "kth_occurrence": f"WITH {_CURRENT}, o AS (SELECT inst_id, CAST(row_number() OVER (PARTITION BY file_name, lower(cand_match) ORDER BY inst_id) AS INTEGER) AS k, {_OFFSETS} AS l FROM cur WHERE file_name IS NOT NULL AND cand_match IS NOT NULL AND post_txt IS NOT NULL) SELECT inst_id, k, l[k] AS start_offset FROM o",
    "every_occurrence": 'SELECT DISTINCT file_name, cand_match, umls_match, unnest(all_match_occ) AS "offset" FROM instances',
    "kept_spans": f"""WITH {_CURRENT}, g AS (SELECT file_name, umls_match, list([{{'i': inst_id, 's': curr_occurence_offset, 'e': CAST(curr_occurence_offset + length(cand_match) AS INTEGER)}}] ORDER BY inst_id) AS l FROM cur
    WHERE file_name IS NOT NULL AND umls_match IS NOT NULL AND cand_match IS NOT NULL AND curr_occurence_offset IS NOT NULL GROUP BY file_name, umls_match),
  k AS (SELECT file_name, umls_match, unnest(list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda y: abs(y.s - b[1].s) <= 2 AND abs(y.e - b[1].e) <= 2)) > 0 THEN a ELSE list_concat(a, b) END)) AS x FROM g)
  SELECT file_name, umls_match, x.i AS inst_id, x.s AS start_offset, x.e AS end_offset FROM k""",
    "gestalt_match": f"""WITH RECURSIVE near AS (SELECT *, term AS x, gram AS y FROM ({_COSINE}) WHERE length(term) > 3 AND len(string_split(term, ' ')) = n), {gestalt('ratios', 'near')}
  SELECT gram, term, ratio FROM near JOIN ratios USING (x, y) WHERE ratio > CASE WHEN n = 1 THEN 0.85::DOUBLE ELSE 0.90::DOUBLE END""",
    "most_specific": f"""WITH RECURSIVE {_CURRENT}, m AS (SELECT inst_id, file_name, umls_match, string_split(umls_match, ' ') AS w, curr_occurence_offset AS s, curr_occurence_offset + length(cand_match) AS e FROM cur WHERE file_name IS NOT NULL AND cand_match IS NOT NULL AND umls_match IS NOT NULL AND curr_occurence_offset IS NOT NULL),
  near AS (SELECT a.inst_id, a.umls_match AS y, array_to_string(b.w[1 : len(a.w)], ' ') AS front, array_to_string(b.w[len(a.w) + 1 :], ' ') AS back FROM m a JOIN m b ON a.file_name = b.file_name AND len(b.w) > len(a.w) AND (abs(a.s - b.s) <= 2 OR abs(a.e - b.e) <= 2) AND length(b.w[len(a.w) + 1]) >= 3),
  parts AS (SELECT inst_id, front AS x, y FROM near UNION SELECT inst_id, back, y FROM near), {gestalt('ratios', 'parts')}
  SELECT inst_id FROM cur WHERE inst_id NOT IN (SELECT inst_id FROM parts JOIN ratios USING (x, y) WHERE ratio > 0.88::DOUBLE)""",
    "context_windows": f"""WITH {_CURRENT}, w AS (SELECT inst_id, list_filter(string_split(substr({_blank('post_txt')}, 1, greatest(curr_occurence_offset - 1, 0)), ' '), lambda x: x <> '') AS w FROM cur WHERE post_txt IS NOT NULL AND curr_occurence_offset IS NOT NULL)
  SELECT inst_id, {', '.join(f"array_to_string(w[greatest(len(w) - {k - 1}, 1) : len(w)], ' ') AS window_{k}" for k in (3, 6, 10))} FROM w""",
    "instances_from_posts": f"""{matches(_TYPE.replace('tui', 'm.tui'))},
  m AS (SELECT *, row_number() OVER () AS id, string_split(umls_match, ' ') AS w, curr_occurence_offset AS s, curr_occurence_offset + length(cand_match) AS e FROM matches),
  near_m AS (SELECT a.id, a.umls_match AS y, array_to_string(b.w[1 : len(a.w)], ' ') AS front, array_to_string(b.w[len(a.w) + 1 :], ' ') AS back FROM m a JOIN m b ON a.post_id = b.post_id AND len(b.w) > len(a.w) AND (abs(a.s - b.s) <= 2 OR abs(a.e - b.e) <= 2) AND length(b.w[len(a.w) + 1]) >= 3),
  parts AS (SELECT id, front AS x, y FROM near_m UNION SELECT id, back, y FROM near_m), {gestalt('covering', 'parts')},
  specific AS (SELECT m.*, list_filter(string_split(substr(t, 1, greatest(s - 1, 0)), ' '), lambda x: x <> '') AS before FROM m JOIN shown USING (post_id) WHERE id NOT IN (SELECT id FROM parts JOIN covering USING (x, y) WHERE ratio > 0.88::DOUBLE))
  SELECT post_id, posts.file_name, cand_match, umls_match, CASE WHEN view < 4 THEN coalesce(f.name, umls_match) ELSE umls_match END AS match_eng,
    CASE WHEN regexp_matches(cand_match, '[A-Za-z]') THEN 'tokenized_text' ELSE ['post_txt', 'tokenized_text', 'segmented_text', 'lemmas', 'tokenized_text'][view + 1] END AS match_type, f.tui AS match_tui, semantic_type, curr_occurence_offset,
    {', '.join(f"array_to_string(before[greatest(len(before) - {k - 1}, 1) : len(before)], ' ') AS match_{k}_window" for k in (3, 6, 10))}
  FROM specific JOIN posts USING (post_id) JOIN forms f ON f.term = umls_match AND f.eng = (view = 4)""",
    "instance_views": f"WITH {_CURRENT} SELECT inst_id, CASE WHEN regexp_matches(cand_match, '[A-Za-z]') THEN 'tokenized_text' ELSE match_type END AS match_type, coalesce(match_eng, umls_match) AS name FROM cur",
    "first_posts": "SELECT min(post_id) AS post_id FROM posts GROUP BY post_txt, lemmas",
    "labelled_posts": "SELECT post_id, file_name FROM posts WHERE trim(post_txt, ' ') IN (SELECT trim(text, ' ') FROM gold_labels)",
    "corpus_counts": "SELECT token, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents WHERE text IS NOT NULL) GROUP BY token",
    "count_features": "WITH c AS (SELECT token, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents WHERE text IS NOT NULL) GROUP BY token) SELECT t.term, coalesce(c.n, 0) AS match_count, coalesce(c.n, 0)::DOUBLE / (SELECT count(*) FROM c) AS match_freq FROM (SELECT DISTINCT umls_match AS term FROM instances WHERE umls_match IS NOT NULL) t LEFT JOIN c ON c.token = t.term",
    "bigram_model": f"WITH {_TRIPLES} SELECT w1, w2, w3, p FROM lm",
    "bigram_feature": f"WITH {_TRIPLES}, {_CURRENT}, q AS (SELECT inst_id, cand_match AS w3, string_split(match_3_window, ' ')[2:] AS c FROM cur) SELECT q.inst_id, coalesce(lm.p, 0) AS pred_2_window FROM q LEFT JOIN lm ON len(q.c) = 2 AND lm.w1 = q.c[1] AND lm.w2 = q.c[2] AND lm.w3 = q.w3",
    "relatedness": f"WITH {_DICT}, t AS (SELECT DISTINCT lower(str) AS term FROM lexicon WHERE str IS NOT NULL) SELECT t.term, coalesce(CASE WHEN t.term IN (SELECT lower(str) FROM lexicon WHERE source_file = 'not_in_kb' AND str IS NOT NULL) THEN 1.0::DOUBLE END, a.score, b.score, -1.0::DOUBLE) AS relatedness FROM t LEFT JOIN dict a ON a.term = t.term LEFT JOIN dict b ON b.term = trim(string_split(t.term, '(')[1], ' ')",
    "missing_terms": f"WITH {_DICT} SELECT concat_ws('<>', community, term) AS line FROM (SELECT DISTINCT {_COMMUNITY.format('file_name')} AS community, lower(match_eng) AS term FROM instances WHERE file_name IS NOT NULL AND match_eng IS NOT NULL) WHERE term NOT IN (SELECT term FROM dict WHERE score >= 0)",
    "missing_counts": f"WITH {_DICT} SELECT lower(match_eng) AS term, count(*) AS n FROM instances WHERE match_eng IS NOT NULL AND lower(match_eng) NOT IN (SELECT term FROM dict WHERE score >= 0) GROUP BY lower(match_eng)",
    "lattice": f"SELECT post_id, CAST(i AS INTEGER) AS line_no, string_split(x, ' ')[-1] AS word, coalesce(nullif(string_split(x, ' ')[1], ''), string_split(x, ' ')[-1]) AS lemma, 'FM' AS gen, 'S' AS num_s_p, CAST(i + 1 AS INTEGER) AS num_last FROM ({_LATTICE})",
    "dependency_tree": f"SELECT post_id, CAST(i AS INTEGER) AS line_no, CAST(i + 1 AS VARCHAR) AS num, string_split(x, ' ')[-1] AS word, string_split(x, ' ')[-1] AS lemma, 'obj' AS dependency_part, '-1' AS dependency_arc_2 FROM ({_LATTICE})",
    "sentence_numbers": f"WITH {_SENTENCE} SELECT post_id, pos, sentence FROM sn",
    "token_groups": f"WITH {_SENTENCE} SELECT post_id, sentence, arg_min(word, (-length(word), pos)) AS word, arg_min(lemma, (-length(lemma), pos)) AS lemma FROM sn GROUP BY post_id, sentence",
    "labels_gestalt": f"{_LABELS_CAND} SELECT inst_id, yi, ann_no, term, label FROM labelled",
    "labels_lemma": f"{_LABELS_LEMMA} SELECT inst_id, yi, ann_no, term, label FROM labelled",
    "labels_unmatched": f"{_LABELS_CAND} SELECT file_name, ann_no, term, start_offset, end_offset, label FROM left_over",
    "labels_could_be_matched": f"""{_LABELS_CAND}, with_matches AS (SELECT l.file_name, l.term AS x, lower(c.cand_match) AS y FROM left_over l JOIN cur c ON c.file_name = l.file_name WHERE c.cand_match IS NOT NULL), {gestalt('alike', 'with_matches')}
  SELECT file_name, count(*) AS pairs FROM with_matches JOIN alike USING (x, y) WHERE ratio > 0.8::DOUBLE GROUP BY file_name""",
    "labels_missed_terms": f"{_LABELS_CAND} SELECT term, count(*) AS n FROM left_over WHERE length(replace({_blank('term')}, ' ', '')) > 3 AND term NOT IN (SELECT lower(heb) FROM lexicon WHERE source_file = 'not_in_kb' AND heb IS NOT NULL) GROUP BY term",
    "labels_registered": f"""WITH {_ANNS}, o AS (SELECT file_name, list([{{'ann_no': ann_no, 'term': term, 'start_offset': start_offset, 'end_offset': end_offset, 'label': label}}] ORDER BY ann_no, term, start_offset, end_offset, label) AS l FROM anns GROUP BY file_name),
  k AS (SELECT file_name, unnest(list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda z: z.term = b[1].term AND abs(z.start_offset - b[1].start_offset) <= 3 AND abs(z.end_offset - b[1].end_offset) <= 3)) > 0 THEN a ELSE list_concat(a, b) END)) AS y FROM o)
  SELECT file_name, y.ann_no AS ann_no, y.term AS term, y.start_offset AS start_offset, y.end_offset AS end_offset, y.label AS label FROM k""",
    "hold_out": "WITH f AS (SELECT file_name, row_number() OVER (ORDER BY file_name) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT file_name FROM gold_labels WHERE file_name IS NOT NULL)) SELECT file_name, CASE WHEN rn > n - ceil(n * 0.25) THEN 'test' ELSE 'train' END AS split FROM f",
    "spans_in_place": f"""WITH RECURSIVE {_GOLD}, p AS (SELECT g.file_name, g.ann_no, g.term AS y, substr(t.text, g.start_offset + 1, greatest(g.end_offset - g.start_offset, 0)) AS x FROM gold g JOIN texts t USING (file_name)), {gestalt('ratios', 'p')}
  SELECT file_name, ann_no, y AS term, coalesce(ratio > 0.72::DOUBLE, false) AS ok FROM p LEFT JOIN ratios USING (x, y)""",
    "span_lists": f"WITH {_GOLD} SELECT file_name, list(concat_ws(':', start_offset, end_offset, label, term) ORDER BY start_offset NULLS FIRST, end_offset NULLS FIRST, label NULLS FIRST, term) AS spans FROM gold GROUP BY file_name",
    "bio_tokens": f"WITH RECURSIVE {_GOLD}, {_bio('gb', 'gold')} SELECT file_name, idx, w, tag FROM gb",
    "tokenisation_problems": f"WITH RECURSIVE {_GOLD}, {_bio('gb', 'gold')} SELECT file_name, ann_no, term FROM gold WHERE (file_name, ann_no) NOT IN (SELECT (file_name, ann_no) FROM gb_ok)",
    "token_confusion": f"{_CONFUSION} SELECT true_tag, pred_tag, n FROM conf",
    "token_confusion_io": f"{_CONFUSION} SELECT CASE WHEN true_tag = 'O' THEN 'O' ELSE string_split(true_tag, '-')[2] END AS true_tag, CASE WHEN pred_tag = 'O' THEN 'O' ELSE string_split(pred_tag, '-')[2] END AS pred_tag, CAST(sum(n) AS BIGINT) AS n FROM conf GROUP BY 1, 2",
    "token_metrics": f"""{_CONFUSION}, tags AS (SELECT DISTINCT tag FROM (SELECT true_tag AS tag FROM conf UNION ALL SELECT pred_tag FROM conf) WHERE tag <> 'O'),
  k AS (SELECT tag, coalesce(sum(CASE WHEN true_tag = tag AND pred_tag = tag THEN n END), 0)::DOUBLE AS tp, coalesce(sum(CASE WHEN true_tag <> tag AND pred_tag = tag THEN n END), 0)::DOUBLE AS fp, coalesce(sum(CASE WHEN true_tag = tag AND pred_tag <> tag THEN n END), 0)::DOUBLE AS fn FROM tags, conf GROUP BY tag),
  e AS (SELECT tag, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, CAST(tp + fn AS BIGINT) AS support FROM k)
  SELECT * FROM e UNION ALL SELECT 'weighted', sum(precision * support) / nullif(sum(support), 0), sum(recall * support) / nullif(sum(support), 0), sum(f1 * support) / nullif(sum(support), 0), CAST(sum(support) AS BIGINT) FROM e""",
    "token_totals": f"{_CONFUSION} SELECT sum(CASE WHEN true_tag = pred_tag THEN n ELSE 0 END)::DOUBLE / sum(n) AS accuracy, CAST(sum(CASE WHEN true_tag = 'O' AND pred_tag = 'O' THEN n ELSE 0 END) AS BIGINT) AS tn FROM conf",
    "entity_errors": f"{_ERRORS} SELECT community, label, kind, count(*) AS n FROM errors GROUP BY ALL",
    "entity_metrics": f"{_ERRORS}, k AS (SELECT community, label, count(*) FILTER (kind = 'TP') AS tp, count(*) FILTER (kind = 'FP') AS fp, count(*) FILTER (kind = 'FN') AS fn FROM errors GROUP BY ALL) SELECT community, label, tp, fp, fn, tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, 2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0) AS f1 FROM k",
    "baseline_metrics": f"{_BASELINE}, {_METRICS.format('community, label')} SELECT * FROM r",
    "entity_report": f"{_ERRORS}, {_METRICS.format('community')} SELECT community, precision, recall, f1, tp + fn AS support FROM r WHERE community IS NOT NULL UNION ALL SELECT 'weighted avg', {', '.join(f'sum({m} * (tp + fn)) / nullif(sum(tp + fn), 0)' for m in ('precision', 'recall', 'f1'))}, CAST(sum(tp + fn) AS BIGINT) FROM r WHERE community IS NOT NULL",
    "error_rows": f"{_ERRORS} SELECT community, file_name, coalesce(string_agg(term, '|' ORDER BY term) FILTER (kind = 'FN'), '') AS fn, coalesce(string_agg(term, '|' ORDER BY term) FILTER (kind = 'FP'), '') AS fp, count(*) FILTER (kind <> 'TP') AS n_errors FROM errors GROUP BY community, file_name HAVING count(*) FILTER (kind <> 'TP') > 0",
    "term_counters": f"{_ERRORS} SELECT community, kind, term, count(*) AS n, list(concat_ws(':', file_name, label, start_offset) ORDER BY concat_ws(':', file_name, label, start_offset)) AS places FROM errors GROUP BY community, kind, term",
    "top_errors": f"{_ERRORS} SELECT term, count(*) AS n, count(DISTINCT file_name) AS n_files FROM errors WHERE kind = 'FP' GROUP BY term ORDER BY n DESC, term LIMIT 10",
    "annotation_stats": f"""WITH {_GOLD} SELECT CASE WHEN grouping(community) = 1 THEN 'Total' ELSE community END AS community, count(*) FILTER (label = 'Disorder') AS disorders, count(*) FILTER (label = 'Chemical or drug') AS chemicals,
  count(DISTINCT CASE WHEN label = 'Disorder' THEN term END) AS unique_disorders, count(DISTINCT CASE WHEN label = 'Chemical or drug' THEN term END) AS unique_chemicals,
  count(DISTINCT CASE WHEN label = 'Disorder' THEN term END) + count(DISTINCT CASE WHEN label = 'Chemical or drug' THEN term END) AS unique_annotated FROM gold WHERE community IS NOT NULL GROUP BY ROLLUP (community)""",
    "value_counts": f"WITH {_CURRENT} SELECT yi, count(*) AS n FROM cur GROUP BY yi",
    "binary_metrics": f"WITH {_SCORED}, k AS (SELECT community, semantic_type, {_BINARY.format(h='hard')} FROM scored GROUP BY ALL) SELECT *, {_RATES} FROM k",
    "threshold_sweep": f"{_SWEEP} SELECT * FROM sweep",
    "best_threshold": f"{_SWEEP} SELECT semantic_type, threshold, f1, precision, recall, accuracy FROM sweep QUALIFY row_number() OVER (PARTITION BY semantic_type ORDER BY f1 DESC, threshold) = 1",
    "filtered_out": f"WITH {_SCORED}, k AS (SELECT community, semantic_type, avg(1 - hard) AS share FROM scored GROUP BY ALL) SELECT *, CAST(CAST(trunc(share * 100) AS INTEGER) AS VARCHAR) || '%' AS percent FROM k",
    "weighted_average": f"WITH {_SCORED}, k AS (SELECT community, {_BINARY.format(h='hard')} FROM scored GROUP BY ALL), r AS (SELECT *, {_RATES}, tp + fn AS support FROM k) SELECT {', '.join(f'sum({m} * support) / nullif(sum(support), 0) AS {m}' for m in ('precision', 'recall', 'f1'))}, CAST(sum(support) AS BIGINT) AS support FROM r",
}
