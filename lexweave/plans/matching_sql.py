"""The gestalt ratio and the matching of posts in plain SQL: for tests on small tables, as the ratio is a recursive query."""

from __future__ import annotations

from lexweave.config import GENERIC_WORDS
from lexweave.functions.text import PUNCTUATION

_PUNCT = "'" + PUNCTUATION.replace("'", "''") + "'"


def blank(x: str) -> str:
    return f"translate({x}, {_PUNCT}, repeat(' ', {len(PUNCTUATION)}))"


def may_exceed(a: str, b: str, least: float) -> str:
    """What the operators leave out of the comparison as well, by the lengths alone."""
    return f"2 * least(length({a}), length({b})) >= {least}::DOUBLE * (length({a}) + length({b}))"


def gestalt(name: str, pairs: str) -> str:
    """CTEs that end in ``name`` (x, y, ratio) for the distinct pairs of ``pairs`` (x, y).

    The longest part of one string that the other holds, the leftmost of several, is matched; then the same on either side of
    it. Parts are tried from the longest down, so the first one held is it.
    """

    def longest(a: str, b: str) -> str:
        parts = f"flatten(list_transform(range(least(length({a}), length({b})), 0, -1), lambda n: list_transform(range(1, length({a}) - n + 2), lambda i: substr({a}, i, n))))"
        return f"list_filter({parts}, lambda p: contains({b}, p))[1]"

    return f"""{name}_r(x, y, a, b, m) AS (
    SELECT x, y, x, y, {longest('x', 'y')} FROM (SELECT DISTINCT x, y FROM {pairs} WHERE x IS NOT NULL AND y IS NOT NULL)
    UNION ALL
    SELECT x, y, a, b, {longest('a', 'b')} FROM (
      SELECT x, y, c.a AS a, c.b AS b FROM (
        SELECT x, y, unnest([{{'a': substr(a, 1, instr(a, m) - 1), 'b': substr(b, 1, instr(b, m) - 1)}}, {{'a': substr(a, instr(a, m) + length(m)), 'b': substr(b, instr(b, m) + length(m))}}]) AS c
        FROM {name}_r WHERE m IS NOT NULL) WHERE c.a <> '' AND c.b <> '')),
  {name} AS (SELECT x, y, CASE WHEN length(x) + length(y) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(sum(length(m)), 0)::DOUBLE / (length(x) + length(y)) END AS ratio FROM {name}_r GROUP BY x, y)"""


GRAMS = "list_distinct(list_transform(range(1, length({0}) + 2), lambda i: substr(' ' || {0} || ' ', i, 2)))"

_VIEWS = f"""shown AS (SELECT post_id, {blank('post_txt')} AS t, tokenized_text, segmented_text, lemmas FROM posts),
  views AS (SELECT * FROM (SELECT post_id, unnest([0, 1, 2, 3, 4]) AS view, unnest([t, tokenized_text, segmented_text, lemmas,
    array_to_string(list_transform(list_filter(string_split(t, ' '), lambda w: length(w) > 2 AND regexp_matches(w, '[A-Za-z]')), lambda w: lower(w)), ' ')]) AS text
    FROM shown WHERE tokenized_text IS NOT NULL) WHERE text <> ''),
  view_words AS (SELECT post_id, view, list_filter(string_split(replace(text, '.', ' '), ' '), lambda w: length(w) >= 2 OR regexp_matches(w, '^\\d+$')) AS l FROM views),
  view_grams AS (SELECT * FROM (SELECT post_id, view, i, n, array_to_string(p[i + 1 : i + n], ' ') AS gram
    FROM (SELECT post_id, view, list_concat(l, ['PAD', 'PAD']) AS p, unnest(range(len(l))) AS i FROM view_words), (SELECT unnest([1, 2, 3]) AS n)) WHERE NOT (n = 1 AND gram IN ({', '.join(repr(w) for w in GENERIC_WORDS)})))"""

_FORMS = """forms AS (SELECT false AS eng, heb AS term, cui, tui, str AS name FROM lexicon WHERE heb <> '' QUALIFY row_number() OVER (PARTITION BY heb ORDER BY CASE WHEN stt = 'PF' THEN 0 ELSE 1 END, lex_idx) = 1
    UNION ALL SELECT true, lower(str), cui, tui, NULL FROM lexicon WHERE str <> '' QUALIFY row_number() OVER (PARTITION BY lower(str) ORDER BY lex_idx) = 1)"""

#: From the posts to ``hits`` (post_id, view, cand, term, ratio, times, first place).
_SEARCH = f"""WITH RECURSIVE {_VIEWS}, {_FORMS},
  asked AS (SELECT eng, gram, n, {GRAMS.format('gram')} AS b FROM (SELECT DISTINCT view = 4 AS eng, gram, n FROM view_grams)),
  sought AS (SELECT eng, term, {GRAMS.format('term')} AS b FROM forms),
  known AS (SELECT DISTINCT eng, unnest(b) AS g FROM sought),
  opened AS (SELECT eng, gram, g FROM (SELECT eng, gram, unnest(b) AS g FROM asked) SEMI JOIN known USING (eng, g)),
  able AS (SELECT eng, gram, len(any_value(b)) AS size, any_value(n) AS n FROM opened JOIN asked USING (eng, gram) GROUP BY eng, gram HAVING count(*) >= 0.6 * len(any_value(b))),
  shared_grams AS (SELECT eng, gram, term, count(*) AS o FROM (SELECT * FROM opened SEMI JOIN able USING (eng, gram)) JOIN (SELECT eng, term, unnest(b) AS g FROM sought) USING (eng, g) GROUP BY ALL),
  closest AS (SELECT eng, gram, n, term FROM (SELECT eng, gram, n, term, CAST(o * o AS DOUBLE) AS o2, size * len(sought.b) AS sizes FROM shared_grams JOIN able USING (eng, gram) JOIN sought USING (eng, term))
    WHERE o2 >= (CASE WHEN n = 1 THEN 0.78::DOUBLE * 0.78::DOUBLE ELSE 0.83::DOUBLE * 0.83::DOUBLE END) * CAST(sizes AS DOUBLE)
    QUALIFY row_number() OVER (PARTITION BY eng, gram ORDER BY o2 / sizes DESC, term) = 1),
  close AS (SELECT *, term AS x, gram AS y FROM closest WHERE length(term) > 3 AND len(string_split(term, ' ')) = n),
  {gestalt('close_ratio', 'close')},
  good AS (SELECT eng, gram, term, ratio FROM close JOIN close_ratio USING (x, y) WHERE ratio > CASE WHEN n = 1 THEN 0.85::DOUBLE ELSE 0.90::DOUBLE END),
  hits AS (SELECT post_id, view, gram AS cand, term, cui, tui, ratio, count(*) AS times, min((i, n)) AS first FROM view_grams JOIN good USING (gram) JOIN forms USING (eng, term) WHERE good.eng = (view = 4) GROUP BY ALL)"""

#: Similar windows of the views, then of the posts; ``near`` (post_id, view, cand, offsets in the order proposed).
_NEAR = f"""wanted AS (SELECT DISTINCT post_id, view, cand, len(string_split(cand, ' ')) AS k FROM @asked),
  key_words AS (SELECT post_id, unnest([0, 1, 2, 3, 4]) AS view, unnest([string_split(t, ' '), string_split(tokenized_text, ' '), list_filter(string_split(segmented_text, ' '), lambda w: length(w) >= 2 OR regexp_matches(w, '^\\d+$')), string_split(lemmas, ' '), string_split(tokenized_text, ' ')]) AS w FROM shown),
  surfaces AS (SELECT post_id, view, cand, k, i, array_to_string(w[i + 1 : i + k], ' ') AS surface FROM (SELECT post_id, view, cand, k, w, unnest(range(len(w) - k + 1)) AS i FROM wanted JOIN key_words USING (post_id, view) WHERE w IS NOT NULL AND len(w) >= k)),
  surface_pairs AS (SELECT *, surface AS x, cand AS y FROM surfaces WHERE {may_exceed('surface', 'cand', 0.88)}),
  {gestalt('surface_ratio', 'surface_pairs')},
  alike AS (SELECT post_id, view, cand, k, i, surface FROM surface_pairs JOIN surface_ratio USING (x, y) WHERE ratio > 0.88::DOUBLE),
  post_words AS (SELECT post_id, string_split(t, ' ') AS w FROM shown WHERE t IS NOT NULL),
  shown_windows AS (SELECT post_id, k, j, array_to_string(w[j + 1 : j + k], ' ') AS win, CAST(length(array_to_string(w[1 : j], ' ')) + CASE WHEN j > 0 THEN 1 ELSE 0 END AS INTEGER) AS s
    FROM (SELECT post_id, k, w, unnest(range(len(w) - k + 1)) AS j FROM (SELECT DISTINCT post_id, k FROM alike) JOIN post_words USING (post_id) WHERE len(w) >= k)),
  seen AS (SELECT * FROM alike JOIN shown_windows USING (post_id, k) WHERE {may_exceed('win', 'cand', 0.82)} OR {may_exceed('win', 'surface', 0.82)}),
  seen_pairs AS (SELECT win AS x, cand AS y FROM seen UNION SELECT win, surface FROM seen),
  {gestalt('seen_ratio', 'seen_pairs')},
  proposed AS (SELECT post_id, view, cand, list(s ORDER BY i, j, s) AS offsets FROM seen LEFT JOIN seen_ratio a ON a.x = win AND a.y = cand LEFT JOIN seen_ratio b ON b.x = win AND b.y = surface
    WHERE a.ratio > 0.82::DOUBLE OR b.ratio > 0.82::DOUBLE GROUP BY post_id, view, cand)"""

_LITERAL = """literal AS (SELECT *, CASE WHEN view = 3 OR t IS NULL OR length(cand) = 0 OR len(p) < 2 THEN [] ELSE list_transform(range(1, len(p)), lambda i: CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(cand) AS INTEGER)) END AS lit
    FROM (SELECT hits.*, t, string_split(lower(t), cand) AS p FROM hits JOIN shown USING (post_id)))"""

_MATCHES = f"""{_SEARCH}, {_LITERAL}, {_NEAR.replace('@asked', '(SELECT * FROM literal WHERE len(lit) < times)')},
  placed AS (SELECT l.*, list_sort(list_distinct(list_concat(lit, coalesce(offsets, [])))) AS occ FROM literal l LEFT JOIN proposed USING (post_id, view, cand)),
  spans AS (SELECT post_id, term, view, first, cand, cui, tui, ratio, CAST(len(occ) AS INTEGER) AS n_occ, unnest(occ) AS s FROM placed WHERE len(occ) > 0),
  ordered AS (SELECT post_id, term, list([{{'view': view, 'cand': cand, 'cui': cui, 'tui': tui, 'ratio': ratio, 'n_occ': n_occ, 's': s, 'e': s + length(cand)}}] ORDER BY view, first, s, s + length(cand), cand) AS l FROM spans GROUP BY post_id, term),
  kept AS (SELECT post_id, term, unnest(list_reduce(l, lambda a, b: CASE WHEN len(list_filter(a, lambda y: abs(y.s - b[1].s) <= 2 AND abs(y.e - b[1].e) <= 2)) > 0 THEN a ELSE list_concat(a, b) END)) AS m FROM ordered),
  matches AS (SELECT post_id, CAST(m.view AS INTEGER) AS view, m.cand AS cand_match, term AS umls_match, m.cui AS cui, @type AS semantic_type, m.ratio AS ratio, m.n_occ AS n_occ, m.s AS curr_occurence_offset FROM kept)"""


def matches(type_of: str) -> str:
    """CTEs that end in ``matches``; ``type_of`` is the SQL of a semantic type by ``m.tui``."""
    return _MATCHES.replace('@type', type_of)


RELOCATED = f"""{_SEARCH}, {_NEAR.replace('@asked', '(SELECT * FROM hits WHERE view = 3)')},
  counted AS (SELECT post_id, cand, offsets, list_distinct(offsets) AS d FROM proposed)
  SELECT post_id, cand AS cand_match, list_sort(d) AS all_match_occ,
    list_sort(list_transform(d, lambda o: {{'n': len(list_filter(offsets, lambda x: x = o)), 'i': list_position(offsets, o), 'o': o}}))[1].o AS curr_occurence_offset FROM counted"""
