"""High-recall matching: candidate n-grams against the lexicon by bigram cosine, then gestalt ratio, then offsets.

A post is searched in five views: its own text, the parser's tokenised, segmented and lemma texts for Hebrew forms, and its
Latin words for English ones. What the views find is united in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.config import GENERIC_WORDS, T
from lexweave.functions import text as X
from lexweave.functions.similarity import bigrams, gestalt, may_exceed, most_shared, signature
from lexweave.session import cut

#: Texts of a post that hold Hebrew forms, in the order in which they are searched; the Latin words come behind them.
VIEWS = ("post_txt", "tokenized_text", "segmented_text", "lemmas")
CELLS = 1 << 14
LEMMAS, LATIN = VIEWS.index("lemmas"), len(VIEWS)


def view_texts(posts: DataFrame) -> DataFrame:
    """``post_id, view, text`` of every non-null text to search; posts without tokens and missing columns give none."""
    shown = X.blank_punctuation(F.col("post_txt"))
    views = [(i, shown if c == "post_txt" else F.col(c)) for i, c in enumerate(VIEWS) if c in posts.columns]
    views.append((LATIN, X.english_text(shown)))
    texts = F.array(*(F.struct(F.lit(i).alias("view"), t.alias("text")) for i, t in views))
    return posts.where("tokenized_text is not null").select("post_id", F.explode(texts).alias("v")).select("post_id", "v.view", "v.text").where("text <> ''")


def post_ngrams(posts: DataFrame, text: str, *keys: str) -> DataFrame:
    """``keys, pos, n, gram`` for every 1- to 3-gram of a text column's usable words, PAD past the end; null texts give none."""
    keys = keys or ("post_id",)
    words = posts.where(F.col(text).isNotNull()).select(*keys, F.posexplode(X.gram_starts(X.usable_tokens(F.col(text)))).alias("pos", "w"))
    grams = words.select(*keys, "pos", F.posexplode(F.array(F.col("w.w1"), F.concat_ws(" ", "w.w1", "w.w2"), F.concat_ws(" ", "w.w1", "w.w2", "w.w3"))).alias("i", "gram"))
    return grams.select(*keys, "pos", (F.col("i") + 1).cast("int").alias("n"), "gram")


def is_generic(gram: Column, n: Column, compat: bool = False) -> Column:
    """Single generic words are not searched for; ``compat`` leaves out only those of four or seven letters."""
    lengths = (4, 7) if compat else {len(w) for w in GENERIC_WORDS}
    return (n == 1) & gram.isin(*GENERIC_WORDS) & F.length(gram).isin(*lengths)


def priority_entries(lexicon: DataFrame, by: str) -> DataFrame:
    """One entry per surface form: the preferred one, then the first, for Hebrew; the first for lower-case English."""
    preferred = F.coalesce(F.col("stt") == "PF", F.lit(False))
    form, order = (F.col("heb"), F.struct(~preferred, F.col("lex_idx"))) if by == "heb" else (F.lower("str"), F.struct("lex_idx"))
    best = F.min_by(F.struct("cui", "tui", "stt", "str", "lex_idx"), order)
    return lexicon.withColumn("form", form).where("form is not null").groupBy("form").agg(best.alias("e")).select("form", "e.cui", "e.tui", "e.stt", F.col("e.str").alias("name"), "e.lex_idx")


def cosine_candidates(candidates: DataFrame, terms: DataFrame, low_single: float = T.low_single, low_multi: float = T.low_multi, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, gram, n, term, overlap, gram_size, term_size`` for each candidate's closest term by cosine of bigram sets.

    Both inputs hold distinct strings (for each value of the columns ``by``, which both bring). Two sets of cosine c share
    one of the first size - ceil(c² size) + 1 bigrams in the
    order of rarity among the terms (those that no term has come first, and match nothing), so only these are joined, under
    bounds on the sizes, on what can follow the shared place and on what 64-bit signatures say is shared. Rarities are counted in ``CELLS`` cells of a hash and
    stand in the plan as one constant, so that a string's prefix is found in its own row: any order that both sides share keeps
    the filter exact. The exact overlap is counted on the pairs left, from the strings themselves. Ties go to the smaller term.
    """
    low = F.when(F.col("n") == 1, low_single).otherwise(low_multi)
    cell = lambda g: F.pmod(F.xxhash64(*by, g), F.lit(CELLS)).cast("int")
    counts = dict(terms.select(F.explode(F.transform(bigrams(F.col("term")), cell)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("f")).collect())  # at most CELLS rows
    rarity = F.split(F.lit(",".join(str(counts.get(i, 0)) for i in range(CELLS))), ",").cast("array<int>")  # a constant of the plan

    def prefixed(df: DataFrame, least: Column, *keys: str) -> DataFrame:
        ranked = F.array_sort(F.transform(bigrams(F.col(keys[0])), lambda g: F.struct(F.get(rarity, cell(g)).alias("f"), g.alias("g"))))
        o = df.select(*by, *keys, F.explode(F.array(ranked)).alias("o"))
        size = F.size("o")
        keep = (size - F.ceil(size * (least * least) - 1e-9) + 1).cast("int")
        rows = o.select(*by, *keys, size.alias("size"), signature(F.transform("o", lambda x: x.g)).alias("sig"), F.posexplode(F.filter(F.slice("o", F.lit(1), keep), lambda x: x.f > 0)).alias("at", "x"), F.size(F.filter("o", lambda x: x.f == 0)).alias("unknown"))
        return rows.select(*by, *keys, "size", "sig", (F.col("at") + F.col("unknown")).alias("at"), F.col("x.g").alias("g"))

    c = prefixed(candidates, low, "gram", "n").withColumnsRenamed({"size": "gram_size", "sig": "gram_sig", "at": "i"})
    t = prefixed(terms, F.lit(min(low_single, low_multi)), "term").withColumnsRenamed({"size": "term_size", "sig": "term_sig", "at": "j"})
    need = low * F.sqrt(F.col("gram_size") * F.col("term_size")) - 1e-9
    can = F.least("i", "j") + 1 + F.least(F.col("gram_size") - F.col("i"), F.col("term_size") - F.col("j")) - 1
    fits = (F.least("gram_size", "term_size") >= need) & (can >= need) & (most_shared(F.col("gram_sig"), F.col("gram_size"), F.col("term_sig"), F.col("term_size")) >= need)
    pairs = c.join(t, [*by, "g"]).where(fits).select(*by, "gram", "n", "gram_size", "term", "term_size").distinct()
    # a generator keeps the overlap from being computed again in every filter and sort key
    counted = pairs.select("*", F.explode(F.array(F.size(F.array_intersect(bigrams(F.col("gram")), bigrams(F.col("term")))))).alias("overlap"))
    scored = counted.where((F.col("overlap") * F.col("overlap")).cast("double") >= low * low * (F.col("gram_size") * F.col("term_size")).cast("double"))
    rank = F.col("overlap").cast("double") * F.col("overlap") / (F.col("gram_size") * F.col("term_size"))
    best = scored.groupBy(*by, "gram", "n").agg(F.min_by(F.struct("term", "overlap", "gram_size", "term_size"), F.struct(-rank, F.col("term"))).alias("m"))
    return best.select(*by, "gram", "n", "m.term", "m.overlap", "m.gram_size", "m.term_size")


def good_matches(cosine: DataFrame, above_single: float = T.above_single, above_multi: float = T.above_multi) -> DataFrame:
    """The closest terms that are also alike in order: more than three characters, as many words, gestalt ratio above the threshold."""
    above = F.when(F.col("n") == 1, above_single).otherwise(above_multi)
    words = F.size(F.split("term", " "))
    near = cosine.where((F.length("term") > 3) & (words == F.col("n")) & may_exceed(F.col("term"), F.col("gram"), min(above_single, above_multi)))
    return near.withColumn("ratio", gestalt("term", "gram")).where(F.col("ratio") > above)


def search(posts: DataFrame, lexicon: DataFrame, compat: bool = False) -> DataFrame:
    """``post_id, view, cand_match, umls_match, cui, tui, match_eng, ratio, times, first``: what each view of a post holds.

    The distinct candidates of all posts are searched once. The found ones, few beside the candidates, are written and
    joined back to where they stand; ``times`` and ``first`` say how often and where in the view.
    """
    grams = post_ngrams(view_texts(posts), "text", "post_id", "view").where(~is_generic(F.col("gram"), F.col("n"), compat))
    grams = grams.withColumn("language", F.when(F.col("view") == LATIN, "eng").otherwise("heb"))
    heb = priority_entries(lexicon, "heb").select(F.lit("heb").alias("language"), F.col("form").alias("term"), "cui", "tui", F.col("name").alias("match_eng"))
    eng = priority_entries(lexicon, "str").select(F.lit("eng").alias("language"), F.col("form").alias("term"), "cui", "tui", F.lit(None).cast("string").alias("match_eng"))
    entries = heb.unionByName(eng).where("term <> ''")
    found = good_matches(cosine_candidates(grams.select("language", "gram", "n").distinct(), entries.select("language", "term").distinct(), by=("language",)))
    named = cut(found.join(entries, ["language", "term"]).select("language", "gram", "n", "term", "cui", "tui", "match_eng", "ratio"))
    hits = grams.join(named, ["language", "gram", "n"])
    keys = ("post_id", "view", F.col("gram").alias("cand_match"), F.col("term").alias("umls_match"))
    return hits.groupBy(*keys).agg(F.first("cui").alias("cui"), F.first("tui").alias("tui"), F.first("match_eng").alias("match_eng"), F.first("ratio").alias("ratio"), F.count(F.lit(1)).alias("times"), F.min(F.struct("pos", "n")).alias("first"))


def located(found: DataFrame, posts: DataFrame) -> DataFrame:
    """Matches of ``search`` with ``all_match_occ``: where the candidate stands in the lower-case post.

    A candidate that its view holds more often than the post does, and any lemma, is also looked for by similar windows.
    """
    shown = posts.select("post_id", F.lower(X.blank_punctuation(F.col("post_txt"))).alias("t"))
    none = F.array().cast("array<int>")
    literal = found.join(shown, "post_id").withColumn("literal", F.when(F.col("view") == LEMMAS, none).otherwise(F.coalesce(X.literal_offsets(F.col("t"), F.col("cand_match")), none))).drop("t")
    literal = cut(literal)
    near = relocated(literal.where(F.size("literal") < F.col("times")), posts)
    both = literal.join(near.select("post_id", "view", "cand_match", F.col("all_match_occ").alias("near")), ["post_id", "view", "cand_match"], "left")
    offsets = F.array_sort(F.array_union("literal", F.coalesce("near", none)))
    return both.withColumn("all_match_occ", offsets).drop("literal", "near").where(F.size("all_match_occ") > 0)


def united(matches: DataFrame, chars: int = T.dedupe_chars) -> DataFrame:
    """One row for each offset of each match, less those that stand within ``chars`` characters, at both ends, of one kept before for the same term.

    The order is that of the views, then of the text. Only the spans of one term in one post meet in a fold.
    """
    x = F.explode("all_match_occ").alias("s")
    rows = matches.select("post_id", "umls_match", F.struct("view", "first", "cand_match", "cui", "tui", "match_eng", "ratio", F.size("all_match_occ").alias("n_occ")).alias("m"), x)
    span = F.struct(F.col("m.view").alias("view"), F.col("m.first").alias("first"), F.col("s"), X.span_end(F.col("s"), F.col("m.cand_match")).alias("e"), F.col("m").alias("m"))
    groups = rows.groupBy("post_id", "umls_match").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast(dict(groups.dtypes)["spans"])
    fold = F.aggregate("spans", none, lambda a, x: F.when(F.exists(a, lambda y: (F.abs(y.s - x.s) <= chars) & (F.abs(y.e - x.e) <= chars)), a).otherwise(F.concat(a, F.array(x))))
    kept = groups.select("post_id", "umls_match", F.explode(fold).alias("x"))
    return kept.select("post_id", "x.view", F.col("x.m.cand_match").alias("cand_match"), "umls_match", "x.m.cui", "x.m.tui", X.semantic_type(F.col("x.m.tui")).alias("semantic_type"), "x.m.match_eng", "x.m.ratio", "x.m.n_occ", F.col("x.s").alias("curr_occurence_offset"))


def match_posts(posts: DataFrame, lexicon: DataFrame, compat: bool = False) -> DataFrame:
    """``post_id, view, cand_match, umls_match, cui, tui, semantic_type, match_eng, ratio, n_occ, curr_occurence_offset``: the matches of all views."""
    return united(located(search(posts, lexicon, compat), posts))


def least_common(offsets: Column) -> Column:
    """The offset that was proposed least often, the first proposed of several."""
    distinct = F.array_distinct(offsets)
    counted = F.transform(distinct, lambda o, i: F.struct(F.size(F.filter(offsets, lambda x: x == o)).alias("n"), i.alias("i"), o.alias("o")))
    return F.array_min(counted).o


def relocated(matches: DataFrame, posts: DataFrame, above: float = T.above_occurrence, again: float = T.above_relocation) -> DataFrame:
    """``post_id, view, cand_match, all_match_occ, curr_occurence_offset`` of matches by similar windows of as many words.

    Windows of the view that resemble the candidate are looked for among the post's windows; of all offsets proposed the
    least common one is taken. Windows meet candidates on the post and the number of words, so one post's rows meet only.
    """

    def windows(texts: DataFrame, name: str, keys: list[str], wanted: DataFrame, placed: bool = False) -> DataFrame:
        p = texts.select(*keys, F.col("w")).join(wanted, keys).where(F.size("w") >= F.col("words"))
        spans = p.select(*keys, "words", *(["w"] if placed else []), F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("words")), lambda i: F.array_join(F.slice("w", i + 1, F.col("words")), " "))).alias(f"{name}_no", name))
        if not placed:
            return spans
        at = F.length(F.array_join(F.slice("w", F.lit(1), F.col(f"{name}_no")), " ")) + F.when(F.col(f"{name}_no") > 0, 1).otherwise(0)
        return spans.withColumn(f"{name}_at", at.cast("int")).drop("w")

    asked = matches.select("post_id", "view", "cand_match").distinct().withColumn("words", F.size(F.split("cand_match", " ")))
    shown = X.blank_punctuation(F.col("post_txt"))
    # Latin words are looked for among the tokens; of segmented text only the usable words count
    have = [(i, c) for i, c in enumerate((*VIEWS, "tokenized_text")) if c in posts.columns]
    words = lambda c: X.usable(F.split(c, " ")) if c == "segmented_text" else F.split(shown if c == "post_txt" else F.col(c), " ")
    keyed = posts.select("post_id", F.explode(F.array(*(F.struct(F.lit(i).alias("view"), words(c).alias("w")) for i, c in have))).alias("v")).select("post_id", "v.view", "v.w").where("w is not null")
    surface = windows(keyed, "surface", ["post_id", "view"], asked.select("post_id", "view", "words").distinct())
    near = asked.join(surface, ["post_id", "view", "words"]).where(may_exceed(F.col("surface"), F.col("cand_match"), above)).withColumn("sim", gestalt("surface", "cand_match")).where(F.col("sim") > above)
    near = cut(near.select("post_id", "view", "words", "cand_match", "surface", "surface_no"))
    seen = windows(posts.where("post_txt is not null").select("post_id", F.split(shown, " ").alias("w")), "shown", ["post_id"], near.select("post_id", "words").distinct(), placed=True)
    there = near.join(seen, ["post_id", "words"]).where(may_exceed(F.col("shown"), F.col("surface"), again) | may_exceed(F.col("shown"), F.col("cand_match"), again))
    hits = there.withColumn("a", gestalt("shown", "cand_match")).withColumn("b", gestalt("shown", "surface")).where((F.col("a") > again) | (F.col("b") > again))
    proposed = hits.groupBy("post_id", "view", "cand_match").agg(F.transform(F.array_sort(F.collect_list(F.struct("surface_no", "shown_no", "shown_at"))), lambda x: x.shown_at).alias("offsets"))
    return proposed.select("post_id", "view", "cand_match", F.array_sort(F.array_distinct("offsets")).alias("all_match_occ"), least_common(F.col("offsets")).alias("curr_occurence_offset"))


def every_occurrence(instances: DataFrame) -> DataFrame:
    """A row for each offset in ``all_match_occ``, each once: ``file_name, cand_match, umls_match, offset``."""
    return instances.select("file_name", "cand_match", "umls_match", F.explode("all_match_occ").alias("offset")).distinct()


def kept_spans(instances: DataFrame, chars: int = T.dedupe_chars) -> DataFrame:
    """Spans of one term in one file, in order of arrival, without those within ``chars`` characters of a kept one at both ends.

    Only the distinct offsets of one term in one file meet in a fold.
    """
    span = F.struct(F.col("inst_id").alias("i"), F.col("curr_occurence_offset").alias("s"), X.span_end(F.col("curr_occurence_offset"), F.col("cand_match")).alias("e"))
    rows = instances.where("file_name is not null and umls_match is not null and cand_match is not null and curr_occurence_offset is not null")
    groups = rows.groupBy("file_name", "umls_match").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    empty = F.array().cast("array<struct<i:bigint,s:int,e:int>>")
    fold = F.aggregate("spans", empty, lambda a, x: F.when(F.exists(a, lambda y: (F.abs(y.s - x.s) <= chars) & (F.abs(y.e - x.e) <= chars)), a).otherwise(F.concat(a, F.array(x))))
    return groups.select("file_name", "umls_match", F.explode(fold).alias("x")).select("file_name", "umls_match", F.col("x.i").alias("inst_id"), F.col("x.s").alias("start_offset"), F.col("x.e").alias("end_offset"))
