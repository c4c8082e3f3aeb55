"""Features of instances: corpus counts, a bigram language model, relatedness and morphology."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexweave.config import T
from lexweave.functions import text as X
from lexweave.functions.similarity import gestalt, may_exceed
from lexweave.session import cut


def corpus_counts(corpus: DataFrame, text: str = "text") -> DataFrame:
    """``token, n`` over single spaces; the empty string is a token."""
    return corpus.where(F.col(text).isNotNull()).select(F.explode(F.split(text, " ")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def count_features(terms: DataFrame, counts: DataFrame, term: str = "umls_match") -> DataFrame:
    """``term, match_count, match_freq`` of distinct terms: occurrences as one token, and these over the number of distinct tokens."""
    distinct = counts.agg(F.count(F.lit(1)).alias("n_unique"))
    t = terms.where(F.col(term).isNotNull()).select(F.col(term).alias("term")).distinct()
    joined = t.join(counts, t["term"] == counts["token"], "left").crossJoin(F.broadcast(distinct))
    n = F.coalesce("n", F.lit(0))
    return joined.select("term", n.alias("match_count"), F.try_divide(n.cast("double"), F.col("n_unique")).alias("match_freq"))


def bigram_model(corpus: DataFrame, text: str = "text") -> DataFrame:
    """``w1, w2, w3, p``: how often w3 follows the two words, among all that follow them."""
    words = corpus.where(F.col(text).isNotNull()).select(F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("w")).where(F.size("w") >= 3)
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.slice("w", i, 3))).alias("g"))
    triples = grams.groupBy(F.get("g", F.lit(0)).alias("w1"), F.get("g", F.lit(1)).alias("w2"), F.get("g", F.lit(2)).alias("w3")).agg(F.count(F.lit(1)).alias("n"))
    pairs = triples.groupBy("w1", "w2").agg(F.sum("n").alias("total"))
    return triples.join(pairs, ["w1", "w2"]).select("w1", "w2", "w3", (F.col("n") / F.col("total")).alias("p"))


def bigram_feature(instances: DataFrame, model: DataFrame, window: str = "match_3_window") -> DataFrame:
    """``inst_id, pred_2_window``: the probability of the match behind the window's last two words; 0 without two words or unseen."""
    context = F.slice(F.split(window, " "), 2, 1000)
    c = instances.select("inst_id", F.when(F.size(context) == 2, F.get(context, F.lit(0))).alias("w1"), F.when(F.size(context) == 2, F.get(context, F.lit(1))).alias("w2"), F.col("cand_match").alias("w3"))
    return c.join(model, ["w1", "w2", "w3"], "left").select("inst_id", F.coalesce("p", F.lit(0.0)).alias("pred_2_window"))


def window_probability(instances: DataFrame, scorer: Callable[[str, str], float], windows: tuple[str, ...] = ("match_3_window", "match_6_window", "match_10_window")) -> DataFrame:
    """``inst_id`` and P(match | window) for each window by a pluggable scorer, called in Arrow batches.

    The neural model this stands for is not available offline; any callable of (context, word) can be given.
    """

    @F.pandas_udf(DoubleType())
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for context, word in batches:
            yield pd.Series([scorer(c, w) if c is not None and w is not None else 0.0 for c, w in zip(context, word, strict=True)], dtype="float64")

    return instances.select("inst_id", *(scored(w, "cand_match").alias(f"pred_{w.split('_')[1]}_window") for w in windows))


def relatedness_lines(lines: DataFrame) -> DataFrame:
    """``term, score`` of lines ``score<>seed(CUI)<>term(CUI)`` with ``line_no``; the last line of a term wins."""
    p = F.split("value", "<>")
    rows = lines.where(F.size(p) >= 2).select(F.split(F.element_at(p, -1), r"\(")[0].alias("term"), F.element_at(p, 1).alias("score"), "line_no")
    return rows.groupBy("term").agg(F.max_by("score", "line_no").alias("score"))


def relatedness(terms: DataFrame, dictionary: DataFrame, outside: DataFrame, term: str = "match_eng") -> DataFrame:
    """``term, relatedness``: 1 for terms outside the terminology, the dictionary's score, that of the part before a bracket, else -1."""
    d = dictionary.select(F.col("term").alias("k"), F.col("score").cast("double").alias("score"))
    t = terms.where(F.col(term).isNotNull()).select(F.col(term).alias("term")).distinct().withColumn("short", F.trim(F.split("term", r"\(")[0]))
    o = outside.select(F.col(outside.columns[0]).alias("term")).distinct().withColumn("alone", F.lit(1.0))
    full = t.join(d.withColumnsRenamed({"k": "term", "score": "s1"}), "term", "left").join(d.withColumnsRenamed({"k": "short", "score": "s2"}), "short", "left").join(o, "term", "left")
    return full.select("term", F.coalesce("alone", "s1", "s2", F.lit(-1.0)).alias("relatedness"))


def missing_terms(terms: DataFrame, dictionary: DataFrame, community: Column, term: str = "match_eng") -> DataFrame:
    """The request lines ``community<>term`` for terms without a score, each once."""
    rows = terms.where(F.col(term).isNotNull()).select(community.alias("community"), F.col(term).alias("term")).distinct()
    return rows.join(dictionary.select("term"), "term", "left_anti").select(F.concat_ws("<>", "community", "term").alias("line"))


def missing_counts(terms: DataFrame, dictionary: DataFrame, term: str = "match_eng") -> DataFrame:
    """``term, n``: how many rows ask for each term without a score."""
    rows = terms.where(F.col(term).isNotNull()).groupBy(F.col(term).alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(dictionary.select("term"), "term", "left_anti")


# ---- morphology --------------------------------------------------------------------------------------------------------


def lattice_rows(posts: DataFrame, key: str = "post_id", column: str = "words_and_lemmas") -> DataFrame:
    """``key, pos, word, lemma`` of items "lemma word"; an empty lemma is the word."""
    w = posts.where(F.col(column).isNotNull()).select(key, F.posexplode(column).alias("pos", "item"))
    lemma, word = F.substring_index("item", " ", 1), F.expr("substring(item, instr(item, ' ') + 1)")
    return w.select(key, "pos", word.alias("word"), F.coalesce(F.nullif(lemma, F.lit("")), word).alias("lemma"))


def sentence_numbers(rows: DataFrame, key: str = "post_id", number: str = "num", compat: bool = False) -> DataFrame:
    """``sentence`` from 1: a sentence starts at a token numbered 1. Several morphemes numbered 1 start one sentence (``compat``: one each)."""
    w = Window.partitionBy(key).orderBy("pos")
    start = (F.col(number) == 1) if compat else ((F.col(number) == 1) & ~F.coalesce(F.lag(number).over(w) == 1, F.lit(False)))
    return rows.withColumn("__start", start.cast("int")).withColumn("sentence", F.sum("__start").over(w)).drop("__start")


def token_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The longest word and lemma of each group, the first of several."""
    pick = lambda c: F.min_by(c, F.struct(-F.length(c), F.col("pos"))).alias(c)
    return rows.groupBy(*keys).agg(pick("word"), pick("lemma"))


def morphology_row(instances: DataFrame, rows: DataFrame, above: float = T.above_occurrence) -> DataFrame:
    """``inst_id, pos, step``: the parser row of a match, by the first of five ways that works.

    1. the k-th row whose word is like the candidate's first word, where there are as many rows as occurrences;
    2. the same by lemma; 3. the previous word put before it spells the candidate; 4. the following words are most like it;
    5. the row whose word is most like the first word. Rows meet instances on the file.
    """
    first = F.split("cand_match", " ")[0]
    i = instances.where("file_name is not null and cand_match is not null").select("inst_id", "file_name", "cand_match", first.alias("head"), F.size(F.split("cand_match", " ")).alias("n"), F.size("all_match_occ").alias("n_occ"), F.array_position("all_match_occ", F.col("curr_occurence_offset")).alias("k"))
    w = Window.partitionBy("file_name").orderBy("pos")
    context = rows.select("file_name", "pos", "word", "lemma", F.lag("word").over(w).alias("before"), F.lead("word").over(w).alias("after"), F.lead("word", 2).over(w).alias("after2"))

    def like(column: str) -> DataFrame:
        """The rows whose word or lemma is like the head, counted within the instance: few beside all pairs."""
        near = i.join(context, "file_name").where(may_exceed(F.col(column), F.col("head"), above)).withColumn("sim", gestalt(column, "head")).where(F.col("sim") > above)
        mine = Window.partitionBy("inst_id")
        return near.withColumn("hits", F.count(F.lit(1)).over(mine)).withColumn("at", F.row_number().over(mine.orderBy("pos")))

    by_word = like("word")
    spelled = F.when(F.col("n") == 1, F.concat("before", "word")).otherwise(F.concat(F.col("before"), F.col("word"), F.lit(" "), F.col("after")))
    following = F.when(F.col("n") == 1, F.col("word")).when(F.col("n") == 2, F.concat_ws(" ", "word", "after")).otherwise(F.concat_ws(" ", "word", "after", "after2"))
    by_word = by_word.withColumn("fs", F.when(may_exceed(following, F.col("cand_match"), above), gestalt(following, "cand_match")).otherwise(0.0))
    kth = (F.col("hits") == F.col("n_occ")) & (F.col("at") == F.col("k"))
    step = F.when(kth, 1).when(spelled == F.col("cand_match"), 3).when(F.col("fs") > above, 4)
    kept = ["inst_id", "pos", "step", "fs", "word", "lemma"]
    ways = by_word.withColumn("step", step).where("step is not null").select(*kept)
    ways = ways.unionByName(like("lemma").where(kth).select("inst_id", "pos", F.lit(2).alias("step"), F.lit(0.0).alias("fs"), "word", "lemma"))
    order = F.struct("step", F.when(F.col("step") == 4, -F.col("fs")).otherwise(F.lit(0.0)), F.col("pos"))
    sure = cut(ways.groupBy("inst_id").agg(F.min_by(F.struct("pos", "step", "word", "lemma"), order).alias("r")).select("inst_id", "r.*"))
    # the rest takes the nearest word of the file; a pair of words is compared once
    rest = i.join(sure, "inst_id", "left_anti").select("inst_id", "file_name", "head").join(rows.select("file_name", "pos", "word", "lemma"), "file_name")
    known = rest.select("word", "head").distinct().withColumn("sim", gestalt("word", "head"))
    nearest = rest.join(known, ["word", "head"]).groupBy("inst_id").agg(F.min_by(F.struct("pos", F.lit(5).alias("step"), "word", "lemma"), F.struct(-F.col("sim"), F.col("pos"))).alias("r"))
    return sure.unionByName(nearest.select("inst_id", "r.*"))


# ---- a window model of counts ------------------------------------------------------------------------------------------


def window_counts(corpus: DataFrame, terms: DataFrame, text: str = "text", reach: int = 10) -> DataFrame:
    """``distance, before, term, p``: how often a one-word term stands ``distance`` words behind a word, among all places of that word.

    Only places of the asked terms are opened, so the table grows with their occurrences.
    """
    words = corpus.where(F.col(text).isNotNull()).select(F.filter(F.split(X.blank_punctuation(F.col(text)), r"\s+"), lambda w: w != "").alias("w"))
    totals = words.select(F.explode("w").alias("before")).groupBy("before").agg(F.count(F.lit(1)).alias("total"))
    asked = terms.select(F.col(terms.columns[0]).alias("term")).where("term is not null and instr(term, ' ') = 0").distinct()
    around = words.select(F.explode(F.transform("w", lambda x, i: F.struct(x.alias("term"), F.slice("w", F.greatest(i - reach + 1, F.lit(1)), F.least(i, F.lit(reach))).alias("b")))).alias("x")).select("x.term", "x.b")
    places = around.join(asked, "term", "left_semi").select("term", F.size("b").alias("n"), F.posexplode("b").alias("i", "before"))
    counted = places.groupBy((F.col("n") - F.col("i")).alias("distance"), "before", "term").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(totals, "before").select("distance", "before", "term", (F.col("n") / F.col("total")).alias("p"))


def window_features(instances: DataFrame, counts: DataFrame, windows: tuple[str, ...] = ("match_3_window", "match_6_window", "match_10_window"), key: str = "inst_id") -> DataFrame:
    """The key and P(match | window) for each window: the nearer a word, the more its own count weighs (half for each step).

    0 for empty windows, for words never seen together, and for terms of several words, which no place of the corpus is.
    """
    out = None
    for name in windows:
        words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
        rows = instances.select(key, F.col("cand_match").alias("term"), F.posexplode_outer(words).alias("i", "before"), F.size(words).alias("size"))
        rows = rows.withColumn("distance", F.col("size") - F.col("i")).join(counts, ["distance", "before", "term"], "left")
        weight = F.pow(F.lit(0.5), F.col("distance"))
        one = rows.groupBy(key).agg(F.coalesce(F.try_divide(F.sum(weight * F.coalesce("p", F.lit(0.0))), F.sum(weight)), F.lit(0.0)).alias(f"pred_{name.split('_')[1]}_window"))
        out = one if out is None else out.join(one, key)
    return out
