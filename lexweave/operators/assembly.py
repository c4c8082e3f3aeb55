"""The chain from posts to judged matches: instances, their features in one row each, and their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import features, instances, labels, matching

#: The columns of a finished row, in their order.
COLUMNS = (
    "inst_id", "umls_match", "cand_match", "file_name", "match_eng", "match_type", "match_3_window", "match_6_window", "match_10_window", "match_tui", "semantic_type", "curr_occurence_offset",
    "yi", "match_count", "match_freq", "pred_10_window", "pred_6_window", "pred_3_window", "pred_2_window", "relatedness",
)


def instances_of(posts: DataFrame, lexicon: DataFrame, compat: bool = False) -> DataFrame:
    """One row for each most specific match of each post, with its windows; ``inst_id`` is a hash of post, form, term and place.

    ``posts`` bring ``post_id, file_name, post_txt`` and the views. Repeated posts give their own rows.
    """
    found = matching.match_posts(posts, lexicon, compat)
    key = F.xxhash64("post_id", "cand_match", "umls_match", "curr_occurence_offset")
    m = found.withColumn("inst_id", key)
    m = instances.most_specific(m, file="post_id")
    view = F.get(F.array(*(F.lit(v) for v in (*matching.VIEWS, "tokenized_text"))), F.col("view"))
    rows = m.join(posts.select("post_id", "file_name", "post_txt"), "post_id")
    rows = rows.select("inst_id", "post_id", "file_name", "post_txt", "cand_match", "umls_match", instances.display_name(F.col("match_eng"), F.col("umls_match")).alias("match_eng"), instances.match_type(F.col("cand_match"), view).alias("match_type"), F.col("tui").alias("match_tui"), "semantic_type", "curr_occurence_offset")
    words = X.prefix_words(X.blank_punctuation(F.col("post_txt")), F.col("curr_occurence_offset"), compat)
    return rows.withColumn("__w", words).select("*", *(X.last_words(F.col("__w"), k).alias(f"match_{k}_window") for k in (3, 6, 10))).drop("__w", "post_txt")


def weak_labels(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """``inst_id, yi``: matches of lemmas are labelled by the wider rule, all others by the narrow one."""
    anns = labels.long_annotations(labels.annotations(gold))
    lemma = F.col("match_type") == "lemmas"
    narrow = labels.label_matches(rows.where(~lemma), anns)
    return narrow.select("inst_id", "yi").unionByName(labels.label_matches(rows.where(lemma), anns, lemma=True).select("inst_id", "yi"))


def assembled(rows: DataFrame, corpus: DataFrame, dictionary: DataFrame, outside: DataFrame, yi: DataFrame | None = None) -> DataFrame:
    """``COLUMNS`` of every instance: each feature table is joined by its own key, and no instance is lost or doubled.

    Terms that a feature table lacks get its default: count 0, probability 0, relatedness -1. ``yi`` is null where it is not given.
    """
    counts = features.count_features(rows, features.corpus_counts(corpus)).withColumnRenamed("term", "umls_match")
    related = features.relatedness(rows.select(F.lower("match_eng").alias("match_eng")), dictionary, outside)
    near = features.window_features(rows, features.window_counts(corpus, rows.select("cand_match")))
    two = features.bigram_feature(rows, features.bigram_model(corpus))
    out = rows.join(counts, "umls_match", "left").join(near, "inst_id", "left").join(two, "inst_id", "left")
    out = out.withColumn("__term", F.lower("match_eng")).join(related.withColumnRenamed("term", "__term"), "__term", "left")
    out = out.join(yi, "inst_id", "left") if yi is not None else out.withColumn("yi", F.lit(None).cast("int"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("match_count",)} | {c: F.coalesce(c, F.lit(0.0)) for c in ("match_freq", "pred_3_window", "pred_6_window", "pred_10_window", "pred_2_window")}
    return out.withColumns(zero | {"relatedness": F.coalesce("relatedness", F.lit(-1.0))}).select(*COLUMNS)


def checked(rows: DataFrame, joined: DataFrame, key: str = "inst_id") -> DataFrame:
    """``joined``, or an error where its keys are not those of ``rows``, each once; the check runs with the query."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name), F.coalesce(F.sum(F.xxhash64(key).cast("decimal(38,0)")), F.lit(0)).alias(f"{name}_sum"))
    same = n(rows, "a").crossJoin(n(joined, "b")).select(F.assert_true((F.col("a") == F.col("b")) & (F.col("a_sum") == F.col("b_sum")), F.lit("the features do not fit the instances")).alias("ok"))  # one row
    return joined.crossJoin(F.broadcast(same)).where("ok is null").drop("ok")


def spans_of(scored: DataFrame, filtered: bool = True) -> DataFrame:
    """Instances as predicted spans; ``filtered`` keeps only those the model accepts, else all candidates stand (the baseline)."""
    kept = scored.where("hard_y_pred = 1") if filtered else scored
    rows = kept.where("file_name is not null and cand_match is not null and curr_occurence_offset is not null")
    return rows.select(F.col("inst_id").alias("pred_id"), "file_name", F.lower("cand_match").alias("term"), F.col("curr_occurence_offset").alias("start_offset"), X.span_end(F.col("curr_occurence_offset"), F.col("cand_match")).alias("end_offset"), F.col("semantic_type").alias("label"), F.col("inst_id").alias("ann_no"))


