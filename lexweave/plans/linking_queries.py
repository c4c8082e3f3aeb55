"""Queries of the linking pipeline over whole tables: text, lexicon, matching, instances, features, labels, model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.config import FEATURES
from lexweave.functions import lattices
from lexweave.functions import text as X
from lexweave.operators import assembly, evaluate, features, instances, labels, matching, model, ranking
from lexweave.session import cut
from lexweave.sources import readers
from lexweave.sources.tables import table


def community(file_name: Column) -> Column:
    """The community that a file name spells."""
    return F.nullif(F.lower(F.regexp_extract(file_name, "(?i)(sclerosis|diabetes|depression)", 1)), F.lit(""))


def current_instances(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each instance once, as delivered last."""
    rest = [c for c in columns if c != "inst_id"]
    return table(s, d, "instances").groupBy("inst_id").agg(F.max_by(F.struct(*rest), "loaded_at").alias("r")).select("inst_id", "r.*")


def gold_texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "gold_labels").where("file_name is not null").groupBy("file_name").agg(F.min("text").alias("text"))


def gold_spans(s: SparkSession, d: str) -> DataFrame:
    a = labels.annotations(table(s, d, "gold_labels"))
    return a.withColumn("gold_id", F.concat_ws("#", "file_name", "ann_no", "start_offset", "term")).withColumn("community", community(F.col("file_name")))


def predicted_spans(s: SparkSession, d: str) -> DataFrame:
    """Instances of annotated files that a fixed score accepts, as spans."""
    i = current_instances(s, d, "file_name", "cand_match", "curr_occurence_offset", "semantic_type", "pred_10_window").where("pred_10_window > 0.3 and file_name is not null and cand_match is not null and curr_occurence_offset is not null")
    i = i.join(table(s, d, "gold_labels").select("file_name").distinct(), "file_name", "left_semi")
    return i.select(F.col("inst_id").alias("pred_id"), "file_name", F.lower("cand_match").alias("term"), F.col("curr_occurence_offset").alias("start_offset"), X.span_end(F.col("curr_occurence_offset"), F.col("cand_match")).alias("end_offset"), F.col("semantic_type").alias("label"), community(F.col("file_name")).alias("community"), F.col("inst_id").alias("ann_no"))


def scored(s: SparkSession, d: str) -> DataFrame:
    i = current_instances(s, d, "file_name", "semantic_type", "yi", "pred_10_window")
    return i.select("inst_id", community(F.col("file_name")).alias("community"), "semantic_type", "yi", F.col("pred_10_window").alias("score"), (F.col("pred_10_window") > 0.5).cast("int").alias("hard_y_pred")).where("yi is not null and score is not null")


def mentions(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "instances").where("cand_match is not null").select(F.lower("cand_match").alias("gram")).distinct()
    return m.withColumn("n", F.size(F.split("gram", " "))).where("n <= 3")


def terms(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "lexicon")
    return x.select(F.explode(F.array("heb", F.lower("str"))).alias("term")).where("term is not null and term <> ''").distinct()


def dictionary(s: SparkSession, d: str) -> DataFrame:
    i = table(s, d, "instances").where("match_eng is not null and relatedness is not null and not isnan(relatedness)")
    return i.groupBy(F.lower("match_eng").alias("term")).agg(F.max_by("relatedness", F.struct("inst_id", "relatedness")).alias("score"))


def relatedness(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "lexicon")
    return features.relatedness(x.select(F.lower("str").alias("match_eng")), dictionary(s, d), x.where("source_file = 'not_in_kb'").select(F.lower("str").alias("t")))


def missing_terms(s: SparkSession, d: str) -> DataFrame:
    i = table(s, d, "instances").select(F.lower("match_eng").alias("match_eng"), "file_name").where("file_name is not null")
    return features.missing_terms(i, dictionary(s, d).where("score >= 0"), community(F.col("file_name")))


def lattice_text(s: SparkSession, d: str) -> DataFrame:
    """The parser output of posts in text form, one sentence per post."""
    rows = table(s, d, "posts").where("words_and_lemmas is not null")
    line = lambda x, i: F.concat_ws("\t", i.cast("string"), (i + 1).cast("string"), F.substring_index(x, " ", -1), F.substring_index(x, " ", 1), F.lit("NN"), F.lit("NNT"), F.lit("gen=F|gen=M|num=S"), (i + 1).cast("string"))
    return rows.select("post_id", F.array_join(F.transform("words_and_lemmas", line), "\n").alias("t"))


def lattice(s: SparkSession, d: str) -> DataFrame:
    return lattices.lattice(lattice_text(s, d), "post_id", "t").select("post_id", "line_no", "word", "lemma", "gen", "num_s_p", "num_last")


def dependency(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "posts").where("words_and_lemmas is not null")
    line = lambda x, i: F.concat_ws("\t", (i + 1).cast("string"), F.substring_index(x, " ", -1), F.lit(""), F.lit("NN"), F.lit("NN"), F.lit("_"), i.cast("string"), F.lit("obj"))
    t = rows.select("post_id", F.array_join(F.transform("words_and_lemmas", line), "\n").alias("t"))
    return lattices.dependency_tree(t, "post_id", "t").select("post_id", "line_no", "num", "word", "lemma", "dependency_part", "dependency_arc_2")


def numbered_rows(s: SparkSession, d: str) -> DataFrame:
    return features.lattice_rows(table(s, d, "posts")).withColumn("num", (F.col("pos") % 12 + 1).cast("int"))


def sample_terms(s: SparkSession, d: str, k: int = 100) -> DataFrame:
    """A repeatable sample of ``k`` entries per semantic type."""
    x = table(s, d, "lexicon").where("str is not null").withColumn("semantic_type", X.semantic_type(F.col("tui"))).where("semantic_type is not null")
    rn = F.row_number().over(Window.partitionBy("semantic_type").orderBy(F.md5(F.concat_ws(":", "lex_idx", "str")), "lex_idx"))
    return x.withColumn("rn", rn).where(F.col("rn") <= k).select("semantic_type", "lex_idx", "str")


def kth_occurrence(s: SparkSession, d: str) -> DataFrame:
    i = current_instances(s, d, "file_name", "cand_match", "post_txt").where("file_name is not null and cand_match is not null and post_txt is not null").withColumn("cand", F.lower("cand_match"))
    k = F.row_number().over(Window.partitionBy("file_name", "cand").orderBy("inst_id"))
    return i.withColumn("k", k).select("inst_id", "k", F.get(X.literal_offsets(F.lower("post_txt"), F.col("cand")), F.col("k") - 1).alias("start_offset"))


def lexicon_union(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "lexicon")
    return readers.lexicon_union(*(x.where(F.col("source_file") == f) for f in ("kb", "acronyms", "not_in_kb"))).select(F.col("lex_idx").cast("long").alias("lex_idx"), "cui", "str", "heb")


def located_matches(s: SparkSession, d: str) -> DataFrame:
    posts = table(s, d, "posts")
    return matching.match_posts(posts, table(s, d, "lexicon")).select("post_id", "view", "cand_match", "umls_match", "cui", "semantic_type", "ratio", "n_occ", "curr_occurence_offset")


def relocated(s: SparkSession, d: str) -> DataFrame:
    """Where the matches of the lemmas stand in their posts."""
    posts = table(s, d, "posts")
    found = matching.search(posts, table(s, d, "lexicon")).where(F.col("view") == matching.LEMMAS)
    return matching.relocated(found, posts).drop("view")


def matches_by_community(s: SparkSession, d: str) -> DataFrame:
    posts = table(s, d, "posts")
    m = matching.match_posts(posts, table(s, d, "lexicon")).join(posts.select("post_id", "community"), "post_id")
    return m.groupBy("community", "semantic_type").agg(F.count(F.lit(1)).alias("n_matches"), F.countDistinct("cui").alias("n_concepts"), F.countDistinct("post_id").alias("n_posts"))


def forest_scores(s: SparkSession, d: str) -> DataFrame:
    """Trained on the documents before the held-out ones, scored on these, with each type's best threshold."""
    i = current_instances(s, d, "file_name", "semantic_type", "yi", *FEATURES).where("yi is not null and file_name is not null")
    split = ranking.hold_out(i)
    rows = i.join(split, "file_name")
    groups = [{"semantic_type": "Disorder"}, {"semantic_type": "Chemical or drug"}]
    models = model.train_groups(rows.where("split = 'train'"), groups)
    out = model.score_groups(models, rows.where("split = 'test'"))
    return model.tuned(out, out, "semantic_type").select("inst_id", "semantic_type", "score", "threshold", "hard_y_pred")


def window_probabilities(s: SparkSession, d: str) -> DataFrame:
    """Each window's probability of the match, by a stand-in scorer (share of the match's letters that the context holds)."""
    i = current_instances(s, d, "cand_match", "match_3_window", "match_6_window", "match_10_window")
    return features.window_probability(i, lambda context, word: sum(c in context for c in word) / max(1, len(word)))


def sentences(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "posts").where("tokenized_text is not null")
    return p.select("post_id", F.posexplode(X.sentences(F.col("tokenized_text"))).alias("sentence_no", "sentence"))


def classed_tokens(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "posts").where("post_txt is not null")
    t = p.select("post_id", F.posexplode(X.classed_tokens(F.col("post_txt"))).alias("pos", "t"))
    return t.select("post_id", "pos", F.col("t.class").alias("class"), "t.token")


def _bio(s: SparkSession, d: str, side: str) -> DataFrame:
    spans = gold_spans(s, d) if side == "gold" else predicted_spans(s, d)
    return evaluate.bio_tokens(gold_texts(s, d), spans)


def confusion(s: SparkSession, d: str, io: bool = False) -> DataFrame:
    return evaluate.token_confusion(_bio(s, d, "gold"), _bio(s, d, "predicted"), io)


def errors(s: SparkSession, d: str) -> DataFrame:
    return evaluate.entity_errors(gold_spans(s, d), predicted_spans(s, d))


def morphology(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "posts").where("file_name is not null").groupBy("file_name").agg(F.min_by("words_and_lemmas", "post_id").alias("words_and_lemmas"))
    return features.morphology_row(current_instances(s, d, "file_name", "cand_match", "all_match_occ", "curr_occurence_offset"), features.lattice_rows(files, "file_name")).select("inst_id", "pos", "step", "word", "lemma")


def window_features(s: SparkSession, d: str) -> DataFrame:
    """Each window's probability of the match, by the counts of the corpus."""
    i = current_instances(s, d, "cand_match", "match_3_window", "match_6_window", "match_10_window")
    return features.window_features(i, features.window_counts(table(s, d, "documents"), i.select("cand_match")))


def label_inputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return current_instances(s, d, "file_name", "cand_match", "umls_match", "curr_occurence_offset"), labels.annotations(table(s, d, "gold_labels"))


def unmatched(s: SparkSession, d: str) -> DataFrame:
    i, a = label_inputs(s, d)
    hit = labels.label_matches(i, a).where("yi = 1").join(i.select("inst_id", "file_name"), "inst_id")
    return labels.unmatched_exact(a, hit)


def unmatched_fuzzy(s: SparkSession, d: str) -> DataFrame:
    i, a = label_inputs(s, d)
    found = i.where("file_name is not null and cand_match is not null").select("file_name", F.col("inst_id").alias("found_no"), F.lower("cand_match").alias("found"))
    return labels.unmatched_fuzzy(a, found.join(a.select("file_name").distinct(), "file_name", "left_semi"))


def instances_from_posts(s: SparkSession, d: str) -> DataFrame:
    return assembly.instances_of(table(s, d, "posts"), table(s, d, "lexicon"))


def assembled(s: SparkSession, d: str) -> DataFrame:
    """Every match of the posts with all its features and its weak label."""
    rows = cut(instances_from_posts(s, d))
    outside = table(s, d, "lexicon").where("source_file = 'not_in_kb'").select(F.lower("str").alias("t"))
    whole = assembly.assembled(rows, table(s, d, "documents"), dictionary(s, d), outside, assembly.weak_labels(rows, table(s, d, "gold_labels")))
    return assembly.checked(rows, whole)


def judged_posts(s: SparkSession, d: str) -> DataFrame:
    """From posts to metrics: the forest learns on the first annotated files, and its decisions on the others are compared with the annotations."""
    gold = gold_spans(s, d)
    rows = cut(assembled(s, d).join(ranking.hold_out(table(s, d, "gold_labels")), "file_name"))
    groups = [{"semantic_type": "Disorder"}, {"semantic_type": "Chemical or drug"}]
    models = model.train_groups(rows.where("split = 'train'"), groups)
    out = model.score_groups(models, rows.where("split = 'test'"))
    scored = model.tuned(out, out, "semantic_type")
    predicted = assembly.spans_of(scored).withColumn("community", community(F.col("file_name")))
    tested = gold.join(rows.where("split = 'test'").select("file_name").distinct(), "file_name", "left_semi")
    return evaluate.entity_metrics(evaluate.entity_errors(tested, predicted), "community", "label")


def candidate_spans(s: SparkSession, d: str) -> DataFrame:
    """All candidates of the annotated files, whatever a model says."""
    i = current_instances(s, d, "file_name", "cand_match", "curr_occurence_offset", "semantic_type").join(table(s, d, "gold_labels").select("file_name").distinct(), "file_name", "left_semi")
    return assembly.spans_of(i, filtered=False).withColumn("community", community(F.col("file_name")))


def entity_report(s: SparkSession, d: str) -> DataFrame:
    rows = evaluate.entity_metrics(errors(s, d).where("community is not null"), "community").withColumn("support", F.col("tp") + F.col("fn"))
    return evaluate.report(rows, "community", ("precision", "recall", "f1"), "support")


QUERIES = {
    "matches_by_community": matches_by_community,
    "post_matches_located": located_matches,
    "post_matches_relocated": relocated,
    "blank_punctuation": lambda s, d: table(s, d, "posts").select("post_id", X.blank_punctuation(F.col("post_txt")).alias("t")),
    "english_text": lambda s, d: table(s, d, "posts").select("post_id", X.english_text(F.col("post_txt")).alias("t")),
    "cleaned_text": lambda s, d: table(s, d, "posts").select("post_id", X.cleaned(F.col("post_txt")).alias("t")),
    "parser_input": lambda s, d: table(s, d, "posts").select("post_id", X.parser_input(F.col("post_txt")).alias("t")),
    "one_spelling": lambda s, d: table(s, d, "posts").select("post_id", X.one_spelling(F.col("post_txt")).alias("t")),
    "display_words": lambda s, d: table(s, d, "posts").where("tokenized_text is not null").select("post_id", F.posexplode(X.display_words(F.col("tokenized_text"))).alias("pos", "w")),
    "usable_tokens": lambda s, d: table(s, d, "posts").where("tokenized_text is not null").select("post_id", F.posexplode(X.usable_tokens(F.col("tokenized_text"))).alias("pos", "token")),
    "classed_tokens": classed_tokens,
    "sentences": sentences,
    "post_ngrams": lambda s, d: matching.post_ngrams(table(s, d, "posts"), "tokenized_text"),
    "semantic_types": lambda s, d: table(s, d, "lexicon").select("lex_idx", "tui", X.semantic_type(F.col("tui")).alias("semantic_type")),
    "lexicon_union": lexicon_union,
    "lexicon_priority_heb": lambda s, d: matching.priority_entries(table(s, d, "lexicon"), "heb").select("form", "cui", "lex_idx"),
    "lexicon_priority_eng": lambda s, d: matching.priority_entries(table(s, d, "lexicon"), "str").select("form", "cui", "lex_idx"),
    "sample_terms": sample_terms,
    "cosine_match": lambda s, d: matching.cosine_candidates(mentions(s, d), terms(s, d)).select("gram", "n", "term", "overlap"),
    "gestalt_match": lambda s, d: matching.good_matches(matching.cosine_candidates(mentions(s, d), terms(s, d))).select("gram", "term", "ratio"),
    "occurrences": lambda s, d: current_instances(s, d, "cand_match", "post_txt").select("inst_id", F.posexplode(X.literal_offsets(F.lower("post_txt"), F.lower("cand_match"))).alias("k", "start_offset")),
    "kth_occurrence": kth_occurrence,
    "every_occurrence": lambda s, d: matching.every_occurrence(table(s, d, "instances")),
    "kept_spans": lambda s, d: matching.kept_spans(current_instances(s, d, "file_name", "umls_match", "cand_match", "curr_occurence_offset")),
    "most_specific": lambda s, d: instances.most_specific(current_instances(s, d, "file_name", "cand_match", "umls_match", "curr_occurence_offset")).select("inst_id"),
    "context_windows": lambda s, d: instances.windows(current_instances(s, d, "post_txt", "curr_occurence_offset").where("post_txt is not null and curr_occurence_offset is not null")),
    "instances_from_posts": lambda s, d: instances_from_posts(s, d).drop("inst_id", "post_txt"),
    "assembled_rows": lambda s, d: assembled(s, d).drop("inst_id"),
    "judged_posts": judged_posts,
    "instance_views": lambda s, d: current_instances(s, d, "cand_match", "match_eng", "umls_match", "match_type").select("inst_id", instances.match_type(F.col("cand_match"), F.col("match_type")).alias("match_type"), instances.display_name(F.col("match_eng"), F.col("umls_match")).alias("name")),
    "first_posts": lambda s, d: instances.first_of_each(table(s, d, "posts").select("post_id", "post_txt", "lemmas"), ["post_txt", "lemmas"], "post_id").select("post_id"),
    "labelled_posts": lambda s, d: readers.labelled_posts(table(s, d, "posts"), table(s, d, "gold_labels")).select("post_id", "file_name"),
    "corpus_counts": lambda s, d: features.corpus_counts(table(s, d, "documents")),
    "count_features": lambda s, d: features.count_features(table(s, d, "instances"), features.corpus_counts(table(s, d, "documents"))),
    "bigram_model": lambda s, d: features.bigram_model(table(s, d, "documents")),
    "bigram_feature": lambda s, d: features.bigram_feature(current_instances(s, d, "cand_match", "match_3_window"), features.bigram_model(table(s, d, "documents"))),
    "window_probability": window_probabilities,
    "relatedness": relatedness,
    "missing_terms": missing_terms,
    "missing_counts": lambda s, d: features.missing_counts(table(s, d, "instances").select(F.lower("match_eng").alias("match_eng")), dictionary(s, d).where("score >= 0")),
    "lattice": lattice,
    "dependency_tree": dependency,
    "sentence_numbers": lambda s, d: features.sentence_numbers(numbered_rows(s, d)).select("post_id", "pos", "sentence"),
    "token_groups": lambda s, d: features.token_groups(features.sentence_numbers(numbered_rows(s, d)), ["post_id", "sentence"]),
    "window_features": window_features,
    "morphology_row": morphology,
    "labels_gestalt": lambda s, d: labels.label_matches(*label_inputs(s, d)),
    "labels_lemma": lambda s, d: labels.label_matches(*label_inputs(s, d), lemma=True),
    "labels_unmatched": unmatched,
    "labels_unmatched_fuzzy": unmatched_fuzzy,
    "labels_could_be_matched": lambda s, d: labels.could_be_matched(unmatched(s, d), label_inputs(s, d)[0]),
    "labels_registered": lambda s, d: labels.registered(labels.annotations(table(s, d, "gold_labels"))),
    "labels_missed_terms": lambda s, d: labels.missed_terms(unmatched(s, d), table(s, d, "lexicon").where("source_file = 'not_in_kb'").select("heb").where("heb is not null")),
    "hold_out": lambda s, d: ranking.hold_out(table(s, d, "gold_labels")),
    "forest_scores": forest_scores,
    "spans_in_place": lambda s, d: evaluate.in_place(gold_spans(s, d), gold_texts(s, d)).select("file_name", "ann_no", "term", "ok"),
    "span_lists": lambda s, d: evaluate.span_lists(gold_spans(s, d)),
    "bio_tokens": lambda s, d: _bio(s, d, "gold"),
    "tokenisation_problems": lambda s, d: evaluate.tokenisation_problems(gold_texts(s, d), gold_spans(s, d)).select("file_name", "ann_no", "term"),
    "token_confusion": confusion,
    "token_confusion_io": lambda s, d: confusion(s, d, io=True),
    "token_metrics": lambda s, d: evaluate.token_metrics(confusion(s, d)),
    "token_totals": lambda s, d: evaluate.token_totals(confusion(s, d)),
    "entity_errors": lambda s, d: errors(s, d).groupBy("community", "label", "kind").agg(F.count(F.lit(1)).alias("n")),
    "entity_metrics": lambda s, d: evaluate.entity_metrics(errors(s, d), "community", "label"),
    "baseline_metrics": lambda s, d: evaluate.entity_metrics(evaluate.entity_errors(gold_spans(s, d), candidate_spans(s, d)), "community", "label"),
    "entity_report": entity_report,
    "error_rows": lambda s, d: evaluate.error_rows(errors(s, d)),
    "term_counters": lambda s, d: evaluate.term_counters(errors(s, d)),
    "top_errors": lambda s, d: evaluate.top_errors(errors(s, d), "FP"),
    "annotation_stats": lambda s, d: evaluate.annotation_stats(gold_spans(s, d).where("community is not null")),
    "value_counts": lambda s, d: current_instances(s, d, "yi").groupBy("yi").agg(F.count(F.lit(1)).alias("n")),
    "binary_metrics": lambda s, d: evaluate.binary_metrics(scored(s, d), "community", "semantic_type"),
    "threshold_sweep": lambda s, d: evaluate.threshold_sweep(scored(s, d), "semantic_type"),
    "best_threshold": lambda s, d: evaluate.best_threshold(evaluate.threshold_sweep(scored(s, d), "semantic_type"), "semantic_type"),
    "filtered_out": lambda s, d: evaluate.filtered_out(scored(s, d), "community", "semantic_type"),
    "weighted_average": lambda s, d: evaluate.weighted_average(evaluate.binary_metrics(scored(s, d), "community").withColumn("support", F.col("tp") + F.col("fn")), ("precision", "recall", "f1"), "support"),
}
