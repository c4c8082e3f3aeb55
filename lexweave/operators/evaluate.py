"""Evaluation: entity-level and token-level quality, thresholds, and the report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.config import T
from lexweave.functions import text as X
from lexweave.functions.similarity import gestalt, may_exceed

# ---- spans -------------------------------------------------------------------------------------------------------------


def in_place(spans: DataFrame, texts: DataFrame, least: float = T.in_place) -> DataFrame:
    """Spans with ``ok``: the text at their place reads like their term. ``texts`` has one ``text`` per file."""
    j = spans.join(texts.select("file_name", F.col("text").alias("t")), "file_name")
    there = F.substring("t", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset"))
    return j.withColumn("there", there).withColumn("ok", F.coalesce(gestalt("there", "term") > least, F.lit(False))).drop("t", "there")


def near_spans(gold: DataFrame, predicted: DataFrame, chars: int = T.dedupe_chars, above: float = T.label) -> DataFrame:
    """Pairs ``gold_id, pred_id, of_gold, of_predicted`` of the same file and label that begin near each other.

    The ratio depends on which term comes first: ``of_gold`` says whether the gold term finds the predicted one, the other
    whether the predicted term finds the gold one. The sides bring ``file_name, term, start_offset, label`` and an id; they
    meet on a grid of offsets.
    """
    cell = chars + 1
    g = gold.select("gold_id", "file_name", "label", F.col("term").alias("gt"), F.col("start_offset").alias("gs"), F.floor(F.col("start_offset") / cell).alias("cell"))
    at = F.floor(F.col("start_offset") / cell)
    p = predicted.select("pred_id", "file_name", "label", F.col("term").alias("pt"), F.col("start_offset").alias("ps"), F.explode(F.array(at - 1, at, at + 1)).alias("cell"))
    near = g.join(p, ["file_name", "label", "cell"]).where(F.abs(F.col("gs") - F.col("ps")) <= chars).where(may_exceed(F.col("gt"), F.col("pt"), above))
    return near.select("gold_id", "pred_id", (gestalt("gt", "pt") > above).alias("of_gold"), (gestalt("pt", "gt") > above).alias("of_predicted"))


def entity_errors(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """``community, file_name, label, term, kind, start_offset`` for every true positive and false negative (of the gold side) and false positive."""
    pairs = near_spans(gold, predicted)
    hit_gold = pairs.where("of_gold").select("gold_id").distinct().withColumn("hit", F.lit(True))
    hit_pred = pairs.where("of_predicted").select("pred_id").distinct().withColumn("hit", F.lit(True))
    columns = ["community", "file_name", "label", "term", "start_offset"]
    g = gold.join(hit_gold, "gold_id", "left").select(*columns, F.when(F.col("hit"), "TP").otherwise("FN").alias("kind"))
    p = predicted.join(hit_pred, "pred_id", "left").where("hit is null").select(*columns, F.lit("FP").alias("kind"))
    return g.unionByName(p)


def term_counters(errors: DataFrame) -> DataFrame:
    """``community, kind, term, n, places``: how often a term is each kind of hit or error, and where, as ordered text ``file:label:start``."""
    places = F.array_sort(F.collect_list(F.concat_ws(":", "file_name", "label", F.col("start_offset").cast("string"))))
    return errors.groupBy("community", "kind", "term").agg(F.count(F.lit(1)).alias("n"), places.alias("places"))


def entity_metrics(errors: DataFrame, *keys: str) -> DataFrame:
    """Counts, precision, recall and F1 by the keys; null where a denominator is 0."""
    n = lambda k: F.sum((F.col("kind") == k).cast("long"))
    c = errors.groupBy(*keys).agg(n("TP").alias("tp"), n("FP").alias("fp"), n("FN").alias("fn"))
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    return c.select(*keys, "tp", "fp", "fn", F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


def error_rows(errors: DataFrame) -> DataFrame:
    """Files with a false negative or false positive and the terms of each, in order."""
    terms = lambda k: F.concat_ws("|", F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("term"))))).alias(k.lower())
    return errors.groupBy("community", "file_name").agg(terms("FN"), terms("FP"), F.sum((F.col("kind") != "TP").cast("long")).alias("n_errors")).where("n_errors > 0")


def top_errors(errors: DataFrame, kind: str, k: int = 10) -> DataFrame:
    """The k most common terms of an error kind, ties by term, with the number of files."""
    return errors.where(F.col("kind") == kind).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_name").alias("n_files")).orderBy(F.desc("n"), "term").limit(k)


def span_lists(spans: DataFrame) -> DataFrame:
    """``file_name, spans``: each file's spans as ordered text ``start:end:label:term``."""
    s = F.array_sort(F.collect_list(F.struct("start_offset", "end_offset", "label", "term")))
    return spans.groupBy("file_name").agg(F.transform(s, lambda x: F.concat_ws(":", x.start_offset.cast("string"), x.end_offset.cast("string"), x.label, x.term)).alias("spans"))


# ---- tokens ------------------------------------------------------------------------------------------------------------


def bio_tokens(texts: DataFrame, spans: DataFrame, least: float = T.in_place) -> DataFrame:
    """``file_name, idx, w, tag`` of every token of the texts: B-D, I-D, B-C, I-C or O.

    A span's first token is as many tokens in as there are spaces before it; it covers as many tokens as its term has words.
    It counts when the tokens read like the term; where spans meet on a token the last one stands.
    """
    fits = _read(texts, spans).where(gestalt("term", "read") >= least)
    tagged = fits.select("file_name", "ann_no", F.substring("label", 1, 1).alias("c"), F.posexplode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("i", "idx"))
    tag = F.concat(F.when(F.col("i") == 0, "B-").otherwise("I-"), F.col("c"))
    last = tagged.groupBy("file_name", "idx").agg(F.max_by(tag, F.col("ann_no")).alias("tag"))
    tokens = texts.select("file_name", F.posexplode(F.split(X.blank_punctuation(F.col("text")), " ")).alias("idx", "w"))
    return tokens.join(last, ["file_name", "idx"], "left").select("file_name", "idx", "w", F.coalesce("tag", F.lit("O")).alias("tag"))


def _read(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans with ``first`` token, ``n`` tokens and what these ``read``; those without words or that end behind the text are left out."""
    t = texts.select("file_name", X.blank_punctuation(F.col("text")).alias("t")).withColumn("w", F.split("t", " "))
    before = F.substring("t", 1, F.col("start_offset") + 1)
    term = F.replace(F.trim("term"), F.lit("-"), F.lit(" "))
    s = spans.join(t, "file_name").select("file_name", "ann_no", "label", term.alias("term"), (F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))).alias("first"), "w")
    s = s.withColumn("n", F.size(F.filter(F.split("term", " "), lambda x: x != ""))).where((F.col("n") > 0) & (F.col("first") + F.col("n") <= F.size("w")))
    return s.select("file_name", "ann_no", "label", "term", "first", "n", F.array_join(F.slice("w", F.col("first") + 1, F.col("n")), " ").alias("read"))


def tokenisation_problems(texts: DataFrame, spans: DataFrame, least: float = T.in_place) -> DataFrame:
    """Spans whose tokens do not read like their term, or that end behind the text."""
    ok = _read(texts, spans).where(gestalt("term", "read") >= least).select("file_name", "ann_no").distinct()
    return spans.join(ok, ["file_name", "ann_no"], "left_anti")


def token_confusion(true: DataFrame, predicted: DataFrame, io: bool = False) -> DataFrame:
    """``true_tag, pred_tag, n`` over the tokens both sides have."""
    tag = X.io_tag if io else (lambda c: c)
    j = true.select("file_name", "idx", tag(F.col("tag")).alias("true_tag")).join(predicted.select("file_name", "idx", tag(F.col("tag")).alias("pred_tag")), ["file_name", "idx"])
    return j.groupBy("true_tag", "pred_tag").agg(F.count(F.lit(1)).alias("n"))


def token_metrics(confusion: DataFrame) -> DataFrame:
    """``tag, precision, recall, f1, support`` by label without O, and their support-weighted mean as ``weighted`` with the accuracy.

    The confusion table has one row per pair of tags, whatever the corpus.
    """
    tags = confusion.select(F.explode(F.array("true_tag", "pred_tag")).alias("tag")).distinct().where("tag <> 'O'")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("double")
    tp, fp, fn = n((F.col("true_tag") == F.col("tag")) & (F.col("pred_tag") == F.col("tag"))), n((F.col("true_tag") != F.col("tag")) & (F.col("pred_tag") == F.col("tag"))), n((F.col("true_tag") == F.col("tag")) & (F.col("pred_tag") != F.col("tag")))
    each = tags.join(F.broadcast(confusion), (F.col("tag") == F.col("true_tag")) | (F.col("tag") == F.col("pred_tag"))).groupBy("tag").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    each = each.select("tag", F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"), (F.col("tp") + F.col("fn")).cast("long").alias("support"))
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)
    return each.unionByName(each.agg(mean("precision"), mean("recall"), mean("f1"), F.sum("support").alias("support")).withColumn("tag", F.lit("weighted")))


def token_totals(confusion: DataFrame) -> DataFrame:
    """Accuracy over all tokens with O, and the true negatives (both O)."""
    same = F.sum(F.when(F.col("true_tag") == F.col("pred_tag"), F.col("n")).otherwise(0))
    return confusion.agg(F.try_divide(same.cast("double"), F.sum("n")).alias("accuracy"), F.sum(F.when((F.col("true_tag") == "O") & (F.col("pred_tag") == "O"), F.col("n")).otherwise(0)).alias("tn"))


# ---- scores ------------------------------------------------------------------------------------------------------------


def binary_metrics(scored: DataFrame, *keys: str, y: str = "yi", predicted: str = "hard_y_pred") -> DataFrame:
    """Accuracy, precision, recall, F1 and the four counts of a binary decision by the keys."""
    n = lambda a, b: F.sum(((F.col(y) == a) & (F.col(predicted) == b)).cast("long"))
    c = scored.groupBy(*keys).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return c.select(*keys, "tp", "fp", "fn", "tn", F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"), F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))


def threshold_sweep(scored: DataFrame, *keys: str, score: str = "score", y: str = "yi") -> DataFrame:
    """Metrics at the thresholds 0.1 to 0.9: each row counts for every threshold below its score, in one pass."""
    grid = F.array(*(F.lit(i / 10) for i in range(1, 10)))
    rows = scored.where(F.col(score).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(y).alias("yi"), F.col(score).alias("score"), F.explode(grid).alias("threshold"))
    return binary_metrics(rows.withColumn("hard_y_pred", (F.col("score") > F.col("threshold")).cast("int")), *keys, "threshold")


def best_threshold(sweep: DataFrame, *keys: str) -> DataFrame:
    """The threshold with the highest F1, the smallest of several; it is defined where all are 0 as well."""
    return sweep.groupBy(*keys).agg(F.max_by(F.struct("threshold", "f1", "precision", "recall", "accuracy"), F.struct("f1", -F.col("threshold"))).alias("b")).select(*keys, "b.*")


def weighted_average(rows: DataFrame, metrics: tuple[str, ...], weight: str) -> DataFrame:
    """Each metric weighted by the support."""
    return rows.agg(*(F.try_divide(F.sum(F.col(m) * F.col(weight)), F.sum(weight)).alias(m) for m in metrics), F.sum(weight).alias(weight))


def report(rows: DataFrame, name: str, metrics: tuple[str, ...], weight: str, label: str = "weighted avg") -> DataFrame:
    """The rows of a report and, under ``label``, their weighted average; ``name`` is the column that names a row."""
    mean = weighted_average(rows, metrics, weight).withColumn(name, F.lit(label))
    return rows.select(name, *metrics, weight).unionByName(mean.select(name, *metrics, weight))


def filtered_out(scored: DataFrame, *keys: str, predicted: str = "hard_y_pred") -> DataFrame:
    """Share of candidates that the model drops, and as a cut percentage."""
    return scored.groupBy(*keys).agg(F.avg(1.0 - F.col(predicted)).alias("share")).withColumn("percent", X.percent(F.col("share")))


def annotation_stats(anns: DataFrame) -> DataFrame:
    """Annotated and distinct terms of each label by community and in total; the total of distinct terms is a true one."""
    n = lambda label, name: F.sum((F.col("label") == label).cast("long")).alias(name)
    d = lambda label, name: F.countDistinct(F.when(F.col("label") == label, F.col("term"))).alias(name)
    rows = anns.rollup("community").agg(F.grouping("community").alias("g"), n("Disorder", "disorders"), n("Chemical or drug", "chemicals"), d("Disorder", "unique_disorders"), d("Chemical or drug", "unique_chemicals"))
    return rows.select(F.when(F.col("g") == 1, "Total").otherwise(F.col("community")).alias("community"), "disorders", "chemicals", "unique_disorders", "unique_chemicals", (F.col("unique_disorders") + F.col("unique_chemicals")).alias("unique_annotated"))
