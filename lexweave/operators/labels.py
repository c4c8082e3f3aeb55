"""Weak labels: matches against annotated spans, and the annotations that no match found."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.config import T
from lexweave.functions import text as X
from lexweave.functions.similarity import gestalt, may_exceed


def annotations(gold: DataFrame, column: str = "merged_inner_and_outer") -> DataFrame:
    """``file_name, ann_no, term, start_offset, end_offset, label`` of the non-null spans; repeated rows of a file count once."""
    a = gold.where("file_name is not null").select("file_name", F.posexplode(column).alias("ann_no", "a"))
    rows = a.where("a is not null and a.term is not null and a.start_offset is not null").select("file_name", "ann_no", F.lower(F.trim("a.term")).alias("term"), "a.start_offset", "a.end_offset", "a.label")
    return rows.distinct()


def long_annotations(rows: DataFrame) -> DataFrame:
    """Only terms of more than three characters."""
    return rows.where(X.long_term(F.col("term")))


def _grid(value: Column, cell: int, spread: bool) -> Column:
    at = F.floor(value / cell)
    return F.explode(F.array(at - 1, at, at + 1)) if spread else at


def label_matches(instances: DataFrame, anns: DataFrame, lemma: bool = False) -> DataFrame:
    """``inst_id, yi, ann_no, term, label``: the last annotation of the file that begins and ends near the match and is like it.

    Spans meet on the file and a grid of offsets as wide as the tolerance, so no pair of distant spans is formed.
    ``lemma`` also compares the terminology's form, with a wider tolerance.
    """
    chars = T.lemma_chars if lemma else T.label_chars
    i = instances.where("file_name is not null and cand_match is not null and curr_occurence_offset is not null").select("inst_id", "file_name", F.lower("cand_match").alias("cand"), F.lower("umls_match").alias("kb"), F.col("curr_occurence_offset").alias("s"), X.span_end(F.col("curr_occurence_offset"), F.col("cand_match")).alias("e"))
    i = i.withColumn("cell", _grid(F.col("s"), chars + 1, False))
    a = anns.select("file_name", "ann_no", "term", "start_offset", "end_offset", "label").withColumn("cell", _grid(F.col("start_offset"), chars + 1, True))
    near = i.join(a, ["file_name", "cell"]).where((F.abs(F.col("s") - F.col("start_offset")) <= chars) & (F.abs(F.col("e") - F.col("end_offset")) <= chars))
    if lemma:
        fits = near.withColumn("sim", F.greatest(gestalt("term", "cand"), gestalt("term", "kb"))).where(F.col("sim") > T.label)
    else:
        fits = near.where(may_exceed(F.col("term"), F.col("cand"), T.label)).withColumn("sim", gestalt("term", "cand")).where(F.col("sim") >= T.label)
    best = fits.groupBy("inst_id").agg(F.max_by(F.struct("ann_no", "term", "label"), F.struct("ann_no", "start_offset", "term")).alias("b"))
    return instances.select("inst_id").distinct().join(best, "inst_id", "left").select("inst_id", F.col("b").isNotNull().cast("int").alias("yi"), "b.ann_no", "b.term", "b.label")


def unmatched_exact(anns: DataFrame, matched: DataFrame) -> DataFrame:
    """Annotations that no match took, by file and number."""
    return anns.join(matched.select("file_name", "ann_no").distinct(), ["file_name", "ann_no"], "left_anti")


def unmatched_fuzzy(anns: DataFrame, found: DataFrame, least: float = T.label) -> DataFrame:
    """Annotations of a file less the found terms: each takes an equal annotation out, else the most similar one of ``least`` or more.

    A greedy step per file; a file's terms are what one post holds.
    """

    def leave(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rest = left.sort_values("ann_no").to_dict("records")
        for term in right.sort_values("found_no")["found"]:
            hit = next((x for x in rest if x["term"] == term), None)
            if hit is None and rest:
                sims = [(SequenceMatcher(None, x["term"], term).ratio(), -k) for k, x in enumerate(rest)]
                best, k = max(sims)
                hit = rest[-k] if best >= least else None
            if hit is not None:
                rest.remove(hit)
        return pd.DataFrame(rest, columns=["file_name", "ann_no", "term", "label"])

    a = anns.select("file_name", "ann_no", "term", "label").groupBy("file_name")
    f = found.select("file_name", "found_no", "found").groupBy("file_name")
    return a.cogroup(f).applyInPandas(leave, "file_name string, ann_no int, term string, label string")


def could_be_matched(unmatched: DataFrame, matches: DataFrame, above: float = T.label) -> DataFrame:
    """``file_name, pairs``: how many pairs of a left-over annotation and any match of the file are alike."""
    m = matches.where("file_name is not null and cand_match is not null").select("file_name", F.lower("cand_match").alias("cand"), "inst_id")
    pairs = unmatched.select("file_name", "ann_no", "term").join(m, "file_name").where(may_exceed(F.col("term"), F.col("cand"), above))
    return pairs.where(gestalt("term", "cand") > above).groupBy("file_name").agg(F.count(F.lit(1)).alias("pairs"))


def registered(anns: DataFrame, chars: int = T.label_chars) -> DataFrame:
    """Annotations of a file that are not the same term at nearly the same place as an earlier kept one."""
    x = F.struct("ann_no", "term", "start_offset", "end_offset", "label")
    rows = anns.groupBy("file_name").agg(F.array_sort(F.collect_list(x)).alias("a"))
    kind = dict(rows.dtypes)["a"]
    fold = F.aggregate("a", F.array().cast(kind), lambda acc, y: F.when(F.exists(acc, lambda z: (z.term == y.term) & (F.abs(z.start_offset - y.start_offset) <= chars) & (F.abs(z.end_offset - y.end_offset) <= chars)), acc).otherwise(F.concat(acc, F.array(y))))
    return rows.select("file_name", F.explode(fold).alias("y")).select("file_name", "y.*")


def missed_terms(unmatched: DataFrame, outside: DataFrame) -> DataFrame:
    """``term, n`` of left-over annotations of more than three characters that are no terms outside the terminology."""
    o = outside.select(F.lower(F.col(outside.columns[0])).alias("term")).distinct()
    return long_annotations(unmatched).join(o, "term", "left_anti").groupBy("term").agg(F.count(F.lit(1)).alias("n"))

