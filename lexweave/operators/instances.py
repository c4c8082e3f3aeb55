"""Training instances: the most specific match of a span, with its context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.config import T
from lexweave.functions import text as X
from lexweave.functions.similarity import gestalt, may_exceed


def located(matches: DataFrame, offset: str = "curr_occurence_offset") -> DataFrame:
    """Matches whose offset is a whole number."""
    return matches.withColumn(offset, F.col(offset).cast("string").try_cast("int")).where(F.col(offset).isNotNull())


def windows(instances: DataFrame, text: str = "post_txt", offset: str = "curr_occurence_offset", sizes: tuple[int, ...] = (3, 6, 10), compat: bool = False, key: str = "inst_id") -> DataFrame:
    """The key and the last 3, 6 and 10 words before the match; punctuation and line breaks part words."""
    words = instances.select(key, X.prefix_words(X.blank_punctuation(F.col(text)), F.col(offset), compat).alias("w"))
    return words.select(key, *(X.last_words(F.col("w"), k).alias(f"window_{k}") for k in sizes))


def match_type(cand: Column, key: Column) -> Column:
    """The text a match came from; Latin candidates count as tokenised text."""
    return F.when(X.is_english(cand), "tokenized_text").otherwise(key)


def display_name(match_eng: Column, umls_match: Column) -> Column:
    return F.coalesce(match_eng, umls_match)


def contained(instances: DataFrame, above: float = T.above_occurrence, chars: int = T.dedupe_chars, key: str = "inst_id", file: str = "file_name") -> DataFrame:
    """The key of matches that a longer match of the same file covers.

    The terms are compared as the terminology has them: of the longer one the first words, as many as the shorter one has,
    or the words behind them read like the shorter one, the first of those behind has three letters or more, and
    the spans begin or end within ``chars`` of each other. Spans meet on the file and a grid of offsets, so a file
    with very many matches is spread and no pair of distant spans is formed.
    """
    known = " and ".join(f"{c} is not null" for c in (file, "cand_match", "umls_match", "curr_occurence_offset"))
    m = instances.where(known).select(key, F.col(file).alias("file"), "umls_match", F.split("umls_match", " ").alias("w"), F.col("curr_occurence_offset").alias("s"), X.span_end(F.col("curr_occurence_offset"), F.col("cand_match")).alias("e"))
    m = m.withColumn("n", F.size("w"))
    cell = chars + 1
    here = m.select("*", F.explode(F.array(F.struct(F.lit("s").alias("side"), F.floor(F.col("s") / cell).alias("cell")), F.struct(F.lit("e").alias("side"), F.floor(F.col("e") / cell).alias("cell")))).alias("g")).drop("w")
    there = m.where("n > 1").select(*(F.col(c).alias(f"l_{c}") for c in ("w", "s", "e", "n")), "file", F.explode(F.flatten(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.array(F.struct(F.lit("s").alias("side"), (F.floor(F.col("s") / cell) + d).alias("cell")), F.struct(F.lit("e").alias("side"), (F.floor(F.col("e") / cell) + d).alias("cell")))))).alias("g"))
    near = here.join(there, ["file", "g"]).where((F.col("l_n") > F.col("n")) & ((F.abs(F.col("s") - F.col("l_s")) <= chars) | (F.abs(F.col("e") - F.col("l_e")) <= chars)) & (F.length(F.get("l_w", F.col("n"))) >= 3))
    front, back = F.array_join(F.slice("l_w", F.lit(1), F.col("n")), " "), F.array_join(F.slice("l_w", F.col("n") + 1, F.greatest(F.col("l_n") - F.col("n"), F.lit(0))), " ")
    near = near.select(key, "umls_match", front.alias("front"), back.alias("back"))
    near = near.where(may_exceed(F.col("front"), F.col("umls_match"), above) | may_exceed(F.col("back"), F.col("umls_match"), above))
    return near.where((gestalt("front", "umls_match") > above) | (gestalt("back", "umls_match") > above)).select(key).distinct()


def most_specific(instances: DataFrame, key: str = "inst_id", file: str = "file_name") -> DataFrame:
    """Instances that no longer match covers."""
    return instances.join(contained(instances, key=key, file=file), key, "left_anti")


def first_of_each(rows: DataFrame, subset: list[str], order: str) -> DataFrame:
    """One row per distinct ``subset`` (nulls are equal): the first by ``order``."""
    rest = [c for c in rows.columns if c not in subset]
    return rows.groupBy(*subset).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*subset, "r.*")
