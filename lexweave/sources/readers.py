"""Readers of the text formats: CSV with JSON columns, folders of posts, corpora, and dictionary lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ANNOTATIONS = "array<struct<term string, start_offset int, end_offset int, label string>>"
LEXICON = ("cui", "tui", "stt", "str", "heb")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; an empty field is null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def posts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Posts with ``words_and_lemmas`` as JSON text."""
    return csv(spark, path).withColumn("words_and_lemmas", F.from_json("words_and_lemmas", "array<string>"))


def gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """Annotated posts with the spans as JSON text; missing spans are an empty list."""
    spans = F.coalesce(F.from_json("merged_inner_and_outer", ANNOTATIONS), F.array().cast("array<struct<term:string,start_offset:int,end_offset:int,label:string>>"))
    return csv(spark, path).withColumn("merged_inner_and_outer", spans)


def lexicon_union(*parts: DataFrame) -> DataFrame:
    """Terminology parts under one another, numbered anew: part by part, in the parts' own order (``lex_idx``)."""
    from lexweave.operators.ranking import global_rank

    out = None
    for i, p in enumerate(parts):
        one = p.withColumn("source_rank", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return global_rank(out, "source_rank", "lex_idx").withColumn("lex_idx", F.col("rank") - 1).drop("rank", "source_rank")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of each line."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def post_folder(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, post_txt`` of a folder of text files: empty lines are dropped, hard spaces are spaces, blank files left out."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("file_name"), F.replace("value", F.lit(" "), F.lit(" ")).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x) != "")
    return files.select("file_name", F.array_join(lines, "\n").alias("post_txt")).where(F.trim("post_txt") != "")


def relatedness_file(spark: SparkSession, path: str) -> DataFrame:
    """``value, line_no`` of a dictionary file, for ``features.relatedness_lines``. Large files are read in blocks; ``line_no`` orders lines over these."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("line_no"))
    return lines.where("value <> ''")


def feature_files(spark: SparkSession, instances: str, *features: str, key: tuple[str, ...] = ("row_idx", "cand_match", "umls_match", "curr_occurence_offset")) -> DataFrame:
    """The instances' CSV joined with the feature CSVs on the common key; columns that both have are taken from the first."""
    out = csv(spark, instances)
    for path in features:
        one = csv(spark, path)
        out = out.join(one.select(*key, *(c for c in one.columns if c not in out.columns)), list(key), "left")
    return out


def train_and_test(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The two sides of a table written with the partition column ``split``; only the asked side's folder is read."""
    rows = spark.read.parquet(path)
    return rows.where("split = 'train'"), rows.where("split = 'test'")


def labelled_posts(posts: DataFrame, gold: DataFrame, expected: int | None = None, within: int = 2) -> DataFrame:
    """Posts whose text is annotated; texts are compared without the spaces around them.

    With ``expected`` the query fails where there are more than ``within`` posts more or less.
    """
    found = posts.join(gold.select(F.trim("text").alias("t")).distinct(), F.trim(posts["post_txt"]) == F.col("t"), "left_semi")
    if expected is None:
        return found
    right = found.agg(F.assert_true(F.abs(F.count(F.lit(1)) - expected) <= within, F.lit(f"not about {expected} posts with labels")).alias("ok"))  # one row
    return found.crossJoin(F.broadcast(right)).where("ok is null").drop("ok")
