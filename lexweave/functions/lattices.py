"""Parser output in text form (tab-separated blocks) as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPENDENCY = ("num", "word", "lemma", "pos", "pos_2", "empty", "dependency_arc", "dependency_part", "dependency_arc_2", "dependency_part_2")
FEATURES = ("gen", "num", "per", "tense", "suf_gen", "suf_num", "suf_per")


def block_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, sentence, line_no, f`` for every non-empty line; blank lines part sentences."""
    blocks = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("sentence", "block"))
    lines = blocks.select(key, "sentence", F.posexplode(F.split("block", "\n")).alias("line_no", "line")).where("line <> ''")
    return lines.select(key, "sentence", "line_no", F.split("line", "\t").alias("f"))


def dependency_tree(df: DataFrame, key: str, text: str) -> DataFrame:
    """Ten columns per token; an empty lemma is the word, missing fields are -1."""
    rows = block_rows(df, key, text)
    columns = [F.coalesce(F.nullif(F.get("f", F.lit(i)), F.lit("")), F.get("f", F.lit(1)) if name == "lemma" else F.lit("-1")).alias(name) for i, name in enumerate(DEPENDENCY)]
    return rows.select(key, "sentence", "line_no", *columns)


def feature_map(features: Column) -> Column:
    """``gen=F|num=S`` as a map; of repeated keys the values are put together."""
    pairs = F.filter(F.split(features, r"\|"), lambda x: F.contains(x, F.lit("=")))
    keys = F.array_distinct(F.transform(pairs, lambda x: F.substring_index(x, "=", 1)))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_join(F.transform(F.filter(pairs, lambda x: F.substring_index(x, "=", 1) == k), lambda x: F.substring_index(x, "=", -1)), "")))


def lattice(df: DataFrame, key: str, text: str, analyses: bool = False) -> DataFrame:
    """Morpheme rows of eight fields: from, to, word, lemma, two tags, features, token number. Other widths are an error.

    ``analyses`` adds the suffix features of the undisambiguated lattice.
    """
    rows = block_rows(df, key, text)
    f = lambda i: F.get("f", F.lit(i))
    fm = feature_map(f(6))
    wanted = FEATURES if analyses else FEATURES[:4]
    checked = rows.where(F.assert_true(F.size("f") == 8, F.lit("a lattice row must have 8 fields")).isNull())
    word = f(2)
    return checked.select(key, "sentence", "line_no", f(0).cast("int").alias("start"), f(1).cast("int").alias("end"), word.alias("word"), F.when(f(3).isin("", "_"), word).otherwise(F.coalesce(f(3), word)).alias("lemma"), f(4).alias("pos"), f(5).alias("pos_2"), *(F.element_at(fm, name).alias("num_s_p" if name == "num" else name) for name in wanted), f(7).cast("int").alias("num_last"))
