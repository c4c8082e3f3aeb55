"""Problem 2: records that differ only in lay-out, collapsed into one each.

Byte-identical rows are collapsed first with their counts; only the distinct survivors are canonicalised, and these are
grouped again on the full canonical text, summing the counts. Both groupings combine on the map side, so a group of
copies with a third of all rows reaches a reducer as one row per map task.

Canonical text drops white space, case and punctuation (ASCII punctuation and Unicode category P). In a filled form - four
or more non-blank lines, each a label and a colon - the lines are sorted, in the text and in the lemmas.

Defined results: null counts as empty; two rows without text and lemmas are copies; invisible characters are neither white
space nor punctuation and keep records apart; rows with a null id take no part; repeated rows with one id count as copies
of themselves but are listed once; ties go to the smallest id; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.session import cut

#: White space and punctuation, spelled for the JVM's regular expressions.
DROPPED = r"[\p{Punct}\p{IsP}\s\u001c-\u001f\u0085   -     　]+"
LABEL = r"^\s*[^:\n]{0,40}\p{L}[^:\n]{0,40}:"


def squeezed(text: Column) -> Column:
    """Text without white space, case and punctuation."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), DROPPED, ""))


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\n\r]+"), lambda x: F.length(F.trim(x)) > 0)


def is_form(text: Column) -> Column:
    """Four or more non-blank lines, each beginning with a label and a colon."""
    lines = _lines(text)
    return (F.size(lines) >= 4) & F.forall(lines, lambda x: x.rlike(LABEL))


def canonical(text: Column, lemmas: Column) -> Column:
    """The full canonical text of a record; forms and plain records never meet."""
    sorted_lines = lambda c: F.array_join(F.array_sort(F.filter(F.transform(_lines(c), squeezed), lambda x: x != "")), "\n")
    return F.when(is_form(text), F.concat(F.lit("F"), sorted_lines(text), F.lit("\u0001"), sorted_lines(lemmas))).otherwise(F.concat(F.lit("N"), squeezed(text), F.lit("\u0001"), squeezed(lemmas)))


def _digest(*parts: Column) -> Column:
    """128 bits that stand for texts in narrow joins; null differs from empty."""
    return F.unhex(F.md5(F.concat_ws("\u0001", *(F.concat(F.coalesce(F.length(p), F.lit(-1)), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts))))


def _survivors(df: DataFrame, key: str, text: str, lemmas: str) -> DataFrame:
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"), F.col(lemmas).alias("l"))
    return rows.groupBy("t", "l").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))


def collapse(df: DataFrame, key: str = "post_id", text: str = "post_txt", lemmas: str = "lemmas") -> DataFrame:
    """One record for each group of copies, as its smallest id has it: ``first_id, text, lemmas, n_copies``."""
    raw = _survivors(df, key, text, lemmas).withColumn("c", canonical(F.col("t"), F.col("l")))
    return raw.groupBy("c").agg(F.min("first").alias("first_id"), F.sum("n").alias("n_copies"), F.min_by(F.struct("t", "l"), "first").alias("r")).select("first_id", F.col("r.t").alias("text"), F.col("r.l").alias("lemmas"), "n_copies")


def copies(df: DataFrame, key: str = "post_id", text: str = "post_txt", lemmas: str = "lemmas") -> DataFrame:
    """Membership of the same groups: ``first_id, copy_id``, each copy once. Beyond the two groupings only digests and ids move."""
    raw = _survivors(df, key, text, lemmas).withColumn("c", canonical(F.col("t"), F.col("l")))
    groups = raw.groupBy("c").agg(F.min("first").alias("first_id"), F.sum("n").alias("n_copies")).where("n_copies > 1")
    groups = groups.select(_digest(F.col("c")).alias("g"), "first_id")
    survivors = raw.select(_digest(F.col("t"), F.col("l")).alias("d"), _digest(F.col("c")).alias("g"), "first", "n")
    link = cut(survivors.join(groups, "g").select("d", "first", "n", "first_id"))
    across = link.where("first <> first_id").select("first_id", F.col("first").alias("copy_id"))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), _digest(F.col(text), F.col(lemmas)).alias("d"))
    within = rows.join(link.where("n > 1"), "d").where("id <> first").select("first_id", F.col("id").alias("copy_id"))
    return across.unionByName(within)
