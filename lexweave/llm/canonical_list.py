"""Problem 4: typed values mapped to the closest entry of a reference list, by a prefix-filter set-similarity join.

A value's set is the set of character bigrams of its padded words. Bigrams are ordered by rarity over values and entries;
two sets of the wanted similarity share at least two of the rarest ones of each - so many that what follows cannot
make up for them - and are joined on two of these at once, under the length and the positional filter and a bound by
64-bit signatures. Pairs of bigrams are rare where single ones are not, so a common bigram forms no block of its own. The
Jaccard similarity of every surviving pair is then computed exactly. Of the pairs that pass, an edit check keeps those that are
typing errors of one name, and the best one wins. The wanted similarity rises with the length of the names, as fewer
bigrams of a long name can be changed by the edits allowed.

Defined results: a row with at least one non-null field comes out once, with ``''`` when nothing fits; rows with none do not come
out; numbers must agree exactly; acronyms (letters without vowels typed as such) must agree exactly; a value that is an
entry stands for it alone; a value that is no entry but begins the entries of just one concept stands for it, if it has five
characters, or four and a mark of abbreviation; names of up to three characters bear no typing error; fields are judged
together, the concept with the most evidence wins, ties by the smaller cui; fields count in whichever column they stand; empty
tables give no rows; extra columns are ignored. Null entries of the list are left out.
"""

from __future__ import annotations

import itertools
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lexweave.functions.similarity import most_shared, signature
from lexweave.session import cut

FIELDS = ("cand_match", "umls_match", "match_eng")
#: Words that annotators add and that name nothing (fixed values).
FILLERS = ("the", "some", "prob", "probably", "maybe", "again", "pill", "pills", "tabs", "tablet", "generic", "drug", "of", "של", "תרופה", "כדור", "אולי", "כנראה", "שוב", "препарат", "таблетка")
DOSE = r'\s+\d+\s*(?:מ["״]?ג|mg|мг)\W*$'
SIMILARITY = 0.24
CELLS = 1 << 14
EDITS, EDITS_LONG, LONG = 2, 3, 11
PREFIXES = "והלבכמש"


def _accents() -> tuple[str, str]:
    """By rule: accented Latin letters and the letters below the accents."""
    odd, plain = [], []
    for i in range(0xC0, 0x250):
        k = unicodedata.normalize("NFD", chr(i))
        if len(k) > 1 and k[0].isascii():
            odd.append(chr(i))
            plain.append(k[0])
    return "".join(odd), "".join(plain)


def words(text: Column) -> Column:
    """Lower-case words without accents, marks, punctuation and fillers; letters typed one by one are put together."""
    x = F.lower(F.translate(F.regexp_replace(text, r"[\p{Mn}\p{Cf}]+", ""), *_accents()))
    w = F.filter(F.split(F.regexp_replace(x, r"[^\p{L}\p{N}]+|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})", " "), " "), lambda y: (y != "") & ~y.isin(*FILLERS))
    spelled = (F.size(w) >= 3) & F.forall(w, lambda y: F.length(y) == 1)
    return F.when(spelled, F.array(F.array_join(w, ""))).otherwise(w)


def _grams(name: Column) -> Column:
    """Hashes of the bigrams of each padded word."""
    padded = F.transform(F.split(name, " "), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.xxhash64(F.substring(w, i, F.lit(2)))))))


def entries(lexicon: DataFrame) -> DataFrame:
    """``name, cui, acronym``: the distinct normal forms of the list in either language."""
    forms = lexicon.select("cui", F.explode(F.array("str", "heb")).alias("form"), F.coalesce(F.col("stt") == "AC", F.lit(False)).alias("acronym")).where("form is not null and cui is not null")
    return forms.select(F.array_join(words(F.col("form")), " ").alias("name"), "cui", "acronym").where("name <> ''").groupBy("name", "cui").agg(F.min("acronym").alias("acronym"))


def typed_values(typed: DataFrame, key: str = "entry_id") -> DataFrame:
    """``entry_id, name, short``: each non-null field in normal form, with and without a dose behind it; ``short`` where it was cut."""
    f = typed.select(F.col(key).alias("entry_id"), F.explode(F.array(*FIELDS)).alias("x")).where("x is not null")
    forms = f.select("entry_id", F.explode(F.array_distinct(F.array(F.col("x"), F.regexp_replace("x", DOSE, "")))).alias("x"))
    short = F.trim("x").rlike(r"\p{L}(?:\.{1,3}|…|['’׳])$")
    return forms.select("entry_id", F.array_join(words(F.col("x")), " ").alias("name"), short.alias("short")).where("name <> ''")


def _wanted(n: Column) -> Column:
    """The similarity asked of sets of ``n`` bigrams: what is left of them after the edits allowed, at most three bigrams for each."""
    changed = 3 * EDITS_LONG
    return F.greatest(F.lit(SIMILARITY), (n - changed) / (n + changed))


def similar(left: DataFrame, right: DataFrame, apart: int = EDITS_LONG + 2) -> DataFrame:
    """``left_name, right_name, jaccard`` of all pairs of names that are similar enough for their lengths, each pair once.

    Both sides bring a column ``name`` of distinct names; lengths differ by at most ``apart`` characters and the sets by two more. Rarities are counted
    in ``CELLS`` cells of a hash and stand in the plan as one constant, so that a name's prefix is found in its own row: any
    order that both sides share keeps the filter exact. Names of fewer than two bigrams in common are not similar.
    """
    cell = lambda g: F.pmod(g, F.lit(CELLS)).cast("int")
    both = left.select("name").unionByName(right.select("name"))
    counts = dict(both.select(F.explode(F.transform(_grams(F.col("name")), cell)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("f")).collect())  # at most CELLS rows
    rarity = F.split(F.lit(",".join(str(counts.get(i, 0)) for i in range(CELLS))), ",").cast("array<long>")

    tasks = 2 * max(both.sparkSession.sparkContext.defaultParallelism, int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)

    def keyed(df: DataFrame) -> DataFrame:
        ranked = F.array_sort(F.transform(_grams(F.col("name")), lambda g: F.struct(F.get(rarity, cell(g)).alias("f"), g.alias("g"))))
        # generators keep what lambdas use from being computed for every element; few bytes mean much work here, so they are spread
        o = df.repartition(tasks, "name").select("name", F.explode(F.array(F.transform(ranked, lambda x: x.g))).alias("s"))
        n = F.size("s")
        # partners are shorter by `apart` bigrams at most and a few for words put together
        least = F.greatest(F.lit(2), F.ceil(n * _wanted(n - apart - 2) - 1e-9)).cast("int")
        p = o.select("name", n.alias("n"), F.length("name").alias("size"), signature(F.col("s")).alias("sig"), F.explode(F.array(F.slice("s", F.lit(1), F.greatest(n - least + 2, F.lit(0))))).alias("p"))
        two = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", F.lit(1), i), lambda y: F.struct(F.xxhash64(y, x).alias("g"), i.alias("i")))))
        return p.select("name", "n", "size", "sig", F.explode(two).alias("x")).select("name", "n", "size", "sig", "x.g", "x.i")

    a = keyed(left).withColumnsRenamed({"name": "left_name", "n": "ln", "size": "ll", "sig": "ls", "i": "li"})
    b = keyed(right).withColumnsRenamed({"name": "right_name", "n": "rn", "size": "rl", "sig": "rs", "i": "ri"})
    t = _wanted(F.least("ln", "rn"))
    need = F.ceil((F.col("ln") + F.col("rn")) * (t / (1 + t)) - 1e-9)
    # the second of the two shared bigrams stands at ``i``: no more than what precedes and follows it can be shared
    can = F.least("li", "ri") + 1 + F.least(F.col("ln") - F.col("li") - 1, F.col("rn") - F.col("ri") - 1)
    near = (F.abs(F.col("ll") - F.col("rl")) <= apart) & (F.abs(F.col("ln") - F.col("rn")) <= apart + 2) & (can >= need) & (most_shared(F.col("ls"), F.col("ln"), F.col("rs"), F.col("rn")) >= need)
    pairs = a.join(b, "g").where(near).select("left_name", "right_name", "ln", "rn").distinct()
    shared = pairs.select("*", F.explode(F.array(F.size(F.array_intersect(_grams(F.col("left_name")), _grams(F.col("right_name")))))).alias("o"))
    return shared.where(F.col("o") >= need).select("left_name", "right_name", (F.col("o") / (F.col("ln") + F.col("rn") - F.col("o"))).alias("jaccard"))


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two strings; ``most + 1`` when there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def name_edits(typed: str, name: str, most: int = EDITS_LONG) -> int:
    """Edits between two names whatever the order of their words, a Hebrew prefix not counted; numbers must be the same."""
    tw, nw = typed.split(), name.split()
    if sorted(w for w in tw if w.isdigit()) != sorted(w for w in nw if w.isdigit()):
        return most + 1
    tw, nw = [w for w in tw if not w.isdigit()], [w for w in nw if not w.isdigit()]

    def word(t: str, n: str) -> int:
        least = edits(t, n, most)
        for k in (1, 2):
            if least and len(t) > k + 2 and all(c in PREFIXES for c in t[:k]):
                least = min(least, edits(t[k:], n, most))
        return least

    least = word(" ".join(tw), " ".join(nw))
    if least and len(tw) == len(nw) <= 5:
        costs = [[word(t, n) for n in nw] for t in tw]
        least = min([least, *(sum(costs[i][j] for i, j in enumerate(order)) for order in itertools.permutations(range(len(nw))))])
    return least


@F.pandas_udf(IntegerType())
def _name_edits(typed: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([name_edits(a, b) for a, b in zip(typed, name, strict=True)], dtype="int32")


def _abbreviated(part: DataFrame, entry: DataFrame) -> DataFrame:
    """``name, full``: the names that begin the entries of just one concept, with the first of these. They meet on the beginning as a whole."""
    starts = entry.where(~F.col("acronym") & (F.length("name") > 4)).select("cui", F.col("name").alias("full"), F.explode(F.transform(F.sequence(F.lit(4), F.length("name") - 1), lambda k: F.substring(F.col("name"), F.lit(1), k))).alias("name"))
    begun = part.where(F.length("name") >= F.when(F.col("short"), 4).otherwise(5)).select("name").join(starts, "name")
    return begun.groupBy("name").agg(F.min("full").alias("full"), F.min("cui").alias("a"), F.max("cui").alias("b")).where("a = b").select("name", "full")


def map_values(typed: DataFrame, lexicon: DataFrame, key: str = "entry_id") -> DataFrame:
    """``entry_id, cui`` with ``''`` for the rows that no entry fits."""
    entry = cut(entries(lexicon))
    values = cut(typed_values(typed, key))
    distinct = values.groupBy("name").agg(F.max("short").alias("short"))
    named = entry.select("name").distinct()
    same = distinct.join(named, "name", "left_semi").select("name", F.col("name").alias("right_name"), F.lit(0).alias("edits"), F.lit(1.0).alias("jaccard"))
    rest = cut(distinct.join(named, "name", "left_anti"))
    # a value that is no entry but begins the entries of just one concept is an abbreviation of it
    one = cut(_abbreviated(rest, entry))
    whole = one.select("name", F.col("full").alias("right_name"), F.lit(0).alias("edits"), F.lit(1.0).alias("jaccard"))
    asked = rest.join(one, "name", "left_anti").where(F.length("name") > 3).select("name")  # shorter names bear no errors
    pairs = similar(asked, named)
    # not deterministic by declaration only: so the check stays above the join's distinct pairs and runs once for each
    judged = pairs.withColumn("edits", _name_edits.asNondeterministic()("left_name", "right_name"))
    most = F.when(F.length("left_name") >= LONG, EDITS_LONG).otherwise(EDITS)
    judged = judged.where(F.col("edits") <= most).select(F.col("left_name").alias("name"), "right_name", "edits", "jaccard")
    fits = same.unionByName(whole).unionByName(judged).join(entry.withColumnRenamed("name", "right_name"), "right_name").where((F.col("edits") == 0) | ~F.col("acronym"))
    by_value = fits.groupBy("name", "cui").agg(F.min("edits").alias("edits"), F.max("jaccard").alias("jaccard")).select("name", "cui", (F.lit(1.0) + F.lit(EDITS_LONG) - F.col("edits") + F.col("jaccard")).alias("score"))
    votes = values.select("entry_id", "name").distinct().join(by_value, "name").groupBy("entry_id", "cui").agg(F.sum("score").alias("score"))
    best = votes.groupBy("entry_id").agg(F.min_by("cui", F.struct(-F.col("score"), "cui")).alias("cui"))
    rows = typed.where(" or ".join(f"{c} is not null" for c in FIELDS)).select(F.col(key).alias("entry_id"))
    return rows.join(best, "entry_id", "left").select("entry_id", F.coalesce("cui", F.lit("")).alias("cui"))


def unmatched(typed: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The rows that no entry fits, as typed."""
    none = map_values(typed, lexicon).where("cui = ''").select("entry_id")
    return typed.select("entry_id", "annotator", *FIELDS).join(none, "entry_id", "left_semi")
