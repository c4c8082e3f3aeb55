import random
import re
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.functions import lattices
from lexweave.functions import text as X
from lexweave.functions.similarity import bigrams, gestalt, may_exceed

ALPHABET = "אבגדזצ'\"`-./\\ \n!?.,;:&()[]{}abcZ019%+ְ$#é "


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("r")).first().r


def tokens(s):
    names = [n for n, _ in X.TOKEN_CLASSES]
    scanner = re.compile(r"\s+|" + "|".join(f"({p})" for _, p in X.TOKEN_CLASSES), re.ASCII)
    return [(names[m.lastindex - 1], m.group()) for m in scanner.finditer(s) if m.lastindex]


def test_tokenizer_against_a_scanner(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(40))) for _ in range(200)] + ["http://a.b/c ד\"ר לא-כן 12.5%"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.classed_tokens(F.col("t")).alias("r")).collect()
    for r in rows:
        got = [(x["class"], x.token) for x in r.r]
        assert [t for _, t in got] == [t for _, t in tokens(texts[r.i])], texts[r.i]
        assert re.sub(r"\s", "", "".join(t for _, t in got)) == re.sub(r"\s", "", texts[r.i]), texts[r.i]


def sentence_brute(text, most=150, chunk=140):
    words, out, cur = text.split(), [], []
    stop = lambda w: re.match(r"[!|.?]", w)
    for i, w in enumerate(words):
        cur.append(w)
        if stop(w) and not (i + 1 < len(words) and stop(words[i + 1])):
            while len(cur) > most:
                out.append(" ".join(cur[:chunk]))
                cur = cur[chunk:]
            out.append(" ".join(cur))
            cur = []
    return out + ([" ".join(cur)] if cur else [])


def test_sentences(spark):
    rnd = random.Random(5)
    texts = ["", "a b", "a . b", "a ... !! b ?", ". . a", "w " * 151 + ". x", "w " * 300 + ".", "w " * 200] + [" ".join(rnd.choice(["a", "b", ".", "!", "?x"]) for _ in range(rnd.randrange(30))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.sentences(F.col("t")).alias("r")).collect()
    for r in rows:
        assert r.r == sentence_brute(texts[r.i]), texts[r.i]


def test_offsets_like_finditer(spark):
    cases = [("aaaa", "aa"), ("a.b.c", "."), ("", "a"), ("abc", ""), ("x(y)x(y)", "(y)"), ("\\Eq\\E", "\\E"), ("שלום שלום", "שלום")]
    df = spark.createDataFrame(cases, "t string, p string").select("t", "p", X.literal_offsets(F.col("t"), F.col("p")).alias("o")).collect()
    for r in df:
        assert r.o == ([m.start() for m in re.finditer(re.escape(r.p), r.t)] if r.p else []), (r.t, r.p)


def test_small_functions(spark):
    assert one(spark, "a-b\nc", X.blank_punctuation) == "a b c"
    assert one(spark, "The MS אב is", X.english_text) == "the"
    assert one(spark, "a bb 3 ד.כן", X.usable_tokens) == ["bb", "3", "כן"]
    assert one(spark, "a1 b--c", X.cleaned) == "a b c"
    assert one(spark, "B-D", X.io_tag) == "D" and one(spark, "O", X.io_tag) == "O"
    assert one(spark, "a b c d", lambda c: X.last_words(F.split(c, " "), 3)) == "b c d"
    assert one(spark, "a b", lambda c: X.last_words(F.split(c, " "), 3)) == "a b"
    assert one(spark, "one two three", lambda c: X.last_words(X.prefix_words(c, F.lit(0)), 3)) == ""
    assert one(spark, "one two three", lambda c: X.last_words(X.prefix_words(c, F.lit(0), compat=True), 3)) == "one two thre"
    assert one(spark, "T047", X.semantic_type) == "Disorder" and one(spark, "T999", X.semantic_type) is None
    assert [tuple(x) for x in one(spark, "a b", lambda c: X.gram_starts(F.split(c, " ")))] == [("a", "b", "PAD"), ("b", "PAD", "PAD")]
    assert spark.sql("select 1").select(X.percent(F.lit(0.29)).alias("p")).first().p == "28%"


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.text("abאב ", max_size=8), st.text("abאב ", max_size=8)), min_size=1, max_size=20))
def test_ratio_and_its_bound(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", gestalt("a", "b").alias("r"), may_exceed(F.col("a"), F.col("b"), 0.8).alias("m")).collect()
    for r in rows:
        assert r.r == SequenceMatcher(None, r.a, r.b).ratio() and 0 <= r.r <= 1
        assert r.m or r.r < 0.8


def test_bigrams(spark):
    assert one(spark, "aaa", bigrams) == [" a", "aa", "a "]


def test_lattices(spark):
    df = spark.createDataFrame([(1, "0\t1\tה\t\tDEF\tDEF\t_\t1\n1\t2\tבית\tבית\tNN\tNN\tgen=F|gen=M|num=S|tense=PAST\t1\n\n0\t1\tx\t_\tA\tB\tper=3|suf_gen=F\t1")], "k int, t string")
    rows = lattices.lattice(df, "k", "t", analyses=True).orderBy("sentence", "line_no").collect()
    assert [(r.lemma, r.gen, r.num_s_p, r.per, r.tense, r.suf_gen, r.num_last) for r in rows] == [("ה", None, None, None, None, None, 1), ("בית", "FM", "S", None, "PAST", None, 1), ("x", None, None, "3", None, "F", 1)]
    tree = lattices.dependency_tree(spark.createDataFrame([(1, "1\tw\t\tNN")], "k int, t string"), "k", "t").first()
    assert tree.lemma == "w" and tree.dependency_part == "-1"
