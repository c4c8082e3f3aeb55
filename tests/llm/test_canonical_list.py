import random

import pytest

from lexweave.llm import canonical_list as C

LEX = [(0, "C1", "PF", "Trarshoitis type 1", "טרארשויטיס סוג 1"), (1, "C2", "PF", "Trarshoitis type 2", "טרארשויטיס סוג 2"), (2, "C3", "PF", "miodavéne 20", "מיודאון 20"), (3, "C3", "AC", "KRKM", None), (4, "C4", "PF", "swelling drebealexia", None), (4, "C4", "PF", " Swelling_drebealexia ", None), (5, None, "PF", "nothing", None)]


@pytest.fixture
def lexicon(spark):
    return spark.createDataFrame(LEX, "lex_idx long, cui string, stt string, str string, heb string")


def mapped(spark, lexicon, rows):
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "entry_id long, cand_match string, umls_match string, match_eng string, name string")
    return {r.entry_id: r.cui for r in C.map_values(df, lexicon).collect()}


def test_values(spark, lexicon):
    rows = [
        ("טרארשוייטיס סוג 2", None, None), (None, None, "the trarshoitis.type.1 again"), (None, None, "Trarshoitis type 3"), (None, None, "drebealexia wsleling"), ("כמו קודם", None, None), (None, None, "k.r.k.m"), (None, None, "krkn"),
        (None, None, "Miodavene 20 mg"), ("מהמיודאון 20", None, None), (None, "trarshoitis type 1", "טרארשויטיס סוג 1"), (None, None, None), ("", None, None), (None, None, "swelling dre..."), ("x" * 5000, None, None), (None, None, "trarshoitis..."),
    ]
    got = mapped(spark, lexicon, rows)
    assert got == {0: "C2", 1: "C1", 2: "", 3: "C4", 4: "", 5: "C3", 6: "", 7: "C3", 8: "C3", 9: "C1", 11: "", 12: "C4", 13: "", 14: ""}


def test_empty(spark, lexicon):
    assert mapped(spark, lexicon.limit(0), [("a", None, None)]) == {0: ""}
    df = spark.createDataFrame([], "entry_id long, annotator string, cand_match string, umls_match string, match_eng string")
    assert C.map_values(df, lexicon).count() == 0 and C.unmatched(df, lexicon).count() == 0


def test_similarity_join_is_exact(spark):
    rnd = random.Random(4)
    names = lambda n: sorted({" ".join("".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 8))) for _ in range(rnd.randrange(1, 3))) for _ in range(n)})
    left, right = names(70), names(70)
    grams = lambda s: {f" {w} "[i : i + 2] for w in s.split() for i in range(len(w) + 1)}
    least = lambda a, b: max(C.SIMILARITY, (min(len(a), len(b)) - 9) / (min(len(a), len(b)) + 9))
    alike = lambda a, b: len(a & b) >= 2 and len(a & b) / len(a | b) >= least(a, b) and abs(len(a) - len(b)) <= 7
    long = ["".join(rnd.choice("abcdefghij ") for _ in range(40)).strip() for _ in range(20)]
    long += [x[:k] + x[k + 1 :] for x in long for k in (3, 20)]
    left, right = [*left, *long[::2]], [*right, *long[1::2]]
    want = {(a, b) for a in left for b in right if abs(len(a) - len(b)) <= 5 and alike(grams(a), grams(b))}
    got = C.similar(spark.createDataFrame([(x,) for x in left], "name string"), spark.createDataFrame([(x,) for x in right], "name string"))
    got = [(r.left_name, r.right_name) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(len(a) > 30 for a, _ in want)


def test_a_common_bigram_forms_no_block(spark):
    # every name holds the same bigrams of one word; they meet by their rare ones
    left = spark.range(3000).selectExpr("concat('common ', substring(md5(string(id)), 1, 8)) AS name")
    right = spark.range(3000).selectExpr("concat('common ', substring(md5(string(id + 1000)), 1, 8)) AS name")
    assert C.similar(left, right).where("jaccard = 1").count() == 2000


def test_edits():
    assert C.edits("abcd", "abdc", 3) == 1 and C.edits("abc", "", 5) == 3 and C.edits("a", "bcdef", 2) == 3
    assert C.name_edits("b a", "a b") == 0 and C.name_edits("ולחם", "לחם") == 0 and C.name_edits("a 1", "a 2") > 3
