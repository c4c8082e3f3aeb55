import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lexweave.operators import evaluate, features, instances, labels, matching, model, ranking
from lexweave.sources import readers, sinks
from lexweave.streaming import match_stream

LEXICON = [(0, "C1", "T047", "PF", "Traimynia", "טריימיניה"), (1, "C1", "T047", "SY", "traimynia", "טריימיניה"), (2, "C2", "T121", "SY", "sodavene forte", "סודאון פורטה"), (3, "C3", "T121", "PF", "other", "סודאון פורטה")]
LEXICON_DDL = "lex_idx long, cui string, tui string, stt string, str string, heb string"


@pytest.fixture
def lexicon(spark):
    return spark.createDataFrame(LEXICON, LEXICON_DDL)


def test_priority(lexicon):
    heb = {r.form: r.cui for r in matching.priority_entries(lexicon, "heb").collect()}
    assert heb == {"טריימיניה": "C1", "סודאון פורטה": "C3"}
    eng = {r.form: r.lex_idx for r in matching.priority_entries(lexicon, "str").collect()}
    assert eng == {"traimynia": 0, "sodavene forte": 2, "other": 3}


def test_matches_posts(spark, lexicon):
    posts = spark.createDataFrame([(1, "יש לי טריימניה וגם sodavene Forte", "יש לי טריימניה וגם sodavene Forte"), (2, None, "x"), (3, "", "")], "post_id long, tokenized_text string, post_txt string")
    m = matching.match_posts(posts, lexicon).collect()
    assert {(r.post_id, r.view, r.cand_match, r.cui, r.curr_occurence_offset) for r in m} == {(1, 0, "טריימניה", "C1", 6), (1, matching.LATIN, "sodavene forte", "C2", 19)}


def test_views_are_united_in_order(spark, lexicon):
    # the text lacks the form, its lemma brings it; what two views find at one place stands once; tokens are needed
    rows = [(1, "סבלתי שמהטריימיניהשלכם אתמול", "סבלתי שמהטריימיניהשלכם אתמול", "סבלתי מ טריימיניה אתמול", "סבל טריימיניה אתמול"), (2, "טריימיניה, טריימיניה", "טריימיניה טריימיניה", None, None), (3, "טריימיניה", None, None, "טריימיניה")]
    posts = spark.createDataFrame(rows, "post_id long, post_txt string, tokenized_text string, segmented_text string, lemmas string")
    m = sorted((r.post_id, r.view, r.curr_occurence_offset, r.n_occ) for r in matching.match_posts(posts, lexicon).collect())
    assert m == [(1, 2, 9, 1), (2, 0, 0, 2), (2, 0, 11, 2)]


def test_only_the_closest_term_is_tried(spark):
    # the closest by bigrams fails the ratio, although the next one would pass it
    terms = spark.createDataFrame([("abcabcabc",), ("abcabd",)], "term string")
    closest = matching.cosine_candidates(spark.createDataFrame([("abcabc", 1)], "gram string, n int"), terms)
    assert [(r.term,) for r in closest.collect()] == [("abcabcabc",)]
    assert matching.good_matches(closest).count() == 0


def test_ratio_begins_with_the_term(spark):
    pair = spark.createDataFrame([("tide", "diet", 1)], "gram string, term string, n int")
    got = matching.good_matches(pair, above_single=0.3).collect()
    assert [r.ratio for r in got] == [SequenceMatcher(None, "diet", "tide").ratio()]


def test_generic_words(spark):
    df = spark.createDataFrame([("מחלה", 1), ("תרופה", 1), ("תרופה", 2)], "g string, n int")
    assert [tuple(r) for r in df.select(matching.is_generic(F.col("g"), F.col("n")), matching.is_generic(F.col("g"), F.col("n"), compat=True)).collect()] == [(True, True), (True, False), (False, False)]


def test_windows_part_at_punctuation(spark):
    i = spark.createDataFrame([(1, "one,two\nthree. four five", 20), (2, "ab cd", 0), (3, "ab cd", 1)], "inst_id long, post_txt string, curr_occurence_offset int")
    got = {r.inst_id: (r.window_3, r.window_6) for r in instances.windows(i).collect()}
    assert got == {1: ("two three four", "one two three four"), 2: ("", ""), 3: ("", "")}
    assert {r.inst_id: r.window_3 for r in instances.windows(i, compat=True).collect()}[2] == "ab c"


def test_window_model(spark):
    corpus = spark.createDataFrame([("a b c. a c",), ("c",), (None,)], "text string")
    i = spark.createDataFrame([(1, "c", "a b", "a b", "a b"), (2, "c d", "a", "a", "a"), (3, "c", None, "", "x")], "inst_id long, cand_match string, match_3_window string, match_6_window string, match_10_window string")
    counts = features.window_counts(corpus, i.select("cand_match"))
    assert {(r.distance, r.before): r.p for r in counts.where("term = 'c'").collect()} == {(1, "b"): 1.0, (2, "a"): 0.5, (1, "a"): 0.5, (2, "c"): 1 / 3, (3, "b"): 1.0, (4, "a"): 0.5}
    got = {r.inst_id: r for r in features.window_features(i, counts).collect()}
    assert got[1].pred_3_window == pytest.approx((0.5 * 1.0 + 0.25 * 0.5) / 0.75) and got[2].pred_6_window == 0 and got[3].pred_10_window == 0


def cosine_brute(cands, terms):
    grams = lambda s: {f" {s} "[i : i + 2] for i in range(len(s) + 1)}
    out = {}
    for c in cands:
        n = len(c.split(" "))
        low = 0.78 if n == 1 else 0.83
        best = sorted((-(len(grams(c) & grams(t)) ** 2) / (len(grams(c)) * len(grams(t))), t) for t in terms if len(grams(c) & grams(t)) ** 2 >= low * low * len(grams(c)) * len(grams(t)))
        if best:
            out[c] = best[0][1]
    return out


def test_cosine_against_brute_force(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9))) for _ in range(60)]
    cands = sorted({" ".join(rnd.sample(words, rnd.choice([1, 1, 2]))) for _ in range(80)})
    got = matching.cosine_candidates(spark.createDataFrame([(c, len(c.split(" "))) for c in cands], "gram string, n int"), spark.createDataFrame([(w,) for w in sorted(set(words))], "term string"))
    assert {r.gram: r.term for r in got.collect()} == cosine_brute(cands, set(words))


def test_relocation(spark):
    posts = spark.createDataFrame([(1, "אכלתי גלידה טובה מאוד", "אכלתי גלידה טובה מאוד")], "post_id long, tokenized_text string, post_txt string")
    m = spark.createDataFrame([(1, 1, "גלידא טובה")], "post_id long, view int, cand_match string")
    assert [(r.all_match_occ, r.curr_occurence_offset) for r in matching.relocated(m, posts).collect()] == [([6], 6)]


def test_kept_spans(spark):
    rows = [(i, "f", "t", "abcd", s) for i, s in enumerate([1, 2, 5, 6, 9, 9])]
    df = spark.createDataFrame([*rows, (9, None, "t", "a", 1)], "inst_id long, file_name string, umls_match string, cand_match string, curr_occurence_offset int")
    assert sorted(r.start_offset for r in matching.kept_spans(df).collect()) == [1, 5, 9]


def test_most_specific(spark):
    rows = [
        (1, "f", "aaa", 10), (2, "f", "aaa bbb", 10), (3, "f", "bbb", 14), (4, "f", "aaa", 90), (5, "f", "aaa bb", 90), (6, None, "aaa", 10),
        # a two-word and a three-word match that end together: what follows the first two words is one word only
        (7, "g", "bbb ccc", 4), (8, "g", "aaa bbb ccc", 0), (9, "g", "aaa", 0), (10, "h", "ccc", 8), (11, "h", "aaa bbb ccc", 0), (12, "h", None, 0),
    ]
    df = spark.createDataFrame([(i, f, c, c, s) for i, f, c, s in rows], "inst_id long, file_name string, umls_match string, cand_match string, curr_occurence_offset int")
    assert {r.inst_id for r in instances.most_specific(df).collect()} == {2, 4, 5, 6, 7, 8, 10, 11, 12}


def test_labels(spark):
    gold = spark.createDataFrame([("f", [("Abcd ", 10, 14, "Disorder"), ("abcd", 13, 17, "Chemical or drug"), None]), ("f", [("Abcd ", 10, 14, "Disorder"), ("abcd", 13, 17, "Chemical or drug"), None]), ("g", None)], "file_name string, merged_inner_and_outer array<struct<term string, start_offset int, end_offset int, label string>>")
    anns = labels.annotations(gold)
    assert anns.count() == 2
    i = spark.createDataFrame([(1, "f", "abcd", "abcd", 11), (2, "f", "abcd", "abcd", 17), (3, "f", "abxx", "abcd", 13), (4, None, "abcd", "abcd", 11)], "inst_id long, file_name string, cand_match string, umls_match string, curr_occurence_offset int")
    got = {r.inst_id: (r.yi, r.label) for r in labels.label_matches(i, anns).collect()}
    assert got == {1: (1, "Chemical or drug"), 2: (0, None), 3: (0, None), 4: (0, None)}
    assert {r.inst_id: r.yi for r in labels.label_matches(i, anns, lemma=True).collect()} == {1: 1, 2: 1, 3: 1, 4: 0}
    found = spark.createDataFrame([("f", 0, "abcd")], "file_name string, found_no long, found string")
    assert [(r.ann_no, r.term) for r in labels.unmatched_fuzzy(anns, found).collect()] == [(1, "abcd")]
    assert labels.registered(anns).count() == 1


def test_counts_and_model(spark):
    corpus = spark.createDataFrame([("a b a",), ("a b  c",), (None,)], "text string")
    assert {r.token: r.n for r in features.corpus_counts(corpus).collect()} == {"a": 3, "b": 2, "": 1, "c": 1}
    c = {r.term: (r.match_count, r.match_freq) for r in features.count_features(spark.createDataFrame([("a",), ("a b",), (None,)], "umls_match string"), features.corpus_counts(corpus)).collect()}
    assert c == {"a": (3, 0.75), "a b": (0, 0.0)}
    lm = features.bigram_model(corpus)
    assert {(r.w1, r.w2, r.w3): r.p for r in lm.collect()} == {("a", "b", "a"): 0.5, ("a", "b", "c"): 0.5}
    i = spark.createDataFrame([(1, "c", "x a b"), (2, "c", "a b"), (3, "q", "x a b"), (4, "c", None)], "inst_id long, cand_match string, match_3_window string")
    assert {r.inst_id: r.pred_2_window for r in features.bigram_feature(i, lm).collect()} == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0}


def test_relatedness(spark, tmp_path):
    (tmp_path / "r.txt").write_text("0.5<>d(C1)<>shivering(C2)\n0.7<>d(C1)<>shivering(C2)\n0.1<>d(C1)<>left part(C3)\n")
    d = features.relatedness_lines(readers.relatedness_file(spark, str(tmp_path / "r.txt")))
    assert {r.term: r.score for r in d.collect()} == {"shivering": "0.7", "left part": "0.1"}
    t = spark.createDataFrame([("shivering",), ("left part (x)",), ("new",), ("alone",), (None,)], "match_eng string")
    got = {r.term: r.relatedness for r in features.relatedness(t, d, spark.createDataFrame([("alone",)], "t string")).collect()}
    assert got == {"shivering": 0.7, "left part (x)": 0.1, "new": -1.0, "alone": 1.0}


def test_sentence_numbers_and_groups(spark):
    rows = spark.createDataFrame([(1, p, n, w, w) for p, (n, w) in enumerate([(1, "a"), (1, "bb"), (2, "c"), (1, "cd"), (2, "ab")])], "post_id long, pos int, num int, word string, lemma string")
    fixed = [r.sentence for r in features.sentence_numbers(rows).orderBy("pos").collect()]
    assert fixed == [1, 1, 1, 2, 2]
    assert [r.sentence for r in features.sentence_numbers(rows, compat=True).orderBy("pos").collect()] == [1, 2, 2, 3, 3]
    assert {(r.sentence, r.word) for r in features.token_groups(features.sentence_numbers(rows), ["post_id", "sentence"]).collect()} == {(1, "bb"), (2, "cd")}


def test_morphology_steps(spark):
    rows = spark.createDataFrame([("f", p, w, l) for p, (w, l) in enumerate([("כאב", "כאב"), ("ב", "ב"), ("ראש", "ראש"), ("כאב", "כאב")])], "file_name string, pos int, word string, lemma string")
    i = spark.createDataFrame([(1, "f", "כאב", [0, 9], 9), (2, "f", "בראש", [4], 4), (3, "f", "כאב ב", [0], 0)], "inst_id long, file_name string, cand_match string, all_match_occ array<int>, curr_occurence_offset int")
    got = {r.inst_id: (r.pos, r.step) for r in features.morphology_row(i, rows).collect()}
    assert got[1] == (3, 1) and got[3] == (0, 4) and got[2][0] == 2


def test_hold_out_and_rank(spark):
    df = spark.createDataFrame([(f"f{i:02d}",) for i in range(10)] + [("f00",), (None,)], "file_name string")
    got = {r.file_name: r.split for r in ranking.hold_out(df).collect()}
    assert sorted(k for k, v in got.items() if v == "test") == ["f07", "f08", "f09"] and len(got) == 10
    ranks = [r["rank"] for r in ranking.global_rank(spark.range(50).withColumn("x", F.rand(1)), "x").orderBy("x").collect()]
    assert ranks == list(range(1, 51))


def test_entity_and_token_metrics(spark):
    ddl = "{} string, file_name string, term string, start_offset int, end_offset int, label string, community string, ann_no long"
    gold = spark.createDataFrame([("g1", "f", "aa bb", 0, 5, "Disorder", "c", 1), ("g2", "f", "cccc", 9, 13, "Disorder", "c", 2)], ddl.format("gold_id"))
    pred = spark.createDataFrame([("p1", "f", "aa bb", 2, 7, "Disorder", "c", 1), ("p2", "f", "cccc", 12, 16, "Disorder", "c", 2), ("p3", "f", "aa bb", 0, 5, "Chemical or drug", "c", 3)], ddl.format("pred_id"))
    e = evaluate.entity_errors(gold, pred)
    assert Counter(r.kind for r in e.collect()) == {"TP": 1, "FN": 1, "FP": 2}
    assert {(r.kind, r.term): r.places for r in evaluate.term_counters(e).collect()}["FP", "cccc"] == ["f:Disorder:12"]
    m = evaluate.entity_metrics(e, "community").first()
    assert (m.tp, m.fp, m.fn) == (1, 2, 1) and abs(m.precision - 1 / 3) < 1e-9 and m.tp + m.fn == gold.count()
    texts = spark.createDataFrame([("f", "aa bb xx cccc")], "file_name string, text string")
    tags = [r.tag for r in evaluate.bio_tokens(texts, gold).orderBy("idx").collect()]
    assert tags == ["B-D", "I-D", "O", "B-D"]
    late = spark.createDataFrame([("g3", "f", "zz zz", 12, 17, "Disorder", "c", 3)], ddl.format("gold_id"))
    assert evaluate.tokenisation_problems(texts, late).count() == 1
    empty = evaluate.bio_tokens(texts, gold.limit(0))
    c = evaluate.token_confusion(evaluate.bio_tokens(texts, gold), empty)
    w = {r.tag: r for r in evaluate.token_metrics(c).collect()}
    assert w["weighted"].recall == 0 and w["weighted"].support == 3


def test_thresholds(spark):
    rows = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.4), ("a", 1, 0.45), ("b", 0, 0.2)], "g string, yi int, score double")
    best = {r.g: (r.threshold, r.f1) for r in evaluate.best_threshold(evaluate.threshold_sweep(rows, "g"), "g").collect()}
    assert best == {"a": (0.4, 1.0), "b": (0.1, 0.0)}


def test_model_round_trip(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, "w", "u", i % 2, rnd.random() + i % 2, *(float("nan") if i % 7 == 0 else rnd.random() for _ in range(5))) for i in range(80)]
    df = spark.createDataFrame(rows, "inst_id long, cand_match string, umls_match string, yi int, match_count double, match_freq double, pred_3_window double, pred_6_window double, pred_10_window double, relatedness double")
    m = model.train(df, trees=5)
    model.save(m, 0.5, str(tmp_path / "m"), spark)
    hits = model.predict_with(str(tmp_path / "m"), df).collect()
    assert sum(r.hard_y_pred == i % 2 for i, r in enumerate(hits)) > 60


def test_sources_and_sinks(spark, tmp_path, lexicon):
    gold = spark.createDataFrame([("f", 'a "q"\nb', [("א", 0, 1, "Disorder")]), ("g", "x", None)], "file_name string, text string, merged_inner_and_outer array<struct<term string, start_offset int, end_offset int, label string>>")
    sinks.csv(gold, str(tmp_path / "gold"))
    back = {r.file_name: r for r in readers.gold_csv(spark, str(tmp_path / "gold")).collect()}
    assert back["f"].text == 'a "q"\nb' and back["f"].merged_inner_and_outer[0].term == "א" and back["g"].merged_inner_and_outer == []
    (tmp_path / "posts").mkdir()
    (tmp_path / "posts" / "p1.txt").write_text("a b\n\nc\n")
    (tmp_path / "posts" / "p2.txt").write_text(" \n")
    assert [tuple(r) for r in readers.post_folder(spark, str(tmp_path / "posts")).collect()] == [("p1", "a b\nc")]
    union = readers.lexicon_union(lexicon.where("lex_idx > 1"), lexicon.where("lex_idx <= 1").drop("heb"))
    assert [(r.lex_idx, r.cui) for r in union.orderBy("lex_idx").collect()] == [(0, "C2"), (1, "C3"), (2, "C1"), (3, "C1")]
    sinks.lines(spark.createDataFrame([("a<>b",)], "line string"), str(tmp_path / "lines"))
    assert readers.corpus(spark, str(tmp_path / "lines")).first().text == "a<>b"
    sinks.report(gold, str(tmp_path / "report"))
    sinks.parquet(gold, str(tmp_path / "pq"), "file_name")
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_stream(spark, tmp_path, lexicon):
    posts = spark.createDataFrame([(1, "יש לי טריימיניה", "יש לי טריימיניה")], "post_id long, tokenized_text string, post_txt string")
    posts.write.parquet(str(tmp_path / "in"))
    q = match_stream.match_arriving(spark, str(tmp_path / "in"), posts.schema, lexicon, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first().cui == "C1"


def test_in_place(spark):
    spans = spark.createDataFrame([("f", "bb", 3, 5), ("f", "zz", 0, 2)], "file_name string, term string, start_offset int, end_offset int")
    texts = spark.createDataFrame([("f", "aa bb")], "file_name string, text string")
    assert {r.term: r.ok for r in evaluate.in_place(spans, texts).collect()} == {"bb": True, "zz": False}
    assert SequenceMatcher(None, "bb", "bb").ratio() == 1
