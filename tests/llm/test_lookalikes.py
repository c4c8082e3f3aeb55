from lexweave.llm import lookalikes


def test_one_form(spark):
    cases = {
        "plain א text": False, "café naïve": False, "café": True, "ｆｏｏ": True, "a​b": True, "a b": True, "line\nbreak\ttab": False, "сahar": True, "сахар": False, "בMRI": False, "MRIב": True,
        "ﬡבג": True, "ℵב": True, "𝐚bc": True, "пocле": True, "ײַ": True, "": False, "１２": True, "x" * 200_000: False, "נקודה – מקף": False,
    }
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(cases)] + [(99, None, "c"), (0, "plain א text", "c")], "post_id long, post_txt string, odd string")
    got = {r.row_id: r for r in lookalikes.one_form(df, "post_id", "post_txt").collect()}
    for i, (t, odd) in enumerate(cases.items()):
        assert got[i].odd == odd, t
    assert got[99].text is None and not got[99].odd
    plain = {t: got[i].text for i, t in enumerate(cases)}
    assert plain["ｆｏｏ"] == "foo" and plain["café"] == "café" and plain["сahar"] == "cahar" and plain["пocле"] == "после" and plain["ℵב"] == "אב" and plain["１２"] == "12" and plain["a b"] == "a b"


def test_found_once(spark):
    p = spark.createDataFrame([(1, "ａ"), (2, "b")], "post_id long, post_txt string")
    i = spark.createDataFrame([(7, "ａ"), (7, "ａ"), (8, None)], "inst_id long, cand_match string")
    assert sorted(tuple(r) for r in lookalikes.found(p, i).collect()) == [("cand_match", 7), ("post_txt", 1)]
    assert lookalikes.found(p.limit(0), i.limit(0)).count() == 0


def test_the_form_is_stable(spark):
    df = spark.createDataFrame([(1, "ｆ​ооd 𝐱 café")], "post_id long, post_txt string")
    once = lookalikes.one_form(df, "post_id", "post_txt").first().text
    again = lookalikes.one_form(spark.createDataFrame([(1, once)], "post_id long, post_txt string"), "post_id", "post_txt").first()
    assert again.text == once and not again.odd
