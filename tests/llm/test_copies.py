from lexweave.llm import copies

DDL = "post_id long, post_txt string, lemmas string, id string"


def test_groups(spark):
    form = "Age: 5\nDrug: x\nNick: q\nDose: 1"
    turned = " * dose: 1\n\nnick:  Q\nAGE: 5\ndrug: 'X'"
    rows = [
        (1, "Hello, world!", "hello world", "a"), (2, "hello  WORLD", "Hello-World", "b"), (3, "hello world", "hello world s", "c"), (1, "Hello, world!", "hello world", "d"),
        (4, form, form, "e"), (5, turned, turned, "f"), (6, None, None, "g"), (7, "", " ", "h"), (8, "hello​ world", "hello world", "i"), (None, "x", "x", "j"), (9, "a: 1\nb: 2", None, "k"), (10, "b: 2\na: 1", None, "l"),
    ]
    df = spark.createDataFrame(rows, DDL)
    assert {(r.first_id, r.copy_id) for r in copies.copies(df).collect()} == {(1, 2), (4, 5), (6, 7)}
    counts = {r.first_id: r.n_copies for r in copies.collapse(df).collect()}
    assert counts == {1: 3, 3: 1, 4: 2, 6: 2, 8: 1, 9: 1, 10: 1}


def test_empty_and_long_and_hot(spark):
    assert copies.copies(spark.createDataFrame([], DDL)).count() == 0
    long = "word, " * 50_000
    hot = spark.range(300).selectExpr("id + 1 as post_id", "case when id % 3 = 0 then 'same' else concat('t', id) end as post_txt", "cast(null as string) as lemmas")
    got = copies.copies(hot).collect()
    assert len(got) == 99 and {r.first_id for r in got} == {1}
    df = spark.createDataFrame([(1, long, ""), (2, long.upper(), None)], "post_id long, post_txt string, lemmas string")
    assert [tuple(r) for r in copies.copies(df).collect()] == [(1, 2)]
