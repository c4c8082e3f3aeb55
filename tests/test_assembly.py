import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import assembly, evaluate, features
from lexweave.sources import parser, readers, sinks

LEXICON = [(0, "C1", "T047", "PF", "Traimynia", "טריימיניה"), (1, "C2", "T121", "SY", "sodavene forte", None)]


@pytest.fixture
def posts(spark):
    rows = [(1, "f1", "יש לי טריימיניה, והיא sodavene Forte", "יש לי טריימיניה , והיא sodavene Forte"), (2, "f2", None, None), (3, "f3", "טריימיניה", "טריימיניה")]
    return spark.createDataFrame(rows, "post_id long, file_name string, post_txt string, tokenized_text string")


@pytest.fixture
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "lex_idx long, cui string, tui string, stt string, str string, heb string")


def test_chain(spark, posts, lexicon):
    rows = assembly.instances_of(posts, lexicon)
    got = {(r.post_id, r.cand_match): r for r in rows.collect()}
    assert set(got) == {(1, "טריימיניה"), (1, "sodavene forte"), (3, "טריימיניה")}
    assert got[1, "sodavene forte"].match_3_window == "לי טריימיניה והיא" and got[1, "sodavene forte"].match_eng == "sodavene forte"
    gold = spark.createDataFrame([("f1", [("טריימיניה", 7, 16, "Disorder")])], "file_name string, merged_inner_and_outer array<struct<term string, start_offset int, end_offset int, label string>>")
    yi = assembly.weak_labels(rows, gold)
    corpus = spark.createDataFrame([("יש לי טריימיניה",), ("טריימיניה",)], "text string")
    dictionary = spark.createDataFrame([("traimynia", 0.5)], "term string, score double")
    none = spark.createDataFrame([], "t string")
    out = assembly.assembled(rows, corpus, dictionary, none, yi)
    assert tuple(out.columns) == assembly.COLUMNS
    by = {(r.file_name, r.cand_match): r for r in assembly.checked(rows, out).collect()}
    first = by["f1", "טריימיניה"]
    assert (first.yi, first.match_count, first.relatedness, first.pred_2_window) == (1, 2, 0.5, 0.0) and first.pred_3_window > 0
    assert (by["f3", "טריימיניה"].yi, by["f1", "sodavene forte"].relatedness) == (0, -1.0)
    with pytest.raises(Exception, match="do not fit"):
        assembly.checked(rows, out.limit(2)).collect()
    judged = rows.withColumn("hard_y_pred", F.lit(0))
    assert assembly.spans_of(judged).count() == 0 and assembly.spans_of(judged, filtered=False).count() == 3


def test_parser_service(spark, posts):
    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["text"]
            body = json.dumps({"md_lattice": f"0\\t1\\t{asked.strip()}"}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = parser.parsed(posts, parser.http_client(f"http://127.0.0.1:{server.server_port}/")).collect()
    finally:
        server.shutdown()
    assert sorted((r.post_id, r.sentence_no, r.sentence) for r in rows) == [(1, 0, "יש לי טריימיניה והיא sodavene Forte"), (3, 0, "טריימיניה")]
    assert all(r.md_lattice.endswith(r.sentence) and r.dep_tree is None for r in rows)


def test_feature_files_and_split(spark, tmp_path):
    key = [(0, "a", "b", 1), (1, "a", "b", 2)]
    ddl = "row_idx int, cand_match string, umls_match string, curr_occurence_offset int, {}"
    sinks.csv(spark.createDataFrame([(*k, "t") for k in key], ddl.format("x string")), str(tmp_path / "i"))
    sinks.csv(spark.createDataFrame([(*k, "other", n) for n, k in enumerate(key)], ddl.format("x string, match_count int")), str(tmp_path / "c"))
    sinks.csv(spark.createDataFrame([(*key[0], "0.5")], ddl.format("relatedness string")), str(tmp_path / "r"))
    got = {r.row_idx: (r.x, r.match_count, r.relatedness) for r in readers.feature_files(spark, str(tmp_path / "i"), str(tmp_path / "c"), str(tmp_path / "r")).collect()}
    assert got == {"0": ("t", "0", "0.5"), "1": ("t", "1", None)}
    sinks.parquet(spark.createDataFrame([(1, "train"), (2, "test")], "x int, split string"), str(tmp_path / "s"), "split")
    train, test = readers.train_and_test(spark, str(tmp_path / "s"))
    assert [r.x for r in train.collect()] == [1] and [r.x for r in test.collect()] == [2]
    sinks.json(spark.createDataFrame([([1],)], "a array<int>"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().a == [1]


def test_labelled_posts_are_counted(spark, posts):
    gold = spark.createDataFrame([("טריימיניה ",)], "text string")
    assert [r.post_id for r in readers.labelled_posts(posts, gold, expected=3).collect()] == [3]
    with pytest.raises(Exception, match="not about 9"):
        readers.labelled_posts(posts, gold, expected=9).collect()


def test_report_and_missing(spark):
    rows = spark.createDataFrame([("a", 0.5, 1), ("b", 1.0, 3)], "community string, f1 double, support long")
    assert {r.community: (r.f1, r.support) for r in evaluate.report(rows, "community", ("f1",), "support").collect()}["weighted avg"] == (0.875, 4)
    terms = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "match_eng string")
    assert [tuple(r) for r in features.missing_counts(terms, spark.createDataFrame([("b",)], "term string")).collect()] == [("a", 2)]


def test_digraphs(spark):
    assert {k: v for k, v in X.digraphs().items() if k in "װױײﭏ"} == {"װ": "וו", "ױ": "וי", "ײ": "יי", "ﭏ": "אל"}
    assert spark.createDataFrame([("aײ\u200db",)], "t string").select(X.one_spelling(F.col("t")).alias("t")).first().t == "aייb"


def test_written_tables_are_removed(spark):
    from pathlib import Path

    from lexweave import session

    first = session.cut(spark.range(3))
    path = Path(first.inputFiles()[0].removeprefix("file:")).parent
    assert path.exists() and first.count() == 3
    session.clear(spark)
    assert not path.exists() and session.cut(spark.range(2)).count() == 2
