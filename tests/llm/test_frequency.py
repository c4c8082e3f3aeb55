import random
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexweave.llm import frequency


def test_trie():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(9))) for _ in range(3000)] + ["z" * 300] * 3
    trie, want = frequency.BurstTrie(4), Counter(words)
    for w in words:
        trie.add(w, 2, 1)
    got = Counter()
    for prefix, table in trie.leaves():
        for s, (o, r) in table.items():
            assert o == 2 * r
            got[prefix + s] += r
    assert got == want


def test_front_coding():
    words = sorted({"", "a", "ab", "abc", "b", "bב"})
    shared, rest = frequency.front_coded(words)
    last, back = "", []
    for n, t in zip(shared, rest, strict=True):
        last = last[:n] + t
        back.append(last)
    assert back == words


def test_counts(spark):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.4 else f"t{rnd.randrange(900)}", f"f{rnd.randrange(300)}", i) for i in range(6000)] + [(None, "f", 0), ("x", None, 0), ("", "f1", 0), ("long" * 3000, "f1", 0)]
    df = spark.createDataFrame(rows, "cand_match string, file_name string, term int")
    n, files = Counter(), defaultdict(set)
    for t, f, _ in rows:
        if t is not None and f is not None:
            n[t] += 1
            files[t].add(f)
    for pieces in (None, 1, 500):  # shallow and deep routes
        got = [(r.term, r.n_rows, r.n_files) for r in frequency.count_terms(df, pieces=pieces).collect()]
        assert sorted(got) == sorted((t, n[t], len(files[t])) for t in n)
    marks = {r.term: r.mark for r in frequency.marked(df).collect()}
    total = len({f for _, f, _ in rows if f is not None})
    assert all(marks[t] == ("rare" if len(files[t]) <= 2 else "common" if len(files[t]) > total * 0.01 else None) for t in n)
    assert frequency.marked(df.limit(0)).count() == 0


def test_exactly_one_percent_is_not_common(spark):
    rows = [("edge" if i < 29 else "over" if i < 59 else f"t{i}", f"f{i}") for i in range(2900)]
    marks = {r.term: r.mark for r in frequency.marked(spark.createDataFrame(rows, "cand_match string, file_name string")).collect()}
    assert marks["edge"] is None and marks["over"] == "common" and marks["t100"] == "rare"


def test_terms_meet_from_unequal_tries(spark):
    # two tasks: one bursts, the other stays a single leaf, or bursts less deep
    rows = [(f"t{i}", "f", 1) for i in range(900)], [(f"t{i}", "g", 1) for i in range(0, 400, 2)]
    want = {f"t{i}": 1 + (i < 400 and i % 2 == 0) for i in range(900)}
    for few in (rows[1], [*rows[1], *((f"a{i}", "g", 1) for i in range(200))]):
        for heavy in (frozenset(), frozenset({"t"}), frozenset({"t", "t1", "t2", "t10"})):
            met = {}
            for part in (rows[0], few):
                blocks = frequency._count(iter([pd.DataFrame(part, columns=["term", "file", "n"])]))
                for b in frequency._routed(blocks, heavy):
                    for route, rest in b.groupby("route"):
                        met.setdefault(route, []).append(rest)
            got = [x for blocks in met.values() for out in frequency._merge(iter(blocks)) for x in zip(out["term"], out["n_files"], strict=True)]
            assert len(got) == len(dict(got)) and {k: v for k, v in got if k[0] == "t"} == want


@pytest.mark.parametrize("coalesced", ["true", "false"])
@pytest.mark.parametrize("length", [0, 2000])
def test_one_row_a_term_whatever_the_tasks(spark, coalesced, length):
    names = {"spark.sql.adaptive.coalescePartitions.enabled": coalesced, "spark.sql.shuffle.partitions": "5"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        # some tasks burst, some do not: a heavy prefix, and a few terms elsewhere
        rows = [(f"t{i}" + "x" * length, f"f{j}") for i in range(364) for j in range(3)] + [("a", "f0"), ("", "f0")]
        df = spark.createDataFrame(rows, "cand_match string, file_name string")
        want = sorted((r.t, r.n, r.k) for r in df.groupBy(F.col("cand_match").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_name").alias("k")).collect())
        for pieces in (None, 1, 50, 5000):
            assert sorted(tuple(r) for r in frequency.count_terms(df, pieces=pieces).collect()) == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
