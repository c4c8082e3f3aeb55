import random

from lexweave.llm import splits

FILES = "{c}_u{a:07d}_t{t:07d}_p{p:08d}"


def brute(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, t in pairs:
        up[find(("a", a))] = find(("t", t))
    return find


def test_random_graphs_against_union_find(spark):
    rnd = random.Random(8)
    for n, k in ((60, 40), (200, 300), (400, 120)):
        pairs = [(rnd.randrange(n) if rnd.random() > 0.3 else 0, rnd.randrange(n)) for _ in range(k)]
        chain = [(1000 + i // 2, 1000 + (i + 1) // 2) for i in range(100)]
        edges = pairs + chain
        df = spark.createDataFrame(edges, "author long, thread long")
        forest = splits.spanning_forest(df)
        find = brute(edges)
        roots = {}
        for r in forest.labels.collect():
            roots.setdefault(find(("a", r.node // 2) if r.node % 2 == 0 else ("t", r.node // 2)), set()).add(r.root)
        assert all(len(v) == 1 for v in roots.values()) and len({next(iter(v)) for v in roots.values()}) == len(roots)
        assert forest.edges.count() == forest.labels.count() - len(roots)


def test_spellings_and_groups(spark):
    rows = [("x_u0000005_t0000001_p1",), ("X_U0000003_T0000001_P00000002.TXT",), ("t0000002__u0000003__p18 (x)",), ("x/u9/t7/p3.txt",), ("x_anon_t0000007_p4",), ("Sclerosis-ANON-T0000050-P5",), ("x_u0000004_p6",), ("x_u0000004_p6",), ("strange",), (None,)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "file_name string, root int")
    got = {r.file_name: r.group_author for r in splits.found(df).collect()}
    assert got == {rows[0][0]: 3, rows[1][0]: 3, rows[2][0]: 3, rows[3][0]: 9, rows[4][0]: 9, rows[6][0]: 4}
    dealt = splits.assign_splits(df).collect()
    assert len(dealt) == 8 and {r.split for r in dealt} <= {"train", "validation", "test"}
    assert splits.found(df.limit(0)).count() == 0 and splits.assign_splits(df.limit(0)).count() == 0


def test_proportions(spark):
    rnd = random.Random(9)
    names = [FILES.format(c="c", a=1 if i % 3 == 0 else rnd.randrange(2, 900), t=10_000 + i // 2 if i % 3 else 5, p=i) for i in range(3000)]
    rows = splits.assign_splits(spark.createDataFrame([(n,) for n in names], "file_name string")).collect()
    share = {s: sum(r.split == s for r in rows) / len(rows) for s in splits.PARTS}
    assert all(abs(share[s] - p) < 0.03 for s, p in splits.PARTS.items()), share
    groups = {}
    for r in rows:
        groups.setdefault(r.root, set()).add(r.split)
    assert all(len(v) == 1 for v in groups.values())


def test_forest_is_given_out_and_kept(spark, tmp_path):
    names = ["sclerosis_u1_t1_p1", "sclerosis_u2_t1_p2", "sclerosis_u2_t2_p3", "sclerosis_u1_t2_p4", "sclerosis_u9_t9_p5", "sclerosis_anon_t5_p6", None]
    df = spark.createDataFrame([(n,) for n in names], "file_name string")
    splits.save_forest(df, str(tmp_path / "forest"))
    edges = [tuple(r) for r in spark.read.parquet(str(tmp_path / "forest")).collect()]
    assert len(edges) == 4 and len({r for _, _, r in edges}) == 2
    assert sorted(tuple(r) for r in splits.tree_sizes(df).collect()) == [(1, 4, 3), (9, 2, 1)]
