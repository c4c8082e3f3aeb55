import json
import random

from lexweave.operators import nested

MATCH = {"cand_match": "a\"b", "umls_match": "ä", "sim": 0.5, "all_match_occ": [1, 2]}


def offsets(v):
    if isinstance(v, bool) or v is None:
        return []
    if isinstance(v, int):
        return [v]
    if isinstance(v, str):
        return [int(v)] if v.strip().lstrip("-").isdigit() else []
    if isinstance(v, list):
        return [x for y in v for x in offsets(y)]
    if isinstance(v, dict):
        return [x for k in v if k in ("start", "occ") for x in offsets(v[k])]
    return []


def brute(text):
    try:
        j = json.loads(text)
        while isinstance(j, str):
            j = json.loads(j)
    except (ValueError, TypeError):
        return None
    out = []

    def walk(o):
        if isinstance(o, dict):
            if {"cand_match", "umls_match", "all_match_occ"} & set(o):
                out.append(offsets(o.get("all_match_occ")))
            for v in o.values():
                walk(v)
        elif isinstance(o, list):
            for v in o:
                walk(v)

    walk(j)
    return out


def texts():
    rnd = random.Random(7)

    def value(depth):
        k = rnd.random()
        if depth > 3 or k < 0.3:
            return rnd.choice([1, -2, 0.5, "x\\ \"{[", "12", None, True, "", "é\n", []])
        if k < 0.5:
            return [value(depth + 1) for _ in range(rnd.randrange(4))]
        if k < 0.7:
            return {rnd.choice(["a", "b", "start", "line"]): value(depth + 1) for _ in range(rnd.randrange(3))}
        return {"cand_match": "w", "all_match_occ": rnd.choice([3, "4", [5, "6"], [[7], []], {"n": 1, "occ": [8]}, [{"line": 1, "start": 9}], None, value(depth + 1)]), "alternatives": [{"cui": "c", "sources": [{"stt": "PF", "rank": 0}]}]}

    good = [json.dumps(value(0), ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1])) for _ in range(150)]
    twice = [json.dumps(t) for t in good[:20]]
    broken = [t[: rnd.randrange(len(t) + 1)] + rnd.choice(["", "]", "}", ",", '"']) for t in good]
    return [*good, *twice, *broken, "", "  ", "nan", "NaN", "[1 2]", '{"a" 1}', "[1,]", "01", '"\\x"', "[\"a\tb\"]", "{}{}", "]["]


def test_against_json_module(spark):
    rows = [(i, t, i) for i, t in enumerate(texts())] + [(9999, None, 0), (None, "[]", 0)]
    df = spark.createDataFrame(rows, "rec_id long, matches_found string, loaded_at int")
    got = {r.rec_key: r for r in nested.index_matches(df).collect()}
    assert None not in got and not got[9999].readable
    for i, t, _ in rows[:-2]:
        want = brute(t)
        assert got[i].readable == (want is not None), t
        assert [m.occ for m in got[i].matches] == (want or []), t


def test_last_delivery_wins_and_tables_link(spark):
    old, new = json.dumps([MATCH]), json.dumps([MATCH | {"alternatives": [{"cui": "C1", "sim": 0.1, "sources": [{"stt": "SY", "rank": 2}]}]}])
    df = spark.createDataFrame([(1, old, 1, "x"), (1, new, 2, "y")], "rec_id long, matches_found string, loaded_at int, match_no string")
    ix = nested.index_matches(df)
    assert nested.records_table(ix).collect() == [(1, True, 1, 0)]
    m = nested.matches_table(ix).first()
    assert (m.cand_match, m.umls_match, m.sim, m.n_occ, m.n_alternatives) == ('a"b', "ä", 0.5, 2, 1)
    assert [tuple(r) for r in nested.occurrences_table(ix).orderBy("occ_no").collect()] == [(1, 1, 1, 1), (1, 1, 2, 2)]
    assert [tuple(r) for r in nested.alternatives_table(ix).collect()] == [(1, 1, 1, "C1", 0.1, 1)]
    assert [tuple(r) for r in nested.sources_table(ix).collect()] == [(1, 1, 1, 1, "SY", 2)]


def test_empty_table_and_long_text(spark):
    schema = "rec_id long, matches_found string, loaded_at int"
    assert nested.index_matches(spark.createDataFrame([], schema)).count() == 0
    long = json.dumps([MATCH] * 20_000)
    assert nested.occurrences_table(nested.index_matches(spark.createDataFrame([(1, long, 0)], schema), fields=False)).count() == 40_000


def test_no_member_is_lost(spark):
    rec = [MATCH | {"new": {"a": [1, None]}, "line": None, "n": 7, "all_match_occ": [2_000_000_000, 3_000_000_000, 5]}]
    df = spark.createDataFrame([(1, json.dumps(rec), 0), (2, "[", 0)], "rec_id long, matches_found string, loaded_at int")
    ix = nested.index_matches(df)
    assert {r.key: r.value for r in nested.members_table(ix).collect()} == {"new": '{"a": [1, null]}', "line": None, "n": "7"}
    assert [tuple(r) for r in nested.occurrences_table(ix).orderBy("occ_no").collect()] == [(1, 1, 1, 2_000_000_000), (1, 1, 3, 5)]
    assert sorted(tuple(r) for r in nested.records_table(ix).collect()) == [(1, True, 1, 1), (2, False, 0, 0)]
    nodes = {r.node_no: r for r in nested.nodes_table(df).collect()}

    def rebuilt(no):
        n, below = nodes[no], [x for x in sorted(nodes) if nodes[x].parent_no == no]
        if n.kind == "array":
            assert [nodes[x].item_no for x in below] == list(range(len(below)))
            return [rebuilt(x) for x in below]
        return {nodes[x].key: rebuilt(x) for x in below} if n.kind == "object" else n.value if n.kind == "string" else json.loads(n.value or "null")

    assert rebuilt(1) == rec


def test_another_shape(spark):
    shape = nested.Shape(marks=("id",), texts=("id",), numbers=("w",), places="at", locating=("from",), below=(nested.Level("parts", ("p",)),))
    df = spark.createDataFrame([(1, '{"rows": [{"id": "x", "w": 1e-2, "at": {"from": 4}, "parts": [{"p": "q"}, {}]}, {"id": 3}]}', 0)], "rec_id long, matches_found string, loaded_at int")
    got = nested.index_matches(df, shape=shape).first().matches
    assert [(m.match_no, m.id, m.w, m.occ, [p.p for p in m.parts]) for m in got] == [(1, "x", 0.01, [4], ["q", None]), (2, "3", None, [], [])]
