import random
from collections import Counter, defaultdict

from lexweave.llm import packing


def check(rows, sizes, capacity):
    space, got = Counter(), Counter()
    pieces = defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.n_tokens
        pieces[r.doc_id].append((r.start_token, r.n_tokens))
        assert r.container_id is not None
        space[r.container_id] += r.n_tokens
    assert got == Counter(sizes) and max(space.values(), default=0) <= capacity
    for d, p in pieces.items():
        p.sort()
        assert len(p) == 1 or sizes[d] > capacity
        assert all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False))
    return len(space)


def test_plan_is_near_the_bound():
    rnd = random.Random(3)
    for capacity in (10, 64, 257):
        counts = Counter(rnd.randrange(1, capacity) for _ in range(2000))
        plan = packing.plan(dict(counts), capacity)
        used = Counter()
        for content, many in plan:
            assert sum(content) <= capacity
            for n in content:
                used[n] += many
        assert used == counts
        bound = max(-(-sum(n * k for n, k in counts.items()) // capacity), sum(k for n, k in counts.items() if 2 * n > capacity))
        assert sum(m for _, m in plan) <= bound * 1.04 + 1


def test_exact_fills():
    assert packing.plan({6: 2, 4: 2}, 10) == [((6, 4), 2)]
    assert packing.plan({6: 1, 3: 1, 1: 1}, 10) == [((6, 3, 1), 1)]
    assert packing.plan({4: 1, 3: 1, 2: 1, 1: 1}, 10) == [((4, 3, 2, 1), 1)]
    assert packing.plan({5: 3}, 10) == [((5, 5), 1), ((5,), 1)]
    assert packing.plan({10: 2}, 10) == [((10,), 2)] and packing.plan({}, 10) == []


def test_documents(spark):
    rnd = random.Random(4)
    sizes = {i: (7 if i % 3 == 0 else rnd.randrange(0, 70)) for i in range(900)}
    df = spark.createDataFrame([(i, n, "x") for i, n in sizes.items()], "doc_id long, n_tokens int, container_id string")
    n = check(packing.pack(df, 32).collect(), sizes, 32)
    assert n <= -(-sum(sizes.values()) // 32) * 1.02 + 1
    assert packing.pack(df.limit(0), 32).count() == 0
    same = spark.createDataFrame([(1, 5), (1, 5), (None, 5)], "doc_id long, n_tokens int")
    assert packing.pack(same, 10).count() == 3


def test_ranks_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 7)
    sizes = spark.createDataFrame([(i % 90, 5) for i in range(100)] + [(None, 5), (200, 23)], "doc_id long, n_tokens int")
    rows = packing.pack(sizes, 10).collect()
    held = {}
    for r in rows:
        held.setdefault(r.container_id, []).append(r.n_tokens)
    assert len(rows) == 104 and max(map(sum, held.values())) <= 10 and len(held) == -(-(101 * 5 + 23) // 10)
