import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from auditspark.llm import ann, binpack


def nearest_brute(rows, asked, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in asked:
        mine = [v for i, v in good if i == q]
        if mine:
            v = min(mine, key=list)
            out[q] = sorted(((-float(v @ w), i) for i, w in good if i != q and len(w) == len(v)), key=lambda x: (round(x[0], 9), x[1]))[:k]
    return {q: v for q, v in out.items() if v}


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16) * rng.choice([0.01, 1, 50])]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # copies, so many ties
    rows += [(20, None), (40, [0.0] * 16), (60, [float("nan")] * 16), (80, [1.0, None] * 8), (100, [float("inf")] + [0.0] * 15), (None, [1.0] * 16), (7, rows[7][1])]
    rows = [r for i, r in enumerate(rows) if not (i < 400 and r[0] in (20, 40, 60, 80, 100))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 AS dim")
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=20, query_block=7, strip=60).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = nearest_brute(rows, {i for i, _ in rows if i is not None and i % 20 == 0}, 20)
    assert set(got) == set(want)
    for q, best in want.items():
        assert [r for r, _, _ in got[q]] == list(range(1, len(best) + 1))
        assert np.allclose([s for _, _, s in got[q]], [-s for s, _ in best], rtol=1e-12, atol=1e-12)
        assert [v for _, v, _ in got[q]] == [i for _, i in best]


def test_few_or_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1.5)]
    assert ann.nearest(df.limit(0), df.limit(0)).collect() == []


def test_packing_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(300):
        h = [(w, rng.randint(1, 6)) for w in rng.sample(range(1, 60), rng.randint(1, 15))]
        n, total = rng.randint(1, 6), sum(w * c for w, c in h)
        capacity = int(total / n * rng.uniform(1, 1.3)) + max(w for w, _ in h) // rng.randint(1, 4)
        free, want = [capacity] * n, []
        for w, c in sorted(h, reverse=True):
            for _ in range(c):
                fits = [(r, s) for s, r in enumerate(free) if r >= w]
                if want is None or not fits:
                    want = None
                    break
                s = min(fits)[1]
                free[s] -= w
                want.append((w, s))
            if want is None:
                break
        got = binpack.pack(h, capacity, n)
        assert (got is None) == (want is None)
        if want is not None:
            assert [(w, s) for w, s, c in got for _ in range(c)] == want
    assert len({s for _, s, _ in binpack.pack([(6, 3), (4, 3)], 10)}) == 3
    with pytest.raises(ValueError):
        binpack.pack([(11, 1)], 10)


def test_shards(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 300))) for _ in range(400)] + [None, "", None] + ["hot text é"] * 200
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x")], "doc_id long, text string, shard string")
    rows = binpack.assign_shards(df, 8).collect()
    texts = {**dict(enumerate(texts)), None: "no id"}
    assert len(rows) == len(texts)
    groups, loads, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        groups[raw].add(r.shard)
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(g) == 1 for g in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(loads) == set(range(8)) and max(loads.values()) - min(loads.values()) <= 0.02 * sum(loads.values()) / 8
    assert binpack.assign_shards(df.limit(0), 8).collect() == []
    small = {r.doc_id: r.shard for r in binpack.assign_shards(df, capacity=3000).collect()}
    loads = Counter()
    for r in rows:
        loads[small[r.doc_id]] += r.size
    assert len(loads) <= 1 + sum(loads.values()) // 2400


def test_rounded_weights(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    weights = [*range(1, 9000, 7), *(rng.randrange(1, 1 << 50) for _ in range(500)), (1 << 40) - 1, 1 << 40]
    df = spark.createDataFrame([(w,) for w in weights], "w long").select("w", binpack.rounded(F.col("w")).alias("r"))
    for r in df.collect():
        unit = 1 << max(0, r.w.bit_length() - binpack.DIGITS)
        assert r.r == -(-r.w // unit) * unit and r.w <= r.r < r.w * (1 + 1 / 2000)


def test_a_very_long_text_is_one_group(spark):
    df = spark.createDataFrame([(1, "x" * 3_000_000), (2, "y"), (3, "z"), (4, "y")], "doc_id long, text string")
    rows = {r.doc_id: r for r in binpack.assign_shards(df, 2).collect()}
    assert rows[1].size == 3_000_001 and rows[2].shard == rows[3].shard == rows[4].shard != rows[1].shard
    assert {r.shard for r in binpack.assign_shards(df.where("doc_id = 3"), 8).collect()} <= set(range(8))
