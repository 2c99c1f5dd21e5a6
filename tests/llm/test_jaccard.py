import random
import re

from auditspark.llm import jaccard
from auditspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, t=75):
    sets = [shingle_set(x) for _, x in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= t * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed):
    """Families of near copies, one of them large, common passages, one that is in most texts, copies and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 6)))
    line = lambda n: [word() for _ in range(n)]
    common, passages = line(25), [line(40) for _ in range(4)]
    texts = []
    for family in range(14):
        base = line(rng.choice([7, 30, 60, 200]))
        for _ in range(90 if family == 0 else rng.randint(1, 8)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = word()
            texts.append(t)
    for _ in range(120):
        t = line(rng.randint(5, 60))
        if rng.random() < 0.8:
            t = common + t
        if rng.random() < 0.5:
            t = t + rng.choice(passages)
        texts.append(t)
    # one text of 60 words with two changes each: linked to the original, hardly to one another
    base = line(60)
    texts.append(base)
    for _ in range(60):
        t = list(base)
        for i in rng.sample(range(6, 54), 2):
            t[i] = word()
        texts.append(t)
    rows = [" ".join(t) for t in texts]
    rows += rows[:5] + [None, "", " \n\t", "one", "One", "two words", "é É", "x " * 5000]
    rng.shuffle(rows)
    return list(enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted([tuple(r) for r in jaccard.jaccard_components(df).collect()], key=str)


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (3, "A b c d e f g"), (None, "lone words"), (7, None), (8, "q w e r t y"), (8, "z z z")]
    assert run(spark, rows) == brute(rows)


def test_structured_words_and_equal_sets_only(spark):
    a = "a"
    for _ in range(10):  # words whose polynomials collide modulo any power of two
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"x {a} y z w"), (2, f"x {b} y z w"), (3, "q" * 6000 + " a b"), (4, "q" * 6001 + " a b"), (5, f"x  {a} Y z w")]
    assert run(spark, rows) == brute(rows) == [(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 1, 4), (5, 1, 1)]
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e f g"), (4, None)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), threshold=100).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 3, 3), (4, 0, 4)]


def test_hashes_do_not_depend_on_neighbours():
    from auditspark.llm.shingles import AT_ONCE, Shingler

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.choice([1, 3, 9, 5000]))) for _ in range(rng.randint(0, 300))) for _ in range(12)]
    texts += ["z" * (AT_ONCE + 7) + " a b c d", " ".join(f"w{i}" for i in range(AT_ONCE // 4)), "", None]
    together = Shingler().sets(texts)
    for t, s in zip(texts, together, strict=True):
        assert s.tolist() == Shingler().sets([t])[0].tolist() and len(s) == len(shingle_set(t))


def test_one_row_of_each_group_stays(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e f"), (9, "other words than these here"), (None, "x y"), (None, "x  y"), (2, None), (2, None), (3, ""), (None, "!"), (8, "!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS key", "'k' AS __again2")
    out = jaccard.drop_near_copies(df)
    assert out.columns == df.columns
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    one = min(("x y", "x  y"), key=jaccard.text_sha)
    assert left == sorted([(4, "a b c d e f"), (9, "other words than these here"), (None, one), (2, None), (3, ""), (8, "!")], key=str)
    assert jaccard.drop_near_copies(df.limit(0)).collect() == []


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, key string, n long")
    assert jaccard.jaccard_components(empty).collect() == []
    rows = spark.createDataFrame([(1, "a b", "k", 1), (2, "a b", "k", 2)], "doc_id long, text string, component_id string, n_shingles long")
    assert sorted(tuple(r) for r in jaccard.jaccard_components(rows).collect()) == [(1, 1, 1), (2, 1, 1)]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    want = sorted((x, find(x)) for x in parent)
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_links_of_blocks():
    import numpy as np

    from auditspark.llm.shingles import Shingler, bitmap, fold

    rng = random.Random(9)
    base = [f"w{i}" for i in range(70)]
    texts = []
    for _ in range(40):
        t = list(base)
        for i in rng.sample(range(70), 2):
            t[i] = f"x{rng.random()}"
        texts.append(" ".join(t))
    texts.append(" ".join(base))
    sets = Shingler().sets(texts)
    least = min(len(bitmap(s)) for s in sets)
    side = [
        np.array([(i, i, len(s)) for i, s in enumerate(sets)], np.int64).ravel(),
        np.stack([fold(bitmap(s), least) for s in sets]).ravel(),
        np.concatenate(sets),
    ]
    links = jaccard._links_of_blocks(side, side, 75)
    linked = {frozenset(p) for p in links}
    true = {frozenset((i, j)) for i in range(41) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= 75 * len(set(sets[i]) | set(sets[j]))}
    assert linked <= true and len(links) == len(linked)
    assert groups(41, linked) == groups(41, true)


def groups(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for p in pairs:
            a, b = p
            label[a] = label[b] = min(label[a], label[b])
    return label
