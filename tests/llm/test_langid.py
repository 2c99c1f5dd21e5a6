import os
import random

import pytest
from pyspark.sql import functions as F

from auditspark.llm import langid, queries

DATA = "/root/testdata/sf0.01"


def test_rare_cases(spark):
    rows = [(1, "der die das und ist nicht", "de"), (2, "the and of is not was", "en"), (3, None, "en"), (4, "", "en"), (5, "123 !?", "en"), (6, "THE AND OF", None), (7, "nicht und der", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("SCORE", F.lit("kept out"))
    profiles = langid.train(df.where("lang <> 'xx'"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, profiles).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "de", 2: "en", 3: "und", 4: "und", 5: "und", 6: "en", 7: "de"}
    assert all(0 <= s <= 1 for _, s in got.values()) and got[3][1] == 0
    nothing = langid.identify(df, langid.train(df.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert langid.identify(df.limit(0), profiles).collect() == []


def test_vectors_do_not_depend_on_neighbours():
    rng, space = random.Random(1), langid.Space()
    texts = ["".join(rng.choice("abc é1\n") for _ in range(rng.randint(0, 50))) for _ in range(30)] + ["z" * 5000]
    together, has = space.vectors(texts)
    for i, t in enumerate(texts):
        alone, own = space.vectors([t])
        assert own[0] == has[i] and abs(alone[0] - together[i]).max() < 1e-5


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    found = queries.op1_language_id(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    share = found.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert share > 0.98


def test_against_plain_profiles(spark):
    """The same vectors, n-gram by n-gram."""
    import numpy as np

    rng, space = random.Random(3), langid.Space()
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 30))), lang)
            for i, (lang, a) in enumerate(24 * [("de", "abcdeäöü"), ("ru", "абвгде"), ("zh", "的一是不了人")])]
    rows += [(100, "ABC Ä1b", None), (101, "ё", None), (102, "日本", None), (103, "", None)]

    def vector(text):
        symbols, last = [0], 0
        for c in text:
            s = ord(c.lower()[0]) if c.isalpha() else 0
            symbols += [s] if s or last else []
            last = s
        symbols += [0] if last else []
        out = np.zeros(langid.DIMENSIONS)
        for i in range(len(symbols) - 2):
            gram = 1.0
            for k, s in enumerate(symbols[i : i + 3]):
                gram = gram * np.roll(space.letter_vectors(np.array([s]))[0].astype(float), 2 - k)
            out += gram
        n = np.linalg.norm(out)
        return out / n if n else out

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages = ["de", "ru", "zh"]
    sums = [sum(vector(t) for _, t, x in rows if x == lang) for lang in languages]
    for r in langid.identify(df, langid.train(df)).collect():
        cosines = [float(vector(r.text) @ s / np.linalg.norm(s)) for s in sums]
        if not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert abs(r.score - max(0.0, *cosines)) < 1e-4
            assert r.lang_pred == languages[int(np.argmax(cosines))] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-4
    tie = langid.Profiles(["aa", "bb"], np.stack([sums[0] / np.linalg.norm(sums[0])] * 2).astype(np.float32), langid.DIMENSIONS, langid.SEED)
    assert {r.lang_pred for r in langid.identify(df.where("lang = 'de'"), tie).collect()} == {"aa"}
