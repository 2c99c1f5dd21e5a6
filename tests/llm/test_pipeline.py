"""The pipeline against a plain version of its five stages, and on odd and empty inputs."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from auditspark.llm import langid, secret_scan

from .test_jaccard import brute as groups_of
from .test_secrets_and_leaks import leak_brute

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def corpus():
    rng = random.Random(6)
    line = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuv") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [(i, line(rng.randint(12, 20))) for i in range(4)] + [(9, None)]
    texts = [None, "", "12 34 !", "!!", "solo", items[2][1]]
    for _ in range(25):
        base = line(rng.choice([3, 40, 80]))
        texts.append(base)
        for _ in range(rng.randint(0, 3)):
            w = base.split(" ")
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        if rng.random() < 0.4:
            texts.append(line(6) + ". " + rng.choice(items[:4])[1] + "! " + line(7))
        if rng.random() < 0.3:
            texts.append(line(12) + ' password = "hunter2secret" ' + line(4))
    texts.append("x" * 70_000)
    rng.shuffle(texts)
    docs = [(i, t, rng.choice(["en", "de"]), f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return docs, items


def plain(docs, items):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    kept = [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]
    vectors = dict(zip([d[0] for d in docs], langid.Space().vectors([d[1] for d in docs])[0], strict=True))
    sums = [sum(vectors[d[0]] for d in docs if d[2] == x) for x in ("de", "en")]
    best = {d: max(float(v @ s / np.linalg.norm(s)) for s in sums) for d, v in vectors.items()}
    kept = [d for d in kept if sum(c.isalpha() for c in d[1]) < 200 or best[d[0]] >= 4 / langid.DIMENSIONS**0.5]
    first = {d: c for d, _, c in groups_of([(d[0], d[1]) for d in kept])}
    kept = [d for d in kept if first[d[0]] == d[0]]
    automaton, out = secret_scan._automaton(), []
    for doc_id, text, lang, source, _ in kept:
        n, hit, _ = leak_brute(text, [(str(i), t) for i, t in items])
        if hit and hit == n:
            continue
        if hit:
            w = [m.group().lower() for m in WORD.finditer(text)]
            marked = [False] * n
            for _, t in items:
                x = [m.group().lower() for m in WORD.finditer(t or "")]
                for s in range(max(1, len(x) - 9) if x else 0):
                    for i in range(n - len(x[s : s + 10]) + 1):
                        if w[i : i + 10][: len(x[s : s + 10])] == x[s : s + 10]:
                            marked[i : i + len(x[s : s + 10])] = [True] * len(x[s : s + 10])
            places, cut, i = [m.span() for m in WORD.finditer(text)], [], 0
            while i < n:
                if marked[i]:
                    j = i
                    while j + 1 < n and marked[j + 1]:
                        j += 1
                    cut.append((places[i][0], places[j][1]))
                    i = j
                i += 1
            for a, b in reversed(cut):
                text = text[:a] + text[b:]
        spans = sorted((s, e) for _, s, e in secret_scan.scan(text, automaton))
        for i in range(len(spans) - 1, 0, -1):
            if spans[i][0] < spans[i - 1][1]:
                spans[i - 1] = (spans[i - 1][0], max(spans[i - 1][1], spans[i][1]))
                del spans[i]
        for a, b in reversed(spans):
            text = text[:a] + "[secret]" + text[b:]
        ids = library.encode(text, add_special_tokens=False).ids
        out.append((doc_id, text, lang, source, len(text), len(ids), b"".join(i.to_bytes(4, "little") for i in ids)))
    return sorted(out)


def test_run_equals_plain_version(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == plain(docs, items)


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    rows = [(None, "a b c d e f", "en", None, None), (1, "a b c d e f", None, "s", 11), (1, "a b c d e f", None, "s", 11), (2, None, None, None, None), (3, "a b c d e f g h", "en", "s", 15)]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for data in (rows, []):
        docs = spark.createDataFrame(data, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
            docs = out
        got = sorted((str(r.doc_id), r.text) for r in docs.collect())
        assert got == ([("1", "a b c d e f"), ("3", "a b c d e f g h")] if data else [])


def test_columns_of_any_name_stay(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = ["spans", "items", "n_words", "n_hit", "secret_spans", "__lang", "key", "component", "row", "leaf", "open", "score", "a.b"]
    text = 'Some words before, one two three four five six seven eight nine ten, password = "hunter2secret" and after.'
    docs = spark.createDataFrame([(7, text, *names)], "doc_id int, text string, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    got = docs.collect()[0].asDict()
    assert [got[n] for n in names] == names and got["doc_id"] == 7 and docs.schema["doc_id"].dataType.simpleString() == "int"
    assert got["text"] == 'Some words before, , [secret]" and after.' and got["n_tokens"] > 5 and len(docs.columns) == len(names) + 4


def test_languages_are_filled_in_and_foreign_texts_go(spark, tmp_path):
    rng = random.Random(1)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    german, english = ["der", "die", "und", "nicht", "ist", "schön"], ["the", "and", "of", "not", "was", "with"]
    rows = [(i, say(w, 80), lang) for i, (w, lang) in enumerate([(german, "de"), (english, "en")] * 5)]
    rows += [(50, say(german, 60), None), (51, say(english, 3), None), (52, "Привет мир как дела " * 20, None), (53, "日本", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect()}
    assert 52 not in got and got[50] == "de" and got[51] == "en" and 53 in got and len(got) == 13


def test_languages_without_a_label(spark, tmp_path):
    rows = [(1, "a b c", None, "s", 5), (2, "12 !", None, "s", 4), (3, None, None, "s", None), (4, "é", None, "s", 1), (None, "Wort", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(str(r.doc_id) for r in corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect()) == ["1", "4", "None"]
