import hashlib
import random

import pytest

bpe = pytest.importorskip("auditspark.llm.bpe")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "the", "ing", "a", "é", "é", "\u0301", "İ", "ß", "Σ", "ς", "日本", "語", "'s", "'r", "'re", "'", "e", "'ll", "!", "!!", "1", "²", "  ", "\n", " ", "\x85", "\x1c", "\xa0",
    "<|endoftext|>", "<|startof", "|>", "😀", "👨‍👩‍👧", "ﬁ", "Ⅳ", "Ａ", "한", "ᄒ", "ᅡ", "ᆫ", "_", "-", "abcdefghij", "zzz", "\x00", "ǅ",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)

    def both(text):
        e = t.encode(text or "", add_special_tokens=False)
        return b"".join(i.to_bytes(4, "little") for i in e.ids), t.decode(e.ids, skip_special_tokens=False)

    return both


def test_small_leaves_equal_the_library(library):
    small, plain = bpe.TreeEncoder(PATH, leaf_chars=40, word_symbols=8), bpe.TreeEncoder(PATH)
    rng = random.Random(3)
    for _ in range(2500):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60)))
        assert small.encode(t) == plain.encode(t) == library(t), t
    for t in ("x" * 3000, "ab" * 2000, "thein" * 999 + "é", "".join(rng.choice("abcdefghijklmno") for _ in range(4000))):
        assert small.encode(t) == library(t)


def test_every_plain_character_equals_the_library(library):
    encoder, small = bpe.TreeEncoder(PATH), bpe.TreeEncoder(PATH, leaf_chars=6)
    for c in map(chr, range(bpe.PLAIN_BELOW + 16)):
        for t in (c, f"ab{c}cd", f"{c}{c}", f"1{c} x{c}!", f"'{c}s {c}"):
            assert encoder.encode(t) == small.encode(t) == library(t), (hex(ord(c)), t)


def test_documents(spark, library):
    rng = random.Random(8)
    texts = [None, "", " \n", "one two", "one two", "z" * 900] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 400))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "1 AS IDS")
    got = {r.doc_id: r for r in bpe.encode_documents(df, PATH, leaf_chars=100, partitions=3).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids, shown = library(t)
        assert (bytes(got[i].ids), got[i].decoded, got[i].n_tokens) == (ids, shown, len(ids) // 4), t
    assert bpe.encode_documents(df.limit(0), PATH).collect() == []


def test_query_digests(spark, library, tmp_path):
    from auditspark.llm import queries

    texts = [None, "", "Hello, WORLD's end!", "long text " * 9000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op2_bpe_codec(spark, str(tmp_path)).collect():
        ids, shown = library(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())
