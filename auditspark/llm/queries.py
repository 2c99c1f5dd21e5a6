"""The training-data operators as queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, binpack, bpe, chat, fm_index, html_text, jaccard, langid, secret_scan, urlgraph


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the public vocabulary file lies; only the queries know it, operators take a path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out(doc_id: Column) -> Column:
    """The third of the documents that no profile is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learned = docs.where((F.crc32(F.col("doc_id").cast("string")) % 3 != 1) & F.col("lang").isNotNull())
    profiles = langid.train(learned)
    found = langid.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, tokenizer_path())
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


URL_RULES = [
    urlgraph.Rule("org", "/", "allow"),
    urlgraph.Rule("example.org", "/es/", "block"),
    urlgraph.Rule("example.org", "/en/1", "block"),
    urlgraph.Rule("com", "/fr/", "allow"),
    urlgraph.Rule("com", "/de/", "block"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_text(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fm_index.find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs)
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("secret_spans")).alias("spans"),
    )


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = binpack.assign_shards(_table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_bpe_codec": op2_bpe_codec,
        "op3_chat_format": op3_chat_format,
        "op4_url_filter": op4_url_filter,
        "op5_html_text": op5_html_text,
        "op6_nearest": op6_nearest,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_decontaminate": op8_decontaminate,
        "op9_secret_scan": op9_secret_scan,
        "op10_shards": op10_shards,
        "pipeline": pipeline,
    }


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLE_WORDS = f"coalesce(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), [])"
_ITEM_WORDS = f"coalesce(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

_JACCARD_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, {_SHINGLE_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 75 * (i.n + j.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT b.y, r.c FROM r JOIN b ON b.x = r.v)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.v = d.doc_id GROUP BY d.doc_id"""

_LEAK_SQL = f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
m AS (SELECT DISTINCT dp.doc_id, bw.item, dp.p, dp.n FROM dp JOIN bw ON bw.n = dp.n AND bw.s = array_to_string(dp.w[p:p + dp.n - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; tests compare the others with brute-force versions."""
    return {"op7_ngram_jaccard": _JACCARD_SQL, "op8_decontaminate": _LEAK_SQL}
