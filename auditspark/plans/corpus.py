"""Code to audit, made from relational rows by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import with_names

#: Line of code of an order, by its key. Each kind is one case of the rules.
LINE = """CASE o_orderkey % 17
WHEN 0 THEN 'cursor.execute(f"SELECT * FROM t WHERE id = {user_id}")'
WHEN 1 THEN 'sql = "SELECT name FROM users WHERE id=" + user_input'
WHEN 2 THEN 'db.execute("DELETE FROM t WHERE k = %s" % name)'
WHEN 3 THEN 'cursor.execute("SELECT * FROM t WHERE id = ?", (x,))'
WHEN 4 THEN 'model = pickle.load(handle)'
WHEN 5 THEN 'tmp_' || CAST(o_orderkey AS STRING) || ' = data_' || CAST(o_custkey AS STRING) || ' + 1'
WHEN 6 THEN 'print("done")'
WHEN 7 THEN 'password = "s3cr3t' || CAST(o_orderkey AS STRING) || '"'
WHEN 8 THEN 'user_id = input("id")'
WHEN 9 THEN 'import sqlite3'
WHEN 10 THEN 'outcome = eval(model.predict(x))'
WHEN 11 THEN 'q = "SELECT a FROM b WHERE c LIKE {x} AND d = {y}".format(x=1, y=2)'
WHEN 12 THEN 'pick = lambda row: row.total'
WHEN 13 THEN 'conn.execute("INSERT INTO log VALUES (1)")'
WHEN 14 THEN '# ' || o_orderpriority
WHEN 15 THEN 'from os.path import *'
ELSE 'width = request.args.get("w")' END"""

PATH = "'src/d' || CAST(o_custkey % 7 AS STRING) || '/f' || CAST(o_custkey AS STRING) || '.py'"

#: (path, line, text) of the corpus for DuckDB, as the start of a WITH clause.
CTE = f"""corpus AS (SELECT {PATH} AS path, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS line, o_orderkey AS ok, {LINE} AS text FROM orders)"""


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Python file for each customer with orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.select(F.expr(PATH).alias("path"), "o_orderkey", F.expr(LINE).alias("text"))
    whole = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "text"))).alias("l"))
    content = F.array_join(F.transform("l", lambda x: x["text"]), "\n")
    files = whole.select("path", content.alias("content")).withColumn("size_bytes", F.octet_length("content").cast("long"))
    return with_names(files)


#: Requirements of a customer's project: a line for each of its parts' suppliers, some of them comments or bad.
REQUIREMENT = """CASE l_suppkey % 6 WHEN 0 THEN 'pkg' || CAST(l_suppkey AS STRING) || '==1.' || CAST(l_linenumber AS STRING)
WHEN 1 THEN '# pinned' WHEN 2 THEN '  lib-' || CAST(l_partkey % 50 AS STRING) || ' >= 2' WHEN 3 THEN '' WHEN 4 THEN '-e .'
ELSE 'x' END"""
REQUIREMENT_CTE = f"""reqs AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY text) AS INTEGER) AS line, text FROM
(SELECT DISTINCT 'p' || CAST(l_orderkey % 40 AS STRING) || '/requirements.txt' AS path, {REQUIREMENT} AS text FROM lineitem))"""


def requirement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.expr("'p' || CAST(l_orderkey % 40 AS STRING) || '/requirements.txt'").alias("path"), F.expr(REQUIREMENT).alias("text")
    )
    whole = rows.groupBy("path").agg(F.array_sort(F.collect_set("text")).alias("l"))
    return with_names(whole.select("path", F.concat(F.array_join("l", "\n"), F.lit("\n")).alias("content")).withColumn("size_bytes", F.octet_length("content").cast("long")))


#: Findings without a parser: one for each order, spread over checkers, severities and places.
FINDING = """SELECT CAST(o_orderkey AS BIGINT) AS fid, 'f' || CAST(o_custkey AS STRING) || '.py' AS path, CAST(o_orderkey % 9 AS INTEGER) AS line,
CASE o_orderkey % 5 WHEN 0 THEN 'sql_injection' WHEN 1 THEN 'contextual_sqli_audit' WHEN 2 THEN 'boilerplate' WHEN 3 THEN 'edge_cases' ELSE 'custom_rule' END AS checker,
CASE o_custkey % 5 WHEN 0 THEN 'info' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS severity,
CASE o_orderkey % 3 WHEN 0 THEN 'security_issue' WHEN 1 THEN 'bad_practice' ELSE 'ai_generated' END AS type,
CAST(o_orderkey % 10 AS DOUBLE) / 10 AS confidence, 'T' || CAST(o_orderkey AS STRING) AS title"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(FINDING + " FROM {orders}", orders=orders)


FINDING_CTE = f"f AS ({FINDING} FROM orders)"

#: Responses of a model, one for each event; some fenced, some no JSON. The second issue of each leaves all but its type out.
RESPONSE = """CASE WHEN event_id % 11 = 0 THEN 'no json here'
ELSE CASE WHEN event_id % 3 = 0 THEN '```json' || chr(10) ELSE '' END || '{"issues":[{"type":"' || CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 5 < 3 THEN 'security' ELSE 'performance' END
WHEN 1 THEN CASE WHEN event_id % 5 < 3 THEN 'misleading' ELSE 'ai_pattern' END WHEN 2 THEN CASE WHEN event_id % 5 < 3 THEN 'ai_generated_comment' ELSE 'generic_docstring' END
ELSE CASE WHEN event_id % 5 < 3 THEN 'resource_exhaustion' ELSE 'data_poisoning' END END || '","title":"E' || CAST(event_id AS STRING)
|| '","severity":"' || CASE event_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'odd' ELSE 'low' END || '","description":"what is wrong","suggestion":"do this","current_name":"a","suggested_name":"b","line_number":' || CAST(event_id % 30 - 2 AS STRING) || '},{"type":"x"}]}'
|| CASE WHEN event_id % 3 = 0 THEN chr(10) || '```' ELSE '' END END"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_id").cast("long").alias("key"), F.expr("element_at(array('edge_cases', 'vibe_naming', 'comment_quality', 'dangerous_ai_logic'), CAST(event_id % 4 AS INT) + 1)").alias("checker"), F.expr(RESPONSE).alias("response"))
