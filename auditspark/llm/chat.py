"""Chat formatting by quotation linking.

Lines that begin with > are quoted; their level is the number of > before the text. Consecutive quoted lines of one
level in a message are a passage. Whole passages, their paragraphs and lines, and the whole unquoted text, paragraphs
and lines of messages, are normalised (A-Z lower-cased, everything but letters, digits and non-ASCII characters
dropped) and hashed with SHA-256; equal hashes link a part of a passage to the first message of its conversation that
holds its words, if that is an earlier one, and a passage links to the original of its longest linked part (the latest
of several). A message replies to the original of its shallowest linked passage (the latest of several); one that
links to nothing replies to the message before it. In reply order a message that answers an older one comes right
after that one and its earlier answers, followed by its own continuation; the rest of the conversation goes on below.
Only DataFrame functions are used.

One conversation may hold a large part of all messages. So places in a conversation are counted in range partitions
of (conversation, turn), with the partitions' totals added up, and no conversation is ever gathered in one row or
task; originals are reduced to the first of each (conversation, hash) before they are joined. Nested answers are
ordered by paths that grow by one level in each checkpointed round.

Cases: a null text counts as empty; a message of quotes alone stays, with an empty text; a quote of nothing known is
removed all the same and links nothing; a passage never links to its own or a later message; rows with equal
(conversation, turn) are ordered by role and text, and later ones can quote earlier ones; null conversation ids form
one conversation, null turns come first; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_QUOTED = r"^[ \t]*>"
_MARKS = r"^([ \t]*(?:>[ \t]*)+)"
#: A line such as "On Tuesday, someone wrote:" right above a quotation.
_INTRODUCTION = r"(?i)^[ \t]*on\b.*\bwrote:[ \t]*$"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "")


def units_of(text: Column) -> Column:
    """The whole text, its paragraphs and its lines."""
    return F.array_distinct(F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, r"\n")))


def passage_hash(text: Column) -> Column:
    """SHA-256 of the normalised text; null if nothing is left of it."""
    kept = normalised(text)
    return F.when(F.length(kept) > 0, F.sha2(kept, 256))


def _running(rows: DataFrame, order: list[Column], total: Column, local: Column, name: str, combine) -> DataFrame:
    """rows with a running value over each conversation, in range partitions of (conversation, order).

    `local` is the value in a partition's part of a conversation (over window `w`), `total` the part's aggregate, and
    `combine` puts what earlier parts came to (null for the first) and the local value together.
    """
    dealt = cut(rows.repartitionByRange("key", *order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("key", "part").orderBy(*order)
    totals = dealt.groupBy("key", "part").agg(total.alias("total"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("key", "part", (F.sum("total") if name != "start" else F.max("total")).over(earlier).alias("before"))
    return dealt.withColumn("local", local.over(inside)).join(before, ["key", "part"]).withColumn(name, combine(F.col("before"), F.col("local"))).drop("part", "before", "local")


def _numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    return _running(rows, order, F.count("*"), F.row_number(), name, lambda before, local: (F.coalesce(before, F.lit(0)) + local).cast("long"))


def parsed(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages with `key` (of the conversation), `at` (place in it), `own` (text without quotes), `quotes` (level, units of size and hash)."""
    rows = messages.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    rows = _numbered(rows, [F.col("turn"), F.col("role"), F.col("text")], "at")
    lines = F.split("text", r"\r?\n")
    level = lambda s: F.when(F.rlike(s, F.lit(_QUOTED)), F.length(F.regexp_replace(F.regexp_extract(s, _MARKS, 1), r"[^>]", ""))).otherwise(0)
    rows = rows.withColumn("lines", F.transform(lines, lambda s: F.struct(level(s).alias("level"), F.regexp_replace(s, _MARKS, "").alias("body"), s.alias("raw"))))
    # a passage begins where the level changes and ends where the next one begins; each line is taken once
    rows = rows.withColumn("begins", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (F.get(F.col("lines"), i)["level"] != F.get(F.col("lines"), i - 1)["level"])))
    stops = lambda k: F.coalesce(F.get(F.col("begins"), k + 1), F.size("lines"))
    body = lambda i, k: F.array_join(F.transform(F.slice("lines", i + 1, stops(k) - i), lambda x: x["body"]), "\n")
    passage = lambda i, k: F.struct(F.get(F.col("lines"), i)["level"].alias("level"), F.when(F.get(F.col("lines"), i)["level"] > 0, body(i, k)).alias("body"))
    # messages without a mark, by far the most, have no passages
    marked = F.exists("lines", lambda x: x["level"] > 0)
    groups = F.when(marked, F.transform("begins", passage)).otherwise(F.array().cast("array<struct<level:int,body:string>>"))
    following = F.transform("lines", lambda x, i: F.struct(x["level"].alias("level"), x["raw"].alias("raw"), F.coalesce(F.get(F.col("lines"), i + 1)["level"], F.lit(0)).alias("next")))
    kept = F.filter(following, lambda x: (x["level"] == 0) & ~((x["next"] > 0) & F.rlike(x["raw"], F.lit(_INTRODUCTION))))
    own = F.when(marked, F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["raw"]), "\n"), r"^\s+|\s+$", "")).otherwise(F.col("text"))
    unit = lambda u: F.struct(F.length(normalised(u)).alias("size"), passage_hash(u).alias("hash"))
    units = lambda body: F.array_distinct(F.filter(F.transform(units_of(body), unit), lambda u: u["size"] > 0))
    quotes = F.filter(
        F.transform(F.filter(groups, lambda g: g["level"] > 0), lambda g: F.struct(g["level"].alias("level"), units(g["body"]).alias("units"))),
        lambda q: F.size(q["units"]) > 0,
    )
    return rows.select("key", "conv_id", "at", "turn", "role", own.alias("own"), quotes.alias("quotes"))


def link_quotes(messages: DataFrame, **columns: str) -> DataFrame:
    """Messages with reply_at (the place of the message answered; null for the first), n_quotes and n_linked passages."""
    rows = cut(parsed(messages, **columns))
    passages = rows.select("key", "at", F.posexplode("quotes").alias("passage", "q"))
    asked = passages.select("key", "at", "passage", F.col("q.level").alias("level"), F.explode("q.units").alias("u")).select("key", "at", "passage", "level", "u.size", "u.hash")
    asking = rows.where(F.size("quotes") > 0).select("key").distinct()
    # only conversations that quote need their originals hashed
    originals = rows.join(asking, "key", "left_semi").select("key", "at", F.explode(units_of(F.col("own"))).alias("u"))
    originals = originals.select("key", passage_hash(F.col("u")).alias("hash"), "at").where("hash IS NOT NULL")
    first = originals.groupBy("key", "hash").agg(F.min("at").alias("original"))
    found = asked.join(first, ["key", "hash"], "left").withColumn("original", F.when(F.col("original") < F.col("at"), F.col("original")))
    longest = F.max(F.when(F.col("original").isNotNull(), F.struct("size", "original")))["original"]
    each = found.groupBy("key", "at", "passage").agg(F.first("level").alias("level"), longest.alias("original"))
    linked = F.col("original").isNotNull()
    per = each.groupBy("key", "at").agg(
        F.min(F.when(linked, F.struct("level", (-F.col("original")).alias("minus")))).alias("best"),
        F.count("*").alias("n_quotes"),
        F.count_if(linked).alias("n_linked"),
    )
    before = F.when(F.col("at") > 1, F.col("at") - 1)
    return rows.join(per, ["key", "at"], "left").select(
        "key", "conv_id", "at", "turn", "role", F.col("own").alias("text"),
        F.coalesce(-F.col("best.minus"), before).alias("reply_at"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )


def _paths(rows: DataFrame) -> DataFrame:
    """(key, start, path) of each run of messages that answer one another in turn, nested below what it answers.

    rows: key, at, reply_at, start (of the message's run). A path is a list of places; the root's is empty.
    """
    heads = rows.where("at = start").select("key", "start", "reply_at")
    home = rows.select("key", F.col("at").alias("reply_at"), F.col("start").alias("up"))
    waiting = cut(heads.where("reply_at IS NOT NULL").join(home, ["key", "reply_at"]))
    done = heads.where("reply_at IS NULL").select("key", "start", F.array().cast("array<bigint>").alias("path"))
    front = done
    while not waiting.isEmpty():
        front = cut(
            waiting.join(front.select("key", F.col("start").alias("up"), "path"), ["key", "up"]).select(
                "key", "start", F.concat("path", F.array("reply_at", "start")).alias("path")
            )
        )
        done = done.unionByName(front)
        waiting = cut(waiting.join(front.select("key", "start"), ["key", "start"], "left_anti"))
    return done


def format_chats(messages: DataFrame, **columns: str) -> DataFrame:
    """Messages in reply order: conv_id, position (from 1), turn, role, text without quotes, reply_turn, n_quotes, n_linked, rendered."""
    rows = link_quotes(messages, **columns)
    head = F.when(F.col("reply_at").isNull() | (F.col("reply_at") < F.col("at") - 1), F.col("at"))
    texts, rows = rows.select("key", "at", "text"), rows.drop("text")  # ordering moves no texts
    rows = cut(_running(rows, [F.col("at")], F.max(head), F.max(head), "start", lambda before, local: F.coalesce(local, before)))
    placed = rows.join(_paths(rows), ["key", "start"]).withColumn("path", F.concat("path", F.array("at")))
    answered = rows.select("key", F.col("at").alias("reply_at"), F.col("turn").alias("reply_turn"))
    # what most messages answer is the one before, but its turn is a join all the same: turns may have gaps
    out = _numbered(placed, [F.col("path")], "position").join(answered, ["key", "reply_at"], "left")
    return out.join(texts, ["key", "at"]).select(
        "conv_id", "position", "turn", "role", "text", "reply_turn", "n_quotes", "n_linked",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n")).alias("rendered"),
    )
