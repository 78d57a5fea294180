"""Queries over state, streams and ciphers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexicon
from ..streaming import documents, state
from .lexicon_queries import _VOCAB, vocabulary
from .registry import query, table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, line, n_words, n_known, n_gain, fault: the turns of conversations as lines of a document. A trial repair takes a
    final s off; three characters in a row beyond ASCII are a fault."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("line"), "text")
    rows = turns.select("doc", "line", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))
    each, lex = rows.groupBy("doc", "line", "word").agg(F.count("*").alias("n")), vocabulary(spark, sf_dir)
    each = lexicon.known(each, lex).withColumnRenamed("known", "before").withColumn("short", F.regexp_replace("word", "s$", ""))
    each = each.join(lex.select(F.col("word").alias("short"), F.lit(True).alias("after")), "short", "left")
    gain = ~F.col("before") & F.coalesce("after", F.lit(False))
    sums = each.groupBy("doc", "line").agg(F.sum("n").alias("n_words"), *[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in (("n_known", F.col("before")), ("n_gain", gain))])
    faults = turns.groupBy("doc", "line").agg(F.bool_or(F.coalesce(F.col("text").rlike(r"[^\x00-\x7F]{3}"), F.lit(False))).alias("fault"))
    return sums.join(faults, ["doc", "line"])


_STATE = f"""WITH v AS ({_VOCAB}), w AS (SELECT conv_id AS doc, turn AS line, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations),
x AS (SELECT conv_id AS doc, turn AS line, bool_or(coalesce(regexp_matches(text, '[^\\x00-\\x7F]{{3}}'), false)) AS fault FROM conversations GROUP BY 1, 2),
l AS (SELECT doc, line, count(*) AS n, count(*) FILTER (word IN (SELECT word FROM v)) AS k, count(*) FILTER (word NOT IN (SELECT word FROM v) AND regexp_replace(word, 's$', '') IN (SELECT word FROM v)) AS g FROM w GROUP BY doc, line),
s AS (SELECT doc, line, n, g, fault, CAST(sum(n) OVER o AS BIGINT) AS words, CAST(sum(k) OVER o AS BIGINT) AS known, CAST(sum(g) OVER o AS BIGINT) AS gain FROM l JOIN x USING (doc, line) WINDOW o AS (PARTITION BY doc ORDER BY line))
SELECT doc, line, words, known, coalesce(bool_or(fault OR words >= 60 AND 2 * known < words OR words >= 40 AND 10 * gain >= words OR g >= 2 AND 10 * g >= 3 * n) OVER (PARTITION BY doc ORDER BY line), false) AS damaged FROM s"""


@query(_STATE)
def doc_state_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running evidence of damage per document, line by line; a verdict stays."""
    return state.damage_batch(lines(spark, sf_dir))


@query(_STATE)
def doc_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream over files of lines, with keyed state."""
    path = f"{state.shared_dir(spark)}/lines-{state.uuid.uuid4().hex}"
    rows = lines(spark, sf_dir)
    rows.write.parquet(path)
    return state.run_to_table(state.grouped_state_stream(spark.readStream.schema(rows.schema).parquet(path)), "doc-state")


@query(_STATE)
def doc_state_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stateful processor, over the RocksDB state store."""
    path = f"{state.shared_dir(spark)}/lines-{state.uuid.uuid4().hex}"
    rows, name = lines(spark, sf_dir), "spark.sql.streaming.stateStore.providerClass"
    rows.write.parquet(path)
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return state.run_to_table(state.damage_stream(spark.readStream.schema(rows.schema).parquet(path)), "doc-state")
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def user_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, item, ts, encoding, converted: events as lines of a user, of which so many words were converted."""
    rows = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    return rows.select(F.col("user_id").cast("long").alias("user"), F.col("event_id").cast("long").alias("item"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("encoding"), (F.col("event_id") % 4).cast("long").alias("converted"))


_CONTEXT = """SELECT "user", item, CASE WHEN ts - last.ts <= INTERVAL 300 SECOND THEN last.encoding END AS context FROM (SELECT user_id AS "user", event_id AS item, ts,
  last_value(CASE WHEN event_id % 4 >= 2 THEN {'ts': ts, 'encoding': event_type} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM events WHERE user_id IS NOT NULL)"""


@query(_CONTEXT)
def context_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoding that each user's line is read in: that of a line up to five minutes before with enough converted words."""
    return documents.context_batch(user_lines(spark, sf_dir))


@query(_CONTEXT)
def context_memory_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream, with state that timers take away."""
    path, rows = f"{state.shared_dir(spark)}/user-lines-{state.uuid.uuid4().hex}", user_lines(spark, sf_dir)
    rows.write.parquet(path)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return state.run_to_table(documents.context_stream(spark.readStream.schema(rows.schema).parquet(path)), "contexts")
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


@query()
def slow_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that are off for a minute after a slow one, per user."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    return state.breaker(rows, 50.0, 60)


@query("SELECT page_id, md5(html) AS html_md5 FROM pages")
def aes_cbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages enciphered by AES in CBC mode, the vector in front as in PDF files, and deciphered again."""
    key = F.unhex(F.md5(F.col("page_id").cast("string")))
    iv = F.unhex(F.md5(F.concat(F.lit("iv"), F.col("page_id").cast("string"))))
    locked = F.aes_encrypt(F.col("html"), key, F.lit("CBC"), F.lit("PKCS"), iv)
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.aes_decrypt(locked, key, F.lit("CBC"), F.lit("PKCS"))).alias("html_md5"))
