"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, line_dedup, mixing, neardup, packing, quality, substring_dedup, topk, toxicity, turn_repair, vector_codes, warc
from .common import shared_dir, staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def _held_out(parts: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == rest, F.lit(False))


def op2_subword_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), _held_out(4, 2)
    model = quality.train(docs, _table(spark, sf_dir, "labels"), ~held)
    return quality.score_quality(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), _held_out(5, 0)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~held)
    return toxicity.score_toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", F.size("segments").alias("n_segments"))


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), neardup.Settings(percent=85))


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role").withColumn("text", F.lit(said))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest_chats(chat.format_chats(staged(chat.linear_tree(turns), "messages")))


def op6_subset_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op7_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_exact_duplicates(_table(spark, sf_dir, "documents"))


def op8_cuckoo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.LineIndex.empty(spark).insert(docs).apply(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_transaction_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("capture_id"), "url", F.col("html").alias("payload")), path)
    captures = warc.assemble(warc.read_records(spark, path, with_payload=False))
    return captures.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))), "*").select(F.col("capture_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def op10_norm_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_turn_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    found = turn_repair.audit_conversations(turn_repair.damage(turns)).withColumnRenamed("conv_id", "audited")
    every = turns.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, every["conv_id"].eqNullSafe(found["audited"]), "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op13_resident_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"), extra=("label",))
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book.tolist() for x in entry).encode()).hexdigest()
    return vector_codes.with_group_sum(codes, "label", "error", "label_error").drop("label").withColumn("codebooks_sha256", F.lit(digest))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_shortest_pack_first, op2_subword_embeddings, op3_segment_search, op4_chosen_path, op5_reply_trees, op6_subset_sum, op7_content_sort, op8_cuckoo_lines, op9_transaction_assembly, op10_norm_sorted, op11_turn_stream, op12_block_anchors, op13_resident_lloyd)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op5_reply_trees": OP5, "op7_content_sort": OP7, "op8_cuckoo_lines": OP8, "op9_transaction_assembly": OP9, "op10_norm_sorted": OP10, "op11_turn_stream": OP11, "op12_block_anchors": OP12, "op13_resident_lloyd": _lloyd_sql()}


OP7 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""

OP5 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v (turn, role)
), e AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS kept FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || role || chr(10) || kept || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS main FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < main THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < main THEN main END AS refers_to FROM m
"""

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT r, doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d)
), f AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT l.*, f.keeper IS NOT NULL AND f.keeper <> l.doc_id AS dropped FROM l LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""

OP10 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS query, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP11 = r"""
WITH RECURSIVE n AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), h AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: CAST(ord(substr(key, i, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS h FROM n
), d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) FROM h WHERE h <> 0)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut
  FROM (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d)
), t AS (
  SELECT c, i, conv_id, turn, role, text, role[1:1] AS ini, lag(role[1:1]) OVER (PARTITION BY c ORDER BY i) AS prev,
    CASE WHEN cut = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o
), p AS (
  SELECT c, CAST(0 AS BIGINT) AS i, {'c': 0, 'a': ''} AS e, {'c': 1000000000, 'a': ''} AS s, {'c': 5, 'a': 'I'} AS u, {'c': 10, 'a': 'II'} AS a FROM (SELECT DISTINCT c FROM t)
  UNION ALL
  SELECT c, i, e, s, u, least(a, {'c': u.c + 5, 'a': u.a || 'I'}) AS a FROM (
    SELECT c, i, e, s, least(u, {'c': e.c + 5, 'a': e.a || 'I'}, {'c': s.c + 5, 'a': s.a || 'I'}, {'c': a.c + 5, 'a': a.a || 'I'}) AS u, a FROM (
    SELECT t.c, t.i, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 5 ELSE 0 END AS stay,
      {'c': e.c + 2, 'a': e.a || 'D'} AS e,
      least({'c': s.c + 2, 'a': s.a || 'D'}, {'c': e0.c + stay + CASE WHEN ini = 's' THEN 0 ELSE 1000000000 END, 'a': e0.a || 'K'}) AS s,
      least({'c': u0.c + 2, 'a': u0.a || 'D'}, {'c': b.c + stay + CASE WHEN ini = 'u' THEN 0 ELSE 1 END, 'a': b.a || CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END}) AS u,
      least({'c': a0.c + 2, 'a': a0.a || 'D'}, {'c': u0.c + stay + CASE WHEN ini = 'a' THEN 0 ELSE 1 END, 'a': u0.a || CASE WHEN ini = 'a' THEN 'K' ELSE 'R' END}) AS a
    FROM (SELECT c, i, e, s, u AS u0, a AS a0, e AS e0, least(e, s, a) AS b FROM p) q JOIN t ON t.c = q.c AND t.i = q.i + 1
  ))
), best AS (
  SELECT c, least(e, a).c AS cost, least(e, a).a AS audit FROM p JOIN (SELECT c, max(i) AS i FROM t GROUP BY c) USING (c, i)
), letters AS (
  SELECT c, k, audit[k:k] AS edit, length(replace(audit, 'D', '')) AS n, length(replace(audit[1:k], 'I', '')) AS i, length(replace(audit[1:k], 'D', '')) AS pos
  FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS k FROM best)
), repaired AS (
  SELECT l.c, sha256(coalesce(string_agg(CASE WHEN edit = 'K' THEN role WHEN (pos + n) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) FILTER (edit <> 'D'), '')) AS sha
  FROM letters l LEFT JOIN t ON t.c = l.c AND t.i = l.i GROUP BY l.c
), counted AS (
  SELECT conv_id, c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id, c
)
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN counted x ON x.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN best USING (c) LEFT JOIN repaired USING (c)
"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT r, id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
g AS (SELECT r, i FROM (SELECT r, i, id, min(id) OVER (PARTITION BY k) AS least FROM x) WHERE least < id),
j AS (SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
c AS (SELECT j.r, j.j, word, max(g.i) OVER (PARTITION BY j.r ORDER BY j.j ROWS 49 PRECEDING) IS NOT NULL AS gone FROM j LEFT JOIN g ON g.r = j.r AND g.i = j.j)
SELECT any_value(doc_id) AS doc_id, count(c.j) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN c USING (r) GROUP BY r
"""


def _lloyd_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Each round is a table of assignments and a table of entries."""
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), p AS MATERIALIZED (SELECT r, pos, x[pos * w + 1 : (pos + 1) * w] AS x FROM (SELECT r, x, len(x) // {parts} AS w, unnest(range({parts})) AS pos FROM v)),
b0 AS MATERIALIZED (SELECT pos, r - 1 AS entry, x FROM p WHERE r <= {entries})"""]  # fmt: skip
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT r, pos, arg_min(entry, {{'d': d, 'e': entry}}) AS entry, min(d) AS d
  FROM (SELECT p.r, p.pos, b.entry, CAST(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x) AS BIGINT) AS d FROM p JOIN b{k} b USING (pos)) GROUP BY r, pos
)""")  # fmt: skip
        if k < rounds:
            steps.append(f"""
m{k} AS (
  SELECT pos, entry, list(mean ORDER BY i) AS x FROM (
    SELECT pos, entry, i, CAST(floor(sum(c) / count(*)) AS BIGINT) AS mean FROM (SELECT pos, a.entry, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM p JOIN a{k} a USING (r, pos)) GROUP BY ALL
  ) GROUP BY ALL
), b{k + 1} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (pos, entry))""")  # fmt: skip
    return ",".join(steps) + f""",
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM b{rounds}),
e AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN e USING (r) CROSS JOIN s
"""
