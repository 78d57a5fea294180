"""Queries over lines, tokens and key text."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import devanagari as deva
from ..functions import text as tx
from ..functions.keymaps import FONT_PATTERNS, I_MARK, REPH_MARK, key_table, kruti_rules
from ..operators import keytext, offsets
from .registry import query, quoted, sql_keys, sql_rules, table

#: Runs of characters of a text that are read as key strokes.
KEYED = r"[A-Za-z;:/\[\]{}|']+"
_KEYED_SQL = f"SELECT doc_id, unnest(regexp_extract_all(text, {quoted(KEYED)})) AS w FROM documents"
_WORDS_SQL = r"SELECT doc_id, lang, unnest(regexp_extract_all(text, '[^\s\x{A0}\x{85}\x{2000}-\x{200A}\x{3000}]+')) AS token FROM documents"
_DISTINCT_SQL = f"SELECT w, count(*) AS n FROM ({_KEYED_SQL}) GROUP BY w"


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, w: the key runs of each document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(KEYED), 0)).alias("w"))


def keyed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """w, n: each distinct key run with its count, so that conversions run once a run."""
    return keyed(spark, sf_dir).groupBy("w").agg(F.count("*").alias("n"))


@query(f"""SELECT lang, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct, count(DISTINCT trim(token, {quoted(tx.DETECTOR_EDGE)})) AS n_cores,
  CAST(sum(CAST(regexp_matches(trim(token, {quoted(tx.DETECTOR_EDGE)}), '[A-Za-z]') AS INT)) AS BIGINT) AS n_scorable FROM ({_WORDS_SQL}) GROUP BY lang""")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(tx.words(F.col("text"))).alias("token"))
    each = rows.groupBy("lang", "token").agg(F.count("*").alias("n")).withColumn("core", tx.core(F.col("token")))
    by_core = each.groupBy("lang", "core").agg(F.sum("n").alias("n"), F.count("*").alias("tokens"))
    scorable = F.sum(F.when(F.col("core").rlike("[A-Za-z]"), F.col("n")).otherwise(0))
    return by_core.groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.sum("tokens").alias("n_distinct"), F.count("*").alias("n_cores"), scorable.alias("n_scorable"))


_CLASSES = {"deva": "[ऀ-ॿ]", "upper": "[A-Z]", "lower": "[a-z]", "digit": "[0-9]", "latin1": "[À-ÿ]", "mark": "[.,!?;:]"}


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, {quoted(p)})) AS n_{k}" for k, p in _CLASSES.items()) + ", 2 * len(regexp_extract_all(text, '[A-Z]')) < len(regexp_extract_all(text, '[A-Za-z]')) AS mostly_lower FROM documents")
def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [tx.count_of(F.col("text"), p).alias(f"n_{k}") for k, p in _CLASSES.items()]
    return table(spark, sf_dir, "documents").select("doc_id", *counts, tx.mostly_lower(F.col("text")).alias("mostly_lower"))


_KINDS = " + ".join(f"CAST(coalesce(regexp_matches(html, {quoted(p)}), false) AS BIGINT)" for p in tx.CODE_KINDS.values())


@query(f"SELECT page_id, n AS n_signals, n >= 2 AS is_code FROM (SELECT page_id, CAST({_KINDS} AS BIGINT) AS n FROM pages)")
def code_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", tx.code_signals(F.col("html")).alias("n_signals"))
    return rows.withColumn("is_code", F.col("n_signals") >= 2)


@query(f"""SELECT doc_id, count(*) AS n FROM (SELECT doc_id, t, CASE WHEN regexp_matches(t, '^\\(.*\\)$|^\\[.*\\]$') THEN substr(t, 2, length(t) - 2) ELSE t END AS inner_ FROM
  (SELECT doc_id, translate(token, '1234567890', '!@#$%^&*()') AS t FROM ({_WORDS_SQL}))) WHERE t = '?=' OR regexp_matches(t, {quoted(tx.SYMBOL_NUMBER)}) AND NOT regexp_matches(t, {quoted(tx.PLAIN_NUMBER)})
  AND (regexp_matches(inner_, '[!@#$%^&*()]') OR starts_with(inner_, '?=')) AND NOT (regexp_matches(t, '[A-Za-z]') AND NOT regexp_matches(inner_, '[!@#$%^&*]'))
  AND len(list_distinct(string_split(t, ''))) > 1 AND NOT regexp_matches(t, '^\\([^!@#$%^&*()]\\)$') GROUP BY doc_id""")
def symbol_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of documents, as a typist of the shifted digit row would have typed them."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.words(F.col("text"))).alias("token"))
    typed = rows.select("doc_id", F.translate("token", "1234567890", "!@#$%^&*()").alias("token"))
    return typed.where(tx.is_symbol_number(F.col("token"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, contains(lower(url), '.pdf') AS is_pdf,
  regexp_matches(url, '(?i)^[a-z][a-z0-9+.-]*://|^www\.|^[^@[:space:]]+@[a-z0-9-]+(\.[a-z0-9-]+)+$|^([a-z0-9-]+\.)+(com|edu|gov|in|info|io|net|np|org)(:[0-9]+)?([/?#].*)?$') AS is_address FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(u, "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract(u, "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"), F.contains(F.lower(u), F.lit(".pdf")).alias("is_pdf"), u.rlike(tx.URLISH).alias("is_address"))


_FONT_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower(name), {quoted(p)}) THEN {quoted(e)}" for p, e in FONT_PATTERNS) + " END"
_NAMES_SQL = "SELECT p_partkey, concat_ws('', substr(p_name, 1, 6), '+', CASE p_size % 6 WHEN 0 THEN 'Preeti' WHEN 1 THEN 'PCS Nepali' WHEN 2 THEN 'Kruti Dev 010' WHEN 3 THEN 'Himalb' WHEN 4 THEN 'HimChuli' ELSE 'Arial' END) AS name FROM part"


@query(f"SELECT p_partkey, name, {_FONT_CASE} AS encoding, CASE WHEN {_FONT_CASE} = 'krutidev' THEN 'hi' WHEN {_FONT_CASE} IS NOT NULL THEN 'ne' END AS language FROM ({_NAMES_SQL})")
def font_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font names as PDF subsets carry them, their encodings and languages."""
    table(spark, sf_dir, "part").createOrReplaceTempView("font_parts")
    rows = spark.sql(_NAMES_SQL.replace("FROM part", "FROM font_parts")).withColumn("encoding", deva.encoding_of_font(F.col("name")))
    return rows.withColumn("language", F.when(F.col("encoding") == "krutidev", "hi").when(F.col("encoding").isNotNull(), "ne"))


def _converted(name: str, rules: list, doc: str, encoding: str = "preeti"):
    expr = sql_rules(sql_keys("w", key_table(encoding)), rules)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return keyed_words(spark, sf_dir).select("w", "n", deva.rewrite(deva.map_keys(F.col("w"), key_table(encoding)), rules).alias("converted"))

    run.__name__, run.__doc__ = name, doc
    query(f"SELECT w, n, {expr} AS converted FROM ({_DISTINCT_SQL})")(run)


_converted("key_convert_raw", [], "Key runs of documents, mapped key by key.")
_converted("key_convert_isign", deva.PLACE_I, "Mapped, with each i-sign behind its cluster.")
_converted("key_convert_reph", deva.PLACE_I + deva.PLACE_REPH, "Mapped, with i-signs and rephs in place.")
_converted("key_convert_stroke", deva.STROKE, "Mapped, with the stroke of the m key applied.")
for _e in ("kantipur", "sagarmatha", "himali", "pcs", "fontasy", "himalaya", "sumod"):
    _converted(f"key_convert_{_e}", deva.WORD_RULES, f"Key runs as the {_e} layout draws them.", _e)

_FULL_SQL = f"nfc_normalize({sql_rules(sql_keys('w', key_table()), deva.WORD_RULES)})"


@query(f"SELECT w, n, {_FULL_SQL} AS converted FROM ({_DISTINCT_SQL})")
def key_convert_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key runs of documents as Unicode text, in normal form."""
    return keyed_words(spark, sf_dir).select("w", "n", deva.from_keys(F.col("w")).alias("converted"))


@query(f"SELECT w, n, {_FULL_SQL} AS converted FROM ({_DISTINCT_SQL})")
def key_map_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key runs of documents as the syllables of their maps, put together again."""
    rows = keyed_words(spark, sf_dir)
    maps = offsets.word_maps(rows.select(F.col("w").alias("word"))).withColumnRenamed("word", "w")
    return rows.join(maps, "w").select("w", "n", F.array_join("aksharas.text", "").alias("converted"))


#: What stands between the words of the planted lines, by turns, and what it becomes.
BETWEEN = [("(!)", "(१)"), ("!):))", "१०:००"), ("•", "•"), ("12", "12"), ("&amp;", "७"), ("()", "९०"), ("(@)*#)", "(२०८३)"), ("baM", "दब:")]
_BETWEEN_SQL = "CASE k % {n} " + " ".join(f"WHEN {k} THEN {quoted(b)}" for k, (_, b) in enumerate(BETWEEN)) + " END"


@query(f"""WITH w AS (SELECT doc_id, item, w, row_number() OVER (PARTITION BY doc_id, item ORDER BY i) - 1 AS k FROM (SELECT doc_id, item, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM
  (SELECT doc_id, item - 1 AS item, regexp_extract_all(t, '[a-z]+') AS ws FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS item FROM documents WHERE doc_id IS NOT NULL)))),
c AS (SELECT w, {_FULL_SQL} AS c FROM (SELECT DISTINCT w FROM w)) SELECT doc_id, item, string_agg(c || ' ' || {_BETWEEN_SQL.format(n=len(BETWEEN))}, ' ' ORDER BY k) AS text FROM w JOIN c USING (w) GROUP BY doc_id, item""")
def key_lines_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of documents as key text, with clauses, times, bullets, numbers, character references and a colon between words."""
    lines = key_lines(spark, sf_dir).where("doc_id IS NOT NULL")
    between = F.array(*(F.lit(a) for a, _ in BETWEEN))
    words = F.regexp_extract_all("text", F.lit("[a-z]+"), 0)
    text = F.array_join(F.transform(words, lambda w, k: F.concat(w, F.lit(" "), F.get(between, k % len(BETWEEN)))), " ")
    lexicon = spark.createDataFrame([("दब",)], "word string")  # the word in front of the planted colon
    return keytext.convert_lines(lines.select("doc_id", "item", text.alias("text")).where("text <> ''"), lexicon)


def key_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, read as key text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("item", "text"))


@query()
def key_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The real text of a range of 12 characters of every line, from the fifth on."""
    lines = key_lines(spark, sf_dir)
    return offsets.range_texts(offsets.line_maps(lines), lines.select("doc_id", "item", F.lit(4).alias("offset"), F.lit(12).alias("length")))


@query()
def key_words_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word around the tenth character of every line, and its real text."""
    lines = key_lines(spark, sf_dir)
    return offsets.word_around(offsets.line_maps(lines), lines.select("doc_id", "item", F.lit(9).alias("offset")))


@query(f"SELECT w, a AS preeti, b AS fontasy FROM (SELECT w, {sql_keys('w', key_table())} AS a, {sql_keys('w', key_table('fontasy'))} AS b FROM ({_DISTINCT_SQL})) WHERE a <> b")
def layout_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key runs that two layouts read differently."""
    rows = keyed_words(spark, sf_dir).select("w", deva.map_keys(F.col("w"), key_table()).alias("preeti"), deva.map_keys(F.col("w"), key_table("fontasy")).alias("fontasy"))
    return rows.where(F.col("preeti") != F.col("fontasy"))


def _sql_replaces(expr: str, pairs: list) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, {quoted(a)}, {quoted(b)})"
    return expr


@query(f"SELECT w, nfc_normalize({sql_rules(_sql_replaces('w', kruti_rules()), deva.KRUTI_RULES)}) AS converted FROM ({_DISTINCT_SQL})")
def kruti_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_words(spark, sf_dir).select("w", deva.from_keys(F.col("w"), "krutidev").alias("converted"))


_BROKEN_SQL = f"SELECT w, {sql_rules(sql_keys('w', key_table()), [(I_MARK, 'ि'), ('', 'र्'), ('', '')])} AS b FROM ({_DISTINCT_SQL})"
_UNMARK = [(I_MARK, "ि"), ("", "र्"), ("", "")]


def broken_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """w, b: key runs converted carelessly, with signs where they were typed: what damaged text looks like."""
    return keyed_words(spark, sf_dir).select("w", deva.rewrite(deva.map_keys(F.col("w"), key_table()), _UNMARK).alias("b"))


@query(f"SELECT w, nfc_normalize(b) AS nfc FROM ({_BROKEN_SQL})")
def nfc_devanagari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_words(spark, sf_dir).select("w", deva.nfc(F.col("b")).alias("nfc"))


@query(f"SELECT w, {sql_rules('b', deva.COMPOSE)} AS composed FROM ({_BROKEN_SQL})")
def compose_matras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_words(spark, sf_dir).select("w", deva.rewrite(F.col("b"), deva.COMPOSE).alias("composed"))


@query(f"SELECT w, CASE WHEN regexp_matches(c, {quoted(deva.TYPED_FAULT)}) THEN nfc_normalize({sql_rules('c', deva.TYPED)}) ELSE c END AS repaired, regexp_matches(c, {quoted(deva.TYPED_FAULT)}) AS fault FROM (SELECT w, nfc_normalize(b) AS c FROM ({_BROKEN_SQL}))")
def typed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = broken_words(spark, sf_dir).select("w", deva.nfc(F.col("b")).alias("c"))
    rows = rows.withColumn("fault", deva.has_typed_fault(F.col("c")))
    return rows.select("w", F.when(F.col("fault"), deva.nfc(deva.rewrite(F.col("c"), deva.TYPED))).otherwise(F.col("c")).alias("repaired"), "fault")


@query(f"SELECT w, CAST(len(regexp_extract_all({_FULL_SQL}, {quoted(deva.AKSHARA.replace('[' + chr(92) + 's' + chr(92) + 'S]', '(?s:.)'))})) AS BIGINT) AS n_aksharas FROM ({_DISTINCT_SQL})")
def aksharas_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_words(spark, sf_dir).select("w", F.size(deva.aksharas(deva.from_keys(F.col("w")))).cast("long").alias("n_aksharas"))


_MOVABLE = f"[{deva.SIGN}्]"


_FORMS_SQL = f"SELECT nfc_normalize(b) AS b FROM ({_BROKEN_SQL}) UNION SELECT nfc_normalize({sql_rules('nfc_normalize(b)', deva.TYPED)}) FROM ({_BROKEN_SQL})"


@query(f"""SELECT k AS movement_key, count(*) AS n_forms, min(b) AS first_form FROM (SELECT b, regexp_replace(b, {quoted(_MOVABLE)}, '', 'g') || '|' ||
  array_to_string(list_sort(regexp_extract_all(b, {quoted(_MOVABLE)})), '') AS k FROM ({_FORMS_SQL})) GROUP BY k HAVING count(*) > 1""")
def movement_key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged and repaired forms that differ only in where their movable signs stand."""
    b = broken_words(spark, sf_dir).select(deva.nfc(F.col("b")).alias("b"))
    forms = b.unionByName(b.select(deva.nfc(deva.rewrite(F.col("b"), deva.TYPED)).alias("b"))).distinct()
    rows = forms.select("b", deva.movement_key(F.col("b")).alias("movement_key"))
    return rows.groupBy("movement_key").agg(F.count("*").alias("n_forms"), F.min("b").alias("first_form")).where("n_forms > 1")


_OVERPRINTED = "SELECT w, t, t[1:list_min(list_filter(range(3, length(t) // 3 + 1), lambda n: repeat(t[1:n], length(t) // n) = t))] AS piece FROM (SELECT w, repeat(w, 4) AS t FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS w FROM documents))"


@query(f"SELECT w, CASE WHEN length(t) > 2000 THEN t ELSE {sql_rules('piece', [(f'{c}{{3,}}', c) for c in string.ascii_letters])} END AS once FROM ({_OVERPRINTED})")
def overprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of documents drawn four times over themselves, read once; a word that repeats a piece is that piece, and of
    letters three times in a row or more one stays."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), 0)).alias("w")).distinct()
    return w.select("w", deva.collapse_overprint(F.repeat("w", F.lit(4))).alias("once"))


@query("SELECT page_id, url AS decoded FROM pages")
def url_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with every character percent-encoded, decoded again."""
    enc = F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20"))
    return table(spark, sf_dir, "pages").select("page_id", tx.decode_url(enc).alias("decoded"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def mojibake_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with their UTF-8 bytes read as Windows-1252, put right."""
    wrong = F.translate(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), tx._BYTES, tx.WINDOWS_1252)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.decode_mojibake(wrong)).alias("text_md5"))


_HEADING = "regexp_replace(regexp_replace('## ' || regexp_replace(text, '^([A-Za-z]+)', '**\\1**'), ' ([A-Za-z]+)([,.])', ' [\\1](http://x.org/a)\\2', 'g'), '_([a-z]+)_', '__\\1__', 'g')"
_PLAIN = _HEADING
for _rule, _new in (("(?m)^[ \\t\\n\\f\\r]{0,3}#{1,6}[ \\t\\n\\f\\r]+", ""), ("!\\[([^\\]]*)\\]\\([^)]*\\)", "\\1"), ("\\[([^\\]]*)\\]\\([^)]*\\)", "\\1"), ("```", ""), ("`([^`]*)`", "\\1"), ("\\*\\*([^*]+)\\*\\*", "\\1"), ("__([^_]+)__", "\\1"), ("\\*([^*\\n]+)\\*", "\\1"), ("(?m)^[ \\t\\n\\f\\r]*[-*+][ \\t\\n\\f\\r]+", ""), ("(?m)^>[ \\t\\n\\f\\r]?", "")):
    _PLAIN = f"regexp_replace({_PLAIN}, {quoted(_rule)}, {quoted(_new)}, 'g')"


@query(f"SELECT conv_id, turn, trim({_PLAIN}) AS plain FROM conversations")
def markdown_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns, marked up as a heading with bold, linked and emphasised parts, as plain text."""
    marked = F.concat(F.lit("## "), F.regexp_replace("text", "^([A-Za-z]+)", "**$1**"))
    marked = F.regexp_replace(F.regexp_replace(marked, " ([A-Za-z]+)([,.])", " [$1](http://x.org/a)$2"), "_([a-z]+)_", "__$1__")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.strip_markdown(marked).alias("plain"))


@query(r"""SELECT p_partkey, version, CAST(regexp_extract(version, '(\d+)', 1) AS INT) AS major, CAST(regexp_extract(version, '\d+\D+(\d+)', 1) AS INT) AS minor, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size % 4 AS INT) ELSE 0 END AS patch
  FROM (SELECT p_partkey, p_size, 'v' || p_size || '.' || (p_partkey % 10) || CASE WHEN p_partkey % 3 = 0 THEN '.' || (p_size % 4) ELSE '' END || '-beta' AS version FROM part)""")
def version_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("."), (F.col("p_size") % 4).cast("string"))).otherwise(""), F.lit("-beta"))
    rows = table(spark, sf_dir, "part").select("p_partkey", v.alias("version"))
    return rows.select("p_partkey", "version", tx.version_parts(F.col("version")).alias("v")).select("p_partkey", "version", "v.*")


_TO_SCREEN = [(f"({deva.CLUSTER})ि", "ि$1"), (f"र्(ि?{deva.CONSONANT}[{deva.SIGN}]*)", f"$1{REPH_MARK}")]
_FROM_SCREEN = [(f"(ि?{deva.CONSONANT}[{deva.SIGN}]*){REPH_MARK}", "र्$1"), (f"ि((?:र्)?{deva.CLUSTER})", "$1ि")]


@query(f"SELECT w, shown, {sql_rules('shown', _FROM_SCREEN)} AS back FROM (SELECT w, {sql_rules('b', _TO_SCREEN)} AS shown FROM (SELECT w, nfc_normalize({sql_rules(sql_keys('w', key_table()), deva.WORD_RULES)}) AS b FROM ({_DISTINCT_SQL})))")
def visual_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words in the order on screen, and back in logical order."""
    b = keyed_words(spark, sf_dir).select("w", deva.from_keys(F.col("w")).alias("b"))
    return b.select("w", deva.to_visual(F.col("b")).alias("shown")).select("w", "shown", deva.from_visual(F.col("shown")).alias("back"))
