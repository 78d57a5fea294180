"""Queries that test words against a vocabulary, score them, and decide lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import devanagari as deva
from ..functions import text as tx
from ..functions.keymaps import key_table
from ..functions.staging import staged
from ..operators import detector, learning, lexicon
from .registry import query, quoted, sql_keys, sql_rules, table
from .text_queries import _BROKEN_SQL, broken_words

_WORDS = "SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents"
_VOCAB = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark"
_DISTINCT = f"SELECT word, count(*) AS n FROM ({_WORDS}) GROUP BY word"


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, word, n: lower-case words of each document with their counts."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).groupBy("doc_id", "lang", "word").agg(F.count("*").alias("n"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon of these queries: the words of the benchmark table, staged, so that its size is known where it is joined."""
    return staged(table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).distinct(), "vocabulary")


def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, n: the distinct words of all documents."""
    return doc_words(spark, sf_dir).groupBy("word").agg(F.sum("n").alias("n"))


_RATE = f"SELECT doc_id, count(*) AS n_words, count(*) FILTER (word IN ({_VOCAB})) AS n_known FROM ({_WORDS}) GROUP BY doc_id"


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexicon.known(doc_words(spark, sf_dir), vocabulary(spark, sf_dir))
    return rows.groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("n_known"))


@query(f"SELECT doc_id, n_words, n_known, CASE WHEN n_words >= 3 THEN 100 * n_known // n_words END AS percent FROM ({_RATE})")
def lexicon_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known share of each document's words; none below three words."""
    percent = F.when(F.col("n_words") >= 3, F.floor(100 * F.col("n_known") / F.col("n_words")))
    return rates(spark, sf_dir).withColumn("percent", percent)


@query(f"SELECT doc_id, n_words, n_known FROM ({_RATE}) WHERE n_words >= 60 AND 2 * n_known < n_words OR n_words >= 3 AND n_words < 60 AND 5 * n_known < 3 * n_words")
def low_word_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with too few known words; ratios are compared by whole numbers."""
    return rates(spark, sf_dir).where("n_words >= 60 AND 2 * n_known < n_words OR n_words >= 3 AND n_words < 60 AND 5 * n_known < 3 * n_words")


_STEMS = "word" + "".join(f" UNION SELECT word, left(word, length(word) - {len(e)}) || '{x}' FROM d WHERE ends_with(word, {quoted(e)}) AND length(word) - {len(e)} >= 3" for e in lexicon.ENGLISH_ENDINGS for x in ["", *([lexicon.RESTORED[e]] if e in lexicon.RESTORED else [])])


@query(f"WITH d AS ({_DISTINCT}), s AS (SELECT word, word AS stem FROM d" + _STEMS.removeprefix("word") + f") SELECT DISTINCT word FROM s WHERE stem IN ({_VOCAB})")
def english_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.known_by_stem(corpus_words(spark, sf_dir), vocabulary(spark, sf_dir))


_RULES = [("S", "P", "", "s", "[a-z]"), ("S", "Q", "e", "ing", "[a-z]e"), ("S", "Q", "", "d", "e"), ("S", "R", "y", "ies", "[^aeiou]y")]
_RULES_SQL = "VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in _RULES)
_FLAGS_SQL = f"SELECT word, unnest(list_filter(['P', CASE WHEN ends_with(word, 'e') THEN 'Q' END, CASE WHEN ends_with(word, 'y') THEN 'R' END], lambda x: x IS NOT NULL)) AS flag FROM ({_VOCAB})"


def affix_lexicon(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stems with flags, made of the vocabulary, and suffix rules."""
    w = F.col("word")
    flags = F.array_compact(F.array(F.lit("P"), F.when(F.endswith(w, F.lit("e")), "Q"), F.when(F.endswith(w, F.lit("y")), "R")))
    return vocabulary(spark, sf_dir).withColumn("flags", flags), spark.createDataFrame(_RULES, "kind string, flag string, strip string, add string, cond string")


_FORMS_SQL = f"SELECT s.word, left(s.word, length(s.word) - length(r.strip)) || r.add AS form, s.flag FROM ({_FLAGS_SQL}) s JOIN ({_RULES_SQL}) r (kind, flag, strip, add, cond) USING (flag) WHERE ends_with(s.word, r.strip) AND regexp_matches(s.word, '(?:' || r.cond || ')$')"


@query(_FORMS_SQL)
def affix_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.affix_forms(*affix_lexicon(spark, sf_dir))


@query(f"SELECT d.word, f.word AS stem, f.flag FROM ({_DISTINCT}) d JOIN ({_FORMS_SQL}) f ON d.word = f.form")
def affix_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that a suffix rule makes of a vocabulary stem."""
    return lexicon.known_by_affix(corpus_words(spark, sf_dir), *affix_lexicon(spark, sf_dir))


#: Prefix rules: an addition, one that drops a letter, and one with a condition on how the stem begins.
_PREFIXES = [("P", "U", "", "in", "."), ("P", "V", "e", "a", "e[a-z]"), ("P", "W", "", "s", "[tchpw]")]
_PREFIX_SQL = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in _PREFIXES) + ")"


@query(f"""SELECT d.word, s.word AS stem, r.flag FROM ({_DISTINCT}) d JOIN ({_PREFIX_SQL}) r (kind, flag, strip, add, cond) ON starts_with(d.word, r.add)
JOIN ({_DISTINCT}) s ON s.word = r.strip || substr(d.word, length(r.add) + 1) AND regexp_matches(s.word, '^(?:' || r.cond || ')')""")
def prefix_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that a prefix rule makes of another word of theirs."""
    words = corpus_words(spark, sf_dir)
    rules = spark.createDataFrame(_PREFIXES, "kind string, flag string, strip string, add string, cond string")
    return lexicon.known_by_affix(words, words.select("word", F.array(*(F.lit(f) for _, f, *_ in _PREFIXES)).alias("flags")), rules)


@query(f"SELECT regexp_replace(word, '[aeiou]', '', 'g') AS skeleton, min(word) AS word FROM ({_VOCAB}) GROUP BY 1 HAVING count(*) = 1")
def skeleton_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consonant skeletons that only one word of the vocabulary has."""
    return lexicon.unique_by(vocabulary(spark, sf_dir).withColumn("skeleton", lexicon.skeleton(F.col("word"))), "skeleton", "word")


@query(f"WITH s AS (SELECT regexp_replace(word, '[aeiou]', '', 'g') AS k, min(word) AS w FROM ({_VOCAB}) GROUP BY 1 HAVING count(*) = 1) SELECT d.word AS slug, s.w AS word FROM (SELECT DISTINCT regexp_replace(word, '[aeiou]', '', 'g') AS word FROM ({_DISTINCT})) d JOIN s ON d.word = s.k")
def skeleton_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words stripped of their signs, as file names carry them, found again by their skeleton."""
    slugs = corpus_words(spark, sf_dir).select(lexicon.skeleton(F.col("word")).alias("slug")).distinct()
    unique = lexicon.unique_by(vocabulary(spark, sf_dir).withColumn("slug", lexicon.skeleton(F.col("word"))), "slug", "word")
    return slugs.join(unique, "slug")


_LANG_WORDS = f"SELECT lang, word, count(*) AS n FROM ({_WORDS}) GROUP BY lang, word"
_BG = "unnest(list_transform(range(1, length(word) + 2), lambda i: substr('^' || word || '$', i, 2)))"


@query(f"SELECT lang, bg, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lang, n, {_BG} AS bg FROM ({_LANG_WORDS})) GROUP BY lang, bg")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_words(spark, sf_dir).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return rows.select("lang", F.explode(detector.bigrams(F.col("word"))).alias("bg"), "n").groupBy("lang", "bg").agg(F.sum("n").alias("n"))


def _model_sql(a: str, b: str) -> str:
    count = lambda x: f"SELECT bg, sum(n) AS n FROM (SELECT n, {_BG} AS bg FROM ({_LANG_WORDS}) WHERE lang = '{x}') GROUP BY bg"
    return f"""SELECT bg, CAST(round(100 * (ln((a + 0.5) / (sa + 0.5 * k)) - ln((b + 0.5) / (sb + 0.5 * k)))) AS BIGINT) AS w_centi FROM (
      SELECT *, CAST(sum(a) OVER (PARTITION BY substr(bg, 1, 1)) AS DOUBLE) AS sa, CAST(sum(b) OVER (PARTITION BY substr(bg, 1, 1)) AS DOUBLE) AS sb, (SELECT count(DISTINCT substr(bg, 2, 1)) FROM (SELECT {_BG} AS bg FROM ({_LANG_WORDS}) WHERE lang IN ('{a}', '{b}'))) AS k
      FROM (SELECT coalesce(x.bg, y.bg) AS bg, CAST(coalesce(x.n, 0) AS DOUBLE) AS a, CAST(coalesce(y.n, 0) AS DOUBLE) AS b FROM ({count(a)}) x FULL JOIN ({count(b)}) y ON x.bg = y.bg)
    ) WHERE abs(CAST(round(100 * (ln((a + 0.5) / (sa + 0.5 * k)) - ln((b + 0.5) / (sb + 0.5 * k)))) AS BIGINT)) > 5"""


def model(spark: SparkSession, sf_dir: str, a: str = "de", b: str = "en") -> DataFrame:
    """A bigram model of one language against another: here German plays the legacy text, English the plain one."""
    rows = doc_words(spark, sf_dir).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return staged(detector.train_bigrams(rows.where(F.col("lang") == a), rows.where(F.col("lang") == b)), "bigram-model")  # as many rows as there are bigrams


@query(_model_sql("de", "en"))
def bigram_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model(spark, sf_dir)


_TOKENS = r"SELECT DISTINCT unnest(regexp_extract_all(text, '[^\s\x{A0}\x{85}\x{2000}-\x{200A}\x{3000}]+')) AS word FROM documents"
_EDGE = quoted(tx.DETECTOR_EDGE)
_ENGLISH = f"SELECT word, length(word) <= 3 AS common FROM ({_VOCAB})"
_SCORE = f"""WITH m AS ({_model_sql('de', 'en')}), t AS (SELECT word AS token, trim(word, {_EDGE}) AS word FROM ({_TOKENS})), e AS ({_ENGLISH}),
b AS (SELECT token, word, {_BG} AS bg FROM t), s AS (SELECT token, word, CAST(sum(coalesce(w_centi, 0)) AS BIGINT) AS s FROM b LEFT JOIN m USING (bg) GROUP BY token, word)
SELECT token AS word, CASE WHEN NOT regexp_matches(s.word, '[A-Za-zÀ-ÿ]') THEN 0 WHEN regexp_matches(token, {quoted(tx.URLISH)}) THEN -2000 ELSE s + 400 * least(3, len(regexp_extract_all(regexp_replace(s.word, {quoted(tx.PAIRED)}, ' ', 'g'), {quoted(tx.SIGNATURE)}))) -
  CASE WHEN e.common THEN 1200 WHEN e.common IS NOT NULL AND length(s.word) >= 3 THEN 600 ELSE 0 END END AS score, e.common IS NOT NULL AS english FROM s LEFT JOIN e ON e.word = lower(s.word)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select(F.explode(tx.words(F.col("text"))).alias("word")).distinct()
    return detector.score_words(tokens, model(spark, sf_dir), vocabulary(spark, sf_dir).withColumn("common", F.char_length("word") <= 3))


@query(_SCORE)
def word_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every distinct token, in whole hundredths."""
    return scores(spark, sf_dir)


_CODE = " + ".join(f"CAST(coalesce(regexp_matches(text, {quoted(p)}), false) AS BIGINT)" for p in tx.CODE_KINDS.values())
_LINES = f"SELECT conv_id, turn, {_CODE} >= 2 AS is_code, unnest(regexp_extract_all(text, '\\s+|\\S+')) AS token, generate_subscripts(regexp_extract_all(text, '\\s+|\\S+'), 1) - 1 AS pos FROM conversations"
_NEVER = f"is_code OR regexp_matches(token, {quoted(tx.URLISH)}) OR regexp_matches(token, {quoted(tx.PLAIN_NUMBER)}) OR regexp_matches(token, {quoted(tx.BARE_SIGN)})"
_SIG = f"len(regexp_extract_all(regexp_replace(token, {quoted(tx.PAIRED)}, ' ', 'g'), {quoted(tx.SIGNATURE)}))"
_DECIDE = f"""WITH sc AS ({_SCORE.replace('FROM documents', 'FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)', 99).replace("unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations)", "unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents")}),
l AS ({_LINES}), j AS (SELECT l.*, regexp_matches(token, '^\\s') AS is_space, coalesce(sc.score, 0) AS raw, coalesce(sc.english, false) AS english FROM l LEFT JOIN sc ON sc.word = l.token),
k AS (SELECT *, CASE WHEN raw >= 300 AND english AND {_SIG} = 0 THEN -100 ELSE raw END AS score FROM j),
v AS (SELECT *, count(*) FILTER (score >= 300) OVER w AS nl, count(*) FILTER (score <= -100) OVER w AS ne, count(*) FILTER (score >= 600) OVER w AS ns FROM k WINDOW w AS (PARTITION BY conv_id, turn)),
d AS (SELECT conv_id, turn, pos, token, is_space, score, CASE WHEN {_NEVER} THEN false WHEN is_space OR NOT regexp_matches(token, '[A-Za-z]') THEN false WHEN nl >= 2 AND nl >= 3 * ne OR ns >= 1 AND ne = 0 THEN score > -400 ELSE score >= 600 AND length(token) >= 4 END AS is_legacy FROM v)
"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations as lines, token by token, with score and verdict."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    tokens = tx.token_table(lines.withColumn("is_code", tx.code_signals(F.col("text")) >= 2))
    both = table(spark, sf_dir, "documents").select("text").unionByName(lines.select("text"))
    words = both.select(F.explode(tx.words(F.col("text"))).alias("word")).distinct()
    scored = staged(detector.score_words(words, model(spark, sf_dir), vocabulary(spark, sf_dir).withColumn("common", F.char_length("word") <= 3)), "word-scores")
    return detector.decide_lines(tokens, scored, ["conv_id", "turn"])


@query(_DECIDE + "SELECT conv_id, turn, count(*) FILTER (NOT is_space) AS n_tokens, count(*) FILTER (is_legacy) AS n_legacy, CAST(sum(score) AS BIGINT) AS score FROM d GROUP BY conv_id, turn")
def line_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tokens of each line are judged legacy."""
    rows = decided(spark, sf_dir)
    return rows.groupBy("conv_id", "turn").agg(F.sum((~F.col("is_space")).cast("long")).alias("n_tokens"), F.sum(F.col("is_legacy").cast("long")).alias("n_legacy"), F.sum("score").alias("score"))


_CONVERTED = f"nfc_normalize({sql_rules(sql_keys('t', key_table()), deva.WORD_RULES)})"


@query(_DECIDE + f""", b AS (SELECT conv_id, turn, pos, token, is_legacy OR is_space AND coalesce(lag(is_legacy) OVER w AND lead(is_legacy) OVER w, false) AS leg FROM d WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)),
c AS (SELECT *, leg IS DISTINCT FROM lag(leg) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS ch FROM b),
r AS (SELECT *, sum(CAST(ch AS INT)) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM c),
g AS (SELECT conv_id, turn, run, leg, string_agg(token, '' ORDER BY pos) AS t FROM r GROUP BY conv_id, turn, run, leg)
SELECT conv_id, turn, string_agg(CASE WHEN leg THEN {_CONVERTED} ELSE t END, '' ORDER BY run) AS text, count(*) FILTER (leg) AS n_legacy_runs FROM g GROUP BY conv_id, turn""")
def convert_mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with each maximal legacy run read as key text."""
    return detector.convert_mixed(decided(spark, sf_dir), ["conv_id", "turn"], deva.from_keys)


_FORCED = f"""SELECT conv_id, turn, CAST(count(*) FILTER (NOT is_space) AS BIGINT) AS n_tokens, CAST(count(*) FILTER (NOT is_space AND NOT regexp_matches(token, {quoted(tx.URLISH)}) AND NOT regexp_matches(token, {quoted(tx.BARE_SIGN)})
  AND NOT regexp_matches(trim(token, {_EDGE}), {quoted(tx.PLAIN_NUMBER)}) AND NOT (length(trim(token, {_EDGE})) >= 3 AND lower(trim(token, {_EDGE})) IN ({_VOCAB}))) AS BIGINT) AS n_legacy
FROM (SELECT *, regexp_matches(token, '^\\s') AS is_space FROM ({_LINES})) GROUP BY conv_id, turn"""


@query(_FORCED)
def force_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns taken as key text as a whole: how many of their tokens are legacy all the same."""
    tokens = tx.token_table(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    rows = detector.force_tokens(tokens, vocabulary(spark, sf_dir))
    return rows.groupBy("conv_id", "turn").agg(F.sum((~F.col("is_space")).cast("long")).alias("n_tokens"), F.sum(F.col("is_legacy").cast("long")).alias("n_legacy"))


@query(f"""WITH a AS ({_model_sql('de', 'en')}), f AS ({_model_sql('fr', 'en')}), w AS ({_DISTINCT}), b AS (SELECT word, {_BG} AS bg FROM w),
s AS (SELECT word, CAST(sum(coalesce(a.w_centi, 0)) AS BIGINT) AS de, CAST(sum(coalesce(f.w_centi, 0)) AS BIGINT) AS fr FROM b LEFT JOIN a USING (bg) LEFT JOIN f USING (bg) GROUP BY word)
SELECT doc_id, CAST(sum(de) AS BIGINT) AS de, CAST(sum(fr) AS BIGINT) AS fr, CASE WHEN sum(fr) > sum(de) + 600 THEN 'fr' ELSE 'de' END AS winner FROM ({_WORDS}) JOIN s USING (word) GROUP BY doc_id""")
def guess_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under two models; the second one wins only by more than six points."""
    words = corpus_words(spark, sf_dir)
    each = words.select("word", F.explode(detector.bigrams(F.col("word"))).alias("bg"))
    a, f = (model(spark, sf_dir, x).withColumnRenamed("w_centi", x) for x in ("de", "fr"))
    s = each.join(a, "bg", "left").join(f, "bg", "left").groupBy("word").agg(*[F.sum(F.coalesce(x, F.lit(0))).alias(x) for x in ("de", "fr")])
    rows = doc_words(spark, sf_dir).join(s, "word").groupBy("doc_id").agg(*[F.sum(F.col(x) * F.col("n")).alias(x) for x in ("de", "fr")])
    return rows.withColumn("winner", F.when(F.col("fr") > F.col("de") + 600, "fr").otherwise("de"))


_EVIDENCE = [("the", "en", 2), ("and", "en", 1), ("of", "en", 1), ("der", "de", 2), ("und", "de", 2), ("die", "de", 1), ("que", "es", 1), ("los", "es", 2), ("el", "es", 1), ("les", "fr", 2), ("et", "fr", 1), ("des", "fr", 1)]
_EVIDENCE_SQL = "VALUES " + ", ".join(f"('{w}', '{la}', {n})" for w, la, n in _EVIDENCE)


@query(f"""SELECT doc_id, s AS evidence, CASE WHEN s IS NULL THEN NULL ELSE tag END AS tag FROM (SELECT d.doc_id, e.lang AS tag, CAST(sum(weight) AS BIGINT) AS s, row_number() OVER (PARTITION BY d.doc_id ORDER BY sum(weight) DESC, e.lang) AS r
  FROM ({_WORDS}) d JOIN ({_EVIDENCE_SQL}) e (word, lang, weight) USING (word) GROUP BY d.doc_id, e.lang) WHERE r = 1""")
def lang_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of a document by weighted evidence words; ties go to the first by name."""
    ev = spark.createDataFrame(_EVIDENCE, "word string, tag string, weight int")
    rows = doc_words(spark, sf_dir).join(F.broadcast(ev), "word").groupBy("doc_id", "tag").agg(F.sum(F.col("weight") * F.col("n")).alias("evidence"))  # a fixed list
    best = rows.groupBy("doc_id").agg(F.min(F.struct((-F.col("evidence")).alias("e"), "tag")).alias("m"))
    return best.select("doc_id", (-F.col("m.e")).alias("evidence"), F.col("m.tag").alias("tag"))


@query(f"""WITH b AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) GROUP BY word),
d AS (SELECT doc_id, word, count(*) AS n FROM ({_WORDS}) GROUP BY doc_id, word)
SELECT doc_id, CAST(sum(least(d.n, coalesce(b.n, 0))) AS BIGINT) AS hits, CAST(sum(d.n) AS BIGINT) AS size FROM d LEFT JOIN b USING (word) GROUP BY doc_id""")
def word_bag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset overlap of each document's words with those of the benchmark."""
    b = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).groupBy("word").agg(F.count("*").alias("m"))
    rows = doc_words(spark, sf_dir).join(b, "word", "left")
    return rows.groupBy("doc_id").agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("hits"), F.sum("n").alias("size"))


_FAULTS = {"half_before_sign": f"्[{deva.SIGN}]", "sign_before_half": f"[{deva.SIGN}]्", "sign_twice": f"[{deva.MATRA}][{deva.MATRA}]", "nasal_before_sign": f"[ँं][{deva.MATRA}]", "virama_twice": "््", "sign_first": f"^[{deva.SIGN}]", "letter_and_sign": f"[अआए][{deva.MATRA}]"}
_FAULT_SQL = " UNION ALL ".join(f"SELECT '{k}' AS fault, CAST(len(regexp_extract_all(b, {quoted(p)})) AS BIGINT) AS n, b FROM ({_BROKEN_SQL})" for k, p in _FAULTS.items())


@query(f"SELECT fault, CAST(sum(n) AS BIGINT) AS n, min(b) AS example FROM ({_FAULT_SQL}) WHERE n > 0 GROUP BY fault")
def fault_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each impossible sequence occurs, with an example."""
    each = F.array(*[F.struct(F.lit(k).alias("fault"), tx.count_of(F.col("b"), p).alias("n")) for k, p in _FAULTS.items()])
    rows = broken_words(spark, sf_dir).select("b", F.explode(each).alias("f")).select("b", "f.*").where("n > 0")
    return rows.groupBy("fault").agg(F.sum("n").alias("n"), F.min("b").alias("example"))


@query(f"""WITH c AS (SELECT nfc_normalize(b) AS a FROM ({_BROKEN_SQL})), r AS (SELECT a AS before, CASE WHEN regexp_matches(a, {quoted(deva.TYPED_FAULT)}) THEN nfc_normalize({sql_rules('a', deva.TYPED)}) ELSE a END AS after FROM c)
SELECT substr(before, 1, 2) AS before2, substr(after, 1, 2) AS after2, count(*) AS n, min(before) AS example FROM r WHERE before <> after GROUP BY 1, 2""")
def change_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the typed repair changes, counted by the first two characters before and after."""
    rows = broken_words(spark, sf_dir).select(deva.nfc(F.col("b")).alias("before"))
    rows = staged(rows, "typed-words")  # filters would take the rules that make a column into every use of it
    rows = staged(rows.where(deva.has_typed_fault(F.col("before"))).select("before", deva.nfc(deva.rewrite(F.col("before"), deva.TYPED)).alias("after")), "typed-repairs").where("before <> after")
    return rows.groupBy(F.substring("before", 1, 2).alias("before2"), F.substring("after", 1, 2).alias("after2")).agg(F.count("*").alias("n"), F.min("before").alias("example"))


_VARIANTS = [("a", "e"), ("i", "o")]
_SWAPPED = "unnest(list_filter(list_transform(range(1, length(word) + 1), lambda i: CASE WHEN contains('aeio', substr(word, i, 1)) THEN substr(word, 1, i - 1) || translate(substr(word, i, 1), 'aeio', 'eaoi') || substr(word, i + 1) END), lambda x: x IS NOT NULL))"


@query(f"SELECT word, min(fixed) AS fixed FROM (SELECT DISTINCT word, {_SWAPPED} AS fixed FROM ({_DISTINCT}) WHERE word NOT IN ({_VOCAB})) WHERE fixed IN ({_VOCAB}) GROUP BY word HAVING count(DISTINCT fixed) = 1")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown words that become a known one by exchanging one vowel, if there is only one."""
    return lexicon.candidates(corpus_words(spark, sf_dir).select("word"), lexicon.one_letter_variants(F.col("word"), _VARIANTS), vocabulary(spark, sf_dir))


_CUTS = f"SELECT word, substr(word, 1, i) AS a, substr(word, i + 1) AS b, i FROM (SELECT word, unnest(range(2, length(word) - 1)) AS i FROM ({_DISTINCT}) WHERE length(word) >= 4 AND word NOT IN ({_VOCAB}))"


@query(f"SELECT word, a, b FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY least(length(a), length(b)) DESC, length(a)) AS r FROM ({_CUTS}) WHERE a IN ({_VOCAB}) AND b IN ({_VOCAB})) WHERE r = 1")
def split_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown words that are two known ones stuck together."""
    return lexicon.split_in_two(corpus_words(spark, sf_dir).select("word"), vocabulary(spark, sf_dir))


_TWICE = " UNION ".join(f"SELECT word, substr(word, 1, i + {n - 1}) || substr(word, i + {2 * n}) AS fixed FROM (SELECT word, unnest(range(1, length(word) - {2 * n - 2})) AS i FROM u WHERE length(word) >= {2 * n}) WHERE substr(word, i, {n}) = substr(word, i + {n}, {n})" for n in (4, 3, 2, 1))


@query(f"WITH u AS (SELECT word FROM ({_DISTINCT}) WHERE word NOT IN ({_VOCAB})) SELECT word, min(fixed) AS fixed FROM ({_TWICE}) WHERE fixed IN ({_VOCAB}) GROUP BY word HAVING count(DISTINCT fixed) = 1")
def repeated_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown words that become a known one when a piece that stands twice is kept once."""
    return lexicon.candidates(corpus_words(spark, sf_dir).select("word"), lexicon.without_repeats(F.col("word")), vocabulary(spark, sf_dir))


_CIPHER = f"SELECT DISTINCT replace(replace(word, 'th', 'q'), 'on', 'x') AS word FROM ({_DISTINCT})"


def cipher_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of documents with two planted substitutions."""
    return corpus_words(spark, sf_dir).select(F.replace(F.replace("word", F.lit("th"), F.lit("q")), F.lit("on"), F.lit("x")).alias("word")).distinct()


_TARGETS = ["th", "on", "er", "in", "an", "re"]
_TRIED = "SELECT word, src, dst, replace(word, src, dst) AS fixed FROM (SELECT word, unnest(list_distinct(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, greatest(1, length(word) - k + 1) + 1), lambda i: substr(word, i, k)))))) AS src FROM u), (SELECT unnest([" + ", ".join(map(quoted, _TARGETS)) + "]) AS dst)"


@query(f"WITH l AS (SELECT word FROM ({_DISTINCT})), u AS (SELECT word FROM ({_CIPHER}) WHERE word NOT IN (SELECT word FROM l)), g AS (SELECT src, dst, count(DISTINCT word) AS n FROM ({_TRIED}) WHERE fixed IN (SELECT word FROM l) GROUP BY src, dst) SELECT src, dst, n FROM g ORDER BY n DESC, src, dst LIMIT 1")
def swap_learning_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The substitution that makes most unknown words known."""
    return learning.best_swap(cipher_words(spark, sf_dir), corpus_words(spark, sf_dir), _TARGETS, 5)


@query()
def swap_learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All substitutions that greedy rounds learn from words with planted ones."""
    return learning.learn_swaps(cipher_words(spark, sf_dir), corpus_words(spark, sf_dir), _TARGETS, longest=5)


@query()
def segment_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all lines of documents, cut in pieces and grouped again by the dictionary."""
    pieces = lambda w: F.when(F.char_length(w) >= 6, F.array(F.substring(w, 1, 3), F.substring(w, F.lit(4), F.char_length(w)))).otherwise(F.array(w))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.lower("text"), "\n")).alias("line", "t"))
    lines = lines.select("doc_id", "line", F.regexp_extract_all("t", F.lit("[a-z]+"), 0).alias("words")).where(F.size("words") > 0)
    lines = lines.select("doc_id", "line", F.flatten(F.transform("words", pieces)).alias("pieces"))
    return learning.group_pieces(lines, vocabulary(spark, sf_dir), ["doc_id", "line"])


_ENDINGS = ["ing", "ed", "er", "ly", "s", "n"]
_STRIP = " UNION ".join(["SELECT word, stem FROM s{k}", *[f"SELECT word, left(stem, length(stem) - {len(e)}) FROM s{{k}} WHERE ends_with(stem, {quoted(e)}) AND length(stem) - {len(e)} >= 2" for e in _ENDINGS]])


@query(f"""WITH v AS ({_VOCAB}), s0 AS (SELECT word, word AS stem FROM ({_DISTINCT})), s1 AS ({_STRIP.format(k=0)}), s2 AS ({_STRIP.format(k=1)}),
c AS (SELECT word, substr(stem, 1, i) AS a, substr(stem, i + 1) AS b FROM (SELECT word, stem, unnest(range(2, length(stem) - 1)) AS i FROM s2 WHERE length(stem) >= 4)),
f AS (SELECT word, CASE WHEN stem = word THEN 0 ELSE 1 END AS n FROM s2 WHERE stem IN (SELECT word FROM v) UNION SELECT word, 2 FROM c WHERE a IN (SELECT word FROM v) AND b IN (SELECT word FROM v))
SELECT word, CASE min(n) WHEN 0 THEN 'word' WHEN 1 THEN 'ending' ELSE 'compound' END AS how FROM f GROUP BY word""")
def known_with_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that the vocabulary has, with endings or as a compound."""
    return lexicon.known_with_endings(corpus_words(spark, sf_dir).select("word"), vocabulary(spark, sf_dir), _ENDINGS)


_GARBLED = "translate(word, 'aegs', 'oica')"


@query(f"WITH p AS (SELECT {_GARBLED} AS shown, word AS real, n FROM ({_DISTINCT})) SELECT src, dst, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, substr(shown, i, 1) AS src, substr(real, i, 1) AS dst FROM (SELECT *, unnest(range(1, length(shown) + 1)) AS i FROM p)) WHERE src <> dst GROUP BY src, dst")
def confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which characters of garbled words stand for which, counted over all words of documents."""
    w = corpus_words(spark, sf_dir)
    return lexicon.confusions(w.select(F.translate("word", "aegs", "oica").alias("shown"), F.col("word").alias("real"), "n"))


_SWAPS = [("o", "a"), ("i", "e"), ("c", "g"), ("a", "s")]
_SWAP = " UNION ".join(f"SELECT word, substr(form, 1, i - 1) || '{b}' || substr(form, i + 1) AS form FROM (SELECT word, form, unnest(range(1, length(form) + 1)) AS i FROM o{{k}}) WHERE substr(form, i, 1) = '{a}'" for a, b in _SWAPS)
_ROUND = """g{n} AS (SELECT DISTINCT word, form FROM (""" + _SWAP + """) WHERE form <> word), h{n} AS (SELECT word, min(form) AS fixed, max(form) AS other FROM g{n} WHERE form IN (SELECT word FROM v) GROUP BY word), o{n} AS (SELECT * FROM g{n} WHERE word NOT IN (SELECT word FROM h{n}))"""


@query(f"""WITH v AS ({_VOCAB}), o0 AS (SELECT DISTINCT x AS word, x AS form FROM (SELECT {_GARBLED} AS x FROM ({_DISTINCT})) WHERE x NOT IN (SELECT word FROM v)),
{", ".join(_ROUND.format(n=k + 1, k=k) for k in range(3))} SELECT word, fixed FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3) WHERE fixed = other""")
def swap_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled words of documents, put right by at most three known confusions where the vocabulary leaves one reading."""
    w = corpus_words(spark, sf_dir).select(F.translate("word", "aegs", "oica").alias("word"))
    return lexicon.swap_fixes(w, vocabulary(spark, sf_dir), _SWAPS)
