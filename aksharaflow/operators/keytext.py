"""Key text and typed text where a lexicon has to prove a reading: candidates are columns, the proof is a join."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import devanagari as deva
from ..functions.keymaps import HALANT, key_table, to_preeti_keys
from ..functions.staging import staged
from ..functions.text import DIGIT_ROW, PLAIN_NUMBER, REPAIR_EDGE, SPACES, is_bare_sign
from .pieces import exchanged_lists

# What the key ¿ draws in one font or another, most frequent first.
UNSURE_KEY, UNSURE = "¿", ("रू", "रु", "ु", "ू")
#: The order of rules without the last, which decides what a sign behind a half letter means.
_AS_TYPED = deva.WORD_RULES[: -len(deva.AFTER_HALF)]


def readings(keys: Column, encoding: str = "preeti") -> Column:
    """The readings of key text, the likeliest first: a sign behind a half letter stands under the whole conjunct, or the
    half letter is a whole one; ट and ड with the ृ key are doubled; the unsure key draws one sign or another."""
    table, out = key_table(encoding), []
    for drawn in UNSURE:
        typed = deva.nfc(deva.rewrite(deva.map_keys(keys, table | {UNSURE_KEY: drawn}), _AS_TYPED))
        own = F.regexp_replace(typed, f"{HALANT}([{deva.MATRA}{deva.MODIFIER}])", "$1")
        each = [deva.rewrite(typed, deva.AFTER_HALF), own, F.regexp_replace(typed, "([टड])ृ", f"$1{HALANT}$1")]
        out += each if not out else [F.when(F.contains(keys, F.lit(UNSURE_KEY)), c) for c in each]
    return F.array_distinct(F.array_compact(F.array(*out)))


def first_known(words: DataFrame, cands: Column, lexicon: DataFrame, name: str) -> DataFrame:
    """words (distinct, a column word) with name: the first candidate that the lexicon has without the punctuation around
    it, else the first one. A word gives a row for each of its few candidates, and the lexicon is joined once."""
    each = words.select("word", F.posexplode(cands).alias("pos", "c")).withColumn("core", F.btrim("c", F.lit(REPAIR_EDGE)))
    known = lexicon.select(F.col("word").alias("core"), F.lit(0).alias("unknown")).dropDuplicates(["core"])
    each = each.join(known, "core", "left")
    best = each.groupBy("word").agg(F.min(F.struct(F.coalesce("unknown", F.lit(1)).alias("u"), "pos", "c")).alias("b"))
    return best.select("word", F.col("b.c").alias(name))


def convert_proved(words: DataFrame, lexicon: DataFrame, encoding: str = "preeti") -> DataFrame:
    """word, converted: distinct key words as Unicode text, with the reading that the lexicon proves."""
    return first_known(words, readings(F.col("word"), encoding), lexicon, "converted")


def repair_proved(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, repaired: distinct typed words with impossible sequences set right; a vowel sign typed twice is a nasal sign
    where the lexicon proves it."""
    c = F.col("word")
    nasal = deva.repair_typed(deva.rewrite(c, deva.NASAL_AA))
    return first_known(words, F.array_distinct(F.when(c.rlike("ा{2,}|आा"), F.array(nasal, deva.repair_typed(c))).otherwise(F.array(deva.repair_typed(c)))), lexicon, "proved").join(
        words.select("word", deva.repair_typed(c).alias("plain")), "word"
    ).join(lexicon.select(F.col("word").alias("proved"), F.lit(True).alias("known")).dropDuplicates(["proved"]), "proved", "left").select("word", F.when(F.col("known"), F.col("proved")).otherwise(F.col("plain")).alias("repaired"))


def as_preeti_keys(keys: Column, encoding: str) -> Column:
    """Keys of another layout as the Preeti keys that draw the same letters; keys without a glyph are left out."""
    table = to_preeti_keys(encoding)
    one = {k: v for k, v in table.items() if v}
    return F.translate(keys, "".join(one) + "".join(k for k, v in table.items() if not v), "".join(one.values()))


# Named character references, and what they stand for; the ampersand comes last.
ENTITIES = {"&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
_DIGIT = "[०-९]"
#: What lines of key text need after their words: a quotation mark that drew a sign on nothing, the colon of a time, a zero
#: behind a decimal point, and the point of an amount.
LINE_RULES: deva.Rules = [
    ("(^|[^ऀ-ॿ])ॅ", "$1‘"), (f"({_DIGIT}){key_table()[':']}({_DIGIT})", "$1:$2"), (f"({_DIGIT}\\.)\\)", "$1०"),
    ("([०-९0-9]+,[०-९0-9]+)।([०-९0-9]+)", "$1.$2"), ("((?:रु\\.?|Rs\\.?)\\s*[०-९0-9]+)।([०-९0-9]+)", "$1.$2"),
]


def unescaped(c: Column) -> Column:
    """Named character references as their characters, once: what a reference makes isn't read again."""
    for name, sign in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def _token_text(encoding: str) -> Column:
    """A token of key text as Unicode text. Brackets around something else than brackets are real, as are those beside other
    signs; a bracket alone is a digit between two words in keys. Bullets, numbers in plain digits (but not the key 5 alone)
    and tokens with Devanagari stay."""
    token = F.col("token")
    wordy = lambda c: F.coalesce(c.rlike("[A-Za-z;:'\\[\\]{}|]"), F.lit(False))
    stays = F.col("is_space") | is_bare_sign(token) & ~token.rlike(f"^[{DIGIT_ROW}]+$") | token.rlike("[ऀ-ॿ]") | token.rlike(PLAIN_NUMBER) & (token != "5") & ~token.rlike("[!@#$%^&*()]")
    enclosed = token.rlike(r"^\(.*[^()].*\)$")
    lone = token.isin("(", ")")
    inner = F.substring(token, F.lit(2), F.char_length(token) - 2)
    read = lambda c: deva.from_keys(c, encoding)
    return F.when(stays, token).when(lone, F.when(wordy(F.col("before")) & wordy(F.col("after")), read(token)).otherwise(token)).when(enclosed, F.concat(F.lit("("), read(inner), F.lit(")"))).otherwise(read(token))


#: Keys of brackets that stand between two words in keys; no token mixes white space with other signs.
_DIGITS = ("( ", ") ")
_KEY_WORD = re.compile("[A-Za-z;:'\\[\\]{}|]")
_TOKEN = re.compile(f"[{SPACES}]+|[^{SPACES}]+")


def _keyed(text: str) -> tuple[list[str], list[str]]:
    """The tokens of a line, and their keys, which say of a bracket alone whether it is a digit. Where there is none, they are one list."""
    ts = _TOKEN.findall(text)
    if "(" not in ts and ")" not in ts:
        return ts, ts
    word = lambda i: 0 <= i < len(ts) and _KEY_WORD.search(ts[i])
    return ts, [t + " " if t in ("(", ")") and word(i - 2) and word(i + 2) else t for i, t in enumerate(ts)]


def convert_lines(lines: DataFrame, lexicon: DataFrame, encoding: str = "preeti") -> DataFrame:
    """lines (doc_id, item, text) of key text as Unicode text: character references first, then distinct tokens (_token_text), then
    rules that need the line (LINE_RULES), last a visarga at a word's end, which is a colon if the lexicon (word) has the word
    without it and not with it. Null texts stay null; white space is kept."""
    plain = staged(lines.select("doc_id", "item", unescaped(F.col("text")).alias("text")), "plain-lines")  # read three times
    wordy = F.when(F.col("key").isin(*_DIGITS), "a")  # any letter will do

    def made(keys: DataFrame) -> DataFrame:
        rows = keys.withColumns({"token": F.when(F.col("key").isin(*_DIGITS), F.left("key", F.lit(1))).otherwise(F.col("key")), "before": wordy, "after": wordy})
        return rows.withColumn("is_space", F.col("token").rlike(r"(?U)^\s")).select("key", _token_text(encoding).alias("made"))

    found = exchanged_lists(plain, _keyed, made).withColumn("text", deva.rewrite(F.col("text"), LINE_RULES))
    return final_colons(staged(found, "key-lines"), lexicon)  # read twice


def final_colons(lines: DataFrame, lexicon: DataFrame) -> DataFrame:
    """lines (doc_id, item, text) with a colon for the visarga at the end of words that the lexicon (word) has only without it. Lines
    without such a word aren't taken apart."""
    ends = "ः(?=[\\s,;)–—-]|$)"
    some = lines.where(F.col("text").rlike(ends))
    words = F.regexp_extract_all("text", F.lit(f"([ऀ-ॿ]+){ends}"), 1)
    each = some.select("doc_id", "item", F.explode(F.array_distinct(words)).alias("word"))
    lex = lexicon.select("word").distinct()
    alone = each.select("word").distinct().join(lex, "word", "left_semi")
    whole = lex.select(F.regexp_replace("word", "ः$", "").alias("word")).where(F.endswith(lex["word"], F.lit("ः")))
    colon = alone.join(whole, "word", "left_anti")
    swaps = each.join(colon, "word").groupBy("doc_id", "item").agg(F.collect_list("word").alias("colons"))
    pieces = F.regexp_extract_all("text", F.lit("[ऀ-ॿ]+|[^ऀ-ॿ]+"), 0)
    word = lambda p: F.regexp_replace(p, "ः$", "")
    text = F.array_join(F.transform(pieces, lambda p: F.when(F.endswith(p, F.lit("ः")) & F.array_contains("colons", word(p)), F.concat(word(p), F.lit(":"))).otherwise(p)), "")
    return lines.join(swaps, ["doc_id", "item"], "left").select("doc_id", "item", F.when(F.col("colons").isNull(), F.col("text")).otherwise(text).alias("text"))
