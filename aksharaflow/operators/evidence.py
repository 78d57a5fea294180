"""What the lines of a document say of it: Unicode text or not, gain by repair; and which file a window shows, by its title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import extracted, lexicon

#: Words in Devanagari from which on a document is Unicode text: so many and this share of all, or so many at any share.
FEW, SHARE, MANY = 5, 0.2, 15


def _words(lines: DataFrame) -> DataFrame:
    return lines.select("doc_id", F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''")


def unicode_documents(lines: DataFrame) -> DataFrame:
    """doc_id, words, devanagari, is_unicode: over all lines (doc_id, text) of a document, how many words it has, how many with letters of
    Devanagari, and whether these are enough for a text that needs no conversion."""
    letters = F.coalesce(F.col("word").rlike("[ऄ-हक़-ॡॲ-ॿ]"), F.lit(False))
    sums = _words(lines).groupBy("doc_id").agg(F.count("*").alias("words"), F.count_if(letters).alias("devanagari"))
    return sums.withColumn("is_unicode", (F.col("devanagari") >= FEW) & (F.col("devanagari") >= SHARE * F.col("words")) | (F.col("devanagari") >= MANY))


def repair_gain(lines: DataFrame, known_words: DataFrame) -> DataFrame:
    """doc_id, words, unknown_before, unknown_after: Devanagari words of lines (doc_id, item, text), and those that the lexicon (word) doesn't
    have as they stand and after a trial of the whole repair. Distinct words are looked up, once for both."""
    both = _words(lines).withColumn("after", F.lit(False)).unionByName(_words(extracted.repair_lines(lines, known_words)).withColumn("after", F.lit(True)))
    each = both.where(F.col("word").rlike("[ऀ-ॿ]")).groupBy("doc_id", "after", "word").agg(F.count("*").alias("n"))
    unknown = lambda after: F.coalesce(F.sum(F.when((F.col("after") == after) & ~F.col("known"), F.col("n"))), F.lit(0)).alias("unknown_after" if after else "unknown_before")
    return lexicon.known(each, known_words).groupBy("doc_id").agg(F.sum(F.when(~F.col("after"), F.col("n"))).alias("words"), unknown(False), unknown(True))


# Programs that put their names behind a window's title.
BROWSERS = ("Google Chrome", r"Microsoft\s*Edge", "Mozilla Firefox", "Chrome", "Edge", "Firefox", "Brave", "Opera", "Vivaldi", "Adobe Acrobat", "Acrobat Reader", "Adobe", "SumatraPDF", "Foxit")
_SUFFIX = rf"(?i)\s*-\s*({'|'.join(BROWSERS)}).*$"


def window_name(title: Column) -> Column:
    """A window's title without the viewer's name, in lower case."""
    return F.lower(F.trim(F.regexp_replace(title, _SUFFIX, "")))


def metadata_title(value: Column) -> Column:
    """The text of a title as a file's metadata has it: (literal) with octal and other escapes, or <hexadecimal>, either in UTF-16 where
    it begins with that mark, else in Latin-1; other values as they are. Broken hexadecimal is null."""
    inner = F.substring(value, F.lit(2), F.char_length(value) - 2)
    piece = lambda p: F.when(p.rlike(r"^\\[0-7]{1,3}$"), F.char(F.conv(F.substring(p, F.lit(2), F.lit(3)), 8, 10).cast("int") % 256)).when(p == "\\n", "\n").when(p == "\\t", "\t").when(p == "\\r", "\r").when(F.startswith(p, F.lit("\\")), F.substring(p, F.lit(2), F.lit(1))).otherwise(p)
    literal = F.array_join(F.transform(F.regexp_extract_all(inner, F.lit(r"\\[0-7]{1,3}|\\[\s\S]|[^\\]"), 0), piece), "")
    latin = literal.rlike(r"^[\x00-\xff]*$")
    raw = F.when(F.startswith(value, F.lit("<")), F.unhex(F.regexp_replace(inner, r"\s", ""))).when(latin, F.encode(literal, "ISO-8859-1"))
    wide = F.startswith(F.hex(raw), F.lit("FEFF"))
    read = F.when(wide, F.decode(F.substring(raw, 3, 1 << 30), "UTF-16BE")).otherwise(F.decode(raw, "ISO-8859-1"))
    return F.trim(F.when(value.rlike(r"^<[\s\S]*>$"), read).when(value.rlike(r"^\([\s\S]*\)$"), F.coalesce(read, literal)).otherwise(value))


def files_of_windows(windows: DataFrame, files: DataFrame) -> DataFrame:
    """window_id, path: the file (path, title: as metadata has it, changed: when) that a window (window_id, title) shows: the newest one
    whose name without its ending, or whose own title, is the window's. Names under three characters name nothing; a window
    that no file fits has no row. Windows and files meet on the name."""
    stem = F.lower(F.trim(F.regexp_replace(F.regexp_extract("path", r"[^/\\]*$", 0), r"\.[^.]*$", "")))
    named = files.select("path", "changed", F.explode(F.array(stem, F.lower(metadata_title(F.col("title"))))).alias("name"))
    newest = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("changed"), "path"))
    named = named.withColumn("r", newest).where("r = 1").drop("r")  # before windows meet it: as many of one name would meet each of these files
    met = windows.select("window_id", window_name(F.col("title")).alias("name")).where(F.char_length("name") >= 3).join(named, "name")
    first = F.row_number().over(Window.partitionBy("window_id").orderBy(F.desc("changed"), "path"))
    return met.withColumn("r", first).where("r = 1").select("window_id", "path")
