"""Column expressions over any text: tokens, cores, predicates, URL, Markdown and mojibake decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .devanagari import Rules, rewrite
from .keymaps import HALANT, I_MARK, REPH_MARK, key_table

# Punctuation around a token, for the detector and for the repair.
DETECTOR_EDGE = ".,!?()…"
REPAIR_EDGE = ".,;:!?()[]{}\"'“”‘’।–—-"
#: What programming code has, by kind; prose may well have one of them.
CODE_KINDS = {
    "comparison": r"[=!<>]=",
    "logic": r"&&|\|\|",
    "arrow": r"[-=]>",
    "step": r"\+\+|[-+*/]=",
    "call": r"\w\(\)",
    "block": r"[\w)]\s*\{\s*(?:\n|$)",
    "statement": r";\s*(?:\n|$)",
    "assignment": r"\w = \S",
    "tag": r"</[A-Za-z]|/>",
    "definition": r"\b(?:def|function|class|struct|interface|enum)\s+\w+\s*[({:]",
    "declaration": r"\b(?:var|let|const|int|float|bool|char|void|static)\s+\w+\s*[=;(]",
    "import": r"(?:^|\n)\s*(?:import|using|package|#include)\s+\S",
    "branch": r"\b(?:if|for|while|switch|catch)\s*\(",
    "result": r"\breturn\b[^.\n]*;",
    "value": r"\b(?:null|None|nil|undefined|true|false)\s*[;,)}\]]",
}
#: Forms of an address or a file name, of which a token has to have one as a whole.
URL_FORMS = (
    r"^[a-z][a-z0-9+.-]*://", r"^www\.", r"^[^@\s]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+$", r"^(?:[a-z0-9-]+\.)+(?:com|edu|gov|in|info|io|net|np|org)(?::[0-9]+)?(?:[/?#].*)?$",
    r"^[\w-]+(?:\.[\w-]+)*\.(?:csv|dll|docx?|exe|html?|js|pdf|pptx?|py|txt|xlsx?|zip)$",
)
URLISH = "(?i)" + "|".join(f"(?:{x})" for x in URL_FORMS)


def _signature() -> str:
    """A key that draws a letter before one that draws a sign alone and is no letter on the keyboard: in other text such a
    pair stands in brackets or is an apostrophe, which PAIRED leaves out."""
    marks = {I_MARK, REPH_MARK, HALANT, *map(chr, [*range(0x900, 0x904), *range(0x93E, 0x94D)])}
    signs = [k for k, v in key_table().items() if k.isascii() and not k.isalnum() and (v in marks or v.startswith(HALANT))]
    open_ = "".join("\\" + k for k in signs if k not in "'\"+")  # a plus is at home in other text
    letter = "[A-Za-z;:/]"
    return f"{letter}[{open_}]|{letter}['\"]{letter}{{2}}"


SIGNATURE = _signature()
#: What looks like a signature in other text: brackets that close, and the apostrophe of English short forms.
PAIRED = r"\[[^\[\]]*\]|\{[^{}]*\}|\|[^|]*\||'(?i:ll|re|ve|em|til)\b"
# The digit row with shift, which types digits in the Preeti layout, and what may stand between digits.
DIGIT_ROW, SEPARATORS = "!@#$%^&*()", ".,/:=÷–—-"
#: Key text of a number: signs of the row and separators, perhaps in brackets, behind the currency keys, or with a suffix in letters.
SYMBOL_NUMBER = r"^[(\[]?(?:\?=)?[!@#$%^&*()0-9.,/:=÷–—-]+(?:[A-Za-z]+)?[)\]]?$"
PLAIN_NUMBER = r"^[$€₹#№]?[0-9]+(?:[.,/:-][0-9]+)*[%°]?$"
MARKDOWN: Rules = [
    (r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"```", ""), (r"`([^`]*)`", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"__([^_]+)__", "$1"),
    (r"\*([^*\n]+)\*", "$1"), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^>\s?", ""),
]
#: The 27 characters of Windows-1252 that aren't those of Latin-1, by their bytes from 0x80 on.
WINDOWS_1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"

#: White space of Unicode.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def tokens(c: Column) -> Column:
    """White-space and other tokens by turns; their concatenation is the text."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\s+|\S+"), 0)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\S+"), 0)


def core(c: Column, edge: str = DETECTOR_EDGE) -> Column:
    return F.btrim(c, F.lit(edge))


def token_table(lines: DataFrame, text: str = "text") -> DataFrame:
    """A row per token: the other columns, pos, token, is_space."""
    rest = [c for c in lines.columns if c != text]
    return lines.select(*rest, F.posexplode(tokens(F.col(text))).alias("pos", "token")).withColumn("is_space", F.col("token").rlike(r"(?U)^\s"))


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def code_signals(c: Column) -> Column:
    """How many kinds of signs of programming code a text has; two or more mean code."""
    return sum((F.coalesce(c.rlike(p), F.lit(False)).cast("long") for p in CODE_KINDS.values()), F.lit(0).cast("long"))


def is_symbol_number(c: Column) -> Column:
    """A number typed on the shifted digit row. It has at least two different characters, at least one of the row inside its
    brackets, one besides brackets where it has letters, and isn't a number as it stands; ?= alone is the currency sign."""
    inner = F.when(c.rlike(r"^\(.*\)$|^\[.*\]$"), F.substring(c, F.lit(2), F.char_length(c) - 2)).otherwise(c)
    typed = inner.rlike("[!@#$%^&*()]") | inner.startswith("?=")
    lettered = c.rlike("[A-Za-z]") & ~inner.rlike("[!@#$%^&*]")
    several = F.size(F.array_distinct(F.split(c, ""))) > 1
    one = c.rlike(r"^\([^!@#$%^&*()]\)$")
    return (c == "?=") | (c.rlike(SYMBOL_NUMBER) & ~c.rlike(PLAIN_NUMBER) & typed & ~lettered & several & ~one)


# Bullets and arrows that stand alone in text of any kind.
BULLETS = "•●○■▪◦✓★→←–—…*+#~※♦►-"
#: A token of signs alone that no layout draws letters with: bullets, arrows, symbols, pictures.
BARE_SIGN = f"^[\u2190-\u2bff\ufe0f\U0001f300-\U0001faff{BULLETS}]+$"


def is_bare_sign(c: Column) -> Column:
    return c.rlike(BARE_SIGN)


def signature_hits(c: Column) -> Column:
    return F.least(count_of(F.regexp_replace(c, PAIRED, " "), SIGNATURE), F.lit(3)).cast("long")


def decode_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Windows-1252, read anew; text that isn't such stays."""
    raw = F.translate(c, WINDOWS_1252, _BYTES)
    again = F.encode(raw, "ISO-8859-1")
    fits = raw.rlike(r"^[\x00-\xff]*$")
    return F.when(fits & F.is_valid_utf8(F.when(fits, again).cast("string")), F.decode(F.when(fits, again), "UTF-8")).otherwise(c)


def decode_url(c: Column) -> Column:
    """Percent-escapes decoded; a plus stays, and so does text whose escapes are broken."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def strip_markdown(c: Column) -> Column:
    return F.trim(rewrite(c, MARKDOWN))


def version_parts(c: Column) -> Column:
    """The first three numbers of a version as integers, missing ones 0."""
    part = lambda n: F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit(r"(\d+)"), 1), F.lit(n)).cast("int"), F.lit(0))
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))


def mostly_lower(c: Column) -> Column:
    """Less than half of the ASCII letters are upper case."""
    return 2 * count_of(c, "[A-Z]") < count_of(c, "[A-Za-z]")
