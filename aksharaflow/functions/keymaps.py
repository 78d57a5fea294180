"""Key tables of legacy Devanagari fonts: which key draws what."""

from __future__ import annotations

#: Private-use markers for what a key draws out of logical order: the short i-sign, reph, and the stroke of the m key.
I_MARK, REPH_MARK, STROKE_MARK = "", "", ""
HALANT = "्"

# The Preeti layout, key by key.
PREETI = {
    "`": "ञ", "1": "ज्ञ", "2": "द्द", "3": "घ", "4": "द्ध", "5": "छ", "6": "ट", "7": "ठ", "8": "ड", "9": "ढ", "0": "ण्", "-": "(", "=": ".",
    "~": "ञ्", "!": "१", "@": "२", "#": "३", "$": "४", "%": "५", "^": "६", "&": "७", "*": "८", "(": "९", ")": "०", "_": ")", "+": "ं",
    "q": "त्र", "w": "ध", "e": "भ", "r": "च", "t": "त", "y": "थ", "u": "ग", "i": "ष्", "o": "य", "p": "उ", "[": "ृ", "]": "े", "\\": HALANT,
    "Q": "त्त", "W": "ध्", "E": "भ्", "R": "च्", "T": "त्", "Y": "थ्", "U": "ग्", "I": "क्ष्", "O": "इ", "P": "ए", "{": REPH_MARK, "}": "ै", "|": "्र",
    "a": "ब", "s": "क", "d": "म", "f": "ा", "g": "न", "h": "ज", "j": "व", "k": "प", "l": I_MARK, ";": "स", "'": "ु",
    "A": "ब्", "S": "क्", "D": "म्", "F": "ँ", "G": "न्", "H": "ज्", "J": "व्", "K": "प्", "L": "ी", ":": "स्", '"': "ू",
    "z": "श", "x": "ह", "c": "अ", "v": "ख", "b": "द", "n": "ल", "m": STROKE_MARK, ",": ",", ".": "।", "/": "र",
    "Z": "श्", "X": "ह्", "C": "ऋ", "V": "ख्", "B": "द्य", "N": "ल्", "M": "ः", "<": "?", ">": "श्र", "?": "रु",
    "¡": "ज्ञ्", "¢": "द्घ", "£": "घ्", "¤": "झ्", "¥": "र्‍", "§": "ट्ट", "ª": "ङ", "«": "्र", "°": "ङ्ढ", "±": "+", "´": "झ", "¶": "ठ्ठ", "¿": "रू",
    "Å": "हृ", "Æ": "”", "Ë": "ङ्ग", "Ì": "न्न", "Í": "ङ्क", "Î": "ङ्ख", "Ö": "=", "Ø": "्य", "Ù": ";", "Ú": "’", "Û": "!", "Ü": "%", "Ý": "ट्ठ", "ß": "द्म",
    "å": "द्व", "æ": "“", "ç": "ॐ", "÷": "/",
    "„": "ध्र", "…": "‘", "ˆ": "फ्", "‰": "झ्", "‹": "ङ्घ", "‘": "ॅ", "“": "ँ", "Œ": "त्त्", "•": "ड्ड", "˜": "ऽ", "›": "द्र", "©": "र", "¬": "ु", "·": "ङ्ग", "Ò": "¨",
    "‚": ")", "ƒ": "द्र", "†": "!", "‡": "े", "Š": "र्", "™": "र", "œ": "त्र्", "\xa0": " ", "¨": "ङ्ग", "\xad": "(", "®": "+", "²": "२", "³": "३", "µ": "झ", "¸": "ड्ड", "¹": "१", "º": "फ्", "»": "",
    "Â": "र", "Ç": "फ्", "È": "ष", "É": "स", "Ê": "ष्", "Ï": "फ्", "Ñ": "ङ", "Ô": "क्ष", "Þ": "़", "è": "द्भ", "é": "ङ्ग", "ì": "त्त्", "í": "ष", "ñ": "ङ", "ø": "य्", "ú": "ू",
}

# The digit row that types Nepali digits, and letters with shift.
_DIGITS_FIRST = {"1": "१", "2": "२", "3": "३", "4": "४", "5": "५", "6": "६", "7": "७", "8": "८", "9": "९", "0": "०"}
_LETTERS_SHIFTED = {"!": "ज्ञ", "@": "द्द", "#": "घ", "$": "द्ध", "%": "छ", "^": "ट", "&": "ठ", "*": "ड", "(": "ढ", ")": "ण्"}
_HIMALI = {"X": "हृ", "¤": "ँ", "¥": "र्‍", "\xad": "(", "®": "+", "°": "ङ्क", "»": "", "Ñ": "ङ", "Ò": "ू", "Ô": "क्ष", "Ù": "ह", "Ú": "ु", "é": "ङ्ग", "í": "ष", "ø": "य्", "ú": "ू"}
# Where related layouts differ from Preeti.
DIFFERENCES = {
    "preeti": {},
    "kantipur": {
        "F": "ा", "X": "हृ", "†": "!", "‹": "ङ्ग", "Œ": "त्त्", "“": "ँ", "™": "र", "›": "ऽ", "œ": "त्र्", "¥": "र्‍", "¨": "ङ्ग", "¬": "…", "\xad": "(", "®": "र", "µ": "र", "º": "फ्",
        "Â": "र", "È": "ष", "Î": "फ्", "Ï": "फ्", "Ô": "क्ष", "ø": "य्",
    },
    "sagarmatha": {
        "‚": ")", "ƒ": "द्र", "„": HALANT, "†": ";", "‡": "े", "ˆ": "ृ", "Š": "र्", "‹": "ै", "Œ": "त्त्", "‘": "‘", "’": "’", "“": "ँ", "”": "”", "œ": "त्र्", "¤": "!", "¥": "र्‍", "¬": "ु",
        "\xad": "(", "®": "र", "°": "ङ्क", "µ": "झ", "·": "ङ्ग", "¸": "ड्ड", "Å": "फ", "Ç": "फ्", "È": "ष", "É": "स", "Ò": "ू", "Ô": "क्ष", "Ù": "ह", "Þ": "ह्", "è": "द्भ", "ø": "य्",
    },
    "himali": _HIMALI,
    "fontasy": _HIMALI | _DIGITS_FIRST | _LETTERS_SHIFTED | {"'": "ू", '"': "ु"},
    "himalaya": _DIGITS_FIRST | {"!": "ङ्ग", "\u0141": "ङ्ग", "\u0142": "त्", "\u0143": "ङ्ग"},
    "sumod": {"Ë": "ङ्क", "Í": "ङ्ग", "¶": "ट्ठ", "¤": "!", "‘": "‘", "∙": "ङ्ग", "ˆ": "", "„": "", "…": "", "¸": ""},
    "pcs": _DIGITS_FIRST | _LETTERS_SHIFTED | {
        "F": "ा", "C": "र्‍", "<": "्र", "?": "रू", "¤": "ँ", "¥": "ऋ", "©": "?", "ª": "ञ", "®": "+", "°": "ङ्क", "·": "ट्ठ", "¿": "रु", "Ò": "ू", "Ô": "क्ष", "Ù": "ह", "é": "ङ्ग", "í": "ष", "ñ": "ङ",
        "ø": "य्", "ú": "ू", "~": "ङ", "`": "ञ्",
    },
}

# Font-name patterns, in the order in which they are tried.
FONT_PATTERNS = [
    ("preeti", "preeti"), ("kantipur", "kantipur"), ("sagarmatha", "sagarmatha"), ("fontasy", "fontasy"), ("himalaya", "himalaya"), ("himal", "himali"),
    (r"pcs\s*nepali", "pcs"), ("sumod", "sumod"), (r"gorkhapatra|ganess|ganesh|himchuli|nayanepal|\bsun\b|acharya|kanchan|everest|jagadamba|rupa|shangrila", "preeti"), (r"kruti\s*dev|k010|kruti", "krutidev"),
]

# Half letters of the Kruti Dev layout; with k behind the key, the letter is whole.
KRUTI_HALVES = {
    "D": "क", "[": "ख", "X": "ग", "?": "घ", "P": "च", "T": "ज", ".": "ण", "R": "त", "F": "थ", "/": "ध", "U": "न", "I": "प", "C": "ब", "H": "भ", "E": "म", "Y": "ल", "O": "व", "'": "श", '"': "ष", "L": "स",
}
# Whole letters, signs and digits of the Kruti Dev layout. Longer keys come before those that they begin with.
KRUTI_WHOLE = [
    ("vks", "ओ"), ("vkS", "औ"), ("v‚", "ऑ"), ("vk", "आ"), ("v", "अ"), ("bZ", "ई"), ("Ã", "ई"), ("b", "इ"), ("m", "उ"), ("Å", "ऊ"), (",s", "ऐ"), (",", "ए"), ("_", "ऋ"), ("d", "क"), ("x", "ग"), ("Ä", "घ"), ("³", "ङ"), ("p", "च"), ("N", "छ"), ("t", "ज"), (">", "झ"), ("÷", "झ्"), ("¥", "ञ"),
    ("V", "ट"), ("B", "ठ"), ("M", "ड"), ("<", "ढ"), ("r", "त"), (")", "द्ध"), ("n", "द"), ("è", "ध"), ("u", "न"), ("i", "प"), ("Q", "फ"), ("¶", "फ्"), ("c", "ब"), ("e", "म"), (";", "य"), ("¸", "य्"), ("j", "र"), ("y", "ल"), ("G", "ळ"), ("o", "व"), ("l", "स"), ("g", "ह"), ("º", "ह्"),
    ("{k", "क्ष"), ("{", "क्ष्"), ("=", "त्र"), ("«", "त्र्"), ("K", "ज्ञ"), ("J", "श्र"), ("#", "रु"), (":", "रू"), ("|", "द्य"), ("}", "द्व"), ("Ø", "क्र"), ("Ý", "फ्र"), ("æ", "द्र"), ("ç", "प्र"), ("Á", "प्र"), ("ä", "क्त"), ("Ùk", "त्त"), ("Ù", "त्त्"), ("é", "न्न"), ("ô", "क्क"), ("í", "द्द"), ("ê", "ट्ट"), ("ë", "ट्ठ"), ("ì", "ड्ड"), ("ï", "ड्ढ"),
    ("à", "ह्न"), ("á", "ह्य"), ("â", "हृ"), ("ã", "ह्म"), ("–", "दृ"), ("—", "कृ"), ("Ñ", "कृ"), ("Ò", "भ"), ("Ó", "्य"), ("Ük", "श"), ("Ü", "श्"), ("ª", "्र"), ("z", "्र"), ("‚", "ॉ"), ("ks", "ो"), ("kS", "ौ"), ("¡k", "ाँ"), ("ak", "kं"), ("k", "ा"), ("È", "ीं"), ("h", "ी"), ("q", "ु"), ("w", "ू"), ("`", "ृ"), ("as", "ें"), ("s", "े"), ("aS", "ैं"), ("S", "ै"), ("a", "ं"), ("¡", "ँ"),
    ("%", ":"), ("W", "ॅ"), ("•", "ऽ"), ("·", "ऽ"), ("~", HALANT), ("+", "़"), ("^", "‘"), ("*", "’"), ("Þ", "“"), ("ß", "”"), ("(", ";"), ("¼", "("), ("½", ")"), ("A", "।"), ("-", "."), ("&", "-"), ("]", ","), ("@", "/"),
    ("å", "०"), ("ƒ", "१"), ("„", "२"), ("…", "३"), ("†", "४"), ("‡", "५"), ("ˆ", "६"), ("‰", "७"), ("Š", "८"), ("‹", "९"),
]
#: Keys that others begin with: they are replaced before all others.
KRUTI_FIRST = ("vks", "vkS", "v‚", "vk", "bZ", ",s", "{k", "Ùk", "Ük", "¡k", "as", "aS")


def key_table(encoding: str = "preeti") -> dict[str, str]:
    """What each key of a Preeti-family layout draws."""
    return PREETI | DIFFERENCES[encoding]


def kruti_rules() -> list[tuple[str, str]]:
    """Ordered replacements of the Kruti Dev layout: half letters followed by k, half letters, then the rest."""
    whole = [(f"{k}k", v) for k, v in KRUTI_HALVES.items()]
    half = [(k, v + HALANT) for k, v in KRUTI_HALVES.items()]
    return [r for r in KRUTI_WHOLE if r[0] in KRUTI_FIRST] + whole + half + [r for r in KRUTI_WHOLE if r[0] not in KRUTI_FIRST]


def to_preeti_keys(encoding: str) -> dict[str, str]:
    """Keys of a layout whose letter another key draws in Preeti, with that key; keys without a glyph give nothing."""
    of: dict[str, str] = {}
    for key, drawn in PREETI.items():
        of.setdefault(drawn, key)
    return {k: of.get(v, k) if v else "" for k, v in key_table(encoding).items() if PREETI.get(k) != v}
