import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aksharaflow.functions import devanagari as deva
from aksharaflow.functions import text as tx
from aksharaflow.functions.keymaps import PREETI


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize(("keys", "want"), [("g]kfn", "नेपाल"), ("s]", "के"), ("ljZj", "विश्व"), ("sd{", "कर्म"), ("lstfa", "किताब"), ("kmn", "फल"), ("cfdf", "आमा"), ("!@#", "१२३")])
def test_preeti_words(spark, keys, want):
    assert column(spark, [keys], deva.from_keys) == [want]


def test_kruti_words(spark):
    assert column(spark, ["fdrkc", "deZ"], lambda c: deva.from_keys(c, "krutidev")) == ["किताब", "कर्म"]


def test_key_tables_are_single_keys():
    assert all(len(k) == 1 for k in PREETI)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=[chr(c) for c in range(0x900, 0x980) if not 0x951 <= c <= 0x954], max_size=12))
def test_normal_form_rules(text):
    assert deva.rewrite_text(text, deva.NFC) == unicodedata.normalize("NFC", text)


def test_typed_pairs(spark):
    from aksharaflow.plans.planted_queries import HINDI_PAIRS, KEY_PAIRS, TYPED_PAIRS

    given, want = zip(*TYPED_PAIRS)
    fixed = column(spark, list(given), deva.repair_typed)
    assert fixed == [unicodedata.normalize("NFC", w) for w in want] and column(spark, fixed, deva.repair_typed) == fixed
    assert column(spark, [k for k, _ in KEY_PAIRS], deva.from_keys) == [unicodedata.normalize("NFC", w) for _, w in KEY_PAIRS]
    assert column(spark, [k for k, _ in HINDI_PAIRS], lambda c: deva.from_keys(c, "krutidev")) == [unicodedata.normalize("NFC", w) for _, w in HINDI_PAIRS]


def test_extracted_pairs(spark):
    from aksharaflow.operators.extracted import repair_extracted, repair_in
    from aksharaflow.plans.planted_queries import EXTRACTED_PAIRS

    fixed = column(spark, [a for a, _ in EXTRACTED_PAIRS], repair_extracted)
    assert fixed == [unicodedata.normalize("NFC", b) for _, b in EXTRACTED_PAIRS] and column(spark, fixed, repair_extracted) == fixed
    assert column(spark, ["घरल]", "plain text", None], lambda c: repair_in(c, F.lit(False))) == ["घरल]", "plain text", None]


def test_typed_repair_leaves_correct_words(spark):
    words = ["नेपाल", "विश्व", "पूर्व", "किताब", "संविधान", "क्षेत्र", "श्री", "दुःख"]
    assert column(spark, words, deva.repair_typed) == words
    assert column(spark, ["किि", "काा", "कंा", "जिल्ल्ाा"], deva.repair_typed) == ["कि", "का", "कां", "जिल्ला"]


def test_tokens_concatenate_to_the_text(spark):
    texts = ["a  b c\n d", "", " x "]
    assert column(spark, texts, lambda c: F.array_join(tx.tokens(c), "")) == texts


def test_predicates(spark):
    assert column(spark, ["@)&*", "((", "!!!", "@", "@)*%.!@", "a@"], tx.is_symbol_number) == [True, False, False, False, True, False]
    code = ["a == b && c", "plain text", None, "def f(x):\n return x;\n", "if (a) {\n b();\n}", "Return to the class, for a while; if true"]
    assert column(spark, code, tx.code_signals) == [2, 0, 0, 3, 4, 0]
    assert column(spark, ["g]kfn", "/fd|f]", "we'll", "[1]", "x'G5a", "don't"], tx.signature_hits) == [1, 2, 0, 0, 0, 0]
    assert column(spark, ["http://x.np", "a@b.org", "file.pdf", "www.x", "x.com/a", "end.", "v1.2"], lambda c: c.rlike(tx.URLISH)) == [True] * 5 + [False] * 2
    assert column(spark, ["v2.1.0-beta", "7", None], lambda c: tx.version_parts(c)["minor"]) == [1, 0, 0]


def test_mojibake_and_urls(spark):
    good = "नेपाल é"
    bad = "".join(dict(zip(tx._BYTES, tx.WINDOWS_1252)).get(c, c) for c in good.encode().decode("latin-1"))
    assert column(spark, [bad, "plain", "é"], tx.decode_mojibake) == [good, "plain", "é"]
    assert column(spark, ["a%20b+c", "100%", "%zz"], tx.decode_url) == ["a b+c", "100%", "%zz"]


def test_overprint(spark):
    assert column(spark, ["k|:tfjk|:tfjk|:tfj", "ab", "बेला बेला"], deva.collapse_overprint)[1:] == ["ab", "बेला बेला"]
    assert column(spark, ["headlineheadlineheadline"], deva.collapse_overprint) == ["headline"]


def test_visual_order_round_trip(spark):
    words = ["किताब", "विश्व", "कर्म"]
    assert column(spark, words, lambda c: deva.from_visual(deva.to_visual(c))) == words
