import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize(
    ("word", "base"),
    [("batteries", "battery"), ("running", "run"), ("falling", "fal"), ("tried", "try"), ("stopped", "stop"), ("used", "used"), ("boxes", "box"), ("glasses", "glass"), ("parts", "part"), ("children", "child"), ("women", "woman"), ("men", "man"),
     ("gas", "gas"), ("2024", "2024"), ("close", "close"), ("seeing", "see"), ("ring", "ring"), ("bed", "bed")],
)
def test_stems(spark, word, base):
    assert one(spark, X.stem, word) == base


def test_index_tokens(spark):
    assert one(spark, X.index_tokens, "How do the Filters stop? cleaned 12") == ["filters", "filter", "stop", "cleaned", "clean", "12"]
    assert one(spark, X.index_tokens, "the of") == [X.EMPTY_TOKEN]
    assert one(spark, X.index_tokens, None) == [X.EMPTY_TOKEN]


def test_normalisation_and_languages(spark):
    assert one(spark, X.normalize_text, " Ab c\n ") == "abc"
    assert one(spark, X.detect_language, "abc 电") == "zh"
    assert [one(spark, X.normalize_language, v) for v in ("EN-us", "Chinese", "de", None)] == ["en", "zh", None, None]
    assert one(spark, X.alnum, "Äb-1_ ½!") == "äb1½"


def test_truncation_keeps_characters_whole(spark):
    text = "é" * 50
    cut = one(spark, lambda c: X.utf8_truncate(c, 20), text)
    assert cut == "é" * 8 + "..." and len(cut.encode()) <= 20
    assert one(spark, lambda c: X.utf8_truncate(c, 100), text) == text


def test_markdown_and_images(spark):
    md = "# Title\n\n```\ncode\n```\n- item **x** [link](http://a) ![pic one](img/a_1.png) ![](img/b_2.jpg)\n| a | b |\n|---|---|\n"
    assert one(spark, X.markdown_to_index_text, md) == "Title\nitem **x** link\na b"
    assert one(spark, X.markdown_to_index_text, "a <PIC:m_1> {{图片描述：red\nbox}} b {{Image description: c}}\n\n\n\n1) d <pic:x>") == "a red\nbox b c\nd"
    assert one(spark, X.image_ids, md) == ["pic one", "b_2"]
    assert one(spark, X.image_placeholders, md).count("<PIC>") == 2


def test_sentences_lines_and_footers(spark):
    assert one(spark, X.head_sentences, "One. Two! Three? Four") == "One. Two!"
    assert one(spark, X.tail_sentences, "One. Two! Three? Four") == "Two! Three?"
    assert one(spark, X.head_sentences, "pi is 3.14 or so. yes") == "14 or so." and one(spark, X.head_sentences, "a\n \nb c\nd") == "a\nb c"
    assert one(spark, X.tail_sentences, "a\nb\n\nc") == "b\nc" and one(spark, X.tail_sentences, None) == ""
    assert one(spark, X.dedupe_lines, "\n a  b\n\n\na b\n c \n\n") == "a  b\n\nc"
    assert one(spark, lambda c: X.footer_field(c, "root_cause"), "text\nroot_cause: cpu high。\nfault_object: x") == "cpu high"
    assert one(spark, lambda c: X.footer_field(c, "root_cause"), "none") is None


def test_keys_times_and_paths(spark):
    assert one(spark, X.chunk_key, " a1 ") == "a1"
    assert one(spark, X.chunk_key, "x" * 101).startswith("chunk_")
    assert one(spark, X.chunk_key, " ") is None
    assert str(one(spark, X.flexible_timestamp, "2024/05/06 (Mon) 07:08")) == "2024-05-06 07:08:00"
    assert str(one(spark, X.flexible_timestamp, "1700000000000")) == "2023-11-14 22:13:20"
    assert one(spark, X.flexible_timestamp, "no time") is None
    rows = spark.createDataFrame([(["a", "b", "c"], ["a", "b", "x"]), (["a"], ["a", "b"]), (["q"], ["a"])], "x array<string>, y array<string>")
    assert [r.o for r in rows.select(X.common_prefix(F.col("x"), F.col("y")).alias("o")).collect()] == [["a", "b"], ["a"], []]


def test_token_estimate(spark):
    assert one(spark, X.token_estimate, "éé") == 6
    assert one(spark, X.token_estimate, None) == 4


ANSWERS = {
    "# T\n\n> q [l](http://x) ![i](a.png)\n---\n**b** and *i* and __u__ 2*3\n\n\n\nend": "T\n\nq l ![i](a.png)\nb and i and u 2*3\n\nend",
    "| a | b |\n|---|:---:|\n| 1 | 2 |\n|  | 3 |\n| 4 |\ntail": "a：1；b：2\nb：3\na：4\ntail",
    "|x|y|\n|---|---|\n|h|k|\n|---|---|\n": "x：h；y：k\nx：---；y：---",
    "a|b\nc": "a|b\nc",
    "|p|\n|--|": "|p|\n|--|",
    "": "",
    " \n|a|\n|---|\n| |\n|b|\n|---|": "a：b\na：---",
    "|a|b|\n|---|---|\n\n|c|\n|---|\n|1|": "a；b\n\nc：1",
}


def test_answer_text(spark):
    assert {t: one(spark, X.markdown_to_answer, t) for t in ANSWERS} == ANSWERS


def test_settings_and_titles(spark):
    assert [one(spark, lambda c: X.to_bool(c, True), t) for t in (" ON ", "no", "", "x", None)] == [True, False, False, True, True]
    assert [one(spark, lambda c: X.to_int(c, 7), t) for t in (" 12", "-3", "1.5", None)] == [12, -3, 7, 7]
    assert [one(spark, X.to_float, t) for t in ("1e3", "x", None)] == [1000.0, 0.0, 0.0]
    title = lambda c: X.guessed_title(c, F.lit("Doc"), F.lit(3))
    assert [one(spark, title, t) for t in ("x\n ## A b \n# C", "x", "#\n# C", None)] == ["A b", "Doc baseline chunk 0003", "Doc baseline chunk 0003", "Doc baseline chunk 0003"]
    assert one(spark, lambda c: X.titled_index_text(F.lit("T"), c), "a <PIC:x>\n b") == "T\na b"
    placed = lambda c: X.placed_index_text(F.array(F.lit("s"), F.lit("t")), F.lit("t"), c)
    assert [one(spark, placed, t) for t in ("body", "t goes on", None)] == ["s > t\nt\nbody", "s > t\nt goes on", "s > t\nt"]


def test_forms_of_words_agree_with_the_column(spark):
    text = "The children were running, stopped classes boxes tries tied 123s bus as is gas hopping falling seed bed ing ied studied oxes 007 feet x"
    words = text.lower().replace(",", "").split()
    assert [X.stem_word(w) for w in words] == spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, i int").orderBy("i").select(X.stem(F.col("w")).alias("s")).toPandas().s.tolist()
    assert X.TokenForms().index_tokens(text) == one(spark, X.index_tokens, text) and X.TokenForms().index_tokens(None) == one(spark, X.index_tokens, None) == ["__empty__"]
