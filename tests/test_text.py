import random
import re

import pytest
from pyspark.sql import functions as F

from citemill.functions import labels as lb
from citemill.functions import text as tx
from citemill.functions.regex import extract, first_letters, is_unusual, java_pattern, matches_any
from citemill.operators.metadata import guess_title
from tests import brute

ALPHABET = "aA Éé.!? \n\n\t\f  \x1c1²é_-ſK😀ñÑ"


def random_texts(n, size, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, size))) for _ in range(n)]


def column(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_squash_matches_python_whitespace(spark):
    texts = random_texts(300, 60)
    assert column(spark, texts, tx.squash(F.col("t"))) == [brute.squash(t) for t in texts]


def test_word_count_matches_python_words(spark):
    texts = random_texts(300, 60)
    assert column(spark, texts, tx.word_count(F.col("t"))) == [len(re.findall(r"\b\w+\b", t)) for t in texts]


@pytest.mark.parametrize("n", [1, 3, 8])
def test_has_words_agrees_with_the_count(spark, n):
    texts = random_texts(300, 60, seed=n)
    assert column(spark, texts, tx.has_words(F.col("t"), n)) == [len(re.findall(r"\b\w+\b", t)) >= n for t in texts]


@pytest.mark.parametrize("pattern", [
    r"\bae\b", r"\be\b", r"a\s+a", r"[\s.]e", r"\w\W\w", r"\d", r"(?P<x>a)(?P=x)", r"(a)\1", r"^\s*a", r"(?im)^\s*(a|é)\b", r"k", r"s\b",
    r"[^\s\w]", r"[[a]", r"a\Z", r"\Be", r"(?:a|1)\b", r"[]a]\b"])
def test_patterns_mean_on_the_jvm_what_they_mean_in_python(spark, pattern):
    texts = random_texts(400, 40, seed=len(pattern))
    assert column(spark, texts, matches_any(F.col("t"), [pattern])) == [bool(re.search(pattern, t, re.I)) for t in texts]


def test_an_empty_family_never_fires(spark):
    assert column(spark, ["a"], matches_any(F.col("t"), [])) == [False]


def test_extract_equals_python(spark):
    texts = ["in 1987.", "x2012", "2012²", "no", "é1999 1999"]
    expected = [m.group(1) if (m := re.search(r"\b(19\d\d|20[0-3]\d)\b", t)) else "" for t in texts]
    assert column(spark, texts, extract(F.col("t"), r"\b(19\d\d|20[0-3]\d)\b", 1)) == expected


def test_sentence_at_every_position(spark):
    rng = random.Random(3)
    texts = random_texts(60, 400, seed=9)
    rows = []
    for t in texts:
        for _ in range(8):
            if t:
                s = rng.randrange(len(t))
                rows.append((t, s, min(len(t), s + rng.randint(1, 4))))
    long = ("Word one. Then more! " * 200).strip()
    rows += [(long, s, s + 3) for s in range(0, len(long) - 3, 97)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, s int, e int")
    got = [r[0] for r in df.orderBy("i").select(tx.sentence_at(F.col("t"), F.col("s"), F.col("e"))).collect()]
    assert got == [brute.sentence(*r) for r in rows]


def test_split_sentences_offsets(spark):
    texts = random_texts(80, 200, seed=11)
    got = column(spark, texts, tx.split_sentences(F.col("t")))
    for text, spans in zip(texts, got):
        for s in spans:
            assert brute.squash(text[s["start"] : s["end"]]) == s["sentence"] != ""
        cuts = [m.span() for m in brute.BREAK.finditer(text)]
        parts = [p for p in brute.BREAK.split(text) if brute.squash(p)]
        assert [s["sentence"] for s in spans] == [brute.squash(p) for p in parts], cuts


def test_pages_count_form_feeds_then_fall_back_to_shares(spark):
    cases = [("ab\fcd\fe", 4, 3, 2), ("ab\fcd\fe", 7, 2, 2), ("ab\fcd", 4, 0, 2), ("x" * 100, 60, 4, 3), ("x" * 100, 99, 1, 1), ("", 0, 5, 1)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, p int, n int, want int")
    page = tx.page_at(tx.page_breaks(F.col("t")), F.col("p"), F.col("n"), F.length("t"))
    assert all(r[0] == r[1] for r in df.select(page, "want").collect())


def test_clean_page_joins_soft_hyphens_only_over_one_line_break(spark):
    got = column(spark, ["neuro-\n toxic  a\x00b", "end-\n\nnew", "a\n\n\n\n\nb "], tx.clean_page(F.col("t")))
    assert got == ["neurotoxic a b", "end-\n\nnew", "a\n\nb"]


def test_clip_and_json_cells(spark):
    assert column(spark, ["x" * 300], lb.clip_marked(F.col("t"))) == ["x" * 216 + " […]"]
    assert column(spark, ["a\x01b\tc"], lb.clean_cell(F.col("t"))) == ["ab\tc"]
    counts = F.from_json("t", "map<string,int>")
    assert column(spark, ['{"methods":2,"title":1}'], lb.counts_to_json(counts)) == ['{"methods": 2, "title": 1}']
    assert column(spark, ["oops"], F.size(lb.counts_from_json(F.col("t")))) == [0]


def test_java_pattern_leaves_plain_patterns_alone():
    assert java_pattern("abc+", fast_edges=True) == "(?iuUd)abc+"


def test_split_sentences_is_linear(spark):
    import time

    def took(n):
        df = spark.createDataFrame([("One thing here. " * n,)], "t string").cache()
        df.count()
        begin = time.perf_counter()
        assert df.select(F.size(tx.split_sentences(F.col("t")))).head()[0] == n
        return time.perf_counter() - begin

    took(100)
    assert took(16000) < 3 * took(8000) + 2


@pytest.mark.parametrize("pattern", [r"\bkind\b", r"\bs?ink\s+of", r"\bno\b", r"\b(may|might)\b", r"\d+\s*mg\b", r"[^\W\d]+x", r"caf[eé]\b"])
def test_ascii_rules_and_literals_answer_as_python_does(spark, pattern):
    texts = ["Kind", "a KIND b", "Kind", "kınd", "kİnd", "ſink  of", "SINK\tof", "sinko f", "no", "nó", "nó", "know", "5 MG", "5 mg.", "mgs",
             "might", "ab1x", "café", "CAFE", "", "x" * 5000 + " no " + "y" * 5000]
    assert column(spark, texts, matches_any(F.col("t"), [pattern])) == [bool(re.search(pattern, t, re.I)) for t in texts]


def test_squash_and_title_lines_equal_the_plain_rules(spark):
    texts = [" a  b ", "a b", "\ta  b\n", "a \x1cb", "\x85", "a b", "  ", "a\r\n\r\nb"]
    assert column(spark, texts, tx.squash(F.col("t"))) == [re.sub(r"\s+", " ", t).strip(" ") for t in texts]
    good = "A title of fitting length"
    lines = [["short"] * n + ["see DOİ and DOI of this", good, "Another fitting title"] for n in (0, 2, 3, 4, 20, 89)]
    found = column(spark, [" ".join(x) for x in lines], guess_title(F.col("t"), F.lit(""), F.create_map().cast("map<string,string>")))
    assert found == [good] * 5 + [""]


def test_a_regex_meets_only_texts_that_hold_its_literal(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(matches_any(F.col("t"), [r"\bkind\b"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(lower(t" in plan.split("RLIKE")[0]


def test_first_letters_of_a_pattern():
    cases = {r"\bfor\b": "f", r"\b(19[5-9]\d|20[0-3]\d)\b": "12", r"(?:no|K)x": "kn", r"\w+": None, r"x?y": None, r"(a)?b": None, r"\bé": None, r"\b": None}
    assert {p: first_letters(p) for p in cases} == cases


def test_first_line_counts_every_line_break(spark):
    texts = ["a\u2028 doi of a line \x0b  the \xa0 title\x1fline \x85next long line", "short\r\nx", "", None, "A line of Received papers"]
    assert column(spark, texts, tx.first_line(F.col("t"), 3, 8, 40, ("doi", "received"))) == ["the title line", None, None, None, None]
    assert column(spark, texts, tx.first_line(F.col("t"), 2, 8, 40, ("doi", "received")))[0] is None


def test_a_text_without_unusual_characters_has_no_unusual_part(spark):
    texts = ["plain", "café\u2014Ωя漢", "x\u0301", "\xb2", "\U0001f600", None]
    assert column(spark, texts, tx.holds_unusual(F.col("t"))) == [bool(u) for u in column(spark, texts, is_unusual(F.col("t")))] == [False, False, True, True, True, False]
