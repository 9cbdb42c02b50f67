"""Line dedup, url filters and line quality against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from citemill.llm import line_dedup, line_quality, url_filter

DOCS = "doc_id bigint, text string, source string, extra string"
LONG, OTHER = "This line is surely longer than forty characters, É.", "another line that is also longer than forty characters"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_dedup(rows, least=5):
    keys = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            k = low(x.strip(" \t\n\x0b\x0c\r"))
            if len(k) >= 40:
                keys.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stays = [x for x in lines if not (len(h := keys.get(low(x.strip(" \t\n\x0b\x0c\r")), ())) >= least and d != max(i for i in h if i is not None))]
        out.append((d, len(lines), len(lines) - len(stays), hashlib.sha256("\n".join(stays).encode()).hexdigest()))
    return sorted(out, key=repr)


def run_dedup(df):
    docs = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df))
    return sorted([tuple(r) for r in docs.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()], key=repr)


def test_line_dedup_equals_brute_force(spark):
    many = "\n".join(["x"] * 70 + [LONG] + ["y"] * 130 + [LONG.upper().replace("É", "é"), "", LONG + " \t"])
    rows = [(i, f"{LONG}\nown {i}\n  {OTHER}\r") for i in range(4)] + [
        (10, many), (11, LONG.replace("T", "t", 1)), (12, None), (13, ""), (14, OTHER), (14, OTHER), (None, LONG + "\nz"), (None, "q"), (15, "\n\n")]
    df = spark.createDataFrame([(d, t, "s", "e") for d, t in rows], DOCS)
    assert run_dedup(df) == brute_dedup(rows)


def test_line_dedup_limits(spark):
    short = "k" * 39
    rows = [(i, f"{short}\n{'k' * 40}\n{OTHER if i < 4 else ''}") for i in range(5)]
    df = spark.createDataFrame([(d, t, "s", "e") for d, t in rows], DOCS)
    assert run_dedup(df) == brute_dedup(rows)
    assert {r[0]: r[2] for r in run_dedup(df)} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0}


def test_line_dedup_empty_table(spark):
    assert run_dedup(spark.createDataFrame([], DOCS)) == []


def test_bitmaps_leave_out_full_words(spark):
    text = "\n".join([LONG] + [f"l{i}" for i in range(300)] + [OTHER])
    df = spark.createDataFrame([(i, text, "s", "e") for i in range(6)], DOCS)
    for r in line_dedup.keep_bitmaps(df).collect():
        assert [w["word"] for w in r["keep"]] == [0, 301 // 64]


@pytest.mark.parametrize(("url", "want"), [
    ("http://com/", ("com", "/", "com/", "allow")), ("http://a.com", ("a.com", "", None, "allow")), ("https://Example.COM/en/x?q#f", ("example.com", "/en/x", "example.com/en/", "block")),
    ("https://m.www.example.com/en/", ("m.www.example.com", "/en/", "www.example.com/en/", "allow")), ("x://notexample.com/en/", ("notexample.com", "/en/", "com/", "allow")),
    ("http://a.net/es/1", ("a.net", "/es/1", "net/es/", "block")), ("http://a.net?/es/", ("a.net", "", None, "allow")), ("http://net/fr", ("net", "/fr", None, "allow")),
    ("no host", ("", "", None, "allow")), (None, ("", "", None, "allow")), ("", ("", "", None, "allow")), ("http://u:p@a.com:80/x", ("u:p@a.com:80", "/x", None, "allow")),
    ("http://www.spam-farm.org/a", ("www.spam-farm.org", "/a", None, "block")), ("http://spam-farmer.org/a", ("spam-farmer.org", "/a", None, "allow")),
    ("http://spam-farm.com/a", ("spam-farm.com", "/a", "com/", "allow")), ("http://x.org/casino/big/bonus", ("x.org", "/casino/big/bonus", None, "block")),
    ("http://x.org/q?u=http://a.com/", ("x.org", "/q", None, "allow")), ("http://x.org/CHEAP-pills", ("x.org", "/CHEAP-pills", None, "block")),
])
def test_url_verdicts(spark, url, want):
    df = spark.createDataFrame([(1, url, "t")], "page_id int, url string, token string")
    r = url_filter.judge(df).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == want


def test_patterns_meet_all_urls_they_match(spark):
    patterns = ("*ads*", "||shop.", "/a/*/b|", "|http://x", "^q=", "tail", "a.b^")
    parts = ["http://", "x", "ads", "shop.", "/a/", "/b", "?q=", "tail", "tails", "a.b", ".", "Z", "%"]
    urls = [p + q + r for p in parts for q in parts for r in parts]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r["page_id"]: r["pattern"] for r in url_filter.judge(df, (), patterns).collect()}
    for i, u in enumerate(urls):
        fits = [p for p in patterns if re.search(url_filter.pattern_regex(p).replace(r"\z", r"\Z"), low(u))]
        assert got[i] == min(fits, default=None), u


def test_url_filter_empty_and_repeated(spark):
    schema = "page_id int, url string"
    assert url_filter.judge(spark.createDataFrame([], schema)).collect() == []
    twice = url_filter.judge(spark.createDataFrame([(1, "http://a.net/es/"), (1, "http://a.net/es/"), (None, None)], schema)).collect()
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in twice) == [(0, "allow"), (1, "block"), (1, "block")]


def brute_repeats(words, k=8):
    seen = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i : i + k]), []).append(i)
    return len({i + j for at in seen.values() if len(at) > 1 for i in at for j in range(k)})


def test_base_counts():
    period = [b"abcdefghijk"[i % 11 : i % 11 + 1] for i in range(60)]
    for words in ([], [b"a"] * 8, [b"a"] * 9, period, period[:18], period[:19], list(b"%d" % i for i in range(40)) * 2, [b"x", *period[:12], b"y", *period[:12]]):
        assert line_quality.repeated_words(words) == brute_repeats(words)
    assert line_quality.base_counts("É a#|\n\n a \n a \na#|\nÉ a#|".encode()) == (7, 13, 6, 2, 0)
    assert line_quality.base_counts(b"") == (0, 0, 0, 0, 0)


def test_frame_lines_are_counted_by_host_and_text(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(25))
    frame = " ".join(f"menu{k}" for k in range(30))
    rows = [(i, f"{frame}\n{own(i)}", "a") for i in range(4)] + [(10 + i, f" {frame.upper()} ", "a") for i in range(3)]
    rows += [(20, frame, "b"), (21, frame, None), (30, None, "a"), (31, "", None)] + [(40 + i, own(99) + "\n" + own(98), "a") for i in range(9)]
    df = spark.createDataFrame([(*r, "e") for r in rows], DOCS)
    got = {r["doc_id"]: (r["base_failed"], r["kept"], r["removed_chars"] > 0) for r in line_quality.judge(df, max_docs=3).collect()}
    assert all(got[i] == (False, True, True) for i in range(4))  # a frame line goes, the prose stays
    assert all(got[10 + i] == (False, False, True) for i in range(3))  # depleted
    assert got[20] == got[21] == (False, True, False)  # another host
    assert got[30] == got[31] == (True, False, False)
    assert all(got[40 + i] == (False, False, True) for i in range(9))  # so are copies: each is a document
    assert line_quality.judge(spark.createDataFrame([], DOCS)).collect() == []
