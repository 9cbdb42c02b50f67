"""URL filters: host rules, and pattern rules found through their rarest literal token.

*Host rules* (verdict, host, path) fit the host, its subdomains, and paths that start with
the rule's path; the longest host + path wins, then the host, then the path as text.

*Pattern rules* are written in the customary filter notation: ``*`` stands for any text,
``^`` for a character outside ``[a-z0-9_.%-]`` or the end, ``||`` at the start for the
beginning of the host or of one of its labels, and ``|`` for the start or end of the url.
Urls are compared with A-Z in lower case. Literal tokens of a rule (runs of ``[a-z0-9]`` with a
literal or anchored edge on both sides) must stand as whole tokens in each url it matches.

Method: tokens are counted over all urls, each pattern rule is indexed under its token that
occurs least, urls are exploded into their distinct tokens, and only rules fetched by a token
run their regular expression. A rule without a token is indexed under the empty token, which
every url has. The rule index is driver configuration; Spark broadcasts it only below its
own size threshold. Hits are gathered per distinct url with a map-side partial aggregate, so
one url on a third of all rows is one group of few rows.

Defined cases: a null url, or one without ``://``, has an empty host and path; host rules
do not fit it, and it is allowed unless a pattern fits. Equal urls get equal verdicts; other
columns are kept out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.llm.common import local_table, lower_ascii


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str


HOST_RULES = (
    HostRule("allow", "com", "/"), HostRule("block", "example.com", "/en/"), HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"), HostRule("block", "net", "/fr/"),
)

#: Block patterns of the production query.
PATTERNS = (
    "||spam-farm.", "cheap-pills", "/casino/*/bonus", "||ads.*^banner^", "free^download^crack", "/wp-admin/", "||tracker.",
    "/porn/", "xxx^video", "?phishing=", "/malware^", "||clickbait.*/out^", "&affiliate=*&payout=", "|ftp://", "/viagra^",
    "payday^loan", "replica^watches", "://doubleclick.", "/torrent/", "keygen^", "/popunder.", "essay^writing^service",
)
SEPARATOR = r"(?:[^a-z0-9_.%-]|\z)"


def pattern_regex(rule: str) -> str:
    """The rule as a regular expression with one meaning in Java and RE2."""
    body, out = rule, ""
    if body.startswith("||"):
        body, out = body[2:], r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, out = body[1:], "^"
    end = ""
    if body.endswith("|"):
        body, end = body[:-1], r"\z"
    for c in body:
        out += ".*" if c == "*" else SEPARATOR if c == "^" else c if re.match(r"[a-z0-9_/&=:%-]", c) else "\\" + c
    return out + end


def literal_tokens(rule: str) -> list[str]:
    """Runs of [a-z0-9] that every matching url holds as whole tokens."""
    anchored = rule.startswith("|")
    body = rule.lstrip("|")
    closed = body.endswith("|")
    body = body.rstrip("|")
    found = []
    for m in re.finditer("[a-z0-9]+", body):
        left = anchored if m.start() == 0 else body[m.start() - 1] != "*"
        right = closed if m.end() == len(body) else body[m.end()] != "*"
        if left and right:
            found.append(m[0])
    return found


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*(/?[^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a lower-case url, and the empty token."""
    return F.array_distinct(F.split(F.concat(F.lit("."), url), "[^a-z0-9]+", -1))


def pattern_index(urls: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """(token, pattern, regex): each rule under its literal token that the fewest urls hold.

    Collects one count per literal token of the rules, so it is bounded by the rule list.
    """
    spark = urls.sparkSession
    tokens = sorted({t for p in patterns for t in literal_tokens(p)})
    wanted = local_table(spark, {"token": ("string", tokens)})
    seen = urls.select(F.explode(url_tokens(F.col("low"))).alias("token")).join(wanted, "token", "left_semi")
    counts = {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    rarest = [min(literal_tokens(p), key=lambda t: (counts.get(t, 0), t), default="") for p in patterns]
    return local_table(spark, {
        "token": ("string", rarest), "pattern": ("string", list(patterns)), "regex": ("string", [pattern_regex(p) for p in patterns])})


def judge(pages: DataFrame, host_rules: tuple[HostRule, ...] = HOST_RULES, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, pattern): ``pattern`` is the first pattern rule that fits, as text."""
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    urls = parsed.where("url IS NOT NULL").select("url", lower_ascii(F.col("url")).alias("low"), "host", "path")
    index = pattern_index(urls, patterns)
    fetched = urls.select("url", "low", F.explode(url_tokens(F.col("low"))).alias("token")).join(index, "token")
    by_pattern = fetched.where(F.expr("low RLIKE regex")).select("url", F.lit(None).cast("struct<n:int,host:string,path:string,verdict:string>").alias("fit"), "pattern")
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rules = local_table(spark, {
        "suffix": ("string", [r.host for r in host_rules]), "start": ("string", [r.path for r in host_rules]),
        "verdict": ("string", [r.verdict for r in host_rules])})
    by_host = urls.select("url", "path", F.explode(suffixes).alias("suffix")).join(rules, "suffix").where("startswith(path, start)").select(
        "url", F.struct((F.length("suffix") + F.length("start")).alias("n"), F.col("suffix").alias("host"), F.col("start").alias("path"), "verdict").alias("fit"),
        F.lit(None).cast("string").alias("pattern"))
    hits = by_host.unionByName(by_pattern).groupBy("url").agg(F.max("fit").alias("fit"), F.min("pattern").alias("pattern"))
    return parsed.join(hits, "url", "left").select(
        "page_id", "url", "host", "path", F.concat("fit.host", "fit.path").alias("rule"),
        F.coalesce("fit.verdict", F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")).alias("verdict"), "pattern")
