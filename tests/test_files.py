import json

import pytest
from pyspark.sql import functions as F

from citemill import fixed
from citemill.operators.lexicon import flatten_taxonomy
from citemill.operators.metadata import choose_metadata, guess_doi, guess_title, guess_year, title_tokens
from citemill.operators.pages import assemble, clean_pages, page_spans
from citemill.sinks.tables import write_tables
from citemill.sources.corpus import discover, natural_order, read_texts
from citemill.sources.lexicons import read_context_lexicon, read_lexicon, to_terms
from citemill.sources.metadata import read_csv_metadata, read_sources
from citemill.sources.runs import read_run_table


def test_corpus_folder(spark, tmp_path):
    (tmp_path / "A10.TXT").write_bytes(b"one\r\ntwo\xff\rthree")
    (tmp_path / "A9.md").write_text("nueve ñ", encoding="utf-8")
    (tmp_path / "A2.pdf").write_bytes(b"%PDF")
    (tmp_path / "b+c d.txt").write_text("x")
    (tmp_path / "notes.csv").write_text("x")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "A1.txt").write_text("x")
    listed = discover(spark, str(tmp_path)).orderBy(*natural_order()).collect()
    assert [r["article_id"] for r in listed] == ["A2", "A9", "A10", "b+c d"]
    texts = {r["article_id"]: r["text"] for r in read_texts(spark, str(tmp_path)).collect()}
    assert texts == {"A10": "one\ntwo\nthree", "A9": "nueve ñ", "b+c d": "x"}


def test_csv_metadata(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('﻿ID,ID2,Title\nA1,,"one, ""quoted""\nline"\n,A2,two\nA1,,last\n,,none\n', encoding="utf-8")
    got = {r["article_id"]: r["row"] for r in read_csv_metadata(spark, str(path)).collect()}
    assert got == {"A1": {"ID": "A1", "ID2": "", "Title": "last"}, "A2": {"ID": "", "ID2": "A2", "Title": "two"}}
    both = read_sources(spark, f" {tmp_path}/gone.csv, {path}, {path} ")
    assert sorted(r["source_ord"] for r in both.select("source_ord").distinct().collect()) == [0, 1]
    assert read_sources(spark, "") is None


def test_metadata_choice_and_guesses(spark):
    articles = spark.createDataFrame([("A1", "Zinc exposure among rural children\nx"), ("A2", "y")], "article_id string, text string")
    sources = spark.createDataFrame([
        (0, "A1", {"Title": "Unrelated matter entirely"}), (1, "A1", {"title": "Exposure of children"}), (2, "A1", {"Paper name": "children exposure"})],
        "source_ord int, article_id string, row map<string,string>")
    got = {r["article_id"]: r["metadata"] for r in choose_metadata(articles, sources).collect()}
    assert got == {"A1": {"title": "Exposure of children"}, "A2": {}}
    tokens = spark.range(1).select(title_tokens(F.lit("Study of ZINC Exposición between niños niños"))).head()[0]
    assert sorted(tokens) == ["exposición", "niños"]


@pytest.mark.parametrize("text, embedded, row, title, year, doi", [
    ("x\n  A plausible   title line\n", "", {}, "A plausible title line", "", ""),
    ("doi: something long here\nReceived in May 2001\nThe actual title 1987\n", "", {}, "The actual title 1987", "2001", ""),
    ("body text of the article", "Microsoft Word - x", {}, "body text of the article", "", ""),
    ("body text of the article", "An embedded title", {"Year": "s. 1949"}, "An embedded title", "", ""),
    ("see 10.1000/ABC-1.2. and 12024", "", {"col3": " From sheet ", "Publication Date": "May 2019"}, "From sheet", "2019", "10.1000/ABC-1.2"),
    ("nothing here at all", "", {"DOI": "https://doi.org/10.5555/x_y;z"}, "nothing here at all", "", "10.5555/x_y;z"),
])
def test_title_year_doi(spark, text, embedded, row, title, year, doi):
    df = spark.createDataFrame([(text, embedded, row)], "t string, e string, r map<string,string>")
    got = df.select(guess_title(F.col("t"), F.col("e"), F.col("r")), guess_year(F.col("t"), F.col("r")), guess_doi(F.col("t"), F.col("r"))).head()
    assert tuple(got) == (title, year, doi)


def test_pages_of_a_long_article(spark):
    pages = [("big", i, f"page {i}\f") for i in range(700)] + [("small", 0, "only")]
    cleaned = clean_pages(spark.createDataFrame(pages, "article_id string, page_no long, page_text string"))
    text = {r["article_id"]: r for r in assemble(cleaned).collect()}
    assert text["big"]["pages"] == 700 and text["big"]["text"].count("\f") == 699
    for r in page_spans(cleaned).where("page_no % 97 = 0 and article_id = 'big'").collect():
        assert text["big"]["text"][r["page_start"] : r["page_end"]] == f"page {r['page_no']}"


TAXONOMY = {"taxonomy": [
    {"id": "c1", "kind": "category", "labelEs": "Metales", "children": [
        {"id": "c2", "kind": "category", "labelEn": "Heavy", "children": [{"id": "lead", "kind": "term", "labelEs": "plomo", "patterns": ["\\bplomo\\b"]}]},
        {"kind": "category", "children": [{"kind": "term", "labelEn": "Zinc", "patterns": ["zinc"], "generic": True}]},
        {"id": "bare", "kind": "term", "labelEs": "x", "patterns": []}]},
    {"id": "root", "kind": "term", "label_es": "raiz", "patterns": ["raiz"]}]}


def test_taxonomy_files(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps(TAXONOMY))
    terms = {t.entity_id: t for t in to_terms(read_lexicon(spark, str(path), "a", "Contaminantes"))}
    assert {k: t.category for k, t in terms.items()} == {"lead": "Metales > Heavy", "zinc": "Metales", "root": "Contaminantes"}
    assert terms["zinc"].generic and terms["lead"].patterns == (r"\bplomo\b",)
    nearest = {r["entity_id"]: r["category"] for r in read_lexicon(spark, str(path), "a", "", full_path=False).collect()}
    assert nearest == {"lead": "Heavy", "zinc": "Metales", "root": ""}


def test_flat_and_context_lexicons(spark, tmp_path):
    flat = tmp_path / "f.json"
    flat.write_text(json.dumps({"entities": [{"label_es": "Ictus", "patterns": ["ictus"], "category": "V"}, {"label_es": "none", "patterns": []}]}))
    got = read_lexicon(spark, str(flat), "b").collect()
    assert [(r["entity_id"], r["category"], r["entity_type"]) for r in got] == [("ictus", "V", "b")]
    single = tmp_path / "s.json"
    single.write_text(json.dumps({"contaminantes": [{"canonico": "zinc", "familia": "M", "patrones": ["zinc"]}]}))
    assert [(r["label_es"], r["category"], r["generic"]) for r in read_context_lexicon(spark, str(single)).collect()] == [("zinc", "M", False)]


def test_run_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("7", 'quote " and, comma\nline', None, "", "k", "Si")], "article_id string, title string, year string, doi string, article_kind string, text_extractable string")
    folder = str(tmp_path)
    write_tables({"articles": rows, "relations": spark.createDataFrame([], "article_id string, entity_a_label string, entity_a_category string, entity_b_label string, entity_b_category string, association string, confidence string, section string")}, folder, "csv")
    assert [tuple(r) for r in read_run_table(spark, folder, "articles").collect()] == [("7", 'quote " and, comma\nline', "", "", "k", "Si")]
    empty = read_run_table(spark, folder, "relations")
    assert empty.count() == 0 and empty.columns[0] == "article_id"
    with pytest.raises(FileNotFoundError):
        read_run_table(spark, folder, "entity_summaries")
    rows.drop("doi").write.mode("overwrite").csv(f"{folder}/articles.csv", header=True)
    with pytest.raises(KeyError):
        read_run_table(spark, folder, "articles")


def test_other_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, {"a": 2})], "i int, m map<string,int>")
    paths = write_tables({"x": df}, str(tmp_path), "json")
    assert spark.read.json(paths["x"]).head()["i"] == 1
    assert spark.read.parquet(write_tables({"x": df}, str(tmp_path))["x"]).head()["m"] == {"a": 2}
    csv = write_tables({"x": df}, str(tmp_path), "csv")["x"]
    assert spark.read.csv(csv, header=True, escape='"').head()["m"] == '{"a":2}'


def test_fixed_values_are_consistent():
    assert set(fixed.ROLE_LABELS) == set(fixed.ROLE_WEIGHTS) and set(fixed.SECTION_HEADERS) == set(fixed.SECTION_WEIGHTS)
    assert fixed.SECTION_PROFILES["baseline_current"] == fixed.SECTION_WEIGHTS
    assert flatten_taxonomy and set(fixed.CUE_POINTS) == set(fixed.MENTION_CUES)


def chain_of_categories(spark, depth):
    rows = [(f"c{i:04d}", f"c{i - 1:04d}" if i else None, f"{i:04d}", "category", None, f"L{i}", "", False, []) for i in range(depth)]
    rows += [("top", "c0000", "x", "term", None, "Top", "", False, ["top"]), ("deep", f"c{depth - 1:04d}", "y", "term", None, "Deep", "", False, ["deep"])]
    return rows


def test_taxonomy_of_any_depth_and_cycles(spark):
    from citemill.operators.lexicon import NODE

    rows = chain_of_categories(spark, 67)
    got = {r["label_es"]: r["category"] for r in flatten_taxonomy(spark.createDataFrame(rows, NODE), "V", "a").collect()}
    assert got == {"Top": "L0", "Deep": " > ".join(f"L{i}" for i in range(67))}
    again = rows[:3] + [("c0001", "c0002", "z", "category", None, "Again", "", False, [])]
    with pytest.raises(ValueError, match="ancestor"):
        flatten_taxonomy(spark.createDataFrame(again, NODE), "V", "a")


def test_taxonomy_rounds_follow_the_logarithm_of_the_depth(spark, monkeypatch):
    """A chain of 300 categories takes ten rounds at most; a cycle that no root reaches drops out; one below the root raises."""
    from citemill.operators import lexicon

    rounds, store = [], lexicon.store
    monkeypatch.setattr(lexicon, "store", lambda df, name: rounds.append(name) or store(df, name))
    rows = [(f"c{i}", f"c{i - 1}" if i else None, f"{i:04d}", "category", None, f"L{i}" if i % 2 else "", "", False, []) for i in range(300)]
    rows += [("t", "c299", "x", "term", "t", "Deep", "", False, ["deep"]), ("lost", "nowhere", "y", "term", "l", "Lost", "", False, ["lost"])]
    rows += [("x1", "x2", "z", "category", None, "X1", "", False, []), ("x2", "x1", "z", "category", None, "X2", "", False, []), ("xt", "x1", "z", "term", "xt", "In a loop", "", False, ["x"])]
    df = spark.createDataFrame(rows, lexicon.NODE)
    got = lexicon.flatten_taxonomy(df, "V", "a").collect()
    assert [(r["entity_id"], r["category"]) for r in got] == [("t", " > ".join(f"L{i}" for i in range(1, 300, 2)))]
    assert len(rounds) <= 2 * 10 + 1
    assert [r["category"] for r in lexicon.flatten_taxonomy(df, "V", "a", full_path=False).collect()] == ["L299"]


def test_dictionary_lines_in_many_files(spark, tmp_path):
    """Order over all files by prefix sums over their parts; what has no label or pattern is left out and leaves a gap."""
    from citemill.sinks.lexicons import write_context_lines, write_entity_lines
    from citemill.sources.lexicons import read_context_lines, read_entity_lines

    rows = [(f"e{i:03d}", "" if i % 50 == 7 else f"name {i}", "", "C", i % 2 == 0, [] if i % 40 == 3 else [f"p{i}"], f"{i:06d}") for i in range(300)]
    df = spark.createDataFrame(rows, "entity_id string, label_es string, label_en string, category string, generic boolean, patterns array<string>, position string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_entity_lines(df, str(tmp_path / "lines"))
        write_context_lines(df, str(tmp_path / "context"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "lines").glob("part-*"))) > 1
    got = [(r["entity_id"], int(r["position"][1:])) for r in read_entity_lines(spark, str(tmp_path / "lines"), "a").orderBy("position").collect()]
    assert got == [(e, i) for i, (e, es, _, _, _, ps, _) in enumerate(rows) if es and ps]
    single = read_context_lines(spark, str(tmp_path / "context")).orderBy("position").collect()
    assert [(r["entity_id"], r["generic"]) for r in single] == [(r[0], r[4]) for r in rows]


def test_limits_can_be_lifted_from_the_job(spark, protocol):
    """Years, DOIs, kinds and titles far inside a text count only without a limit."""
    from dataclasses import replace

    from citemill.config import Limits
    from citemill.plans import context
    from citemill.plans.review import describe_articles

    text = "x" * 11_000 + " 1999 doi 10.1234/abc systematic review"
    raw = spark.createDataFrame([("a", text)], "article_id string, text string").selectExpr(
        "article_id", "'f' AS source_path", "text", "1 AS pages", "'' AS embedded_title", "CAST(map() AS map<string,string>) AS metadata")
    near, far = (describe_articles(raw, p).first() for p in (protocol, replace(protocol, limits=Limits(*[None] * 7))))
    assert (near["year"], near["doi"], near["article_kind"]) == ("", "", "unclear")
    assert (far["year"], far["doi"], far["article_kind"]) == ("1999", "10.1234/abc", "review_or_synthesis")
    kinds = [context.describe_articles(raw, context.ContextProtocol((), cues={"preclinical_text": [r"\breview\b"]}, limits=x)).first()["article_kind"] for x in (Limits(), Limits(context_kind_chars=None))]
    assert kinds == ["no_determinado", "preclinico_experimental"]


def test_labels_are_reached_in_the_dialect_of_the_scan(spark):
    from citemill.operators.lexicon import unreachable_labels

    rows = [("a", ["(?P<x>lead)"], "Lead", "pb"), ("b", [r"\bzin\w\b", "("], "ZINC", ""), ("c", ["["], "c", None), ("d", None, "d", "d")]
    terms = spark.createDataFrame(rows, "entity_id string, patterns array<string>, label_es string, label_en string")
    assert sorted((r["entity_id"], r["lang"]) for r in unreachable_labels(terms).collect()) == [("a", "en"), ("c", "es"), ("d", "en"), ("d", "es")]


def test_one_row_group_is_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    """A table in one file of one row group: without a named number, tasks follow its bytes; many small files stay as they are."""
    from citemill import session

    spark.range(1000).selectExpr("id AS doc_id", "repeat(md5(string(id)), 20) AS text").coalesce(1).write.parquet(str(tmp_path / "one"))
    named = spark.conf.get("spark.citemill.partitions")
    spark.conf.unset("spark.citemill.partitions")
    try:
        monkeypatch.setattr(session, "TASK_BYTES", 4096, raising=False)
        df = spark.read.parquet(str(tmp_path / "one"))
        sizes = session.dealt(df).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert len(sizes) >= 5 and sum(sizes) == 1000 and max(sizes) < 400
        monkeypatch.setattr(session, "TASK_BYTES", 1 << 30, raising=False)
        assert session.dealt(df).rdd.getNumPartitions() == df.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.citemill.partitions", named)


def test_texts_are_written_one_file_a_name(spark, tmp_path):
    """A local folder and a store that only Spark reaches give the same texts; the local one has no folder and no checksum file for each text."""
    from citemill.sinks.texts import write_texts

    rows = [(f"N{i % 400}", None if i % 7 == 3 else i // 400, None if i % 11 == 5 else f"line {i}\r\nñ") for i in range(4000)]
    df = spark.createDataFrame(rows, "name string, turn int, value string")
    want = {}
    for name, _, value in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "")):
        if value is not None:
            want[name] = want.get(name, "") + value.replace("\r\n", "\n") + "\n"
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.texts.link./at", f"file://{tmp_path}")
    for folder, place in ((f"file://{tmp_path}/a", r"/(N\d+)\.txt$"), ("viewfs://texts/at/b", r"name=(N\d+)/")):
        write_texts(df, folder, "turn", "value")
        got = read_texts(spark, f"{folder}/*").select(F.regexp_extract("source_path", place, 1).alias("name"), "text").collect()
        assert len(got) == 400 and {r["name"]: r["text"] for r in got} == want
    assert len(list((tmp_path / "a").iterdir())) <= 256 + 2 and not list((tmp_path / "a").glob("*/*.crc")) and len(list((tmp_path / "a").glob("*/*"))) == 400
    with pytest.raises(Exception, match="no name of a file"):
        write_texts(df.withColumn("name", F.lit("../x")), str(tmp_path / "c"), "turn")
    assert not list(tmp_path.glob("*.txt"))


def conversations(spark, folder, rows):
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")


def test_text_folder_on_odd_rows(spark, tmp_path):
    """Null ids, turns, roles and texts, a conversation of nulls alone, negative ids: as in SQL. An empty table gives no row."""
    import duckdb

    from checks.queries import QUERIES
    from checks.sql import ORACLES

    rows = [(1, 1, "user", "b"), (1, None, "user", "last"), (1, 0, "user", "a\n"), (1, 2, None, "x"), (1, 3, "user", None), (-7, 0, "", ""), (None, 0, "user", "no id"),
            (None, 1, "user", "still none"), (5, 0, None, None), (5, 1, "user", None), (2**62, 0, "user", "ñ é \U0001F600")]
    conversations(spark, tmp_path / "odd", rows)
    conversations(spark, tmp_path / "none", [])
    want = duckdb.sql(ORACLES["text_folder"].replace("FROM conversations", f"FROM '{tmp_path}/odd/conversations.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in QUERIES["text_folder"](spark, str(tmp_path / "odd")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == 5
    assert QUERIES["text_folder"](spark, str(tmp_path / "none")).collect() == []


def test_text_folder_lists_few_folders(spark, tmp_path, monkeypatch):
    """The folders that Spark lists do not grow with the files."""
    from checks import trips

    conversations(spark, tmp_path, [(i, t, "user", f"{i} {t}") for i in range(1500) for t in range(2)])
    monkeypatch.setattr(trips, "folder", lambda _: str(tmp_path / "texts"))
    assert trips.text_folder(spark, str(tmp_path)).count() == 1500
    assert sum(p.is_dir() for p in (tmp_path / "texts").rglob("*")) <= 256
