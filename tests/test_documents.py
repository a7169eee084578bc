import json

import pytest

from tessera.functions import frontmatter as fm
from tessera.functions import text as tx
from tessera.functions.frontmatter import Filter, FilterError
from tessera.plans import config
from tessera.sources import providers
from tessera.sources.documents import parse_document, scan_folder, split_frontmatter


def test_frontmatter():
    front, body, error = parse_document("---\ntype: chapter\ntitle: Guide\ndate: 2024-01-01\nok: yes\nn: 0x1F\n---\n\n# Intro\nBody", "a.md")
    assert json.loads(front) == {"type": "chapter", "title": "Guide", "date": "2024-01-01", "ok": "yes", "n": 31}
    assert body == "\n# Intro\nBody" and error is None
    assert "no frontmatter" in parse_document("plain body", "a.md")[2]
    assert "required 'type'" in parse_document("---\ntitle: x\n---\nbody", "a.md")[2]
    assert "required 'type'" in parse_document("---\ntype: 4\n---\nbody", "a.md")[2]
    assert "invalid frontmatter yaml" in parse_document("---\ntitle: [unterminated\n---\nbody", "a.md")[2]


@pytest.mark.parametrize("raw", ["---\ntype: x\nbody", "\n---\ntype: x\n---\n", "----\ntype: x\n---\n", "a\n---\ntype: x\n---\n"])
def test_not_a_block(raw):
    assert split_frontmatter(raw) is None


def test_crlf():
    assert split_frontmatter("---\r\ntype: x\r\n---\r\nbody") == ("type: x\r\n", "body")


def test_folder_scan(spark, tmp_path):
    for name in ("a b.md", "B.MD", "index.md", "log.md", "c.txt"):
        (tmp_path / name).write_text("x", encoding="utf-8")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.md").write_text("x", encoding="utf-8")
    rows = {r["filename"]: r["content"] for r in scan_folder(spark, str(tmp_path)).collect()}
    assert rows == {"a b.md": "x", "B.MD": "x", "bad.md": None}


@pytest.mark.parametrize("text, key, value, negated", [("kind=recipe", "kind", "recipe", False), ("course!=soup", "course", "soup", True), ("yield=2=3", "yield", "2=3", False), ("unit!=g==", "unit", "g==", True), ("note=", "note", "", False), ("note!=", "note", "", True), ("!salt=no", "!salt", "no", False)])
def test_filter_grammar(text, key, value, negated):
    assert Filter.parse(text) == Filter(key, value, negated)


@pytest.mark.parametrize("text", ["", "type", "key!", "=x", "!=x"])
def test_bad_filters(text):
    with pytest.raises(FilterError, match="filter"):
        Filter.parse(text)


DOCS = {
    "broth": '{"kind":"recipe","course":"soup","needs":["pot","leek"]}',
    "stock": '{"kind":"basics","course":"soup","needs":["pot"]}',
    "torte": '{"kind":"recipe","course":"cake","needs":["oven","tin"]}',
    "toast": '{"kind":"recipe","needs":[]}',
    "blank": "{}",
    "list": '{"kind":["recipe","basics"]}',
}


@pytest.mark.parametrize(
    "filters, expected",
    [
        (["kind=recipe"], "broth list toast torte"),
        (["kind=recipe", "kind=basics"], "list"),
        (["needs=pot"], "broth stock"),
        (["needs=pot", "course!=cake", "kind!=basics"], "broth"),
        (["course!=soup"], "blank list toast torte"),
        (["needs!=tin", "kind=recipe"], "broth list toast"),
        (["price=3"], ""),
        (["price!=3", "course=cake"], "torte"),
        (["kind=x' OR 'x'='x"], ""),
    ],
)
def test_filter_truth_table(spark, filters, expected):
    rows = spark.createDataFrame(list(DOCS.items()), "name string, fm string")
    found = rows.filter(fm.where(rows["fm"], [Filter.parse(f) for f in filters]))
    assert " ".join(sorted(r["name"] for r in found.collect())) == expected


def test_filters_on_other_types(spark):
    rows = spark.createDataFrame([('{"a":[4,"x"],"n":4,"b":true,"z":null}',)], "fm string")
    holds = lambda f: rows.select(Filter.parse(f).column(rows["fm"]).alias("x")).first()["x"]
    assert [holds(f) for f in ("a=4", "a=x", "n=4", "b=true", "z=null", "z!=null")] == [False, True, True, True, False, True]
    assert fm.where(rows["fm"], []) is None


def test_titles_and_links(spark):
    rows = spark.createDataFrame(
        [("g.md", '{"book":"ddia","chapter":4,"title":"Guide","resource":"http://x","generated":{"at":"2026-08-13","by":"human:x"}}', "The Leaf"), ("dir.x.md", "{}", None), ("f.md", '{"chapter":"007","book":"b"}', "Ünï 1"), ("f.md", '{"chapter":"one","tags":"t"}', None)],
        "f string, fm string, leaf string",
    )
    got = rows.select(fm.result_title(rows["f"], rows["fm"], rows["leaf"]).alias("t"), fm.result_url(rows["f"], rows["fm"], rows["leaf"]).alias("u"), fm.result_date(rows["fm"]).alias("d"), fm.tags_of(rows["fm"]).alias("g")).collect()
    assert [tuple(r)[:3] for r in got] == [
        ('ddia · ch4 "Guide" · The Leaf', "http://x · kb://ddia/ch4#the_leaf", "2026-08-13 (generated: human:x)"),
        ("dir.x", "kb://dir.x", None),
        ("b · ch7 · Ünï 1", "kb://b/ch7#Ünï_1", None),
        ("one", "kb://f", None),
    ]
    assert got[3]["g"] == []


def test_text_functions(spark):
    one = spark.createDataFrame([("Hello, World! -- " + "x" * 60, "", "a\"b\\c\nd", 1536)], "a string, e string, q string, n long")
    row = one.select(tx.slug(one["a"]).alias("s"), tx.slug(one["e"]).alias("u"), tx.yaml_quoted(one["q"]).alias("q"), tx.format_bytes(one["n"]).alias("b")).first()
    assert row["s"] == "hello-world-" + "x" * 36 and row["u"] == "untitled" and row["q"] == '"a\\"b\\\\c d"' and row["b"] == "2 KB"


def test_providers():
    assert providers.parse_markers('{"markers": [" a ", "", "b"]}') == ["a", "b"]
    for bad in ("no", "[]", '{"markers": "a"}', '{"markers": [1]}', '{"markers": [" "]}'):
        with pytest.raises(providers.ProviderError):
            providers.parse_markers(bad)
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        providers.with_retry(fails, 3, 1000, waits.append)
    assert len(calls) == 4 and waits == [1, 2, 4]
    assert providers.reranked(providers.OverlapReranker(), "a b", ["c", "a b", "a"], 2) == [(1, 1.0), (2, 0.5)]
    assert providers.reranked(providers.OverlapReranker(), "a", [], 2) == []

    class Bad:
        def rerank(self, query, documents, top_n):
            return [(0, 1.0), (0, 0.5)]

    with pytest.raises(providers.ProviderError):
        providers.reranked(Bad(), "a", ["x", "y"], 2)


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("store: '{ROOT}/kb'\nchunk: {strategy: fixed, chunk_size: 64, future: 1}\nembedders: [{name: e, model: m, api_key: '{KEY}'}]\n", encoding="utf-8")
    (tmp_path / "over.yaml").write_text("chunk: {chunk_size: 32}\nretrieval: {top_k: 9}\n", encoding="utf-8")
    (tmp_path / ".env").write_text("KEY=first\nKEY=second\nROOT=/low\n", encoding="utf-8")
    made = config.load(tmp_path / "c.yaml", [tmp_path / "over.yaml"], {"ROOT": "/high"})
    assert (made.store, made.chunk.chunk_size, made.retrieval.top_k, made.named("embedders").api_key) == ("/high/kb", 32, 9, "first")
    with pytest.raises(config.ConfigError, match="placeholder"):
        config.interpolate("{NOPE}", {})
    with pytest.raises(config.ConfigError, match="unknown"):
        config.typed({"nope": 1})
    with pytest.raises(config.ConfigError, match="unknown"):
        config.typed({"embedders": [{"name": "a", "model": "b", "nope": 1}]})
    assert config.merged({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
