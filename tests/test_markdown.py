import pytest

from tessera.operators.markdown import full_text, is_reference_title, parse, prune, tree_text


def only(body):
    return [(c.kind, c.text) for c in parse(body).children]


def figure(body):
    (node,) = parse(body).children
    return node.kind, node.src, node.caption, node.description


@pytest.mark.parametrize(
    "body, expected",
    [
        ('![Harbour at dusk](img/harbour.jpg "Boats left of the pier")', ("figure", "img/harbour.jpg", "Harbour at dusk", "Boats left of the pier")),
        ('<span id="m7"></span>\n![Map](maps/north.svg)', ("figure", "maps/north.svg", "Map", None)),
        ("![Plan](<ground floor.png>)", ("figure", "ground floor.png", "Plan", None)),
    ],
)
def test_a_lone_image_is_a_figure(body, expected):
    assert figure(body) == expected


@pytest.mark.parametrize(
    "body, expected",
    [
        ("Compare it with ![the old map](maps/old.png) once more.", "Compare it with the old map once more."),
        ("![Sketch](s.png) was drawn on site.", "Sketch was drawn on site."),
        ("![a](1.png)\n![b](2.png)", "a b"),
        ("![A](x.png)text", "A text"),
        ("text before $$x=1$$ text after", "text before $$x=1$$ text after"),
        ("inline $a=b$ here", "inline $a=b$ here"),
        ("$$a$$ $$b$$", "$$a$$ $$b$$"),
        ("costs $5 or $6", "costs $5 or $6"),
        ("a *b* _c_ **d** snake_case [link](http://x 't') <b>h</b> &amp; \\*e\\*", "a b c d snake_case link <b>h</b> & *e*"),
        ("soft\nbreak", "soft break"),
        ("hard  \nbreak", "hard\nbreak"),
        ("hard\\\nbreak", "hard\nbreak"),
        ("`code *x*`", "code *x*"),
        ("#hashtag", "#hashtag"),
        ("####### seven", "####### seven"),
    ],
)
def test_paragraphs(body, expected):
    assert only(body) == [("paragraph", expected)]


def test_blocks():
    assert only("para one\n\n$$x=1$$\n\npara two") == [("paragraph", "para one"), ("math_block", "$$x=1$$"), ("paragraph", "para two")]
    assert only("```py\n# no heading\n```") == [("code_block", "# no heading\n")]
    assert only("    indented\n\n    more") == [("code_block", "indented\n\nmore\n")]
    assert only("| a | b |\n| - | - |\n| 1 | **2** |\n| 3 |") == [("table", "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 |  |")]
    assert only("- one\n- two\n  more\n\n1. x") == [("paragraph", "one"), ("paragraph", "two more"), ("paragraph", "x")]
    assert only("> quote *x*") == [("paragraph", "quote x")]
    assert only("<div>\nx\n</div>\n\nafter") == [("paragraph", "after")]
    assert only("") == []


def test_headings_nest_and_lose_their_attributes():
    root = parse("# A {#a}\n\ntext\n\n### C\n\n## B ##\n\nTitle\n=====\n")
    a, title = root.children
    assert (a.text, a.level, title.text, title.level) == ("A", 1, "Title", 1)
    assert [(c.kind, c.text, c.level) for c in a.children] == [("paragraph", "text", 0), ("heading", "C", 3), ("heading", "B", 2)]
    assert parse("# ![Logo](fig/logo.png)").children[0].text == "Logo"


def test_prune_drops_reference_sections_whole():
    root = parse("# Tides\n\n## References {.small}\n\n- none yet\n\n### More of them\n\n## Currents {#refs}\n\n# 参考文献\n")
    assert prune(root, is_reference_title) == ["References", "参考文献"]
    assert [c.text for c in root.children[0].children] == ["Currents"]


def test_full_text_and_drawing():
    root = parse("# A\n\ntext\n\n![c](x.png \"d\")")
    assert full_text(root) == "A\n\ntext\n\nc\n\nd"
    assert tree_text(root).splitlines()[1] == "└── h1: A"


def test_targets_defined_elsewhere():
    body = "See [the log][Log Book], [map][] and [map], not [tide][none] or [none].\n\n[log  book]: <a b.md>\n[MAP]: m.svg 'North'\n[map]: other.svg"
    assert only(body) == [("paragraph", "See the log, map and map, not [tide][none] or [none].")]
    assert figure("[map]: m.svg\n  (North up)\n\n![Chart *one*][map]") == ("figure", "m.svg", "Chart one", "North up")
    assert only("# On [x]\n\n| [x] | b |\n| - | - |\n| ![y][x] | 2 |\n\n> [x]: u\n> left") == [("heading", "On x")]
    assert [c.text for c in parse("# On [x]\n\n| [x] | b |\n| - | - |\n| ![y][x] | 2 |\n\n> [x]: u\n> left").children[0].children] == ["| x | b |\n| --- | --- |\n| y | 2 |", "left"]


def test_what_is_no_definition():
    assert only("text\n[a]: b") == [("paragraph", "text [a]: b")]
    assert only("[a]: b c") == [("paragraph", "[a]: b c")]
    assert only("[ ]: b") == [("paragraph", "[ ]: b")]
    assert only("[a]: b\n===\nrest [a]") == [("paragraph", "=== rest a")]
    assert only("[a]: b 'open\n\n[a]") == [("paragraph", "[a]: b 'open"), ("paragraph", "[a]")]
