from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions.tokens import tokenizer
from tessera.operators.chunk import Fixed, Layered, chunk_documents, fixed, layered, pack_blocks, pack_sentences, sentences
from tessera.operators.markdown import parse

T = tokenizer()


def of(body, **how):
    return layered(parse(body), Layered(**how), T)


def sums(counts):
    return lambda some: sum(counts[i] for i in some)


def test_an_empty_document_has_the_root_alone():
    nodes, chunks = of("")
    assert len(nodes) == 1 and not chunks and nodes[0].parent_id is None


def test_breadcrumbs():
    _, chunks = of("# A\n\n## B\n\ntext")
    assert (chunks[0].heading_path, chunks[0].embedding_text, chunks[0].text) == (["A", "B"], "A > B\n\ntext", "text")
    assert of("# A\n\ntext", with_path=False)[1][0].embedding_text == "text"


def test_sections_never_mix_and_ids_are_stable():
    nodes, chunks = of("intro\n\n# A\n\none\n\n# A\n\ntwo\n\n## X\n\nx")
    more, _ = of("other intro\n\n# A\n\none\n\nadded\n\n# A\n\ntwo\n\n## X\n\nx")
    assert [c.text for c in chunks] == ["intro", "one", "two", "x"]
    assert [n.node_id for n in nodes] == [n.node_id for n in more]
    assert len({n.node_id for n in nodes}) == 4 and [n.sort_order for n in nodes] == [0, 1, 2, 3]


def test_like_titles_below_like_titles_differ():
    nodes, _ = of("# A\n\n## X\n\n# A\n\n## X")
    assert len({n.node_id for n in nodes}) == 5


def test_packing_with_overlap():
    assert pack_blocks(sums([5, 5, 5, 5]), 4, 10, 5) == [(0, 0, 2), (1, 2, 3), (2, 3, 4)]
    assert pack_blocks(sums([30, 5, 5, 5]), 4, 10, 0) == [(0, 0, 1), (1, 1, 3), (3, 3, 4)]
    assert pack_blocks(sums([1, 1]), 2, 10, 5) == [(0, 0, 2)]
    assert pack_blocks(sums([]), 0, 10, 5) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=20), st.integers(1, 30), st.integers(0, 30))
def test_packing_keeps_every_block_once_as_new_and_within_the_limit(counts, limit, overlap):
    made = pack_blocks(sums(counts), len(counts), limit, min(overlap, limit))
    assert [i for _, a, b in made for i in range(a, b)] == list(range(len(counts)))
    assert all(sum(counts[a:b]) <= limit or b - a == 1 for a, _, b in made)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .。!\n1é", max_size=80), st.integers(1, 10))
def test_fixed_chunks_without_overlap_are_the_text(text, size):
    assert "".join(sentences(text, size, T)) == text
    assert "".join(c.text for c in fixed(text, Fixed(size, 0), T)[1]) == text


def test_fixed_overlap_goes_on():
    assert pack_sentences([5, 5, 5], 10, 5) == [(0, 2), (1, 3)]
    assert pack_sentences([20, 20], 10, 50) == [(0, 1), (1, 2)]
    assert pack_sentences([], 10, 5) == []


def test_documents(spark):
    docs = spark.createDataFrame([(1, "# A\n\ntext\n\n![c](x.png)\n\n# References\n\n- r"), (2, None), (3, "")], "document_id long, body string")
    rows = {r["document_id"]: r for r in chunk_documents(docs, Layered()).collect()}
    assert rows[1]["pruned"] == ["References"] and len(rows[1]["nodes"]) == 2
    (chunk,) = rows[1]["chunks"]
    assert [b["block_type"] for b in chunk["blocks"]] == ["paragraph", "figure"] and chunk["figures"][0]["src"] == "x.png"
    assert rows[2]["chunks"] == [] and len(rows[3]["nodes"]) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=1, max_size=25), st.integers(1, 30), st.integers(0, 30))
def test_sizes_do_not_change_the_packing(counts, limit, overlap):
    some = pack_blocks(sums(counts), len(counts), limit, min(overlap, limit))
    assert pack_blocks(sums(counts), len(counts), limit, min(overlap, limit), counts) == some
    # joining costs a token: sizes tell only about where a chunk ends
    dear = lambda at: sum(counts[i] for i in at) + max(0, len(at) - 1)
    assert pack_blocks(dear, len(counts), limit, 0, counts) == pack_blocks(dear, len(counts), limit, 0)


def test_few_joined_blocks_are_counted():
    asked = []

    def counted(some):
        asked.append(len(some))
        return 5 * len(some)

    made = pack_blocks(counted, 5000, 100, 10, [5] * 5000)
    assert made[0] == (0, 0, 20) and len(asked) < 8 * len(made) and sum(asked) < 200 * len(made)
