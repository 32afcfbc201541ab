import itertools
import math
import random
import time

import numpy as np
import pytest

from tidewell.llm.html_extract import Field, _expected, default_field, drawn_page, extract_text, features, labelled_page, leaf_blocks, train


@pytest.fixture(scope="module")
def field():
    return default_field()


def texts(page):
    return [t for _, t, _ in leaf_blocks(page)]


def test_leaf_blocks():
    assert texts("<p>a <b>b</b>&amp;c\n\n d<br>e<p>f</p>g") == ["a b&c d e", "f", "g"]
    assert texts("<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>") == ["one", "two", "x", "y"]
    assert texts("<script>if (a<b) '<p>no</p>'</script><style>p{}</style><!-- <p>no --><p>yes") == ["yes"]
    assert texts("&lt;p&gt; &#233; &#x1F600; &nbsp;x&copy") == ["<p> é 😀 x©"]
    assert texts("") == [] and texts("<div></div>") == [] and texts("plain") == ["plain"]
    assert texts("<h2>a</h3><p>b</div></section>c") == ["a", "b", "c"]


def test_markup_that_hides_nothing():
    assert texts("<p>a</p><svg/><p>b</p>") == texts("<p>a</p><svg class=i/><p>b</p>") == texts("<p>a</p><math/><p>b</p>") == ["a", "b"]
    assert texts("<p>a</p><svg><title>no</title><path d='x'/></svg><p>b") == ["a", "b"]
    assert texts("<p>a</p><svg-icon>i</svg-icon><template-x>j</template-x><p>b") == ["a", "i", "j", "b"]
    assert texts("<p>a</p><!--><p>b</p><!-- no --><!---><p>c</p>") == ["a", "b", "c"]


def test_head_without_optional_tags():
    head = "<html><head><meta charset=utf-8><title>no</title><script>no</script><link rel=x>"
    for rest in ("<p>a<p>b", "<h1>a</h1>b", "a<p>b", "</head><p>a<p>b", "</head><body><p>a<p>b", "<body>a<p>b", "<svg></svg><p>a<p>b"):
        assert texts(head + rest) == ["a", "b"], rest
    assert texts("<p>a</p><head><p>b") == texts("<head></head><p>a</p><head>b") == ["a", "b"]


def test_plain_text_elements_that_are_never_closed_hide_the_rest():
    for page in ("<p>Main<script><p>x", "<p>Main<style>p{} <p>x", "<p>Main<textarea><p>x", "<p>Main<xmp><p>x"):
        assert texts(page) == ["Main"], page


def test_elements_of_markup_that_are_never_closed_hide_nothing():
    for page in ("<body><svg/><article><p>Main</p>", "<head><title>t</title><p>Main", "<video/><p>Main", "<select><p>Main", "<iframe src=x /><p>Main", "<canvas><p>Main"):
        assert texts(page) == ["Main"], page
    assert texts("<div><video><p>no</p></div><p>a</p><video>no</video>") == ["a"]
    assert texts("<p>a</p><select><option>no<option>no</select><p>b") == ["a", "b"]


def test_signs_inside_quotes():
    assert texts('<p title="a>b">x text</p>') == texts("<p title='a>b' x = \">\">x text</p>") == texts('<p a=b"c>x text') == ["x text"]
    assert texts("a < b <3 </> c") == ["a < b <3 c"]


def test_numbers_of_any_length():
    assert texts("&#" + "9" * 20_000 + ";&#" + "0" * 20_000 + "65;&#x" + "f" * 20_000 + ";") == ["\ufffdA\ufffd"]


@pytest.mark.parametrize(
    "page", ["<a " * 1_700_000, "<p>hi</p><" + "a" * 5_000_000, "<!-- " * 1_000_000, '<a b="' * 800_000, "<script>" * 100_000, "<div>" * 100_000 + "</x>" * 100_000, "<a " + "=" * 5_000_000, "<select>" * 100_000],
    ids=["open tags", "open name", "comments", "quotes", "scripts", "stray ends", "equal signs", "selects"],
)
def test_time_is_in_proportion(page):
    start = time.process_time()
    leaf_blocks(page)
    assert time.process_time() - start < 10


def test_forward_and_backward_sums_are_those_of_all_chains():
    rng = np.random.default_rng(4)
    for n in (1, 2, 6):
        score, steps = rng.normal(size=n) * 3, rng.normal(size=(2, 2)) * 2
        p, pair, whole = np.zeros(n), np.zeros((2, 2)), 0.0
        for chain in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(s for s, c in zip(score, chain, strict=True) if c) + sum(steps[a, b] for a, b in itertools.pairwise(chain)))
            whole += w
            p += w * np.array(chain)
            for a, b in itertools.pairwise(chain):
                pair[a, b] += w
        got = _expected(score.tolist(), steps)
        assert np.allclose(got[0], p / whole) and np.allclose(got[1], pair / whole)


def test_page_with_every_kind_of_boilerplate(field):
    page = """<html><head><title>T</title></head><body><div class="cookie-notice">We use cookies. <button>OK</button></div>
    <nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav><header><h2>Site name</h2></header>
    <article><h1>The title</h1><p>First paragraph of the article, with   several words in it.</p>
    <div class="ad">Buy now! Cheap things.</div><p>Second &eacute; paragraph is here.</p><form><label>Mail</label><input><button>Subscribe</button></form></article>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=/y>Other story</a></ul></aside>
    <section id="comments"><h3>Comments</h3><p>I liked this article very much, thank you.</p></section>
    <footer>&copy; 2020 Site, all rights reserved.</footer><script>var x = "<p>no</p>";</script></body></html>"""
    assert field.extract(page) == "The title\n\nFirst paragraph of the article, with several words in it.\n\nSecond é paragraph is here."


def test_held_out_pages(field):
    rng, right, n = random.Random(77), 0, 0
    for _ in range(150):
        _, blocks, truth = labelled_page(drawn_page(rng))
        right += sum(a == b for a, b in zip(field.decode(blocks), truth, strict=True))
        n += len(truth)
    assert right / n > 0.97


def test_viterbi_is_the_best_of_all_chains():
    rng = np.random.default_rng(1)
    page = "<div class=ad>a</div><p>some text here, and more.</p><nav>n</nav><p>b</p><h1>c</h1><li>d"
    blocks = leaf_blocks(page)
    names = sorted({f for i, b in enumerate(blocks) for f in features(b, blocks[i - 1] if i else None)})
    for _ in range(50):
        made = Field({f: i for i, f in enumerate(names)}, rng.normal(size=len(names)), rng.normal(size=(2, 2)) * 3)
        scores = made.scores(blocks)

        def value(chain, made=made, scores=scores):
            return sum(s for s, c in zip(scores, chain, strict=True) if c) + sum(made.steps[a, b] for a, b in itertools.pairwise(chain))

        best = max(itertools.product((0, 1), repeat=len(blocks)), key=value)
        assert math.isclose(value(best), value([int(x) for x in made.decode(blocks)]))


def test_training_learns_from_ones_own_pages():
    pages = []
    for i in range(40):
        blocks = leaf_blocks(f"<div class=keepme>text {i}</div><div class=dropme>text {i}</div>" * 3)
        pages.append((blocks, [".keepme" in path.all_marks() for path, _, _ in blocks]))
    made = train(pages)
    assert made.extract("<div class=dropme>no</div><div class=keepme>yes</div>") == "yes"


def test_odd_pages(spark, field):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    rows = [(1, "u", None), (2, None, ""), (3, "u", "   "), (4, "u", "<"), (5, "u", "<p"), (6, "u", "</p></p>"), (7, "u", deep), (None, "u", "<article><p>Text of it, long enough.</p></article>"),
            (8, "u", "<article>" + "<p>One sentence of many words follows another.</p>" * 20_000 + "</article>"), (9, "u", "<!-- never closed <p>x</p>")]
    rows += rows[:2]
    got = extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"), field).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text is not None and r.n_chars == len(r.text)
        if r.page_id in (1, 2, 3, 6, 9):
            assert r.text == ""
        if r.page_id == 8:
            assert r.text.count("\n\n") == 19_999
    assert extract_text(spark.createDataFrame([], "page_id bigint, url string, html string"), field).count() == 0


def test_clashing_names(spark, field):
    pages = spark.createDataFrame([(1, "u", "<article><p>Some text of a page, here.</p></article>")], "page_id bigint, url string, html string").selectExpr("*", "'own' AS text", "'own' AS n_chars", "'own' AS row")
    got = extract_text(pages, field, carry=pages.columns).first()
    assert got.text == "Some text of a page, here." and got["row"] == "own"


PARAGRAPHS = [f"This is paragraph number {i} of the article, which tells a little about the budget of the town, and goes on for a while." for i in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
ONE = "One sentence of an article that is short but real."
SITE = "<html><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>{}<footer>© 2020 The Site. All rights reserved.</footer></body></html>"
FOREIGN = {  # pages that the drawn ones do not make: the markup of an article and its text
    "cut script": (f"<article><h1>Title here</h1><p>{ONE}</p><script>var a = 1; function go() {{ return a; }} go();", ["Title here", ONE]),
    "cut style": (f"<article><h1>Title here</h1><p>{ONE}</p><style>p{{margin:0}} a{{color:red}}", ["Title here", ONE]),
    "comments": (f'<article><p>{ONE}</p><section id="comments"><p>I like it a lot.</p><p>Me too, thanks.</p></section></article>', [ONE]),
    "form": (f"<article><p>{ONE}</p><form><textarea>your text</textarea><button>Send</button></form></article>", [ONE]),
    "header": (f"<article><header><h1>The title of it all</h1></header>{BODY}</article>", ["The title of it all", *PARAGRAPHS]),
    "section": (f'<main><h1>Budget</h1><section class="introduction">{BODY}</section></main>', ["Budget", *PARAGRAPHS]),
    "plain": (f"<div><h1>Budget</h1>{BODY}</div>", ["Budget", *PARAGRAPHS]),
    "unknown names": (f'<div class="zq-wrap"><div class="xk9"><h1>Budget</h1>{BODY}</div></div>', ["Budget", *PARAGRAPHS]),
    "sections": (f"<article><section><h2>First part</h2>{BODY}</section><section><h2>Second part</h2>{BODY}</section></article>", ["First part", *PARAGRAPHS, "Second part", *PARAGRAPHS]),
}


@pytest.mark.parametrize("name", FOREIGN)
@pytest.mark.parametrize("page", ["{}", SITE])
def test_pages_of_other_layouts(name, page):
    markup, want = FOREIGN[name]
    assert default_field().extract(page.replace("{}", markup)) == "\n\n".join(want)


def test_deep_names_take_time_in_proportion():
    import time

    def page(n):
        names = (" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}x" for j in range(26)) for i in range(500))
        return "".join(f'<div class="{x}">' for x in names) + "<p>x</p>" * n

    def seconds(n):
        start = time.perf_counter()
        default_field().extract(page(n))
        return time.perf_counter() - start

    seconds(10)
    assert seconds(100_000) < 8  # 1 MB; with marks copied to every block it took minutes


def test_marks_of_a_block_are_those_of_its_elements():
    blocks = leaf_blocks('<div class="a b">one<div class="b c"><p>two</p></div>three</div><p>four</p>')
    assert [(b[0].all_marks(), b[0].tag, b[1]) for b in blocks] == [(["div", ".a", ".b"], "div", "one"), (["div", ".a", ".b", ".c", "p"], "p", "two"), (["div", ".a", ".b"], "div", "three"), (["p"], "p", "four")]
