import random
import time

import pytest

from awardlens.llm import html_extract as op

ARTICLE = "First paragraph of the story, with commas and more words."


def test_held_out_pages_are_labelled_well():
    field = op.default_field()
    right = total = 0
    for feats, labels in op.sequences(op.labelled_pages(120, seed=5150)):
        right += sum(a == b for a, b in zip(field.decode(feats), labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def other_pages(n=60):
    """Pages of layouts that training has not: headings in tables, menus of divs, articles by role, definition lists."""
    rnd = random.Random(77)
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()
    said = lambda a, b: " ".join(rnd.choice(words) for _ in range(rnd.randint(a, b)))
    for _ in range(n):
        main = [f"{said(3, 8)} headline"] + [f"{said(12, 60)}, {said(4, 20)}." for _ in range(rnd.randint(2, 6))] + [f"{said(2, 5)} term", f"{said(8, 20)}."]
        menu = "".join(f'<div class="nav-item"><a href="/{w}">{w}</a></div>' for w in rnd.sample(words, 5))
        inner = f"<h1>{main[0]}</h1>" + "".join(f"<div><p>{t}</p></div>" for t in main[1:-2]) + f"<dl><dt>{main[-2]}<dd>{main[-1]}</dl>"
        body = rnd.choice(("<div class='article-body'>{}</div>", "<main role=main>{}</main>", "<section class='content'><article>{}</article></section>")).format(inner)
        extra = rnd.choice(('<div class="related-links"><a href="#">read on</a></div>', '<aside><p>best deals now</p></aside>', '<div class="newsletter-signup"><label>your mail</label></div>'))
        yield f'<html><body><div class="navigation">{menu}</div>{body}{extra}<div class="site-footer">\u00a9 2020 {said(1, 3)}</div></body></html>', main


def test_block_f1_on_pages_of_another_generator():
    field, hit, found, wanted = op.default_field(), 0, 0, 0
    for page, main in other_pages():
        blocks = op.leaf_blocks(page)
        got = {b.text for b, y in zip(blocks, field.decode(op.features(blocks)), strict=True) if y}
        hit += len(got & set(main))
        found += len(got)
        wanted += len(set(main))
    assert 2 * hit / (found + wanted) > 0.9


def plain_viterbi(field, feats):
    """The best labels by trying both predecessors of every label, with scores of single features."""
    best = {y: (float(field.start[y] + sum(field.emit[f][y] for f in feats[0])), (y,)) for y in (0, 1)}
    for own in feats[1:]:
        best = {y: max(((v + float(field.move[path[-1]][y]) + float(sum(field.emit[f][y] for f in own)), (*path, y)) for v, path in best.values()), key=lambda x: x[0]) for y in (0, 1)}
    return max(best.values(), key=lambda x: x[0])[1]


def test_text_is_that_of_a_plain_decoder(spark):
    field = op.default_field()
    pages = [p for p, _ in other_pages(15)] + [p for p, _ in op.labelled_pages(25, seed=99)]
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    for r in op.extracted(df).collect():
        blocks = op.leaf_blocks(pages[r.page_id])
        labels = plain_viterbi(field, op.features(blocks))
        assert r.text == " ".join(b.text for b, y in zip(blocks, labels, strict=True) if y) and r.n_chars == len(r.text)


def test_viterbi_is_the_best_of_all_sequences():
    from itertools import product

    field = op.default_field()
    feats = op.sequences(op.labelled_pages(1, seed=9))[0][0][:9]
    s = field.scores(feats)

    def value(y):
        return field.start[y[0]] + sum(s[i][y[i]] for i in range(len(y))) + sum(field.move[a, b] for a, b in zip(y, y[1:], strict=False))

    best = max(product((0, 1), repeat=len(feats)), key=value)
    assert tuple(field.decode(feats)) == best


def test_main_text_of_odd_pages():
    f = op.default_field()
    page = f'<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><article><h1>Title of it</h1><p><b>{ARTICLE}<br>line&nbsp;two &amp;amp; more</b><p>Second one here.</article><section id="comments"><p>I say no.</p></section><footer>&copy; all</footer>'
    assert op.main_text(page, f) == f"Title of it {ARTICLE} line two &amp; more Second one here."
    assert op.main_text(None, f) == "" and op.main_text("", f) == "" and op.main_text("<!-- x", f) == ""
    assert op.main_text(f"<article><p>{ARTICLE} cut <di", f) == f"{ARTICLE} cut"
    assert [b.text for b in op.leaf_blocks("<p title='a>b'>x<i>y</i>z<style>p{}</style> w</p><ul><li>1<li>2</ul>")] == ["xyz w", "1", "2"]
    deep = "<div>" * 3000 + "t" + "</div>" * 3000
    assert [b.text for b in op.leaf_blocks(deep)] == ["t"]


def test_no_text_is_lost_to_heads_drawings_or_depth():
    def texts(page):
        return [b.text for b in op.leaf_blocks(page)]

    assert texts("<head><title>x</title><meta charset=utf-8><h1>One</h1><p>Two") == ["One", "Two"]
    assert texts("<head><title>x</title></ul>  <!-- c --> Words first<p>Two") == ["Words first", "Two"]
    assert texts("<html><head><style>p{}</style><script>'</head>'</script><body><p>One") == ["One"]
    assert texts("<html><head><title>a <p> b</title></head><p>One") == ["One"]
    assert texts('<p>One <svg class="i"/>two</p><p>Three</p>') == ["One two", "Three"]
    assert texts("<p>One <svg/>two<svg width=1 /> more</p><svg><text>no</text></svg>") == ["One two more"]
    assert texts("<p>One <svg href=a/><text>no</text></svg>two</p>") == ["One two"]
    inside = "<article class=comments>" + "<div>" * 199 + "<nav>" + "<div>" * 900
    blocks = op.leaf_blocks(inside + "in" + "</div>" * 900 + "<p>menu</nav>" + "side" + "</div>" * 199 + "main</article>out")
    assert [b.text for b in blocks] == ["in", "menu", "side", "main", "out"]
    assert [("nav" in b.tags, "article" in b.tags, "talk" in b.hints) for b in blocks] == [(True, True, True)] * 2 + [(False, True, True)] * 2 + [(False, False, False)]
    assert [b.tag for b in blocks] == ["div", "p", "div", "article", ""]


def test_rows_are_kept(spark):
    df = spark.createDataFrame([(1, "u", None, 5), (1, "u", None, 5), (None, None, f"<article><p>{ARTICLE}</p></article>", 6)], "page_id long, url string, html string, text int")
    got = op.extracted(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, ARTICLE, len(ARTICLE)), (1, "", 0), (1, "", 0)]
    assert op.extracted(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    ['<a "' * 250_000 + '"', "<a " * 300_000 + '"', "<p title='x>y</p>" * 60_001, "<script></script" * 60_000, "<a <a \" > '" * 90_000, '<p a="' * 100_000 + "'>" * 100_000, "".join(f"<x{i}><p>t" for i in range(80_000)), "<div>" * 200_000 + "t"],
    ids=["open quotes", "one quote", "apostrophes", "open end tags", "mixed", "crossed", "many names", "deep"],
)
def test_pages_of_a_megabyte_take_linear_time(page):
    start = time.process_time()
    op.leaf_blocks(page)
    assert time.process_time() - start < 4


def test_open_quotes_leave_no_markup_in_the_text():
    cases = {
        '<p>First part.</p><p title="x>Second part.</p>': ["First part.", "Second part."],
        '<p title="a > b">x</p><p title="x>Second.</p><p class="a">More</p>': ["x", "Second.", "More"],
        "<p title='it>One.</p><p>Two.</p>": ["One.", "Two."],
        '<p a="1" b=\'2 > "\'>Three.</p>': ["Three."],
        '<p a="unclosed': [],
        "<script>var a = '<p>';</script foo><p>After.</p>": ["After."],
    }
    for page, want in cases.items():
        assert [b.text for b in op.leaf_blocks(page)] == want, page
