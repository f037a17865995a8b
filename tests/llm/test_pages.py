"""Main-text extraction against brute-force matching, hand-made pages and pages of any depth and width."""

from __future__ import annotations

import hashlib
import random

from episodica.llm import html_extraction as pages

WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha", "ke", "li") for b in ("ran", "sel", "tim", "von", "wur")]
SCHEMA = "page_id long, url string, html string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def page(title, paragraphs, extra=""):
    body = "".join(f"<p>{x}" for x in paragraphs)
    return f"<!doctype html><html><head><title>{title}</title><script>var a='</p>';</script></head><body><div><ul><li>Home<li>About us</ul></div><div class=box>{extra}<h1>{title}</h1>{body}<p>Always the same line</div><div>All rights reserved</div><footer>f</footer></body></html>"


def extracted(spark, rows):
    return {r.page_id: r.main_text for r in pages.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_wrapper_removes_what_a_host_repeats(spark):
    rows = [(i, "http://a.example/x", page(f"Title {i}", [f"{prose(i, 20)} &eacute;&amp;", prose(50 + i, 30).replace(" ", "\n ")])) for i in range(6)]
    rows += [(6, None, "<article><h1>T</h1><p>One<br>two <b>three</b><nav>menu</nav><p>four<div class='comments'>c</div></article>"), (7, "http://a.example/y", None), (8, "no host", ""), (9, "http://b.example", "plain text")]
    got = {r.page_id: r["_main_text"] for r in pages.extract(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'m' AS main_text"), keep=("page_id", "main_text")).collect()}
    for i in range(6):
        assert got[i] == "\n".join([f"Title {i}", prose(i, 20) + " é&", prose(50 + i, 30)])
    assert (got[6], got[7], got[8], got[9]) == ("T\nOne two three\nfour", "", "", "plain text")


def test_copies_of_a_page_vote_once(spark):
    bodies = [f"<p>{prose(500 + i, 60)}<p>Repeated line of the host.<p>{prose(600 + i, 60)}" for i in range(6)]
    htmls = [f"<html><body><div><article>{b}</article></div></body></html>" for b in bodies]
    first = min(htmls, key=lambda h: hashlib.md5(h.encode()).hexdigest())
    got = extracted(spark, [(i, "http://a.example/x", h) for i, h in enumerate(htmls + [first] * 12)])
    assert len(got) == 18 and not any("Repeated line" in t for t in got.values()) and all(t.split()[0] in WORDS for t in got.values())


def test_near_copies_do_not_make_an_article_template():
    htmls = [f"<body><div>Menu of the site</div><article><h1>Same title</h1><p>{prose(1, 80)} {i}</p><p>{prose(2, 80)}</p></article></body>" for i in range(8)]
    assert all(t.count("\n") == 2 and "Menu" not in t for t in pages.texts_of_group(htmls))


def test_a_large_host_is_many_groups(spark):
    rows = [(i, "http://big.example/x", page(f"Title {i}", [prose(i, 12), prose(9000 + i, 20)])) for i in range(700)] + [(700, "http://small.example", "<p>one")]
    got = extracted(spark, rows)
    assert all(got[i] == f"Title {i}\n{prose(i, 12)}\n{prose(9000 + i, 20)}" for i in range(700)) and got[700] == "one"


def test_repeated_rows_and_no_rows(spark):
    row = (1, "http://a.example/x", page("T", [prose(1, 9)]))
    got = pages.extract(spark.createDataFrame([row] * 300, SCHEMA)).collect()
    assert len(got) == 300 and len({r.main_text for r in got}) == 1
    assert pages.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_regions_come_from_votes_without_an_article():
    """The text is in plain divs with meaningless names; rotating and constant parts stand around it."""
    htmls = [f"<body><div class=x1>Brand name</div><div class=x2><div class=x3><h1>Head {i}</h1><div class=x4><p>{prose(i, 40)}</p><p>{prose(70 + i, 40)}</p></div></div><div class=x5>Call us now</div></div><div class=x6>Imprint</div></body>" for i in range(9)]
    for i, t in enumerate(pages.texts_of_group(htmls)):
        assert t == f"Head {i}\n{prose(i, 40)}\n{prose(70 + i, 40)}"


def test_names_that_only_contain_a_mark_keep_their_text():
    source = (
        "<body class='has-sidebar comments-open'><div class='article-header'><h1>Title</h1></div><p class='share-price'>Share price fell.</p><p class='social-policy'>Social policy.</p><div class='related-work-text'>Related work.</div>"
        "<div class='comments'><p>A reader</p></div><div id='site-footer'>foot</div><div class='ad'>buy</div><div class='ad-slot-3'>buy</div><section class='reader-comments'>me too</section><div class='cookie-notice'>cookies</div><p>Last.</p></body>"
    )
    assert pages.texts_of_group([source]) == ["Title\nShare price fell.\nSocial policy.\nRelated work.\nLast."]


def test_depth_and_width():
    deep = ["<body>" + "<div>" * 5000 + f"deep {i}" + "</div>" * (5000 - i) for i in range(5)]
    assert pages.texts_of_group(deep) == [f"deep {i}" for i in range(5)]
    wide = ["<body><article>" + "".join(f"<p>{i} {j}" for j in range(20_000)) + "".join(f"<ul><li>item {i} {k}</ul>" for k in range(i)) + "</article>" for i in range(4)]
    assert [t.count("\n") for t in pages.texts_of_group(wide)] == [19_999 + i for i in range(4)]


def brute(a, b):
    """Pairs of two trees in simple tree matching, by plain recursion."""
    if a.tag != b.tag:
        return 0
    table = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + brute(x, y))
    return table[-1][-1] + 1


def random_tree(rng, depth):
    return "".join(f"<{t}>{random_tree(rng, depth - 1) if depth else 'x'}</{t}>" for t in rng.choices(("div", "ul", "section"), k=rng.randrange(1, 5)))


def test_matching_pairs_the_most_nodes(monkeypatch):
    rng = random.Random(3)
    for cells in (pages.CELLS, 1):
        monkeypatch.setattr(pages, "CELLS", cells)
        for _ in range(40):
            a, b = (pages.parse(random_tree(rng, 3)) for _ in range(2))
            shapes = pages.Shapes()
            shapes.name(a)
            shapes.name(b)
            pairs = pages.align(a[0], b[0], shapes)
            assert len(pairs) == brute(a[0], b[0]) == shapes.weight(a[0].shape, b[0].shape)
            assert all(a[i].tag == b[j].tag for i, j in pairs.items()) and len(set(pairs.values())) == len(pairs)


def test_only_white_space_becomes_a_blank():
    assert pages.texts_of_group(["<p>zero\u200bwidth&#8203;space \t\n two&nbsp;three"]) == ["zero\u200bwidth\u200bspace two three"]


def test_large_pages_are_many_groups(spark, monkeypatch):
    """Groups are bounded by bytes too, and equal pages of a group are held once."""
    monkeypatch.setattr(pages, "GROUP_BYTES", 150_000)
    words = lambda seed: " ".join(f"w{random.Random(seed).randrange(10**6) + j}" for j in range(400))
    rows = [(i, "http://big.example/x", page(f"Title {i}", [words(i), words(9000 + i)])) for i in range(120)]
    got = extracted(spark, rows + [(1000 + i, *rows[0][1:]) for i in range(40)])
    assert all(got[i] == f"Title {i}\n{words(i)}\n{words(9000 + i)}" for i in range(120)) and {got[1000 + i] for i in range(40)} == {got[0]}
