import random
import time

import pytest

from surelake.llm import html_extraction
from surelake.llm.html_extraction import extract, lines, main_text

LONG = "word " * 40


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<script>x", ""),
        ("just text", "just text"),
        ("<p>a<b>b</b>c<br>d&nbsp;e &amp;lt;", "abc d e &lt;"),
        ("<nav><a href=x>Home</a></nav><article><h1>T</h1><p>One\n two</article><footer>f</footer>", "T One two"),
        ("<title>t</title><main><p>x <!-- y --><style>p{}</style>z</p><div class='share'>s</div><p>w</main>", "x z w"),
        (f"<div class=top-menu>m</div><div><h2>H</h2><p>{LONG}</p><p>S.</p></div><div id='comments'><p>{LONG}</div>", f"H {LONG}S."),
        (f"<article><p>{LONG}</p><form>f</form><aside>x</aside><p>end</p><section class='comments'>{LONG}</section></article>", f"{LONG}end"),
        (f"<div><a href=1>{LONG}</a></div><div>{LONG}</div>".replace("</div><div>", "</div><hr><nav></nav><div>"), LONG.strip()),
        ("<article>a < b and c > d</article>", "a < b and c > d"),
        ("<p title=\"unclosed>x", "x"),
        ("x <!-- y", "x"),
        ("<p>x</p><!-- y > z", "x"),
        ("<p>x</p><script>a</script>y", "x y"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text.strip()


CARD = "<div class=grid><article><h3>Teaser</h3><p>More on this.</p></article></div>"


@pytest.mark.parametrize(
    "page,text",
    [
        (f"{CARD}<div><h1>H</h1><p>{LONG}</p><p>{LONG}</p></div>", f"H {LONG}{LONG}".strip()),  # a teaser is marked, the main text is not
        (f"<div><p>{LONG}</p></div>{CARD * 30}", f"{LONG}" + "Teaser More on this. " * 30),  # many teasers, none as long as the main text
        (f"<article><p>{LONG}</p></article><div class=x><p>{LONG}{LONG}</p></div>", f"{LONG}{LONG}{LONG}"),  # neither is much longer
        (f"<article><p>{LONG}</p></article><div class=x><p>{LONG[5:]}</p></div>", LONG),
        (f"<div class=x><p>{LONG[:100]}</p></div><article>Short.</article>", f"{LONG[:100]}Short."),
        (f"<article><p>{LONG}</p><div><div><div><ul><li><a href=x>{LONG}</a></ul></div></div></div></article>", f"{LONG}{LONG}"),
        ("<main><ul><li><a href=x>one</a><li><a href=y>two</a></ul></main>", "one two"),
    ],
)
def test_marked_pages(page, text):
    assert main_text(page) == text.strip()


def test_columns(spark):
    rows = [("x", 1, "u", "<article>é𝒳</article>", "t"), ("x", None, None, None, "t"), ("x", 1, "u", "<article>é𝒳</article>", "t")]
    found = extract(spark.createDataFrame(rows, "text string, page_id bigint, url string, html string, n_chars string"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, "u", "é𝒳", 2), (None, None, "", 0), (1, "u", "é𝒳", 2)], key=repr)
    assert extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


PARTS = f"<header>Site name</header><nav><a href=1>Home</a> <a href=2>News</a></nav><div><h1>H</h1><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar>Also read this</div><div id=comments><p>First!</p><p>I read {LONG}</p></div><footer>All rights reserved.</footer>"
BODY = f"H {LONG}{LONG}".strip()


@pytest.mark.parametrize(
    "page,text",
    [
        (PARTS, BODY),
        (f"<div class='layout has-sidebar'>{PARTS}</div>", BODY),
        (f"<form action=/>{PARTS}</form>", BODY),
        (f"<form><div class='layout has-sidebar'>{PARTS}</div></form>", BODY),
        (f"<p>A tagline.</p><nav><a href=1>Home</a></nav><div class='related-research'><p>{LONG}</p><p>{LONG}</p></div><footer>f</footer>", f"{LONG}{LONG}"),
        (f"<article><p>{LONG}</p><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><p>{LONG}</p></article>", f"{LONG}One Two Three {LONG}"),
        (f"<article><p>{LONG}</p><p><a href=1>A single link</a></p><p>{LONG}</p></article>", f"{LONG}A single link {LONG}"),
        (f"<nav>n</nav><div><p>{LONG}</p><aside>Subscribe now</aside><p>The end.</p></div><footer>f</footer>", f"{LONG}The end."),
        (f"<div><div><p>{LONG}</p></div><div><p>Short.</p></div></div>", f"{LONG}Short."),
        (f"<article><h1>Short</h1><p>Very.</p><section class=comments><p>{LONG}</p><p>{LONG}</p></section></article>", "Short Very."),
        (f"<article><p>{LONG}</p><div class=cookie-notice><p>{LONG}</p></div><p>More.</p></article>", f"{LONG}More."),
        (f"<div class=ad>{LONG}</div><article><h1>Short</h1><p>Very.</article>", "Short Very."),
        (f"<body hidden><div><p>{LONG}</p></div><nav>menu</nav>", LONG),
    ],
)
def test_names_shift_a_weight_and_the_distribution_decides(page, text):
    assert main_text(page) == text.strip()


@pytest.mark.parametrize("page", [PARTS, f"<article><p>{LONG}</p><aside>x</aside></article><footer>f</footer>"])
def test_without_the_distribution_other_text_comes_out(page, monkeypatch):
    found = main_text(page)
    monkeypatch.setattr(html_extraction, "surges", lambda rows: [r.text for r in rows if r.text])
    assert len(main_text(page)) > len(found)


def test_deep_and_long_pages_take_linear_time():
    begin = time.process_time()
    assert main_text("<div>" * 100_000 + LONG) == LONG.strip()
    assert main_text("<div class=ad>" * 100_000 + "</section>" * 100_000 + LONG) == LONG.strip()
    assert main_text("<b '" * 100_000 + LONG)
    assert len(main_text(f"<p>{LONG}" * 20_000)) == len(LONG) * 20_000 - 1
    assert time.process_time() - begin < 15


def test_a_tie_goes_to_the_first_region():
    one, two = "a" * 60, "b" * 60
    assert main_text(f"<div><p>{one}</p></div><nav></nav><hr><hr><div><p>{two}</p></div>").startswith(one)
    assert lines("")[0] == []


FIVE = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>"
TEXT = f"Title {LONG * 5}".strip()


@pytest.mark.parametrize(
    "part,text",
    [
        ("<table><tr><th>Year</th><th>Sum</th></tr><tr><td>1</td><td>2</td></tr></table>", "Year Sum 1 2"),
        ("<div><div><div><p>The end.</p></div></div></div>", "The end."),
        ("<h2><a href=1>A linked title</a></h2><p><a href=2>A paragraph that is a link as a whole</a></p>", "A linked title A paragraph that is a link as a whole"),
        ("<h2>References</h2><ul><li><a href=1>Smith 2001</a><li><a href=2>Miller 2002</a><li><a href=3>Jones</a></ul>", "References Smith 2001 Miller 2002 Jones"),
        *((f"<section {kind}='{name}'><h2>Part</h2><p>It goes on.</p></section>", "Part It goes on.") for kind in ("class", "id") for name in ("share-price-analysis", "social-history", "search-algorithms", "related-work", "menu_of_the_day", "adaptive", "navigation-by-stars")),
        *((f"<section id={name}><h2>Part</h2><p>{LONG}</p><p>{LONG}</p></section>", f"Part {LONG}{LONG}".strip()) for name in ("related", "share", "social", "search")),
        ("<p title='is hidden = x'>Not hidden.</p>", "Not hidden."),
        ("<p data-x='aria-hidden=true' data-style='display:none'>Shown.</p>", "Shown."),
        ("<pre>a\n  b</pre><blockquote>Q.</blockquote><dl><dt>T<dd>D</dl><figure><img src=x><figcaption>C.</figcaption></figure>", "a b Q. T D C."),
        ("<header><p>By someone</p></header>", "By someone"),
    ],
)
def test_nothing_of_an_article_is_lost(part, text):
    assert main_text(f"<nav><a href=1>Home</a></nav><article>{FIVE}{part}</article><footer>f</footer>") == f"{TEXT} {text}"
    assert main_text(f"<article><h1>Title</h1>{part}{FIVE[14:]}</article>") == f"Title {text} {TEXT[6:]}"


@pytest.mark.parametrize(
    "part",
    [
        *(f"<div {kind}={name}><p>Words of it.</p></div>" for kind in ("class", "id") for name in ("ad", "sidebar", "cookie-notice", "newsletter-signup", "share-buttons", "related-articles", "social", "search", "breadcrumbs", "comments", "site-footer", "ad-slot-3", "menu", "promo_box")),
        *(f"<div class='x {name} y'><p>{LONG}</p><p>{LONG}</p></div>" for name in ("ad", "comments", "cookie-consent", "sidebar", "newsletter")),
        "<p hidden>No.</p>", "<p style='color:red; display : none'>No.</p>", "<div aria-hidden=true>No.</div>", "<form>Mail <input></form>", "<aside>No.</aside>", "<nav><a href=1>x</a></nav>", "<script>x</script>", "<button>Send</button>",
        f"<div class=related><ul><li><a href=1>{LONG}</a><li><a href=2>{LONG}</a></ul></div>",
        f"<section><h3>3 Comments</h3><p>{LONG}</p><p>Me too.</p></section>", f"<div><h2>Leave a reply</h2><p>{LONG}</p></div>",
    ],
)
def test_what_is_no_article_goes(part):
    assert main_text(f"<article>{FIVE}{part}<p>The end.</p></article>") == f"{TEXT} The end."
    assert main_text(f"<article>{FIVE}</article>{part}") == TEXT


def made_page(rng: random.Random, marked: bool) -> tuple[str, str]:
    """A page and its main text: an article of random parts between random furniture."""
    sentence = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(n)).capitalize() + "."
    text: list[str] = []

    def t(n: int) -> str:
        text.append(sentence(n))
        return text[-1]

    def part(depth: int = 0) -> str:
        kind = rng.randrange(9 if depth < 3 else 4)
        if kind < 3:
            return f"<p>{t(rng.randint(15, 60))}</p>"
        if kind == 3:
            return f"<h2>{t(3)}</h2><p>{t(40)}</p>"
        if kind == 4:
            return "<table>" + "".join(f"<tr><td>{t(1)}</td><td>{t(2)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if kind == 5:
            return "<ol>" + "".join(f"<li>{t(rng.randint(1, 12))}</li>" for _ in range(rng.randint(1, 5))) + "</ol>"
        if kind == 6:
            return f"<p>{t(10)}<br>{t(4)}</p>"
        if kind == 7:
            return f"<section class={rng.choice(('related-work', 'social-history', 'methods', 'share-price'))}>{part(depth + 1)}{part(depth + 1)}</section>"
        return f"<div><div>{part(depth + 1)}</div></div>"

    furniture = [
        lambda: "<nav><ul>" + "".join(f"<li><a href=x>{sentence(1)}</a></li>" for _ in range(5)) + "</ul></nav>", lambda: f"<div class=ad>{sentence(9)}</div>", lambda: f"<aside>{sentence(30)}</aside>",
        lambda: f"<div id=cookie-notice>{sentence(20)}<button>{sentence(1)}</button></div>", lambda: f"<form>{sentence(5)}<input></form>", lambda: f"<script>var a = '<p>{sentence(9)}</p>';</script>",
        lambda: f"<div class='share-buttons'><a href=1>{sentence(1)}</a> <a href=2>{sentence(1)}</a></div>", lambda: f"<section class=comments><h3>{sentence(2)}</h3><p>{sentence(40)}</p><p>{sentence(50)}</p></section>", lambda: f"<!-- {sentence(9)} -->",
    ]
    some = lambda n: "".join(rng.choice(furniture)() for _ in range(rng.randrange(n)))
    head = f"<html><head><title>{sentence(4)}</title></head><body><header>{sentence(3)}</header>{some(4)}"
    body = f"<h1>{t(5)}</h1><p>{t(50)}</p><p>{t(50)}</p>"
    for _ in range(rng.randint(1, 6)):
        body += part() + some(2)
    tag = "article" if marked else "div"
    return f"{head}<{tag}>{body}</{tag}>{some(4)}<footer>{sentence(12)}</footer></body></html>", " ".join(text)


@pytest.mark.parametrize("marked", [True, False])
def test_random_pages(marked):
    rng = random.Random(11)
    pages = [made_page(rng, marked) for _ in range(600)]
    assert [main_text(p) for p, _ in pages] == [t for _, t in pages]


def test_without_marks_and_names_the_distribution_decides():
    """The same article, with unnamed blocks beside it: short ones and lists of links dive below the threshold."""
    rng = random.Random(5)
    right = 0
    for _ in range(200):
        page, text = made_page(rng, False)
        body = page[page.index("<h1>") : page.rindex("</div>", 0, page.index("<footer>"))] if "<footer>" in page else ""
        menu = "".join(f"<li><a href=x>Item {i}</a></li>" for i in range(6))
        plain = f"<body><div><ul>{menu}</ul></div><div>Some short words.</div><div>{body}</div><div>All rights reserved.</div>"
        right += main_text(plain) == text
    assert right >= 190
