import pytest

from umbra.llm.html_text import extract, extract_pages

PARA = "This is a sentence with words, clauses, and enough length to look like running text in an article."
CASES = [
    (None, ""),
    ("", ""),
    ("<html><body></body></html>", ""),
    ("plain words only", "plain words only"),
    (f"<body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>Title</h1><p>{PARA}<p>Second &amp; last.</article><footer>&copy; x</footer>", f"Title\n{PARA}\nSecond & last."),
    (f"<div class='cookie-notice'>We use cookies, yes, really, all of them.</div><div id=content><p>{PARA}</p><p>{PARA}</p></div><div class=sidebar><p>{PARA}</p></div>", f"{PARA}\n{PARA}"),
    (f"<article><p>{PARA}</p><div class='comments'><p>{PARA} reader</p></div></article>", PARA),
    (f"<article><p>{PARA}</p><script>var a='</p><p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><form><input value=x>no</form></article>", PARA),
    (f"<article><p>one<br>two\n\t three&nbsp;four</p><p>{PARA}</p></article>", f"one two three four\n{PARA}"),
    (f"<article><p>{PARA}</p><p>cut &amp; off <a href='x", f"{PARA}\ncut & off"),
    (f"<article><p>a < b and <b>bold</b> text, {PARA}</p>", f"a < b and bold text, {PARA}"),
    (f"<main><ul><li><a href=/1>One link</a></li><li><a href=/2>Two link</a></li></ul><p>{PARA}</p><ul><li>real item</li></ul></main>", f"{PARA}\nreal item"),
    (f"<body><div><p>{PARA}</p></div><div><p>{PARA} more</p></div></body>", f"{PARA}\n{PARA} more"),
]


@pytest.mark.parametrize(("source", "text"), CASES)
def test_extract(source, text):
    assert extract(source) == text


def test_long_and_odd_input():
    assert extract("<" * 5000).strip("<") == ""
    assert extract("<p>" * 3000 + "x") == "x"
    assert extract("<div>" * 3000 + f"<p>{PARA}</p>") == PARA
    assert extract("<!--" * 2000) == ""
    many = "".join(f"<p>{PARA} {i}</p>" for i in range(2000))
    assert extract(f"<article>{many}</article>").count("\n") == 1999


def test_frame_keeps_rows(spark, sf_dir):
    pages = spark.createDataFrame([(1, "u", f"<p>{PARA}</p>", "x"), (1, "u", f"<p>{PARA}</p>", "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = extract_pages(pages).collect()
    assert sorted((r["text"], r["n_chars"]) for r in rows) == [("", 0), (PARA, len(PARA)), (PARA, len(PARA))]
    assert extract_pages(pages.limit(0)).count() == 0


def test_articles_of_the_pages_table(spark, sf_dir):
    """The pages' articles, cut out by their tags, are what is extracted, and nothing around them."""
    import html as entities
    import re

    for r in extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.DOTALL)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>?", " " , b.replace("<b>", ""))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b), r["page_id"]


BODY = f"<p>{PARA}</p><p>{PARA} Again.</p><p>{PARA} And more.</p>"
KEPT = f"{PARA}\n{PARA} Again.\n{PARA} And more."


@pytest.mark.parametrize(
    "page",
    [
        f'<article class="post category-alerts">{BODY}</article>',
        f'<article class="post tag-newsletter">{BODY}</article>',
        f'<div class="right-sidebar">{BODY}<div class="sidebar"><ul><li><a href="y">More of it</a></li></ul></div></div>',
        f'<div class="social-history">{BODY}</div>',
        f'<form action="x"><div id="c">{BODY}<input><label>Mail</label></div></form>',
        f'<div class="promo">{BODY}</div>',
        f'<article class="post comments-open">{BODY}</article>',
        f'<article>{BODY}</article><section class="comments">{BODY}{BODY}{BODY}</section>',
        f'<main>{BODY}<div class="newsletter-box"><p>{PARA}</p></div></main>',
    ],
)
def test_names_are_only_hints(page):
    assert extract(f'<body><nav><a href="x">Home</a></nav>{page}<footer>All rights</footer></body>') == KEPT


def test_letters_that_grow_when_lowered_and_page_size():
    head = f'<script>var a = "{"İ" * 12}";</script>'
    for filler in ("", "<!-- " + "x" * 5000 + " -->"):
        assert extract(f"<body>{head}{filler}{BODY}</body>") == KEPT
