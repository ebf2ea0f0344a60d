"""Articles of made hosts: with and without main elements, copies, comments, teasers, deep pages."""

import time
import tracemalloc

import pytest
from folioscope.llm import template_extraction

SCHEMA = "page_id long, url string, html string"


def extracted(spark, rows, options=None):
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {row.page_id: row.text for row in template_extraction.extract(pages, options).collect()}


def prose(n, words=60):
    return " ".join(f"w{n}x{place}" for place in range(words))


@pytest.mark.parametrize("copies", [9, 10, 40])
@pytest.mark.parametrize("name", ["main", "div"])
def test_copies_of_a_page_keep_their_article(spark, copies, name):
    html = f"<body><nav><a href='/'>Home</a></nav><{name}><p>{prose(1)}</p></{name}></body>"
    other = f"<body><nav><a href='/'>Home</a></nav><{name}><p>{prose(2)}</p></{name}></body>"
    rows = [(n, f"http://h.example/{n}", html) for n in range(copies)] + [(99, "http://h.example/x", other)]
    got = extracted(spark, rows)
    assert got == {n: prose(1) for n in range(copies)} | {99: prose(2)}


def layout(n, body, extra=""):
    """A page of a host without main elements and without telling names: only the other pages show what is template."""
    return (
        f"<html><body><div class=a1><ul><li><a href='/1'>One {n}</a><li><a href='/2'>Two</a><li><a href='/3'>Three</a></ul></div>"
        f"<div class=b2><p>Welcome to the site of the made host</p></div><div class=c3>{body}</div>{extra}"
        "<div class=d4><p>All rights with the made host</p></div></body></html>"
    )


def test_the_template_of_a_host_is_left_out(spark):
    rows = [(n, f"http://plain.example/{n}", layout(n, f"<p>{prose(n)}</p><p>and <b>more</b> {n}</p>")) for n in range(30)]
    # A layout of its own on one page, and a page with links in its text.
    rows.append((30, "http://plain.example/30", f"<html><body><section><p>{prose(30)}</p></section></body></html>"))
    rows.append((31, "http://plain.example/31", layout(31, f"<p>{prose(31)} <a href='/x'>a link in the text</a></p>")))
    got = extracted(spark, rows)
    assert got == {n: f"{prose(n)} and more {n}" for n in range(30)} | {30: prose(30), 31: f"{prose(31)} a link in the text"}
    # Without the other pages a page shows no template.
    alone = extracted(spark, rows[:1])
    assert alone[0] != got[0] and "Welcome" in alone[0]


def test_slots_of_a_template():
    pages = [layout(n, f"<p>{prose(n)}</p>") for n in range(12)]
    rows = []
    for token in {token for page in pages for _, _, _, tags in template_extraction.blocks(page) for token in tags}:
        counts = [sum(tags.count(token) for _, _, _, tags in template_extraction.blocks(page)) for page in pages]
        marks = [(n + 7) ** 3 for n in range(12)]
        vector = sum(mark * n for mark, n in zip(marks, counts))
        rows.append({"token": token, "pages": sum(map(bool, counts)), "times": sum(counts), "vector_one": vector, "vector_two": -vector})
    skeleton, fixed = template_extraction.template_of(rows, 12, template_extraction.TemplateOptions())
    known = {}
    slots = {template_extraction.slot_of(place, frozenset(skeleton), known) for place, _, _ in template_extraction.shown(pages[0])}
    # html, body, the four divisions and the list are elements of the template, each with all elements around it.
    assert fixed == [] and len(slots) == 4 and slots <= set(skeleton)


def test_what_belongs_to_an_article(spark):
    inner = (
        "<header><h1>Title</h1></header><figure><figcaption>A caption</figcaption></figure>"
        "<div class='section-header'><h2>Part one</h2></div><p class='share-price'>Price 5</p>"
        f"<p>{prose(1)}</p><div class='share-buttons'><p>Tell others</p></div><aside>aside</aside>"
        "<div class='ad'>buy</div><div class='post-comments'><article><p>first!</p></article></div>"
    )
    rows = [
        (1, "http://a.example/1", f"<body><header>Site</header><main>{inner}<article class='comment'><p>nice</p></article></main></body>"),
        (2, "http://b.example/1", f"<body><div class='post'><p>{prose(2)}</p></div><article class='card'><p>a teaser</p></article></body>"),
        (3, "http://c.example/1", f"<body><article><p>{prose(3)}</p></article><article class='comment'><p>no</p></article><div>short end</div></body>"),
    ]
    got = extracted(spark, rows)
    assert got[1] == f"Title A caption Part one Price 5 {prose(1)}"
    assert prose(2) in got[2]
    assert got[3] == prose(3)


def test_deep_pages_take_memory_by_their_length(spark):
    deep = "<div class='box row'><p>t" * 20_000
    tracemalloc.start()
    started = time.perf_counter()
    found = list(template_extraction.blocks(deep))
    assert tracemalloc.get_traced_memory()[1] < 64 << 20 and time.perf_counter() - started < 20
    tracemalloc.stop()
    assert sum(text == "t" for _, text, _, _ in found) == 20_000
    assert all(len(token) < 40 for block in found for token in block[3])
    assert extracted(spark, [(1, "http://d.example/", deep)])[1] == " ".join("t" * 20_000)
