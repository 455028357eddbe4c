import random
import time
from collections import Counter

from shelfspark.llm import html_wrappers as h


def page(*parts, body="<body>"):
    return f"<html><head><title>t</title></head>{body}<div>{''.join(f'<p>{p}</p>' for p in parts)}</div></body></html>"


def extract(spark, pages):
    df = spark.createDataFrame([(i, f"http://{host}/{i}", html) for i, (host, html) in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    return {r["page_id"]: r["text"] for r in h.extract_main_text(df).collect()}


def test_texts_of_every_page_are_template_text_as_brute_force_says(spark):
    rng, pages, rows = random.Random(3), [], []
    for k in range(40):
        parts = [f"{rng.random()} own {i} " + "word " * 9 + "end" for i in range(rng.randint(1, 6))]
        parts = ["Please accept our notice", *parts, *(["An offer for you"] if k % 4 else []), "Call us today"]
        pages.append(("a.net", page(*parts)))
        rows.append(parts)
    shared = Counter(p for parts in rows for p in parts)
    got = extract(spark, pages)
    own = {k: [p for p in parts if shared[p] < 20] for k, parts in enumerate(rows)}
    assert got == {k: " ".join(own[k] if 2 * sum(map(len, own[k])) >= sum(map(len, parts)) else parts) for k, parts in enumerate(rows)}
    assert sum(own[k] != parts and got[k] == " ".join(own[k]) for k, parts in enumerate(rows)) >= 35


def test_the_alignment_decides(spark, monkeypatch):
    pages = [("a.net", page("notice", f"text {k}")) for k in range(6)]
    assert set(extract(spark, pages).values()) == {f"text {k}" for k in range(6)}
    alone = [h.structure(h.blocks(html)) for _, html in pages]
    assert all(h.template_texts(w) == frozenset() for w in alone)  # one page tells nothing


def test_repeated_rows_and_hosts_of_one_text_lose_nothing(spark):
    same = page("one", "two")
    got = extract(spark, [("a.net", same)] * 5 + [("b.net", page("one", f"x{k}")) for k in range(2)])
    assert [got[k] for k in range(7)] == ["one two"] * 5 + ["one x0", "one x1"]


def test_the_nearest_element_tells(spark):
    article = "<article><p>kept</p><div class='share'>gone</div></article>"
    pages = [("a.net", f'<body class="no-sidebar">{article}</body>'), ("b.net", f'<body><div class="post search-result">{article}</div><aside>gone</aside></body>'), ("c.net", '<body><div class="no-ads"><p>kept</p></div><div class="ads">gone</div></body>')]
    assert set(extract(spark, pages).values()) == {"kept"}


def test_copies_of_an_article_keep_it(spark):
    story = [f"paragraph {i} " + "of the story " * 20 for i in range(4)]
    got = extract(spark, [("a.net", page(*story, f"read {k} times")) for k in range(3)])
    assert got == {k: " ".join([*(" ".join(p.split()) for p in story), f"read {k} times"]) for k in range(3)}


def test_names_and_headers_of_articles_lose_nothing(spark):
    long = "The story itself, which is longer than the teaser beside it by far."
    pages = [
        ("a.net", "<body><div class='social-post'><div class='text'><p>the story</p></div></div><div class='social-share'>gone</div></body>"),
        ("b.net", "<body><article><p>the story</p><div data-class='ad'><p>goes on</p></div></article></body>"),
        ("c.net", "<body><header>gone</header><article><header><h1>Title</h1><div class='share'>gone</div></header><p>the story</p><footer>gone</footer></article></body>"),
        ("d.net", f"<body><nav>gone</nav><div class='page'><p>{long}</p></div><article><p>Teaser</p></article></body>"),
        ("e.net", f"<body><p>Menu</p><article><p>{long}</p></article></body>"),
    ]
    assert extract(spark, pages) == {0: "the story", 1: "the story goes on", 2: "Title the story", 3: f"{long} Teaser", 4: long}


def test_unclosed_markup_takes_linear_time():
    for piece in ('<a "', "<div>", "<!--", "<p", "</x>", "<script>", "<ul><li>"):
        began = time.time()
        h.blocks(piece * (1_000_000 // len(piece)))
        assert time.time() - began < 10, piece


def test_alignment_makes_slots_options_and_repeats():
    import json

    whole = h.structure(h.blocks(page("n", "a 0")))
    for k in range(1, 60):
        whole = h.align(whole, h.structure(h.blocks(page("n", *[f"{k} {i}" for i in range(1 + k % 3)], *(["o"] if k % 2 else [])))))
    pages, items = json.loads(whole)
    n, *rest = items
    assert pages == 60 and n[1] == h.said("n") and n[4] == 60 and not n[2]
    assert any(i[1] is None and i[3] for i in rest) and any(i[1] == h.said("o") and i[2] and i[4] >= 25 for i in rest)
