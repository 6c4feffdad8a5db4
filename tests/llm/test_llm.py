"""The training-data operators on edge cases and against brute force."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import duckdb  # noqa: E402

from sortwell.llm import bpe, chat_repair, cnn, ego, exact_dedup, html_density, keep, mixing, qda, simhash, token_histogram  # noqa: E402
from sortwell.llm.queries import oracle_sql, queries  # noqa: E402

DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and very long texts, repeated rows, ties.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one two", "en", "a", 7), (5, "one  two", "de", "b", 8), (6, "one\ntwo", None, "b", 7), (7, "One two", "en", None, 7),
    (7, "One two", "en", None, 7), (8, "word " * 30000, "en", "a", 150000), (None, "one two", "en", "a", 7), (9, "x" * 70000, "en", "b", 70000), (10, "naïve café ｆｕｌｌ   日本語 🙂 <|endoftext|> done", "fr", "b", 40), (11, " ", "fr", "b", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit(1)).withColumn("row", F.lit("x")).withColumn("group_n", F.lit(2)).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = c.sql(oracle_sql()[name])
    got = queries()[name](spark, DIR)
    cols = sorted(got.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    a = sorted(repr([plain(r[x]) for x in cols]) for r in got.collect())
    assert a == sorted(repr([plain(dict(zip(want.columns, r, strict=True))[x]) for x in cols]) for r in want.fetchall())


# 1, 8


def test_bpe(spark, odd, none):
    t = Tokenizer.from_file(PATH)
    rows = bpe.encode_decode(odd, PATH).collect()
    want = sorted((str(i), t.encode(x or "", add_special_tokens=False).ids) for i, x, *_ in ODD)
    assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == want
    assert sorted(r.decoded for r in rows) == sorted(t.decode(i, skip_special_tokens=False) for _, i in want)
    assert bpe.encode_decode(none, PATH).count() == 0
    d = bpe.digests(bpe.encode_decode(odd.where("doc_id = 4"), PATH)).first()
    ids = t.encode("one two", add_special_tokens=False).ids
    assert (d.n_tokens, d.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_bpe_chunks_agree_with_the_whole_text():
    t, c, r = Tokenizer.from_file(PATH), bpe.ChunkCoder(PATH), random.Random(1)
    parts = ["a", "b ", "  ", "\n", "\n\n ", "'s", "'ll", "é", "日本", "1", " <|endoftext|>", "###", "the", "  of", "\t", "🙂", " ", "'", "!? ", "ß"]
    for _ in range(150):
        x = "".join(r.choice(parts[: r.randint(3, len(parts))]) for _ in range(r.randint(0, 4000)))
        ids = t.encode(x, add_special_tokens=False).ids
        assert c.encode(x).tolist() == ids and c.decode(np.array(ids, np.uint32)) == t.decode(ids, skip_special_tokens=False)
    shared = " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(3000))
    before = c.reused
    for k in range(5):
        x = f"Head {k} of this one. " * k + shared
        assert c.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids
    assert c.reused > before


def test_bpe_keeps_chunks_by_bytes(monkeypatch):
    c, r = bpe.ChunkCoder(PATH), random.Random(2)
    text = "".join(r.choices("abcdefgh", k=400_000))
    for k in range(12):  # texts without a place to cut
        ids = c.encode(chr(97 + k) + text)
        assert c.decode(ids) == chr(97 + k) + text
    monkeypatch.setattr(bpe, "KEEP_BYTES", 50_000)
    c = bpe.ChunkCoder(PATH)
    for _ in range(60):
        c.encode(" ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(800)))
        for table in (c.young, c.old):
            assert sum(len(x) + got[0].nbytes for x, got in table.items()) <= 50_000
            assert all(len(x) <= bpe.KEEP_CHUNK for x in table)
    assert c.seen > 200


def test_histogram(spark, odd, none):
    t = Tokenizer.from_file(PATH)
    n = np.array([len(t.encode(x or "", add_special_tokens=False).ids) for _, x, *_ in ODD])
    h = token_histogram.length_histogram(odd, PATH)
    for r in h.collect():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.truncated_total) == ((n == r.n_tokens).sum(), (n >= r.n_tokens).sum(), n[n >= r.n_tokens].sum(), np.minimum(n, r.n_tokens).sum())
    assert [(r.limit, r.total, r.docs_cut) for r in token_histogram.truncated_totals(h, [0, 3, 10**9]).collect()] == [(k, np.minimum(n, k).sum(), (n > k).sum()) for k in (0, 3, 10**9)]
    assert [r.n_tokens for r in token_histogram.length_quantiles(h, [0.5, 1.0]).collect()] == np.quantile(n, [0.5, 1.0], method="inverted_cdf").tolist()
    assert token_histogram.length_histogram(none, PATH).count() == 0


# 2


def test_mixing(spark, odd, none):
    rows = mixing.mix(odd).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", x or "")) for i, x, *_ in ODD}
    assert len(rows) == len(ODD) and all(r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size for r in rows)
    source = {i: s for i, _, _, s, _ in ODD}
    got = {}
    for r in rows:
        t, w = got.setdefault(source[r.doc_id], [r.target, 0])[0], got[source[r.doc_id]]
        w[1] += r.taken
        assert t == r.target <= 2 * r.source_size
    assert all(abs(t - w) <= 2 for t, w in got.values())
    assert abs(sum(t for t, _ in got.values()) - 1.5 * sum(r.size for r in rows)) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd.repartition(7)).collect()))
    out = mixing.materialise(odd)
    words = out.select(F.sum(mixing.n_words("text"))).first()[0]
    assert out.columns == odd.columns and words == sum(r.taken for r in rows)
    assert mixing.mix(none).count() == 0 and mixing.materialise(none).count() == 0


def plain_mix(docs):
    """(id, taken, times, extra) of (id, text, source), from the definition, one document after another."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    place = lambda i, t: int(hashlib.md5(f"17:{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
    by_source = {}
    for i, t, s in docs:
        by_source.setdefault(s, []).append((place(i, t), i, words(t)))
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    size = {s: sum(n for *_, n in by_source[s]) for s in names}
    target, open_ = {}, set(names)
    while True:
        rest = 1.5 * sum(size.values()) - sum(target.values())
        over = {s for s in open_ if weight[s] * rest / sum(weight[x] for x in open_) > 2 * size[s]}
        if not over:
            break
        target |= {s: 2.0 * size[s] for s in over}
        open_ -= over
        if not open_:
            break
    for s in open_:
        target[s] = min(2.0 * size[s], weight[s] * rest / sum(weight[x] for x in open_))
    out = []
    for s in names:
        epochs = int(target[s] // size[s]) if size[s] else 0
        missing = math.floor(target[s] - epochs * size[s] + 0.5)
        if size[s] and missing >= size[s]:
            epochs, missing = epochs + 1, 0
        at = {}
        for u, _, n in by_source[s]:
            at[u] = at.get(u, 0) + n
        before, total = {}, 0
        for u in sorted(at):
            before[u], total = total, total + at[u]
        nth = {}
        for u, i, n in by_source[s]:
            once = missing > 0 and before[u] + at[u] <= missing
            k = nth[u] = nth.get(u, -1) + 1
            part = max(0, min(n, missing - before[u] - k * n)) if missing > 0 and at[u] and before[u] <= missing < before[u] + at[u] else 0
            out.append((i, (epochs + once) * n + part, epochs + once, part))
    return out


def test_mixing_against_a_plain_one(spark, monkeypatch):
    r = random.Random(9)
    docs = [(i if i % 40 else None, None if i % 17 == 0 else " ".join(["w"] * r.choice([0, 1, 3, 50, 400])), r.choice(["a"] * 6 + ["b", "c", "d", None])) for i in range(150)]
    docs += [docs[5]] * 3 + [(900, "x y", "tiny"), (901, "", "none"), (902, None, "none")]
    clash = ("row", "id", "u", "p_cut", "cut", "_times", "_whole", "_extra", "_s", "times", "words", "whole", "epochs", "_way")
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], DOCS).withColumns({c: F.lit(77) for c in clash})
    want = plain_mix(docs)
    for few in (mixing.FEW_SOURCES, 0):
        monkeypatch.setattr(mixing, "FEW_SOURCES", few)
        got = [(x.doc_id, x.taken, x.times, x.extra) for x in mixing.mix(df).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
        out = mixing.materialise(df)
        assert out.columns == df.columns and {tuple(x[c] for c in clash) for x in out.collect()} == {(77,) * len(clash)}
        copies = {}
        for i, _, times, extra in want:
            copies[i] = copies.get(i, 0) + times + (extra > 0)
        held = {}
        for x in out.collect():
            held[x.doc_id] = held.get(x.doc_id, 0) + 1
            assert x.n_chars == len(x.text or "")
        assert held == {i: n for i, n in copies.items() if n}
    assert all(times + (extra > 0) <= 2 for _, _, times, extra in want)


def test_mixing_meets_the_target_without_ids(spark):
    """Rows that repeat, with null ids and equal texts, share one place; none of their words is lost."""
    rows = [(None, "word", "en", "a", 4)] * 1000 + [(7, "two words", "en", "b", 9)] * 500 + [(None, f"w{k} x", "en", "c", 0) for k in range(300)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = mixing.mix(df).groupBy("target").agg(F.sum("taken").alias("taken"), F.max("times").alias("times")).collect()
    assert len(got) == 3 and all(abs(r.target - r.taken) <= 0.5 for r in got)
    assert sum(len(x.text.split()) for x in mixing.materialise(df).collect()) == sum(r.taken for r in got)


def test_mixing_of_sources_without_words(spark):
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", "b", 0)], DOCS)).collect()] == [0, 0]


def test_mixing_rounded_up_to_a_whole_repetition(spark):
    one = spark.createDataFrame([(1, "word", "en", "a", 4)], DOCS)
    for share, taken in ((0.6, 1), (1.7, 2)):
        assert [(r.target, r.taken) for r in mixing.mix(one, share=share).collect()] == [(share, taken)]
        assert [r.text for r in mixing.materialise(one, share=share).collect()] == ["word"] * taken
    # targets 2, 0.83 and 1.67 words
    small = [(i, "word", "en", s, 4) for i, s in enumerate("abc")]
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", small)
    got = mixing.mix(spark.createDataFrame(small, DOCS)).collect()
    assert {r.doc_id: r.taken for r in got} == {r[0]: r[4] for r in c.sql(mixing.OP2_SQL).fetchall()} == {0: 2, 1: 1, 2: 2}


# 3


HTML = {
    None: "", "": "", "plain text": "plain text", "<p>a<p>b": "a\nb", "<div>x<br>y</div><script>z</script>": "x y", "<![CDATA[x]]>y&nbsp;&eacute;&#x41;&amp;lt;<!-- c -->z": "y éA&lt;z", "<table><tr><td>1<td>2<tr><td>3</table>": "1\n2\n3",
    "<body class='has-sidebar'><nav><a href=x>menu</a></nav><div id=main><h1>Head</h1><div class=body><p>" + "long text here " * 30 + "</p><p>short</p></div><div class='comments'><p>" + "reader says " * 90
    + "</p></div></div><aside>side</aside><form>f<input></form><footer>foot</footer></body>": "Head\n" + ("long text here " * 30).strip() + "\nshort",
    "<article><header><h1>T</h1></header><p>one</p><footer>by me</footer></article>": "T\none", "<article>" + "<p>w w</p>" * 3000 + "</article>": "\n".join(["w w"] * 3000),
}


def test_html(spark):
    pages = spark.createDataFrame([(i, h, "x") for i, h in enumerate(HTML)], "page_id long, html string, text string")
    got = {r.row.page_id: r.text for r in html_density.extract(pages).collect()}
    assert got == dict(enumerate(HTML.values()))
    assert html_density.extract(pages.where("false")).count() == 0


def test_html_text_beside_child_blocks():
    words = lambda n, w="word": " ".join([w] * n)
    items = "".join(f"<li>{words(25, 'item')}</li>" for _ in range(5))
    listed = "\n".join([words(25, "item")] * 5)
    loose = "<br>".join([words(100)] * 5)
    for outer in ("article", "div", "td"):
        page = f"<body><{outer}>{loose}<ul>{items}</ul></{outer}></body>"
        if outer == "td":
            page = page.replace("<td>", "<table><tr><td>").replace("</td>", "</td></tr></table>")
        assert html_density.main_text(page) == words(500) + "\n" + listed
    # short lines beside a list, in a block of their own as well
    lines = "<br>".join([words(10)] * 50)
    assert html_density.main_text(f"<body><article>{lines}<ul>{items}</ul></article></body>") == words(500) + "\n" + listed
    assert html_density.main_text(f"<body><div>{lines}</div><ul>{items}</ul></body>") == words(500) + "\n" + listed
    # text less than the list's is content by its own density, before and after it
    assert html_density.main_text(f"<body><article>{words(60)}<ul>{items}</ul>{words(50)}</article></body>") == words(60) + "\n" + listed + "\n" + words(50)


def test_html_names_are_no_proof():
    text = html_density.main_text
    long, more = "long text here " * 30, "more text there " * 30
    a, b = long.strip(), more.strip()
    story = f"<p>{long}</p><p>{more}</p>"
    assert text(f"<article><h2 id='Advertising'>Advertising</h2><p>{long}</p><section id='discussion'><h2>4. Discussion</h2><p>{more}</p></section></article>") == f"Advertising\n{a}\n4. Discussion\n{b}"
    for name in ("id='related-work'", "id='login-flow'", "id='social-impact'", "class='hidden-print'", "class='hidden-xs'", "class='overflow-hidden'"):
        assert text(f"<article><p>{long}</p><div {name}><p>{more}</p></div></article>") == f"{a}\n{b}"
    assert text(f"<article><p>see <a id='sponsor'>the sponsor</a> <span id='ads'>here</span> {long}</p></article>") == f"see the sponsor here {a}"
    for name in ("layout-sidebar-right", "layout-sidebar", "sidebar"):
        for inner in (f"<article>{story}</article>", f"<main>{story}</main>", story):
            assert text(f"<body><div class='{name}'>{inner}<div class='ad'>buy</div></div></body>") == f"{a}\n{b}"
    assert text(f"<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></math> {long}</p></article>") == f"so x=2 {a}"
    assert text(f"<article><h1>Title</h1><div class='layout-sidebar'>{story}</div></article>") == f"Title\n{a}\n{b}"
    # the rest of the page is kept beside a larger named block, and names still cut
    assert text(f"<body><div><p>{long}</p></div><div class='cookie-notice'><p>{'we use ' * 300}</p></div></body>").startswith(a)
    assert text(f"<article><p>{long}</p><div class='left-sidebar'><p>side</p></div></article><div class='ad'><p>{more * 5}</p></div>") == a
    assert text(f"<div><p>{long}</p></div><section id='comments'><h2>Comments</h2><p>{more * 5}</p></section>") == a
    assert text(f"<p>one <span class='ad'>buy</span> two {long}</p>") == f"one buy two {a}"  # a word of the sentence
    assert text(f"<article><p>{long}</p><p><span class='share'>Share this</span></p><p>The <span class='share'>share price</span> rose. See <b class='notice'>this point</b></p></article>") == f"{a}\nThe share price rose. See this point"


def test_html_of_hostile_pages_is_linear():
    """What never ends takes the rest of a page; 1 MB of it takes no longer than 1 MB of text."""
    import time

    text = html_density.main_text
    story = "<p>" + "the story goes on " * 20 + "</p>"
    box = "<article><p>some words of text here</p><div class='share' id='x'><p>pass it on</p></div></article>"
    pages = {"<a " * 333_000: None, "<a x=\"" * 150_000: None, "<!-- " * 200_000: None, "</a " * 250_000: None, "<script>" * 100_000: None, box * 5000: 5000}
    for tail, lines in pages.items():
        began = time.process_time()
        got = text("<body>" + story + tail)
        assert time.process_time() - began < 5
        assert got.startswith("the story goes on") and (lines is None or got.count("\n") == lines)


def test_html_query(spark):
    rows = duckdb.sql(f"SELECT page_id, html FROM '{DIR}/pages.parquet'").fetchall()
    from html import unescape

    def article(h):
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", h, re.S)[1])
        return "\n".join(b for b in (" ".join(unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if b)

    got = {r.page_id: (r.text, r.n_chars) for r in queries()["op3_html_text_density"](spark, DIR).collect()}
    assert got == {i: (article(h), len(article(h))) for i, h in rows}


STORY = "some words of the story that run on for a while, as they do here. " * 3
ARTICLE = f"<h1>Title</h1><p>{STORY}</p><p>{STORY}{STORY}</p><p>{STORY}</p>"
ARTICLE_TEXT = "\n".join(["Title", STORY.strip(), (STORY + STORY).strip(), STORY.strip()])
MENU = "<nav><ul>" + "".join(f"<li><a href=/{i}>menu {i}</a></li>" for i in range(6)) + "</ul></nav>"


def test_html_parts_that_lists_of_names_get_wrong():
    text = html_density.main_text
    assert text(f"<body><form action=x>{MENU}<div class=c>{ARTICLE}</div><input name=q><select><option>a<option>b</select><button>Go</button></form></body>") == ARTICLE_TEXT
    assert text(f"<body>{MENU}<div><button>Go<div class=c>{ARTICLE}</div></div></body>") == ARTICLE_TEXT
    assert text(f"<body><article><h1>T</h1><p>{STORY}</p><div class='section related-work'><p>{STORY}</p></div><div class='share-price'><p>{STORY}</p></div></article></body>") == "\n".join(["T"] + [STORY.strip()] * 3)
    for comments in (f"<article class='comment'><p>{STORY}</p></article><article id='comment-5'><p>{STORY * 9}</p></article>",):
        assert text(f"<body>{MENU}<article>{ARTICLE}</article>{comments}</body>") == ARTICLE_TEXT
        assert text(f"<body>{MENU}<article>{ARTICLE}<section class=comments>{comments}</section></article></body>") == ARTICLE_TEXT
    assert text(f"<body>{MENU}{ARTICLE}<footer>c me</footer></body>") == ARTICLE_TEXT
    assert text(f"<body><div><ul><li><a href=x>a</a><li><a href=y>b</a></ul></div>{ARTICLE}<div>copyright me</div></body>") == ARTICLE_TEXT
    parts = "".join(f"<section><h2>{k}</h2>" + f"<p>{STORY}</p>" * n + "</section>" for k, n in zip("ABC", (3, 1, 2)))
    assert text(f"<body>{MENU}<div>{parts}</div><div>buy now</div></body>") == "\n".join(x for k, n in zip("ABC", (3, 1, 2)) for x in [k] + [STORY.strip()] * n)


def test_html_density_finds_the_article_without_names():
    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    tried = 0
    for (h,) in rows:
        plain = re.sub(r"<(/?)(nav|article|footer|header|aside|main|section)\b[^>]*>", r"<\1div>", h)
        plain = re.sub(r'\s(class|id|role)="[^"]*"', "", plain)
        want = html_density.main_text(h)
        rest = re.sub(r"<[^>]*>", "", re.sub(r"(?s)<head>.*?</head>|<nav>.*?</nav>|<article>.*</article>", "", h))
        if len(want) > 2 * len(rest):  # an article shorter than the loose text around it looks like that
            tried += 1
            assert html_density.main_text(plain) == want
    assert tried > 0.9 * len(rows)


def test_html_without_density_is_another_text(monkeypatch):
    rows = duckdb.sql(f"SELECT html FROM '{DIR}/pages.parquet'").fetchall()
    with_density = [html_density.main_text(h) for (h,) in rows]
    monkeypatch.setattr(html_density, "composite_density", lambda *_: 0.0)
    assert all(html_density.main_text(h) != t for (h,), t in zip(rows, with_density, strict=True))


def test_html_densities_against_plain_counts():
    from xml.etree import ElementTree

    page = f"<body><div><ul><li><a>menu one</a></li><li><a>menu</a></li></ul></div><div><p>{STORY}<b>bold</b> <a>link</a></p><p>{STORY}<br/>more</p><ul><li>one</li><li>two words</li></ul></div><p>end</p></body>"
    tree = ElementTree.fromstring(page)
    chars = lambda e: len("".join("".join(e.itertext()).split()))
    links = lambda e: sum(chars(a) for a in e.iter("a"))
    body = (chars(tree), links(tree))

    def density(e):
        c, t, lc, lt = chars(e), sum(1 for _ in e.iter()), links(e), sum(1 for _ in e.iter("a"))
        base = math.log(c / max(1, c - lc) * lc + body[1] / body[0] * c + math.e)
        return c / t * math.log(max(1, c / max(1, lc) * t / max(1, lt))) / math.log(base)

    parsed = html_density.Page()
    parsed.feed(page)
    parsed.close()
    nodes = html_density._in_order(parsed.body)
    html_density._total(nodes)
    html_density._measure(parsed.body, {})
    elements = [e for e in tree.iter() if e.tag in html_density.BLOCK]
    assert [n.tag for n in nodes] == [e.tag for e in elements]
    for n, e in zip(nodes, elements, strict=True):
        assert n.density == pytest.approx(density(e))
        if n.children and n is not nodes[0]:
            assert n.sum == pytest.approx(sum(density(x) for x in e if x.tag in html_density.BLOCK))


# 4


def cheapest(roles):
    """The least cost over all ways, by trying every assignment of roles, merges and insertions."""
    best = {0: 0}
    for r in roles:
        nxt = {}
        for s, c in best.items():
            for run in itertools.chain.from_iterable(itertools.product((1, 2, 3), repeat=k) for k in range(4)):
                at, ok = s, True
                for t in run:
                    ok, at = ok and t in chat_repair.NEXT[at], t
                if not ok:
                    continue
                for t in (1, 2, 3):
                    extra = chat_repair.INSERT * len(run) + chat_repair.RELABEL * (chat_repair.role_number(r) != t - 1)
                    if at == t:
                        nxt[t] = min(nxt.get(t, 10**9), c + extra + chat_repair.MERGE)
                    if t in chat_repair.NEXT[at]:
                        nxt[t] = min(nxt.get(t, 10**9), c + extra)
        best = nxt
    return min(c + chat_repair.ending(s) for s, c in best.items())


def test_chat(spark, monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(chat_repair, "CHUNK_TURNS", 8)
    sizes = [r.choice([1, 2, 3, 6]) for _ in range(40)] + [700]
    data = [(None if c == 3 else c, r.randint(0, 3) if c == 5 else i, r.choice(["user", "assistant", " System", "tool", None]), r.choice([None, "", f"t{i}"]), "z") for c, n in enumerate(sizes) for i in range(n)]
    data += [(50, 1, "user", "same", "z")] * 2 + [(51, None, "assistant", "x" * 300000, "z"), (51, 1, "user", "b", "z")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, cost string").repartition(4)
    df = df.withColumns({c: F.lit("x") for c in ("conv", "part", "no", "open", "place", "draw", "rendered")})
    rows = chat_repair.format_chats(df).collect()
    assert len(rows) == len(data)
    place = {(r.role, r.text): r.h for r in df.select("role", "text", F.xxhash64("role", "text").alias("h")).distinct().collect()}
    rank = lambda x: (x[1] is not None, x[1] or 0, place[x[2], x[3]], x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")
    for c in {d[0] for d in data}:
        turns = sorted((d for d in data if d[0] == c), key=rank)
        mine = [x for x in rows if x.conv_id == c]
        assert sum(x.cost for x in mine) == cheapest([t[2] for t in turns])
        want = chat_repair.repair([t[1:4] for t in turns])
        assert sorted(x.rendered for x in mine) == sorted(w[4] for w in want)
        seq = re.findall(r"<\|im_start\|>(\w+)", "".join(w[4] for w in want))
        assert seq[0] in ("system", "user") and seq[-1] == "assistant" and all(b == {"system": "user", "user": "assistant", "assistant": "user"}[a] for a, b in zip(seq, seq[1:]))
    assert chat_repair.format_chats(df.where("false")).count() == 0


# 5, 9


def held_out(d, label, mod, rest):
    rows = duckdb.sql(f"SELECT doc_id, text, {label} FROM '{d}/documents.parquet' JOIN '{d}/labels.parquet' USING (doc_id)").fetchall()
    return [(i, t, y, zlib.crc32(str(i).encode()) % mod == rest) for i, t, y in rows]


def test_quality(spark, odd, none):
    d = "/root/testdata/sf0.01"
    y = {i: y for i, _, y, h in held_out(d, "quality", 5, 0) if h}
    rows = {r.doc_id: r for r in queries()["op5_quality_qda"](spark, d).collect()}
    assert len(rows) == 1000 and sum(rows[i].predicted == v for i, v in y.items()) >= 0.95 * len(y)
    assert all(rows[i].held_out for i in y) and all(0 <= r.score <= 1 for r in rows.values())
    labels = spark.createDataFrame([(1, 1), (4, 1), (8, 0), (9, 0), (4, None), (99, 1)], "doc_id long, quality int")
    assert qda.quality(odd, labels).count() == len(ODD) and qda.quality(none, labels).count() == 0
    assert {r.score for r in qda.quality(odd, labels.where("quality = 1")).collect()} == {1.0}
    assert {r.score for r in qda.quality(odd, labels.where("quality = 0")).collect()} == {0.0}
    assert {r.score for r in qda.quality(odd, labels.where("false")).collect()} == {0.0}
    again = qda.quality(odd.union(odd), labels.union(labels)).groupBy("doc_id").agg(F.countDistinct("score").alias("n")).collect()
    assert {r.doc_id: r.n for r in again if r.doc_id not in (7,)} == {i: 1 for i, *_ in ODD if i != 7}


def test_quality_statistics_against_plain_counts():
    texts = ["", "one", "A b, C d. E! 12 | x", "Ünï cödé wörds; and and and.\n\nline two\nline two\n", "word " * 500, "a|b\tc#d $e\n" * 40]
    for t in texts:
        w, b = t.encode().split(), t.encode()
        shown = max(1, sum(c not in b" \t\n\r\x0b\x0c" for c in b))
        count = lambda chars: sum(c in chars for c in b)
        in_bytes = lambda k, usual: math.log((k + qda.MORE_BYTES * usual) / (shown + qda.MORE_BYTES) + 1e-3)
        in_words = lambda k, usual: math.log((k + qda.MORE_WORDS * usual) / (len(w) + qda.MORE_WORDS) + 1e-3)
        distinct = lambda xs: math.log((len(set(xs)) + qda.MORE_WORDS) / (len(xs) + qda.MORE_WORDS))
        want = {
            "word_length": in_words(shown, 5.0), "marks": in_bytes(count(b"#$%&*@~^_=+<>{}[]\\`"), 0), "pipes": in_words(count(b"|"), 0), "capitals": in_bytes(count(bytes(range(65, 91))), 0.03), "bangs": in_words(count(b"!?"), 0),
            "digits": in_bytes(count(b"0123456789"), 0), "stops": in_words(count(b"."), 0.1), "commas": in_words(count(b",;:"), 0.07), "distinct_words": distinct(w), "distinct_pairs": distinct(list(zip(w, w[1:]))),
            "distinct_lines": distinct([x for x in b.split(b"\n") if x.strip()]), "short_words": in_words(sum(len(x) <= 3 for x in w), 0.3), "other_bytes": in_bytes(sum(c > 127 for c in b), 0.02),
        }
        assert dict(zip(qda.STATISTICS, qda.statistics(t))) == pytest.approx(want)


def test_quality_pairs_cover_the_whole_text():
    loop = [b"w%d" % i for i in range(100)]
    assert qda.distinct_pairs(loop * 10_000) == 100
    r = random.Random(3)
    words = [b"w%d" % r.randrange(500) for _ in range(2 * qda.SPAN + 7)]
    assert qda.distinct_pairs(words) == len(set(zip(words, words[1:])))
    at = qda.STATISTICS.index("distinct_pairs")
    text = b" ".join(loop).decode() + " "
    assert qda.statistics(text * 2000)[at] == pytest.approx(math.log((100 + qda.MORE_WORDS) / (199_999 + qda.MORE_WORDS)))


def test_quality_scores_are_density_differences():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 1, (200, 3)), r.normal(1, 2, (300, 3))])
    y = np.repeat([0, 1], [200, 300])
    m = qda.discriminant(np.array([200.0, 300.0]), np.stack([x[y == k].sum(0) for k in (0, 1)]), np.stack([x[y == k].T @ x[y == k] for k in (0, 1)]))
    out = []
    for k in (0, 1):
        cov = m.factors[k] @ m.factors[k].T
        d = x - m.means[k]
        out.append(math.log((200, 300)[k] / 500) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(m.log_ratio(x), out[1] - out[0])


def test_toxicity(spark, odd, none):
    d = "/root/testdata/sf0.1"
    y = {i: y for i, _, y, h in held_out(d, "toxic", 4, 2) if h}
    rows = {r.doc_id: r for r in queries()["op9_toxicity_cnn"](spark, d).collect()}
    bad = [i for i, v in y.items() if v]
    assert sum(rows[i].predicted for i in bad) >= 0.85 * len(bad)
    assert sum(rows[i].predicted for i in y if not y[i]) <= 0.03 * len(y)
    assert all(rows[i].held_out for i in y) and all(0 <= r.score <= 1 for r in rows.values())
    one = spark.createDataFrame([(4, 1), (5, 1)], "doc_id long, toxic int")
    assert cnn.train(odd, one) is None and {r.score for r in cnn.score(odd, None).collect()} == {0.0}
    m = cnn.fit([cnn.featurise(t)[0] for t in ["bad awful thing", "good nice thing"] * 8], np.zeros(16, int), np.array([1, 0] * 8, np.float32), 0.5)
    got = cnn.score(odd, m).select("row.*", F.col("score").alias("s")).collect()
    assert len(got) == len(ODD) and all(0 <= r.s <= 1 for r in got) and cnn.score(none, m).count() == 0


def small_model(seed=1):
    r = np.random.default_rng(seed)
    n = len(cnn.WIDTHS) * cnn.FILTERS
    tables = [r.normal(0, 1, (k, cnn.DIM)) for k in (cnn.WORD_BUCKETS, cnn.WORD_BUCKETS, cnn.PREFIX_BUCKETS)]
    for t in tables:
        t[0] = 0
    return cnn.Model(tables, r.normal(0, 1, (cnn.DIM, sum(cnn.WIDTHS) * cnn.FILTERS)), r.normal(0, 1, n), r.normal(0, 1, n), 0.3, np.zeros(len(cnn._LANGS) + 1))


def some_words(r, n):
    return np.column_stack([r.integers(1, k, n) for k in (cnn.WORD_BUCKETS, cnn.WORD_BUCKETS, cnn.PREFIX_BUCKETS)]).astype(np.int32)


def plain_loss(m, docs, y, shown):
    """The loss, window by window; a window starts at a shown word and sees left-out words and those past the end as zeros."""
    total = 0.0
    for d, label, s in zip(docs, y, shown, strict=True):
        v = [m.tables[0][a] + m.tables[1][b] + m.tables[2][c] if there else np.zeros(cnn.DIM) for (a, b, c), there in zip(d, s, strict=True)]
        z, at = m.out_bias, 0
        for k, width in enumerate(cnn.WIDTHS):
            for f in range(cnn.FILTERS):
                acts = [sum(v[i + o] @ m.kernel[:, at + o * cnn.FILTERS + f] for o in range(width) if i + o < len(v)) for i in range(len(v)) if s[i]]
                if acts:
                    z += max(0.0, max(acts) + m.bias[k * cnn.FILTERS + f]) * m.out[k * cnn.FILTERS + f]
            at += width * cnn.FILTERS
        total += math.log1p(math.exp(-z if label else z))
    return total


@pytest.mark.parametrize("span", [cnn.SPAN, 4])
def test_convolution_and_gradients_against_plain_loops(monkeypatch, span):
    monkeypatch.setattr(cnn, "SPAN", span)
    r = np.random.default_rng(4)
    m = small_model()
    docs = [some_words(r, n) for n in (1, 2, 7, 12, 5)]
    docs[3][5] = docs[3][6]
    y = np.array([1, 0, 1, 0, 1.0])
    every = [np.ones(len(d), bool) for d in docs]
    for d, z in zip(docs, m.logits(docs), strict=True):
        assert math.log1p(math.exp(-z)) == pytest.approx(plain_loss(m, [d], [1], [np.ones(len(d), bool)]), rel=1e-4)
    for shown in (every, [r.random(len(d)) > 0.4 for d in docs], [np.zeros(len(d), bool) for d in docs]):
        (kernel, bias, out), out_bias, tables = cnn.gradients(m, docs, y, shown)

        def slope(array, at, h=1e-5):
            was = array[at]
            array[at] = was + h
            up = plain_loss(m, docs, y, shown)
            array[at] = was - h
            down = plain_loss(m, docs, y, shown)
            array[at] = was
            return (up - down) / (2 * h)

        for array, got in ((m.kernel, kernel), (m.bias, bias), (m.out, out)):
            for at in list(np.ndindex(array.shape))[::7]:
                assert got[at] == pytest.approx(slope(array, at), abs=2e-4)
        for t, (where, g) in enumerate(tables):
            for k in range(0, len(where), 3):
                if where[k]:
                    assert g[k, 2] == pytest.approx(slope(m.tables[t], (where[k], 2)), abs=2e-4)
        base, h = m.out_bias, 1e-5
        losses = []
        for step in (h, -h):
            m.out_bias = base + step
            losses.append(plain_loss(m, docs, y, shown))
        m.out_bias = base
        assert out_bias == pytest.approx((losses[0] - losses[1]) / (2 * h), abs=2e-4)


def test_language_of_a_text():
    lang = lambda t: cnn.featurise(t)[1]
    assert [lang("the house of the king"), lang("der Hund und die Katze"), lang("le chat et les chiens"), lang("el perro y los gatos")] == [cnn._LANGS.index(x) for x in ("en", "de", "fr", "es")]
    assert lang("jestem bardzo zmęczony dzisiaj") == lang("") == lang(None) == cnn.UNKNOWN


def test_toxicity_learns_from_long_texts_within_its_bound(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(cnn, "fit", lambda docs, langs, y, prior: seen.update(sizes=sorted(map(len, docs)), y=sorted(y.tolist())) or small_model())
    docs = spark.createDataFrame([(1, "bad " * 100_000), (2, "good one"), (3, "so so"), (3, "so so"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1), (4, 1)], "doc_id long, toxic int")
    cnn.train(docs, labels)
    assert seen["sizes"][-1] == 100_000 and 0.0 in seen["y"] and 1.0 in seen["y"]
    monkeypatch.setattr(cnn, "WORDS_PER_LABEL", 3)
    cnn.train(docs, labels)
    assert sum(seen["sizes"]) <= 6 and 2 in seen["sizes"]


def test_long_texts_are_convolved_whole(monkeypatch):
    r = np.random.default_rng(1)
    ids = np.column_stack([r.integers(1, n, 500) for n in (cnn.WORD_BUCKETS, cnn.WORD_BUCKETS, cnn.PREFIX_BUCKETS)]).astype(np.int32)
    m = cnn.fit([ids[:5], ids[5:9]] * 4, np.zeros(8, int), np.array([1, 0] * 4, np.float32), 0.5)
    whole = m.pool([ids, ids[:3], ids[:0]])
    monkeypatch.setattr(cnn, "SPAN", 64)
    assert np.allclose(m.pool([ids, ids[:3], ids[:0]]), whole, atol=1e-5)


# 6


def test_exact_dedup(spark, odd, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for everything in (True, False):
        rows = exact_dedup.exact_groups(odd, digest_all=everything).collect()
        assert len(rows) == len(ODD)
        for r in rows:
            text = next(norm(t) for i, t, *_ in ODD if i == r.doc_id)
            ids = [i for i, t, *_ in ODD if norm(t) == text]
            keep = min((i for i in ids if i is not None), default=None)
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
            assert r.text_sha256 in ({hashlib.sha256(text.encode()).hexdigest()} if everything or len(ids) > 1 else {None, hashlib.sha256(text.encode()).hexdigest()})
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.keep_one(odd).columns == odd.columns


def test_exact_dedup_is_the_same_without_lookups(spark, odd, monkeypatch):
    plain = lambda df: sorted(map(repr, df.collect()))
    names = odd.withColumns({c: F.lit("x") for c in ("id", "key", "_stays", "_id", "_key", "gone_id", "len", "head", "way", "t", "least")})
    results = lambda: [plain(exact_dedup.exact_groups(odd).drop("text_sha256")), plain(exact_dedup.keep_one(names)), plain(simhash.keep_one(names))]
    first = results()
    for module in (simhash, keep):
        monkeypatch.setattr(module, "LOOKUP_ROWS", -1)
    monkeypatch.setattr(simhash, "HOT", 0)
    monkeypatch.setattr(exact_dedup, "SLOTS", 2)  # a sieve that lets nearly everything through
    monkeypatch.setattr(exact_dedup, "SLOT_WORDS", 1)
    assert first == results()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    best = {}
    for i, t, *_ in ODD:
        best[norm(t)] = min([best.get(norm(t)), i], key=lambda x: (x is None, x))
    assert sorted(r.doc_id for r in exact_dedup.keep_one(names).collect()) == sorted(best.values())


def test_exact_dedup_tells_equal_heads_apart(spark):
    a = "x" * 300
    rows = exact_dedup.exact_groups(spark.createDataFrame([(1, a + "a"), (2, a + "b"), (3, a + "a")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in rows) == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]


# 7


def test_ego(spark, monkeypatch):
    r = random.Random(6)
    base = [[r.gauss(0, 1) for _ in range(12)] for _ in range(25)]
    rows = []
    for i in range(420):
        v = [x + r.gauss(0, 0.12) for x in r.choice(base)]
        rows.append((1000 - i, v, r.choice([0, 0, 0, 1, 2])))
    rows += [(2000 + i, rows[7][1], rows[7][2]) for i in range(30)] + [(3000, [2 * x for x in rows[7][1]], rows[7][2])]
    rows += [(4000, None, 0), (4001, [], 0), (4002, [0.0] * 12, 0), (4003, [float("nan")] * 12, 0), (4004, [float("inf")] + [1.0] * 11, 0), (4005, [None] + [1.0] * 11, 0), (4006, rows[7][1], None), (4007, rows[7][1][:11], 0), (4008, [1e300] * 12, 0), (4009, [2e300] * 12, 0)]
    ok = [x for x in rows if x[2] is not None and x[1] and all(c is not None and math.isfinite(c) for c in x[1]) and any(x[1])]
    links, parent = dict.fromkeys((x[0] for x in rows), 0), {x[0]: x[0] for x in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ok, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]):
            u, v = (np.array(x[1]) / max(map(abs, x[1])) for x in (a, b))
            if u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.93:
                links[a[0]] += 1
                links[b[0]] += 1
                p, q = find(a[0]), find(b[0])
                parent[max(p, q)] = min(p, q)
    df = spark.createDataFrame([(*x, 1) for x in [*rows, (None, rows[7][1], rows[7][2])]], "vec_id long, embedding array<double>, label int, n long").repartition(3)
    df = df.withColumns({c: F.lit("x") for c in ("node", "v", "id", "block", "dim", "rep", "ok")})
    for sizes in ((512, 64, 128, 1 << 14), (8, 4, 2, 3), (16, 3, 128, 50)):
        for name, size in zip(("BLOCK", "LEAF", "TILE", "AT_ONCE"), sizes, strict=True):
            monkeypatch.setattr(ego, name, size)
        got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in ego.near_vectors(df).collect()}
        assert got == {i: (links[i], find(i), find(i) == i) for i in links} | {None: (0, None, True)}
    assert ego.near_vectors(df.where("false")).count() == 0
    # rows that repeat an id share its component
    again = ego.near_vectors(df.where("vec_id = 1000 OR vec_id = 4000").union(df.where("vec_id = 1000 OR vec_id = 4000"))).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in again) == [(1000, 1, 1000)] * 2 + [(4000, 0, 4000)] * 2


def test_intervals_find_all_links(monkeypatch):
    r = np.random.default_rng(3)
    base = r.normal(0, 1, (6, 10))
    v = base[r.integers(0, 6, 160)] + r.normal(0, 0.2, (160, 10))
    w = r.integers(1, 4, 160)
    u = ego.unit(v)
    axes = ego.principal(list(v))
    p = ego.project(u, axes)
    order = np.lexsort(np.floor(p / 0.3).T[::-1])
    v, w, u, p = v[order], w[order], u[order], p[order]
    linked = u @ u.T >= 0.93
    np.fill_diagonal(linked, False)
    for leaf, at_once in ((64, 1 << 14), (5, 7), (1, 3), (300, 2)):
        monkeypatch.setattr(ego, "LEAF", leaf)
        monkeypatch.setattr(ego, "AT_ONCE", at_once)
        one = (v, p, w)
        whole = ego.IntervalJoin(one, one, 0.93)
        assert whole.counts.tolist() == (linked @ w).tolist()
        for a in range(160):
            assert all(whole.comp[a] == whole.comp[b] for b in np.flatnonzero(linked[a]))
        assert len(set(whole.comp.tolist())) == 160 - np.linalg.matrix_rank(np.diag(linked.sum(1)) - linked.astype(float))
        left, right = (v[:90], p[:90], w[:90]), (v[90:], p[90:], w[90:])
        split = ego.IntervalJoin(left, right, 0.93)
        assert split.counts.tolist() == (linked[:90, 90:] @ w[90:]).tolist() + (linked[:90, 90:].T @ w[:90]).tolist()


# 10


def plain_fingerprint(text):
    import xxhash

    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd, none):
    rows = simhash.near_groups(odd).collect()
    for r in rows:
        assert r.fp % 2**64 == plain_fingerprint(next(t for i, t, *_ in ODD if i == r.doc_id))
    ids = {r.doc_id: r.component_id for r in rows}
    assert ids[1] == ids[2] == ids[3] == 1 and ids[7] == ids[4] == ids[6] == ids[None] == 4
    assert simhash.near_groups(none).count() == 0 and simhash.keep_one(odd).columns == odd.columns


def test_multi_index_finds_all_links(spark):
    r = random.Random(8)
    fps = {r.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    for f in list(fps):
        for _ in range(12):
            g = f
            for b in r.sample(range(64), r.randint(1, 4)):
                g ^= 1 << b
            fps.add(g)
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    got = [tuple(x) for x in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()]
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3}
    assert set(got) == want


@pytest.mark.parametrize("hot", [0, 3, 64])
def test_links_of_values_that_many_share(spark, monkeypatch, hot):
    """Families that share a half, with links within and between values of a ball, each found once."""
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(21)
    fps = set()
    for half in (r.getrandbits(32), r.getrandbits(32)):
        for _ in range(60):
            low = r.getrandbits(32)
            for _ in range(5):
                f = (half << 32) | low
                for b in r.sample(range(64), r.randint(0, 3)):
                    f ^= 1 << b
                fps.add(f)
                fps.add((f >> 32) | ((f & 0xFFFFFFFF) << 32))
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    got = [tuple(x) for x in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()]
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3}
    assert set(got) == want


def test_a_dense_family_is_compared_with_few(spark):
    """Variants with one common half are met by 48 bits."""
    n = 20_000
    fps = spark.range(n).select(F.lit(0x1234567800000000).bitwiseOR(F.xxhash64("id").bitwiseAND(F.lit(0xFFFFFFFF))).alias("fp"), F.lit(None).cast("long").alias("root")).distinct()
    for radius in (0, 1):
        assert simhash._candidates(fps, radius).count() < 50 * n


def test_families_of_fingerprints(spark):
    r = random.Random(11)
    fps = {r.getrandbits(64) for _ in range(25)}
    for f in list(fps)[:4]:  # dense families
        for a, b in itertools.combinations_with_replacement(range(0, 64, 3), 2):
            fps.add(f ^ (1 << a) ^ (1 << b))
    for _ in range(6):  # chains
        f = r.getrandbits(64)
        for _ in range(12):
            fps.add(f)
            for b in r.sample(range(64), 3):
                f ^= 1 << b
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    nodes = sorted(signed(f) for f in fps)
    parent = {f: f for f in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if ((a ^ b) % 2**64).bit_count() <= 3:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = {x.fp: x.root for x in simhash.fingerprint_groups(spark.createDataFrame([(f,) for f in nodes], "fp long")).collect()}
    assert got == {f: find(f) for f in nodes}


def test_only_survivors_are_hashed_in_full(spark):
    """And no hash decides without its text; rows without ids are spread."""
    head = "h" * 300
    rows = [(k, f"alone {k} " + "x" * k, "en", "a", 0) for k in range(40)] + [(50, head + "tail", "en", "a", 0), (51, head + "liat", "en", "a", 0), (52, head + "tail", "en", "a", 0)] + [(None, "same", "en", "a", 0)] * 30
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id for r in got if r.text_sha256} == {50, 51, 52, None}
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got if r.doc_id and r.doc_id >= 50} == {(50, 50, 2), (51, 51, 1), (52, 50, 2)}
    assert [r.group_size for r in got if r.doc_id is None] == [30] * 30
    left = exact_dedup.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(str(r.doc_id) for r in left) == sorted([*map(str, range(40)), "50", "51", "None"])


def test_training_rows_are_bounded_for_each_label(spark, monkeypatch):
    monkeypatch.setattr(cnn, "ROWS_PER_LABEL", 20)
    monkeypatch.setattr(cnn, "WORDS_PER_LABEL", 300)
    held = []
    monkeypatch.setattr(cnn, "fit", lambda x, lang, y, share: held.append((x, y)))
    bad, good = "foul words here " * 3, "fair words there "
    docs = [(1, bad, "en", "a", 0)] * 3000 + [(1, bad + "." * (k % 50), "en", "a", 0) for k in range(500)] + [(2, f"{bad} {k}x " * 2, "en", "a", 0) for k in range(60)] + [(100 + k, good * (1 + k % 40), "en", "a", 0) for k in range(60)]
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), *((100 + k, 0) for k in range(60))], "doc_id long, toxic int")
    cnn.train(spark.createDataFrame(docs, DOCS).repartition(4), labels)
    x, y = held[0]
    for label in (0, 1):
        mine = [v for v, z in zip(x, y) if z == label]
        assert 1 <= len(mine) <= 20 and sum(map(len, mine)) <= 300
    assert sum(z == 1 for z in y) <= 20 and len(x) <= 40


@pytest.mark.parametrize("alphabet", ["абвгдежз", "ابتثجحخد", "一二三四五六七八", "क ख ग घ च छ ज झ".replace(" ", "")])
def test_chunks_are_reused_in_any_script(alphabet):
    r = random.Random(3)
    word = lambda: "".join(r.choice(alphabet) for _ in range(r.randint(2, 7)))
    joint = "，" if alphabet[0] == "一" else " "
    passage = joint.join(word() for _ in range(900)) + "。\n"
    texts = [joint.join(word() for _ in range(200)) + joint + passage + joint.join(word() for _ in range(100)) for _ in range(12)]
    c = bpe.ChunkCoder(PATH)
    plain = Tokenizer.from_file(PATH)
    spent = 0
    encode = c.coding.encode_to_numpy

    class Counted:
        def encode_to_numpy(self, text, **kw):
            nonlocal spent
            spent += len(text.encode())
            return encode(text, **kw)

    coding, c.coding = c.coding, Counted()
    got = [c.encode(t).tolist() for t in texts]
    c.coding = coding
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert c.reused > c.seen / 3 and spent < 1.2 * sum(len(t.encode()) for t in texts)


def test_intervals_of_wide_vectors_are_narrow(spark):
    wide = spark.createDataFrame([(b, "a", dim) for dim in (64, 1024, 100_000) for b in range(400)], "block long, label string, dim int").select("*", F.array_repeat(F.lit(0.0), ego.LEAD).alias("lo"), F.array_repeat(F.lit(0.0), ego.LEAD).alias("hi"))
    for r in ego._tiles(wide, 0.93).groupBy("dim", "a", "grp").agg(F.countDistinct("block").alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect():
        assert r.n * r.dim * 8 * ego.BLOCK <= max(ego.TILE_BYTES, r.dim * 8 * ego.BLOCK)


def test_dedup_stages_keep_one_row_of_each_text(spark):
    r = random.Random(5)
    a, b, c, d = (" ".join(r.choice("uvwxyz") * 3 + str(r.randrange(900)) for _ in range(60)) for _ in range(4))
    docs = [
        (1, a, "en", "x", 1), (1, a, "en", "x", 1), (1, a, "de", "x", 1), (5, a, "en", "x", 1),  # repeated rows and a copy
        (2, b, "en", "x", 1), (2, a, "en", "x", 1), (3, b, "en", "x", 1),  # an id of two texts, one of them a copy
        (None, b, "en", "x", 1), (None, c, "en", "x", 1), (None, c, "en", "x", 1), (None, d, "en", "x", 1), (4, d, "en", "x", 1),
    ]
    df = spark.createDataFrame(docs, DOCS)
    want = sorted(map(repr, [(1, a, "de", "x", 1), (2, b, "en", "x", 1), (None, c, "en", "x", 1), (4, d, "en", "x", 1)]))
    for keep_one in (exact_dedup.keep_one, simhash.keep_one):
        assert sorted(repr(tuple(x)) for x in keep_one(df).collect()) == want
        assert sorted(repr(tuple(x)) for x in keep_one(df.repartition(5)).collect()) == want
    assert sorted(repr(tuple(x)) for x in simhash.keep_one(exact_dedup.keep_one(df)).collect()) == want
    # one id with two texts that are not alike: both stay
    assert exact_dedup.keep_one(df.where("doc_id = 2")).count() == simhash.keep_one(df.where("doc_id = 2")).count() == 2


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline as p

    d = DIR
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    toxic = {r.doc_id for r in queries()["op9_toxicity_cnn"](spark, d).where("predicted = 1").collect()}
    left = [r for r in docs if r.doc_id not in toxic]
    seen, unique = set(), []
    for r in sorted(left, key=lambda r: r.doc_id):
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        if t not in seen:
            seen.add(t)
            unique.append(r)
    fps, kept = [(plain_fingerprint(r.text), r) for r in unique], []
    parent = list(range(len(fps)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a][0] ^ fps[b][0]).bit_count() <= 3:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    kept = [fps[i][1] for i in range(len(fps)) if find(i) == i]
    t = Tokenizer.from_file(PATH)
    take = {i: (times, extra) for i, _, times, extra in plain_mix([(r.doc_id, r.text, r.source) for r in kept])}
    want = []
    for r in kept:
        n = len(t.encode(r.text, add_special_tokens=False).ids)
        times, extra = take[r.doc_id]
        want += [(r.doc_id, n)] * times
        if extra:
            part = re.match(r"\s*(?:\S+\s+){%d}\S+" % (extra - 1), r.text)[0]
            want.append((r.doc_id, len(t.encode(part, add_special_tokens=False).ids)))
    got = [(r.doc_id, r.n_tokens) for r in p.run(spark, d).collect()]
    assert sorted(got) == sorted(want) and len(p.STAGES) == 5
