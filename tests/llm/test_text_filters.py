"""Quality rules, HTML extraction, URL filters, language identification, decontamination."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hinspark.llm import decontam, html_extract, langid, quality_rules, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    w = WORD.findall(text or "")
    tri = list(zip(w, w[1:], w[2:]))
    n = Counter(tri)
    hit = {k for i, t in enumerate(tri) if n[t] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(docs, odd):
    for df in (docs, odd):
        got = quality_rules.judge(df.select("doc_id", "text")).select("text", *quality_rules.COUNTS, "base_failed").collect()
        assert len(got) == df.count()
        for r in got:
            want = measured(r["text"])
            assert tuple(r[c] for c in quality_rules.COUNTS) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_quality_agrees_with_labels(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    j = quality_rules.judge(docs).where("not base_failed").join(labels, "doc_id")
    assert j.where((F.col("quality") == 1) != F.col("kept")).count() <= 0.02 * j.count()


def test_quality_plan_is_native(docs):
    plan = quality_rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


@pytest.mark.parametrize("condition", ["kept", "not base_failed", "n_words > 60 and symbol_ratio < 0.1", "doc_id > 5"])
def test_quality_filter_stays_above_the_measures(docs, condition):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    whole, filtered = plan(quality_rules.judge(docs)), plan(quality_rules.judge(docs).where(condition))
    assert filtered.count("xxhash64(") == whole.count("xxhash64(") and filtered.count("split(") == whole.count("split(")
    assert filtered.index("Filter") < filtered.index("split(")


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda *w: F.length(w[0]).cast("long"), lambda *w: F.lit(1).cast("long")])
def test_repeats_when_hashes_collide(spark, hashed):
    texts = ["a b c a b c", "a b c d e f g", "x y z a b c x y z", "a a a a a", "a b", "", "aa b c dd b c aa b c ee b c"]
    df = spark.createDataFrame([(t, t.split()) for t in texts], "t string, words array<string>")
    got = {r["t"]: r["at"] for r in df.select("t", quality_rules._let(F.col("words"), lambda w: quality_rules._repeats(w, hashed)).alias("at")).collect()}
    for t in texts:
        tri = list(zip(t.split(), t.split()[1:], t.split()[2:]))
        assert got[t] == [i for i, w in enumerate(tri) if tri.count(w) > 1]


def test_quality_of_empty_table_and_other_stop_words(docs, odd):
    assert quality_rules.judge(odd.where("false")).count() == 0
    assert not quality_rules.judge(docs, stop_words=("nosuchword",)).where("kept").head(1)


def test_quality_keeps_clashing_columns(odd):
    out = quality_rules.judge(odd)
    assert out.columns.count("n_words") == 1 and {"source", "score", "kept"} <= set(out.columns) and len(out.collect()) == odd.count()


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Site name</header>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class="cookie-notice">We use cookies on this site, please agree.</div>
<article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b> text,<br>second&nbsp;line.<p>Short.<form><input name=x><label>Mail</label></form>
<aside>Related stories for you</aside><p>Last &lt;para&gt;  with\n  spaces.</article><section id="comments"><p>Great post, I loved it so much!</p></section>
<div class="sidebar">More things to read</div><footer>&copy; somebody</footer></body></html>"""


def test_html_parts():
    assert html_extract.main_text(PAGE) == "Title & more\n\nFirst bold text, second line.\n\nShort.\n\nLast <para> with spaces."


def test_html_without_article():
    page = "<body><div id=menu><a href=1>One</a> <a href=2>Two</a></div><div><p>A long paragraph of text that says a lot about things.</p><p>Another one that goes on about the same things.</p></div><div class='footer-links'>x</div>"
    assert html_extract.main_text(page) == "A long paragraph of text that says a lot about things.\n\nAnother one that goes on about the same things."


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<p>", ""), ("plain", "plain"), ("<article>a<p>b</article></div></p>", "a\n\nb"), ("<script>x", ""), ("<p>a &amp", "a &")])
def test_html_odd(page, text):
    assert html_extract.main_text(page) == text


ARTICLE = "<article><header class='entry-header'><h1>Title of it</h1></header><p>Some text of the article itself.</p><footer class='footer'>By me</footer></article>"


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "content-with-menu", "site-search-enabled", "layout sidebar", "search", "comments"])
def test_html_article_inside_named_wrapper(name):
    page = f"<body><nav>Home</nav><div class='{name}'><div>{ARTICLE}</div></div></body>"
    assert html_extract.main_text(page) == "Title of it\n\nSome text of the article itself.\n\nBy me"
    assert html_extract.main_text(page.replace("div", "form")) == html_extract.main_text(page)


def test_html_articles_of_comments_stay_out():
    page = f"<body>{ARTICLE}<section id=comments><article>A comment of some length, longer than all else on it.</article></section></body>"
    assert html_extract.main_text(page) == "Title of it\n\nSome text of the article itself.\n\nBy me"
    page = "<body><div><p>A long paragraph of text that says a lot.</p></div><section id=comments><article>A comment of some length.</article></section></body>"
    assert html_extract.main_text(page) == "A long paragraph of text that says a lot."


@pytest.mark.parametrize("before,block,after", [("", "<div>{}</div>", ""), ("<table>", "<tr><td>{}</td></tr>", "</table>"), ("<section>", "<p>{}", "</section>")])
def test_html_short_blocks_without_article(before, block, after):
    blocks = ["long " * 100 + "one", *(f"short{i}" for i in range(5)), "long " * 100 + "two"]
    page = f"<body><nav>Home</nav>{before}{''.join(block.format(b) for b in blocks)}{after}<footer>Us</footer></body>"
    assert html_extract.main_text(page) == "\n\n".join(blocks)


def test_html_one_long_block_and_layout_table():
    assert html_extract.main_text(f"<body><div><div>a</div><div>b</div><div>c</div><div>d</div><div>{'x' * 500}</div></div></body>") == f"a\n\nb\n\nc\n\nd\n\n{'x' * 500}"
    links = "".join(f"<p><a href=/{i}>{i}</a></p>" for i in range(9))
    body = ["first " * 40 + "end", "short", "last " * 40 + "end"]
    page = f"<table><tr><td>{links}</td><td><p>{'</p><p>'.join(body)}</p></td></tr></table>"
    assert html_extract.main_text(page).split("\n\n")[-3:] == body


def test_html_article_of_every_page(pages):
    import html

    for r in html_extract.extract(pages).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n\n".join(b for b in blocks if b)


BODY = "<h1>Title of it</h1><p>Some text of the article itself, long enough to count.</p><p>Short.</p>"
BLOCKS = "Title of it\n\nSome text of the article itself, long enough to count.\n\nShort."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><meta charset=utf-8><body><article>{BODY}</article>",
        f"<head><title>T</title><article>{BODY}</article>",
        f"<html><head><title>T</title><link rel=x><div><div>{BODY}</div></div>",
        f"<body><form action=/x><input type=hidden><nav>Home</nav><article>{BODY}</article><button>Go</button></form>",
        f"<body><form action=/x><div id=page><ul class=menu><li>Home</ul><div>{BODY}</div></div><select><option>One</select></form>",
        f"<body><main>{BODY}<form><p>Sign up here</p><label>Mail</label><input></form></main>",
        f"<body><article>{BODY}<div class=share><a href=/a>Share this</a> <a href=/b>Send it</a></div></article>",
        f"<body><article>{BODY}<div class=related><ul><li><a href=/a>Another story of ours, with a long title</a><li><a href=/b>One more</a></ul></div></article>",
        f"<body><div><p>{'Unnamed side text that goes on and on. ' * 9}</p></div><article>{BODY}</article>",
        f"<body><ul><li class=ad>Buy this<li>Home</ul><article>{BODY}</article>",
    ],
)
def test_html_templates(page):
    assert html_extract.main_text(page) == BLOCKS


@pytest.mark.parametrize("name", ["discussion", "header", "notice", "related"])
def test_html_names_only_vote_inside_an_article(name):
    text = "What we found here agrees with what others have found before, and this says so at some length."
    assert html_extract.main_text(f"<article>{BODY}<section id={name}><h2>Heading</h2><p>{text}</p></section></article>") == f"{BLOCKS}\n\nHeading\n\n{text}"


LONG = "What we found here agrees with what others have found before, and this says so at some length."


def test_html_links_and_copyright_beside_a_body_without_article():
    page = f"<body><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div><a href=/h>Home</a><br><a href=/n>News</a></div><div>Copyright 2020 Foo</div></body>"
    assert html_extract.main_text(page) == f"{LONG}\n\nShort.\n\n{LONG}"
    # a block for each paragraph: their container is the page's
    page = f"<body><ul><li><a href=/h>Home</a><li><a href=/n>News</a></ul><div>{LONG}</div><div>Short.</div><div>{LONG}</div><div><p><a href=/x>One more</a><p><a href=/y>Another</a></div><div>© Foo</div></body>"
    assert html_extract.main_text(page) == f"{LONG}\n\nShort.\n\n{LONG}"


def test_html_a_linked_paragraph_stays():
    page = f"<body><div><p>{LONG}</p><p><a href=/x>All of this is a link</a></p><p>{LONG}</p></div></body>"
    assert html_extract.main_text(page) == f"{LONG}\n\nAll of this is a link\n\n{LONG}"


@pytest.mark.parametrize("name", ["notice", "user-comments", "reader-comments", "advert-box", "cookie-info", "post_comments", "top-ad", "gdpr-consent"])
@pytest.mark.parametrize("text", ["We use cookies here.", LONG, f"{LONG}</p><p>{LONG}"])
def test_html_named_parts_go_by_the_words_of_their_names(name, text):
    part = f"<div class={name}><p>{text}</p></div>"
    assert html_extract.main_text(f"<article>{BODY}{part}</article>") == BLOCKS
    assert html_extract.main_text(f"<article>{BODY.replace('<p>Short', part + '<p>Short')}</article>") == BLOCKS
    assert html_extract.main_text(f"<body><div><h1>Title</h1><p>{LONG}</p>{part}<p>{LONG}</p></div></body>") == f"Title\n\n{LONG}\n\n{LONG}"


@pytest.mark.parametrize("name", ["has-comments", "with-ads", "no-notice", "content-with-advert"])
def test_html_named_wrappers_of_all_text_stay(name):
    assert html_extract.main_text(f"<article><div class={name}>{BODY}<div class=advert-box>Buy this now, and another of it too, while there are some.</div></div></article>") == BLOCKS
    assert html_extract.main_text(f"<body><div class={name}><article>{BODY}</article></div></body>") == BLOCKS
    assert html_extract.main_text(f"<body><div class={name}><p>{LONG}</p><p>Short.</p></div><div>Copyright 2020 Foo</div></body>") == f"{LONG}\n\nShort."


def test_html_items_without_end_tags():
    assert html_extract.main_text("<article><ul><li class=ad>Buy this<li>One<li>Two<ul><li>In</ul></ul><dl><dt>T<dd>D</dl><table><tr><td>a<td>b<tr><td>c</table></article>") == "One\n\nTwo\n\nIn\n\nT\n\nD\n\na\n\nb\n\nc"


@pytest.mark.parametrize("junk", ["</i>", "<b></i>", "<b>", "<i><div><b></i>", "<div></i></span>", "<p>", "<li>", "<td></div>", "<", "<!--", "<a ", "&", "<ul><li>", "<div>a", "<dl>", "</"])
def test_html_time_grows_with_length(junk):
    import time

    took = []
    for size in (1 << 16, 1 << 18):
        begun = time.process_time()
        html_extract.main_text("<article>x" + junk * (size // len(junk)))
        took.append(time.process_time() - begun)
    assert took[1] < max(1.0, 8 * took[0])


def test_html_columns(spark):
    df = spark.createDataFrame([(1, "old", "<p>new", "x"), (1, "old", "<p>new", "x")], "page_id long, text string, html string, extra string")
    assert [r.asDict() for r in html_extract.extract(df).collect()] == [{"page_id": 1, "html": "<p>new", "extra": "x", "text": "new"}] * 2


def test_html_long_page_and_empty_table(spark):
    page = "<article>" + "<p>some words here</p>" * 20_000 + "</article>"
    assert html_extract.main_text(page).count("\n\n") == 19_999
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def glob_regex(p):
    host, slash, path = p.partition("/")
    g = lambda s: "".join({"*": "(?s:.*)", "?": "(?s:.)"}.get(c, re.escape(c)) for c in s)
    return re.compile((g(host).replace("(?s:.", "(?s:[^\0]") + "\0" + (g(slash + path) if slash else "(?s:.*)") + r"\Z"))


def test_automaton_against_regex():
    patterns = ["*casino*", "a?c*/x*y", "*", "*.com/*", "exact.org/", "*a*b*c*", "?*", "*" + "long" * 40 + "*", "x*/a*"]
    texts = [b"www.casino.org\0/x", b"abcd\0/xzzy", b"abcd\0/xzz", b"exact.org\0/", b"exact.org\0", b"a1b2c3\0", b"\0", b"x.com\0/", ("z" + "long" * 40).encode() + b"\0/q", b"xa\0/ab", b"casino\0", b"a\0/b/casino"]
    got = url_filter.Automaton([url_filter.of_pattern(p) for p in patterns]).match([t.replace(b"\0", b"\xff") for t in texts])
    for i, t in enumerate(texts):
        for j, p in enumerate(patterns):
            assert got[i, j] == bool(glob_regex(p).match(t.decode())), (t, p)


def test_url_verdicts(spark):
    urls = [
        ("http://Shop.EXAMPLE.com/en/7a?x", "shop.example.com", "/en/7a", "example.com/en/7", "allow"),
        ("http://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
        ("http://badexample.com/en/7", "badexample.com", "/en/7", "com/en/", "block"),
        ("https://a.example.net/de/81#t", "a.example.net", "/de/81", "example.net/de/8", "block"),
        ("https://a.net/de", "a.net", "/de", None, "allow"),
        ("https://x.org/es/1", "x.org", "/es/1", "org/es/", "block"),
        ("https://best-casino.io/", "best-casino.io", "/", None, "block"),
        ("no scheme.com/en/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://?a://b", "", "", None, "allow"),
        ("http://com/en/", "com", "/en/", "com/en/", "block"),
        ("http://a.com#/en/", "a.com", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls)}


def test_many_patterns_go_in_blocks(spark, monkeypatch):
    rules = (*url_filter.RULES, *(url_filter.Rule("block", f"host{i}.net/p{i}") for i in range(300)))
    blocked = (*url_filter.BLOCKED, *(f"*bad{i}x*" for i in range(300)))
    urls = ["http://shop.example.com/en/7a", "http://com/en/8", "http://a.host17.net/p17/x", "http://host299.net/p299", "http://host299.net/p29", "http://is-bad211x.org/", "http://is-bad211.org/", "http://x.org/bad211x", "http://q/" + "long/" * 400, "http://a\0b-casino/x", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string")
    whole = sorted(map(tuple, url_filter.filter_urls(df, rules, blocked).select("page_id", F.coalesce("rule", F.lit("-")), "verdict").collect()))
    monkeypatch.setattr(url_filter, "BLOCK_WORDS", 20)
    assert len(url_filter.automata([url_filter.of_pattern(b) for b in blocked])) > 1
    assert sorted(map(tuple, url_filter.filter_urls(df, rules, blocked).select("page_id", F.coalesce("rule", F.lit("-")), "verdict").collect())) == whole
    want = ["example.com/en/7", "com/en/", "host17.net/p17", "host299.net/p299", "-", "-", "-", "-", "-", "-", "-"]
    assert [r for _, r, _ in whole[1:]] == want
    assert [v for _, _, v in whole[1:]] == ["allow", "block", "block", "block", "allow", "block", "allow", "allow", "allow", "block", "allow"]
    assert url_filter.filter_urls(df.where("false")).count() == 0


def brute_force_language(model, text):
    """Shares by plain expectation-maximisation over every set of languages, grown as the penalty allows."""
    import itertools
    import math

    cells = Counter(langid.trigrams(__import__("numpy").frombuffer(text.encode(), dtype="uint8")).tolist())
    total = sum(cells.values())

    def fitted(chosen):
        share = [1 / len(chosen)] * len(chosen)
        likely = {c: [math.exp(model.log_p[c, k]) for k in chosen] for c in cells}
        for _ in range(100):
            grown = [0.0] * len(chosen)
            for c, n in cells.items():
                p = [s * x for s, x in zip(share, likely[c])]
                for j, x in enumerate(p):
                    grown[j] += n * x / sum(p)
            share = [x / total for x in grown]
        value = sum(n * math.log(sum(s * math.exp(model.log_p[c, k]) for s, k in zip(share, chosen))) for c, n in cells.items())
        return value - (len(chosen) - 1) * model.penalty * 0.5 * math.log(total), dict(zip(chosen, share))

    sets = [s for k in range(1, len(model.languages) + 1) for s in itertools.combinations(range(len(model.languages)), k)]
    return max(map(fitted, sets), key=lambda x: x[0])[1]


def test_language_mixtures_against_brute_force():
    import random

    import numpy as np

    rng = random.Random(8)
    words = {"aa": "kato mila soru tane".split(), "bb": "whix thunq drelp snarf".split(), "cc": "oui'la béna çoté dûme".split()}
    counts = np.zeros((3, langid.CELLS))
    for k, said in enumerate(words.values()):
        counts[k] = np.bincount(langid.trigrams(np.frombuffer(" ".join(rng.choices(said, k=3000)).encode(), dtype=np.uint8)), minlength=langid.CELLS)
    model = langid.Mixture(sorted(words), counts)
    for shares in ((60, 0, 0), (40, 25, 0), (0, 30, 30), (20, 20, 20), (1, 0, 0), (50, 1, 0), (3, 3, 0)):
        text = " ".join(w for said, n in zip(words.values(), shares) for w in rng.choices(said, k=n))
        got, want = model.shares(np.frombuffer(text.encode(), dtype=np.uint8)), brute_force_language(model, text)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 0.02 for k in want), (shares, got, want)
        assert model.predict(text)[0] == model.languages[max(want, key=lambda k: (round(want[k], 2), -k))]


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(docs.where(~langid.held_out()))


def test_language_accuracy_on_held_out_rows(spark, docs, model):
    got = langid.predict(docs, model).where(langid.held_out() & F.col("lang").isNotNull()).select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)


def test_held_out_is_crc32(docs):
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in docs.select("doc_id", langid.held_out().alias("h")).collect())


def test_language_shares(docs, model):
    by = {lang: docs.where((F.col("lang") == lang) & (F.length("text") > 1500)).first()["text"] for lang in ("en", "fr")}
    import numpy as np

    shares = model.shares(np.frombuffer((by["en"][:1000] + " " + by["fr"][:500]).encode(), dtype=np.uint8))
    named = {model.languages[i]: s for i, s in shares.items()}
    assert set(named) == {"en", "fr"} and 0.5 < named["en"] < 0.8


def test_language_of_odd_texts(spark, odd, model):
    got = langid.predict(odd, model)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_words"] and got.columns[-1] == "score" and got.count() == odd.count()
    assert {r["doc_id"] for r in got.where("lang_pred = 'und'").collect()} == {0, 1, 2}
    nothing = langid.fit(odd.where("false"))
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.accepted(odd, model).columns == odd.columns
    assert model.predict("12 34 !?") == ("und", 0.0)


def test_training_sample_is_bounded(docs):
    small = langid.fit(docs, max_docs_per_language=10)
    assert small.languages == sorted({r["lang"] for r in docs.where("lang is not null").select("lang").distinct().collect()})
    with pytest.raises(ValueError):
        langid.fit(docs, max_languages=2)


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hits(text, items, size):
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        m = min(size, len(b))
        known = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if m else set()
        for i in range(len(w) - m + 1):
            if m and tuple(w[i : i + m]) in known:
                hit |= set(range(i, i + m))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [1 << 25, 700, 150])
def test_decontamination_against_brute_force(spark, block_bytes):
    items = [(1, "a b c d e f g h i j k l"), (10, "Short item"), (2, None), (3, ""), (1, "a b c d e f g h i j k l"), (None, "no id here at all, none"), (4, "é à ü ö ß ç ñ á í ó ú"), *((100 + i, f"filler item number {i} of the list") for i in range(30))]
    texts = [None, "", "x A b, c d e f g h i j y", "b c d e f g h i j k l a short ITEM", "short", "é à ü ö ß ç ñ á í ó zzz é à", "no id here at all none", "a b c d e f g h i j", "a b c d e f g h i j " * 3000, "filler item number 7 of the list"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(2, texts[2], 0), (None, texts[2], 0)], "doc_id long, text string, n_hit long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.report(docs, bench, size=10, block_bytes=block_bytes).collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r[1:]) == hits(texts[2] if r["doc_id"] is None else texts[r["doc_id"]], items, 10)


def test_spans_and_documents(spark):
    docs = spark.createDataFrame([(1, "Before it, A b c d e f g h i j! after"), (2, "clean"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert [r[:] for r in decontam.remove_spans(docs, bench).orderBy("doc_id").collect()] == [(1, "Before it, ! after"), (2, "clean"), (3, None)]
    assert {r["doc_id"] for r in decontam.remove_documents(docs, bench).collect()} == {2, 3}
    assert decontam.report(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontam.report(docs.where("false"), bench).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 25, 20])
def test_removers_keep_columns_of_any_name(spark, block_bytes):
    schema = "doc_id long, n_hit string, text string, n_words long, items int, hit_bytes double, __hits long, __row long"
    docs = spark.createDataFrame([(1, "mine", "Before it, A b c d e f g h i j! after", 5, 6, 7.0, 8, 9), (2, "mine", "clean", 5, 6, 7.0, 8, 9)], schema)
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "nothing of the kind")], "item_id long, text string")
    left = decontam.remove_documents(docs, bench, block_bytes=block_bytes)
    assert left.schema == docs.schema and [tuple(r) for r in left.collect()] == [(2, "mine", "clean", 5, 6, 7.0, 8, 9)]
    cut = decontam.remove_spans(docs, bench, block_bytes=block_bytes)
    assert cut.schema == docs.schema and sorted(tuple(r) for r in cut.collect()) == [(1, "mine", "Before it, ! after", 5, 6, 7.0, 8, 9), (2, "mine", "clean", 5, 6, 7.0, 8, 9)]


def test_windows_are_told_by_their_words():
    known = decontam.Windows(["1", "2", None], ["a b c d", "x a b c", "a b"], 3)
    said = lambda t: known.owners(known.lengths[3][1][0], 3, t)
    assert said(b"no such words") is None
    by_words = {decontam._joined(known.data, known.starts, known.ends, int(at), 3): h for h, at in zip(known.lengths[3][1], known.lengths[3][2])}
    assert known.owners(by_words[b"a b c"], 3, b"a b c") == {"1", "2"} and set(known.lengths) == {2, 3}
