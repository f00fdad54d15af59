import random
import re
from html import unescape

from codequarry.llm import extract

NAV = "<nav><ul><li><a href='/a'>Home</a><li>News</ul></nav>"
PAGE = f"""<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="page with-sidebar">
{NAV}<div class="ad">Buy this</div><article><header><h1>Head&nbsp;line</h1></header><p><b>Bold <i>in</i>side.<br><p>A &lt; b &amp;amp; c
 d&#8212;e</p><p class="cookie-notice">We use cookies</p><ul><li>one<li>two</ul><aside>see also</aside>
<section id="comments"><article class="comment">first!</article></section><!-- no --></article><footer>&copy; x</footer>"""


def test_structure():
    text = extract.unique_text(extract.blocks(PAGE), set())
    assert text == "Head line Bold inside. A < b &amp; c d—e one two"


def test_broken_pages():
    read = lambda h: extract.unique_text(extract.blocks(h), set())
    assert read(None) == read("") == read("<script>x") == read("<!-- x <p>y") == ""
    assert read("plain &lt;text&gt; 1 < 2") == "plain <text> 1 < 2"
    assert read("<nav>menu<article>body</div></article>") == "body"
    assert read('<p title="a>b">x</p><p title=">y') == "x y"
    assert read("<div class=comments><article>mine</article></div><main>yours</main>") == "yours"


def brute_covered(pages, hosts, run):
    """For each page the tokens inside runs that a page of its host with another text has too."""
    streams = [extract.stream(p) for p in pages]
    seen = {}
    for p, s, h in zip(pages, streams, hosts):
        for i in range(len(s) - run + 1):
            seen.setdefault((h, tuple(s[i : i + run])), set()).add(extract.mirror(p))
    return [{i + k for i in range(len(s) - run + 1) if len(seen[h, tuple(s[i : i + run])]) > 1 for k in range(run)} for s, h in zip(streams, hosts)]


def test_repeats_across_pages_go_and_unique_runs_stay(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    shared = [" ".join(rng.choices(words, k=12)) for _ in range(4)]
    rows = []
    for n in range(120):
        parts = [" ".join(rng.choices(words, k=rng.randrange(1, 15))) for _ in range(3)] + rng.sample(shared, 2)
        parts[0] += " " + " ".join(rng.choices(words, k=14))
        rng.shuffle(parts)
        tag = rng.choice(["div", "article", "nav"])
        rows.append((n, f"http://h{rng.randrange(3)}.example/{n}", f"<{tag}>{parts[0]}</{tag}>" + "".join(f"<div>{p}</div>" for p in parts[1:]), 1))
    rows += [(500, None, None, 1), (501, "no host", "", 1), rows[0]]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int").repartition(7)
    found = sorted((r["page_id"], r["text"], r["n_chars"]) for r in extract.main_text(pages).collect())
    distinct = sorted(set(rows), key=lambda r: r[0])
    hosts = [re.sub(r"^http://([^/]*)/.*", r"\1", u) if u and "//" in u else "" for _, u, _, _ in distinct]
    cut = [extract.blocks(h) for _, _, h, _ in distinct]
    expected = {r[0]: extract.unique_text(b, c) for r, b, c in zip(distinct, cut, brute_covered(cut, hosts, extract.RUN))}
    assert found == sorted((i, expected[i], len(expected[i])) for i, *_ in rows)
    assert sum(expected[r[0]] != extract.unique_text(b, set()) for r, b in zip(distinct, cut)) > 50
    assert extract.main_text(pages.where("false")).collect() == []


LEAD = "the harbour was closed for two days after the storm had torn the northern pier"
NOTE = "all prices are given without tax and may change at any time without notice"


def texts_of(spark, *htmls, hosts=()):
    rows = [(n, f"https://{hosts[n] if hosts else 'one.example'}/{n}", h) for n, h in enumerate(htmls)]
    return [r["text"] for r in sorted(extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect(), key=lambda r: r["page_id"])]


def test_what_repeats_decide(spark):
    first = f"<article><p>{LEAD}</p><p class='fineprint'>{NOTE}</p><p>first of the articles, with a text of its own that nobody else has got anywhere</p></article>"
    second = f"<article><p>{LEAD}</p><p class='fineprint'>{NOTE}</p><p>second of the articles, whose text is again its own and stands on no other page at all</p></article>"
    third = f"<div>{LEAD}</div><div>third page, which has no article and quotes the lead of another one before its own long text</div><div>{NOTE}</div>"
    found = texts_of(spark, first, second, third)
    # plain paragraphs of articles stay, marked ones and blocks outside go where they repeat
    assert found[0] == f"{LEAD} first of the articles, with a text of its own that nobody else has got anywhere"
    assert found[1].startswith(LEAD) and NOTE not in found[1]
    assert found[2] == "third page, which has no article and quotes the lead of another one before its own long text"
    # alone on its host, each keeps everything
    assert texts_of(spark, first, second, third, hosts=("a.example", "b.example", "c.example"))[2].startswith(LEAD)


def test_what_few_pages_share_stays(spark):
    own = "own words of page {} which follow the lead and fill the rest of it, as nobody else has written them"
    leads = [f"<article><p class='lead'>{LEAD}</p><p>{own.format(n)}</p></article>" for n in range(2)]
    assert texts_of(spark, *leads) == [f"{LEAD} {own.format(n)}" for n in range(2)]
    # three of forty pages are no share of the host
    many = [f"<article><p class='lead'>{LEAD if n < 3 else f'lead {n} that says what page {n} and no other tells in the words below'}</p><p>{own.format(n)}</p></article>" for n in range(40)]
    assert all(t.startswith(LEAD) for t in texts_of(spark, *many)[:3])


def test_nothing_is_cut_out_of_a_sentence(spark):
    quoted = [f"<div>{'He' if n else 'She'} wrote on day {n}: {LEAD}, and went on for long.</div><div>page {n} has more to say than that, all of it its own, number {n}</div>" for n in range(5)]
    assert texts_of(spark, *quoted) == [re.sub("<[^>]*>", " ", q).strip().replace("  ", " ") for q in quoted]


def test_menus_without_a_hint_go(spark):
    menu = "<ul>" + "".join(f"<li>{w}</li>" for w in "Start Harbour Ferries Tickets Islands Weather Crew Archive Maps Letters".split()) + "</ul>"
    pages = [f"{menu}<div>the story of island {n} is told here in {n} words or more, and on no other page</div>" for n in range(12)]
    assert texts_of(spark, *pages) == [re.sub("<[^>]*>", "", p.removeprefix(menu)) for p in pages]


def test_mirrors_count_once(spark):
    body = " ".join(f"word{i}" for i in range(60))
    page = f"<div>{body}</div><div>{NOTE}</div>"
    assert texts_of(spark, page, page.replace("<div>", "<div lang=en>")) == [f"{body} {NOTE}"] * 2
    assert texts_of(spark, page, page, page + "<div>seen from a phone</div>") == [f"{body} {NOTE}"] * 2 + [f"{body} {NOTE} seen from a phone"]


def test_joined_instead_of_broadcast(spark, monkeypatch):
    pages = [f"<div>{NOTE}</div><div>page {n} has this long block of text, number {n}, and no other page has it</div>" for n in range(6)]
    expected = texts_of(spark, *pages)
    assert not any(NOTE in t for t in expected)
    monkeypatch.setattr(extract, "MOST_BROADCAST", -1)
    assert texts_of(spark, *pages) == expected


def test_very_long_and_clashing(spark):
    long = " ".join(f"w{i % 5000}x{i}" for i in range(200_000))
    rows = [(1, "http://h/1", f"<p>{long}</p>", "x", 1), (2, "http://h/2", f"<p>{NOTE}</p>", "y", 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, page int")
    assert {r["page_id"]: r["text"] for r in extract.main_text(pages).collect()} == {1: long, 2: NOTE}


def test_articles_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in extract.main_text(pages).collect():
        inner = re.search(r"<article>(.*)</article>", html[r["page_id"]], re.S)[1]
        plain = unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inner)))
        assert r["text"] == " ".join(plain.split())
