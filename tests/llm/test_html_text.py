import html as H
import math
import random
import re
import xml.etree.ElementTree as ET

from corpusmill.llm.html_text import FORMAT, Page, extract, main_text

PARAS = ["First paragraph of the piece, with enough words in it to count as text.", "Second, with a link and some more words after it.", "Third; it ends here."]


def page(body, attrs=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>if (a<b) x='</p>';</script></head><body {attrs}>{body}</body></html>"


ARTICLE = f"<article><h1>Title &amp; more</h1><p>{PARAS[0]}</p><p>Second, with a <a href=x>link</a> and\n some&nbsp;more words<br>after it.<p>{PARAS[2]}</article>"
WANT = "\n".join(["Title & more", *PARAS])
AROUND = {
    "menu": '<nav><ul><li><a href="/">Home</a><li><a href="/b">Things about it</a></ul></nav>',
    "header": "<header><p>The site of a paper with a long line on top of every page it has</p></header>",
    "footer": "<footer>&copy; somebody. All rights reserved, and more small print.</footer>",
    "sidebar": '<div class="left-sidebar"><p>Other things that may be read on this site, at length and breadth</p></div><aside><p>An aside with words</p></aside>',
    "notice": '<div id="cookie-notice"><p>We use cookies. Do you agree to that? Please say so now.</p></div>',
    "advert": "<div class='ad'>Buy it now.</div><div class=advertisement><p>Buy this thing, which is cheap, and good.</p></div>",
    "form": "<form><label>Name</label><input value='a>b'><textarea>a <p> b</textarea><button>Send</button></form>",
    "comments": '<section id="comments"><h2>Comments</h2><article class="comment"><p>I do not agree with the writer of this at all, and say so.</p></article></section>',
    "script": "<script>document.write('<p>none of it</p>')</script><noscript><p>Turn it on</p></noscript><!-- <p>hidden</p> -->",
}


def test_surroundings_go_and_the_article_stays():
    assert main_text(page(ARTICLE)) == WANT
    for name, x in AROUND.items():
        assert main_text(page(x + ARTICLE)) == WANT, name
        assert main_text(page(ARTICLE + x)) == WANT, name
        assert main_text(page(ARTICLE.replace("</article>", x + "</article>"))) == WANT or name == "header", name
    everything = "".join(AROUND.values())
    assert main_text(page(everything + ARTICLE + everything, 'class="has-sidebar"')) == WANT


def test_density_finds_text_without_article_tags():
    long = [f"Paragraph {i} of the main text, which goes on for a while so that it is dense." for i in range(6)]
    links = "<div class=x>" + "".join(f"<a href={i}>link {i}</a> " for i in range(30)) + "</div>"
    body = f"<div>{links}<div><div>{''.join(f'<p>{p}</p>' for p in long)}</div></div><div><span>small</span></div></div>"
    assert main_text(page(body)) == "\n".join(long)


def test_text_split_over_wrappers_without_article_tags():
    para = lambda s, i: (f"Part {s} paragraph {i} of the main text " + "word " * 60)[:200].strip()
    parts = [[para(s, i) for i in range(10)] for s in range(3)]
    section = lambda ps: "<section><div>" + "".join(f"<p>{p}</p>" for p in ps) + "</div></section>"
    links = "<div>" + "".join(f"<a href={i}>link {i}</a> " for i in range(30)) + "</div>"
    want = "\n".join(p for ps in parts for p in ps)
    assert main_text(page(f"<main>{''.join(map(section, parts))}</main>")) == want
    assert main_text(page(f"<div>{section(parts[0])}</div>{links}<div>{section(parts[1])}</div><div>{section(parts[2])}</div>")) == want


def test_marks_are_whole_tokens_of_whole_attributes():
    text = "\n".join(PARAS)
    ps = "".join(f"<p>{p}</p>" for p in PARAS)
    for x in ('class="content no-sidebar"', 'id="related-work"', 'title="the hidden truth"', "data-x='class=ad id=nav'", 'alt="a role=navigation of"', "class=has-menu", 'title="a hidden'):
        assert main_text(page(f"<p>{PARAS[0]} Before it.</p><div {x}>{ps}</div><p>{PARAS[0]} Behind it.</p>")).split("\n")[1:-1] == PARAS, x
    for x in ('class="left-sidebar"', 'class="x related-posts"', "id=comment-12", "id = 'cookie_notice'", "hidden", "class=ad/", 'role="navigation"'):
        assert main_text(page(f"<p>{PARAS[0]}</p><div {x}><p>Few words</p></div>")) == PARAS[0], x
    assert text in main_text(page(f"<article><h1>A</h1><section id=related-work>{ps}</section></article>"))


def test_what_holds_most_of_the_text_stays():
    text = "\n".join(PARAS)
    ps = "".join(f"<p>{p}</p>" for p in PARAS)
    for x in ("class=sidebar", 'id="related"', "role=dialog", "hidden", "class=comments"):
        assert main_text(page(f"<div {x}>{ps}</div>")) == text, x
        assert main_text(page(f"<div {x}><div class=nav><article>{ps}</article></div></div>")) == text, x
    assert main_text(page(f"<form id=page>{AROUND['menu']}<div>{ps}</div></form>")) == text
    assert main_text(page(f"<div class=social>{ps}</div><p>Small print</p>")).startswith(text)
    # an article tells what is one, and comments beside other text are comments
    assert main_text(page(f"<article><p>Short.</p></article><div class=cookie-notice>{ps}</div>")) == "Short."
    assert main_text(page(f"<p>Short.</p><div class=comments>{ps}</div>")) == "Short."
    links = "".join(f"<a href=x>{p}</a>" for p in PARAS)
    assert main_text(page(f"<p>Short.</p><div class=menu>{links}</div>")) == "Short."


def test_densities_choose_inside_an_article(monkeypatch):
    paras = "".join(f"<p>{p} {p}</p>" for p in PARAS)
    links = "".join(f"<p><a href={i}>See here also {i}</a></p>" for i in range(40))
    html = page(f"<article><div>{paras}</div><div>{links}</div></article>")
    assert main_text(html) == "\n".join(f"{p} {p}" for p in PARAS)
    monkeypatch.setattr(Page, "densities", lambda self: [1.0 if c > 0 else 0.0 for c in self.chars])
    assert "See here also" in main_text(html)


def brute(html):
    """The blocks of the main text of a page that is well-formed, from the formulas as they stand."""
    body = ET.fromstring(html)
    above = {c: p for p in body.iter() for c in p}
    strings = lambda e: [x for x in [e.text, *(y for c in e for y in (*strings(c), c.tail))] if x]
    chars = lambda e: sum(len(re.sub(r"\s+", " ", x).strip()) for x in strings(e))
    nodes = [e for e in body.iter() if e.tag not in FORMAT]
    link_chars = lambda e: sum(chars(x) for x in e.iter("a"))
    share = link_chars(body) / chars(body)

    def density(e):
        c, lc = chars(e), link_chars(e) if e.tag != "a" else chars(e)
        if not c:
            return 0.0
        t = max(1, sum(x in nodes for x in e.iter()) - 1)
        lt = max(1, sum(1 for x in e.iter("a") if x is not e))
        ratio = c / max(lc, 1) * t / lt
        base = math.log(c / max(c - lc, 1) * max(lc, 1) + share * c + math.e)
        return c / t * math.log(max(ratio, 1)) / math.log(base)

    def children(e):
        for c in e:
            if c.tag in FORMAT:
                yield from children(c)
            else:
                yield c

    dens = {e: density(e) for e in nodes}
    total = {e: sum(dens[c] for c in children(e)) for e in body.iter()}
    best = lambda e: max((x for x in e.iter() if x is e or chars(x)), key=lambda x: total[x])
    target = best(body)
    path, e = [dens.get(target, 0)], target
    while e is not body:
        path.append(dens.get(e, min(path)))
        e = above[e]
    threshold = min(path)
    chosen = {target}
    if target is not body:
        low = min((dens[c] for c in children(target) if dens[c] > 0), default=0.0)
        beside = set(above[target].iter()) if target in above else set()
        chosen |= {best(x) for x in nodes if x is not body and chars(x) and dens[x] >= threshold and (x in beside or max(dens[x], total[best(x)]) >= low)}
    inside = {y for x in chosen for y in x.iter()}
    out = [[]]

    def walk(e):
        block = e.tag in ("div", "p", "section", "h2")
        if block:
            out.append([])
        if e.text and e in inside:
            out[-1].append(e.text)
        for c in e:
            walk(c)
            if c.tail and e in inside:
                out[-1].append(c.tail)
        if block:
            out.append([])

    walk(body)
    return "\n".join(t for x in out if (t := re.sub(r"\s+", " ", "".join(x)).strip()))


def test_densities_sums_target_and_threshold_match_brute_force():
    rnd = random.Random(4)

    def element(depth):
        kind = rnd.choice(["div", "section", "p", "p", "p", "ul"]) if depth < 5 else "p"
        if kind == "ul":
            return "<div>" + "".join(f'<p><a href="{i}">{"link " * rnd.randint(1, 4)}</a></p>' for i in range(rnd.randint(2, 12))) + "</div>"
        if kind == "p":
            words = "word " * rnd.choice([1, 3, 20, 60])
            return f"<p>{words}<b>bold</b> and <a href='x'>one</a> {words}</p>" if rnd.random() < 0.4 else f"<p>{words}</p>"
        return f"<{kind}>" + "".join(element(depth + 1) for _ in range(rnd.randint(1, 5))) + f"</{kind}>"

    texts = set()
    for i in range(150):
        html = "<body>" + "".join(element(0) for _ in range(rnd.randint(1, 4))) + "</body>"
        want = brute(html)
        assert main_text(html) == want, html
        texts.add(len(want) < len(re.sub("<[^>]*>", "", html)) * 0.8)
    assert texts == {True, False}


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<p") == main_text("   ") == main_text("<script>x") == ""
    assert main_text("just text &lt;b&gt; 1 < 2 &am") == "just text <b> 1 < 2 &am"
    assert main_text("<p>a b c</p") == "a b c"
    assert main_text('<body><p>one two</p><p title="never closed>three</p><p>four</p>') == "one two\nthree\nfour"
    assert main_text("<body>" + "<div>" * 20_000 + "deep</div>") == "deep"
    assert main_text("<body><p>" + "x " * 300_000) == ("x " * 300_000).strip()
    assert main_text("<p>a</b></i>b</p></div>c") == "ab\nc"


def test_table(spark):
    df = spark.createDataFrame([(1, "u", page(ARTICLE), "t"), (2, None, None, "t"), (2, None, None, "t"), (None, "v", "", "t")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract(df).collect()), key=str)
    assert got == sorted([(1, "u", WANT, len(WANT)), (2, None, "", 0), (2, None, "", 0), (None, "v", "", 0)], key=str)
    assert extract(df.limit(0)).collect() == []


def test_given_pages_against_their_articles(spark):
    """The given pages hold one article element each; its blocks are the expected text."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        inner = r.html[r.html.index("<article>") + 9 :].split("</article>")[0].split("<footer>")[0]
        inner = re.sub(r"<[^>]*$", "", inner)
        parts = [H.unescape(re.sub(r"<[^>]*>", " ", x)) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert main_text(r.html) == "\n".join(t for x in parts if (t := re.sub(r"\s+", " ", x).strip())), r.page_id
