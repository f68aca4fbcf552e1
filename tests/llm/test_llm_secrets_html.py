"""Secret scans and HTML extraction."""

import hashlib
import random
import re
import string

from sheetwise.llm import common as C
from sheetwise.llm import html, secrets


def plain_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((*m.span(), "assign"))
    out += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


CASES = ["", "é token: abc", "password: token: abcdefgh", 'API_KEY = "abcdef.ghi=" x', "secret=secret=abcdef", "AKIA" + "A1" * 8, "AKIAKIA" + "Z" * 12, "x" + "0a" * 12 + "g", "é" * 5 + "0123456789abcdef01234567",
         "apikey:'q' passwd=123456", "token=" + "a" * 30, "TOKEN\t=abcdef", "password=" + "f" * 24 + " AKIA" + "9" * 16, "Key toKen=abcdefg"]


def test_base_spans_equal_the_plain_patterns(spark, sf_dir):
    texts = CASES + [r.text for r in C.table(spark, sf_dir, "documents").collect()]
    assert all(secrets.base_spans(t) == plain_spans(t) for t in texts)


def test_scan_digests(spark, odd_docs, no_docs, sf_dir):
    C.prepare(spark)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CASES + [None])], "doc_id long, text string").union(C.table(spark, sf_dir, "documents").selectExpr("doc_id + 1000", "text"))
    model = secrets.train([])
    for r, t in zip(secrets.scan(docs, model).orderBy("doc_id").collect(), [r.text or "" for r in docs.orderBy("doc_id").collect()], strict=True):
        spans = plain_spans(t)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex"))
        assert {f"{k}:{a}:{b}" for a, b, k in spans} <= set(r.spans.split(","))
    assert secrets.scan(odd_docs, model).count() == odd_docs.count()
    assert secrets.scan(no_docs, secrets.fit(no_docs)).count() == 0


def test_markov_models_on_held_out_strings(spark, sf_dir):
    r = random.Random(7)
    texts = [x.text for x in C.table(spark, sf_dir, "documents").collect()]
    model = secrets.train(texts[::2])
    keys = ["".join(r.choices(string.ascii_letters + string.digits, k=r.randint(24, 44))) for _ in range(300)]
    found = sum(any(s[2] == "markov" for s in secrets.spans_of(f"see {k} there", model)) for k in keys)
    assert found >= 0.97 * len(keys)
    assert not any(s[2] == "markov" for t in texts[1::2] for s in secrets.spans_of(t, model))
    words = ["get_user_account_by_identifier", "internationalisierungsmassnahmen", "content-management-system-overview", "/usr/local/share/applications/config", "====================", "thisisalongordinarylowercaseidentifier"]
    assert not any(secrets.spans_of(w, model) for w in words)


def test_redaction(spark, odd_docs):
    C.prepare(spark)
    model = secrets.train([])
    out = secrets.redact(odd_docs, model)
    assert out.schema.names == odd_docs.schema.names and sorted(map(str, out.collect())) == sorted(map(str, odd_docs.collect()))
    d = spark.createDataFrame([(1, "a token=abcdef0123456789abcdef012345 b", 5)], "doc_id long, text string, n_chars long")
    assert secrets.redact(d, model).first()[1:] == ("a [SECRET] b", 12)


def test_rest_of_a_run_beside_a_base_span(spark, sf_dir):
    """A secret joined to an access key or a hex string by a token character."""
    C.prepare(spark)
    r, model = random.Random(3), secrets.fit(C.table(spark, sf_dir, "documents"))
    key = "G" + "".join(r.choices(string.ascii_letters + string.digits, k=38)) + "z"
    access, digits = "AKIA" + "Q7X2" * 4, "0123456789abcdef" * 2
    for text, kind, first in [(f"{access}{j}{key}", "access", len(access)) for j in "/+_=-"] + [(f"{digits}-{key}", "hex", 32)]:
        assert [(a, b, k) for a, b, k in secrets.spans_of(text, model) if k in (kind, "markov")] == [(0, first, kind), (first, len(text), "markov")]
        d = spark.createDataFrame([(1, f"x {text} y")], "doc_id long, text string")
        assert key not in secrets.redact(d, model).first().text
    before = f"{key}/{access}/{key}"
    assert [k for _, _, k in secrets.spans_of(before, model)] == ["markov", "access", "markov"]
    assert secrets.spans_of(f"{access}/short-end", model) == [(0, len(access), "access")]


# ---- html -------------------------------------------------------------------------

def model():
    return html.train([(t, html.labels_of(t)) for t in map(html.parse, html.labelled_pages())])


def test_held_out_pages():
    m = model()
    pages = html.labelled_pages(150, seed=77)
    right = 0
    for page in pages:
        tree = html.parse(page)
        p, y = html.marginals(tree, m), html.labels_of(tree)
        right += all((p[i] > 0.5) == y[i] for i, _, t, _ in tree.texts if t.strip())
    assert right >= 0.95 * len(pages)


def brute_marginals(tree, m):
    """Sums over all labellings."""
    n = len(tree.tag)
    found = html.features(tree)
    total, main = 0.0, [0.0] * n
    import math
    for code in range(1 << (n - 1)):
        y = [0] + [(code >> k) & 1 for k in range(n - 1)]
        w = 1.0
        for i in range(n):
            x = math.exp(sum(m["unary"].get(f, 0) for f in found[i]))
            w *= (x if y[i] else 1) / (1 + x)
            if i:
                q = m["edge"].get(html._kind(tree, i), m["other"])[y[tree.parent[i]]]
                w *= q if y[i] else 1 - q
        total += w
        for i in range(n):
            main[i] += w * y[i]
    return [x / total for x in main]


def test_messages_give_exact_marginals():
    m = model()
    for page in ("<body><nav><a href=x>Home</a></nav><article><p>Some long words here and there.</p><div class=ad>Buy</div></article></body>",
                 "<div class=content><p>Text text text.</p></div><footer>c</footer>",
                 "<ul><li>a b c<li class=ad>buy it<li>some more words of text<li>x<li><a href=y>y</a><li>and so on</ul>"):
        tree = html.parse(page)
        assert all(abs(a - b) < 1e-9 for a, b in zip(html.marginals(tree, m), brute_marginals(tree, m), strict=True))


def test_text_and_markup():
    m = model()
    page = ("<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x='</p>'</script></head><body><header class='site-header'><h1>Site</h1></header>"
            "<nav><ul><li><a href='/a'>Menu one</a><li><a href='/b'>Menu two</a></ul></nav><div class=\"cookie-notice\">We use cookies.</div><!-- c --><article><h1>Title &eacute;</h1>"
            "<p>First <b>bold</b>\n  words&amp;more&nbsp;x.<p>Second line<br>goes on.<ul><li>one item of text<li>two item of text</ul><form><label>Name</label><input></form></article>"
            "<aside class=sidebar><h3>Related</h3><ul><li><a href=x>Link</a></li></ul></aside><section class='comments'><div class='comment'><p>Nice post!</p></div></section><footer>&copy; me</footer>")
    assert html.extract(page, m) == "Title é\n\nFirst bold words&more x.\n\nSecond line goes on.\n\none item of text\n\ntwo item of text"
    assert html.extract("", m) == "" and html.extract("<p", m) == ""
    deep = "<div>" * 30_000 + "text"
    assert isinstance(html.extract(deep, m), str)


def test_elements_with_text_of_their_own():
    m = model()
    page = ("<body><nav><a href=a>Home</a></nav><article><h1>On energy</h1><p>Energy is <math><mi>E</mi>=mc<sup>2</sup></math> and more of it than one would think.</p>"
            "<object data=x><p>A text that stands for the missing picture of it.</p></object><svg><text>Drawn words</text></svg><p>It ends here, after some more words of text.</p>"
            "<video src=v>Words for those who see no film.</video><form><select><option>optional</select><button>Go</button></form></article><footer>&copy; us</footer>")
    got = html.extract(page, m)
    for piece in ("Energy is E=mc2 and more of it", "A text that stands for the missing picture of it.", "Drawn words", "Words for those who see no film."):
        assert piece in got
    assert "optional" not in got and "Go" not in got.split()


def test_malformed_pages_take_linear_time():
    import time
    for page in ("<a '" * 1_250_000, '<a b="' * 800_000, "<a " * 1_600_000, "<div><a>" + "<div>" * 300_000 + "</a>" * 300_000, "<p>" + "<b>" * 300_000 + "<p>" * 300_000,
                 "<!--" * 1_000_000, "<a \"'" * 900_000, '</a "' * 900_000, "<script>" * 500_000):
        start = time.time()
        html.parse(page)
        assert time.time() - start < 30, page[:12]
    # a quote that never closes is no tag: its text stays
    assert html.parse("<p>one <a 'two</p> three").texts[0][2] == "one <a 'two"


def test_own_pages(spark, sf_dir):
    """The article of every page, by a plain reading of their one layout."""
    from html import unescape
    C.prepare(spark)
    pages = C.table(spark, sf_dir, "pages")
    got = {r.page_id: r for r in html.op4_html_extraction(spark, sf_dir).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", re.sub("<br>", " ", re.sub(r"<[a-z/][^<>]*$", "", inside[1] if inside else ""))))
        text = "\n\n".join(x for b in blocks if (x := " ".join(unescape(b).split())))
        assert got[r.page_id].text == text and got[r.page_id].n_chars == len(text) and got[r.page_id].url == r.url


def test_odd_pages(spark):
    C.prepare(spark)
    rows = [(1, "u", None, 1), (None, None, "", 2), (2, "u", "<p>x", 3), (2, "u", "<p>x", 3)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = html.extract_pages(d, html.fit(d)).collect()
    assert len(out) == 4 and all(r.n_chars == len(r.text) for r in out)
    assert html.extract_pages(d.limit(0), html.fit(d.limit(0))).count() == 0
