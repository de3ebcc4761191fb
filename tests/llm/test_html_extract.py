import random
from html.parser import HTMLParser

import pytest

from sparkloom.llm.html_extract import common_lines, locate, main_text, text_lines


@pytest.mark.parametrize("seed", range(60))
def test_common_lines_against_table(seed):
    r = random.Random(seed)
    a, b = ([r.choice("abcd") for _ in range(r.randint(0, 14))] for _ in range(2))
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    got = common_lines(a, b)
    assert len(got) == t[-1][-1] and got == sorted(set(got))
    it = iter(b)
    assert all(a[i] in it for i in got)


def test_text_lines():
    page = "<!DOCTYPE html><head><title>T</title></head><style>p{}</style><script>var t='</p>';</script><nav><li><a href=x>One</a></li></nav><!-- <p>no</p> --><p>a <b>b</b>&amp;c<br>d\n e<p>1 < 2</p>"
    assert text_lines(page) == ["One", "a b&c", "d", "e", "1 < 2"]
    # tags that may be left out, that close themselves, or that are never closed
    assert text_lines("<html><head><title>T</title><body><p>real text</p>more") == ["real text", "more"]
    assert text_lines("<p>x</p><svg/><p>after</p>") == ["x", "after"] and text_lines("a<svg><title>q</title><text>no</text></svg>b<svg>c <noscript>no</noscript>d") == ["abc d"]
    assert text_lines("<script>var a = '<svg>';</script>ok</svg>") == ["ok"] and text_lines("<svg>" * 3000 + "x" + "<template>" * 3000) == ["x"]
    assert text_lines("") == [] and text_lines("<script>never closed") == []
    assert locate("HTTP://u@WWW.A.com:80/x?y#z") == ("a.com", "/x?y") and locate(None) == (None, "") and locate("nohost") == (None, "")


class Reader(HTMLParser):
    """The text of a page by the standard library's parser."""

    BREAKS = {"p", "div", "br", "li", "ul", "h1", "h2", "tr", "td", "table", "nav", "main", "footer", "header", "body", "html", "article"}
    HIDDEN = {"title", "svg", "noscript", "template", "script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [""], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        if tag in self.BREAKS and not self.hidden:
            self.out.append("")

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN
        if tag in self.BREAKS and not self.hidden:
            self.out.append("")

    def handle_startendtag(self, tag, attrs):
        if tag in self.BREAKS and not self.hidden:
            self.out.append("")

    def handle_data(self, data):
        if not self.hidden:
            parts = data.split("\n")
            self.out[-1] += parts[0]
            self.out.extend(parts[1:])


def real_page(r):
    words = lambda n: " ".join(r.choice(["news", "caf&eacute;", "5 &lt; 6", "a &amp; b", "<b>bold</b>", '<a href="/x?y=1&z=2">link</a>', "w\u00f6rd", "<img src=x>"]) for _ in range(n))
    head = f"<head><meta charset=utf-8><title>{words(3)}</title><style>p > a {{ }}</style><script>if (1 < 2) {{ x('<p>no</p>'); }}</script>" + r.choice(["</head>", ""])
    body = [r.choice([f"<p class='k'>{words(8)}</p>", f"<div><ul><li>{words(2)}<li>{words(2)}</ul></div>", f"<h1>{words(3)}</h1>", f"<table><tr><td>{words(1)}</td><td>{words(1)}</td></tr></table>", "<svg width=3><text>no</text></svg>", "<noscript>turn it on</noscript>", f"<!-- {words(4)} -->", f"{words(3)}<br/>{words(2)}\n"]) for _ in range(r.randint(1, 15))]
    return f"<!DOCTYPE html>\n<html lang=en>{head}<body><nav><a href=/>Home</a></nav><main>{''.join(body)}</main><footer>&copy; 2024</footer></body></html>"


@pytest.mark.parametrize("seed", range(20))
def test_text_lines_against_a_parser(seed):
    page = real_page(random.Random(seed))
    reader = Reader()
    reader.feed(page)
    reader.close()
    assert text_lines(page) == [x for x in (" ".join(line.split()) for line in reader.out) if x]


def page(*lines):
    return "".join(f"<p>{x}</p>" for x in lines)


def brute(rows):
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for i, u, h in rows:
        host, path = locate(u)
        others = [(p2, i2, h2) for i2, u2, h2 in rows for ho, p2 in [locate(u2)] if host and ho == host and p2 != path]
        own, pair = text_lines(h or ""), None
        if others:
            def rank(o):
                n = 0
                while n < min(len(o[0]), len(path)) and o[0][n] == path[n]:
                    n += 1
                return n
            # of paths alike in prefix, the neighbours in order are the nearest
            before = max((o[0] for o in others if o[0] < path), default=None)
            after = min((o[0] for o in others if o[0] > path), default=None)
            best = max([p for p in (before, after) if p is not None], key=lambda p: rank((p,)))
            assert rank((best,)) == max(map(rank, others))
            pair = next(o for o in others if o[0] == best)
        gone = set(common_lines(own, text_lines(pair[2] or ""))) if pair else set()
        out.append((i, pair[1] if pair else None, "\n".join(x for j, x in enumerate(own) if j not in gone), len(own), len(gone)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for i in range(80):
        host = r.choice(["a.com", "b.org", "c.net", f"only{i}.com"])
        path = "/".join(r.choice(["x", "y", "zz"]) for _ in range(r.randint(0, 3)))
        body = ["menu", host, *[r.choice(["shared one", "shared two", f"own {i} {j}"]) for j in range(r.randint(0, 6))], "foot"]
        rows.append((i, f"https://{host}/{path}", page(*body)))
    rows += [(90, None, page("x")), (91, "bad", page("x")), (92, "http://a.com/x", None), (93, "http://a.com/x", ""), (None, "http://a.com/x/q", page("menu", "k")), rows[0], (1, *rows[0][1:]), (94, "http://b.org/long", page(*[f"l{j}" for j in range(3000)])), (95, "http://b.org/long2", page(*[f"l{j}" for j in range(0, 3000, 2)]))]
    df = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, host int")
    assert sorted((tuple(x) for x in main_text(df).collect()), key=str) == brute(rows)
    assert main_text(df.limit(0)).count() == 0
