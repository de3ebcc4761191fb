import random
import re

import numpy as np

from sparkloom.llm.url_filter import RULES, Globs, canonical, filter_urls, keep_allowed


def to_regex(g):
    return re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g).encode(), re.S)


def test_globs_against_regexes():
    r = random.Random(0)
    globs = ["".join(r.choice("ab*?/") for _ in range(r.randint(0, 12))) for _ in range(60)] + ["*", "", "**a**", "?"]
    texts = ["".join(r.choice("ab/") for _ in range(r.randint(0, 16))).encode() for _ in range(300)]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = Globs(globs).match(np.frombuffer(b"".join(texts), np.uint8), offs)
    want = np.array([[bool(to_regex(g).fullmatch(t)) for g in globs] for t in texts])
    assert (got == want).all()


def test_classes_and_quotes():
    texts = [b"a.b", b"axb", b"a*b", b"a?b"]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = Globs(["a[.x]b", "a[!.x]b", r"a\*b", "a[?]b"]).match(np.frombuffer(b"".join(texts), np.uint8), offs)
    assert got.tolist() == [[True, False, False, False], [True, False, False, False], [False, True, True, False], [False, True, False, True]]


def test_canonical():
    assert canonical("HTTP://User@WWW.Example.COM:80/a/./b/../c/?b=2&utm_source=x&a=1&ref=q#top") == b"example.com/a/c?a=1&b=2"
    assert canonical("https://e.org") == canonical("e.org/") == canonical("//e.org/?") == b"e.org/"
    assert canonical("http://e.org/%7Eu/%2f%e9") == b"e.org/~u/%2F%E9"
    assert canonical("http://e.org:8080/é") == "e.org:8080/é".encode()
    assert canonical("//example.com/p?u=http://evil.org/x") == canonical("example.com/p?u=http://evil.org/x") == b"example.com/p?u=http://evil.org/x"
    assert canonical("http://a.org/http://b.org/x") == b"a.org/http:/b.org/x"
    assert canonical("http:///x") is None and canonical("  ") is None


def test_rows(spark):
    rows = [(1, "https://spam-farm.example.org/x", 1), (2, "http://blog.spam.example.org/x", 1), (3, "http://ok.example.net/y", 1), (4, None, 1), (None, "", 1), (3, "http://ok.example.net/y", 1), (6, "http://ok.example.net/" + "z" * 200_000 + ".zip", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule int")
    got = sorted(((x.page_id, x.rules, x.rule, x.kept) for x in filter_urls(df).collect()), key=str)
    assert got == sorted([(1, ["spam_host"], "spam_host", False), (2, ["spam_host", "allowed_blog"], "allowed_blog", True), (3, [], None, True), (3, [], None, True), (4, [], None, False), (None, [], None, False), (6, ["binary_file"], "binary_file", False)], key=str)
    assert sorted(x.page_id for x in keep_allowed(df).collect()) == [2, 3, 3]
    assert keep_allowed(df).columns == df.columns
    assert sorted(x.page_id for x in keep_allowed(df, []).collect()) == [1, 2, 3, 3, 6]
    assert filter_urls(df.limit(0)).count() == 0 and keep_allowed(df.limit(0)).count() == 0
    assert len(RULES) == len({n for n, _, _ in RULES})
