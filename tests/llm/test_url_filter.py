"""The bit-parallel automaton against rules applied one by one."""

import random
import re

import numpy as np
import pytest

from graphloom.llm.common import text_bytes
from graphloom.llm.url_filter import GlobAutomaton, Rule, filter_urls

RULES = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"), Rule("a.b.example.org/" + "deep/" * 30, "block")]


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fit = []
    for r in RULES:
        h, p = r.name.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append(r)
    best = max(fit, key=lambda r: len(r.name)) if fit else None
    return host, path, best.name if best else None, best.verdict if best else "allow"


def test_filter(spark):
    rng = random.Random(2)
    urls = [None, "", "x", "://", "http://", "http://NET/", "http://net", "http://.net/", "http://a.net?x/", "http://evil.com/.example.net/en/", "http://ex.org/fr/?q#z", "http://É.example.NET/en/é", "ftp://a.example.com/de/" + "z" * 20000, "http://a.b.example.org/" + "deep/" * 31]
    for _ in range(400):
        urls.append("http://" + ".".join(rng.choice(["a", "example", "Net", "net", "com", "org", ""]) for _ in range(rng.randint(1, 4))) + "".join(rng.choice(["/", "en", "de/", "fr/", "?", "#", ".net/"]) for _ in range(rng.randint(0, 5))))
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages, RULES).collect()}
    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert filter_urls(pages.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in filter_urls(pages, []).collect()} == {"allow"}


def expression(glob):
    """The glob as a regular expression."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[":
            end = glob.index("]", i + 2)
            own = glob[i + 1 : end]
            out, i = out + (f"[^/{own[1:]}]" if own[0] in "!^" else f"(?!/)[{own}]"), end + 1
        else:
            i += glob[i] == "\\"
            out, i = out + re.escape(glob[i]), i + 1
    return re.compile(out, re.DOTALL)


def test_globs_of_any_form():
    import pyarrow as pa

    rng = random.Random(8)
    globs = ["", "*", "**", "?", "a?*b", "*a*/b", "**/b", "[a-c]*", "[!a]b", "é?", "?é**", "\\*a", "a**b*c", "*.x[0-9-]/**/*.gif", "***", "[^b-]é", "\\[a]"] + ["".join(rng.choice("ab/?*é.") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = ["", "/", "*a", "[a]", ".a.x7/q/r/t.gif", ".a.x-/t.gif", "日é", "é日", "-é"] + ["".join(rng.choice("ab/cé.日") for _ in range(rng.randint(1, 10))) for _ in range(600)]
    automaton = GlobAutomaton(globs)
    found = automaton.match(*text_bytes(pa.array(texts, pa.string())))
    want = np.array([[expression(g).fullmatch(t) is not None for g in globs] for t in texts])
    assert automaton.words > 4 and (found == want).all()
    with pytest.raises(ValueError):
        GlobAutomaton(["a[b"])


def test_patterns_null_ids_and_repeated_rows(spark):
    rules = [Rule("ads", "block", "*/ads/**.gif"), Rule("a*[b].org/", "block"), Rule("two", "allow", "*.x?.org/[a-f]*")]
    urls = ["http://q.org/ads/1/z.gif", "http://q.org/b/ads/z.gif", "http://a*[b].org/", "http://axb.org/", "http://xé.org/ff", "http://xé.org/gf"]
    pages = spark.createDataFrame([(None if i == 4 else i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string")
    got = sorted(((r["page_id"] if r["page_id"] is not None else -1, r["rule"], r["verdict"]) for r in filter_urls(pages, rules).collect()), key=str)
    assert got == sorted([(0, "ads", "block"), (0, "ads", "block"), (1, None, "allow"), (2, "a*[b].org/", "block"), (3, None, "allow"), (-1, "two", "allow"), (5, None, "allow")], key=str)
