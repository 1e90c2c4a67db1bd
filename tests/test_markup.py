"""Character references and nested fragments against plain Python."""

import html
import json
import random

from pyspark.sql import functions as F

from graphloom.functions import markup
from graphloom.functions import normative as N
from graphloom.sources import artifacts


def test_character_references(spark):
    texts = ["&mdash; &eacute; &copy;", "&lt;b&gt; &amp;lt; &quot;&#39;&apos;", "&#20013;&#x6587;&#65 &#x41", "&notit; &noti; &amp &ampx", "&#0; &#xD800; &#1114112; &#99999999999999999; &#128; &#x9f; &#1;", "no & reference; & &; &&", "", None, "AT&T &nosuch;", "&#;&#x;&"]
    rng = random.Random(3)
    texts += ["".join(rng.choice(["&", "#", "x", "lt", "amp", ";", "not", "eacute", "12", " ", "中"]) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["u"] for r in table.select("i", markup.unescaped(F.col("t")).alias("u")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (html.unescape(t) if t is not None else None), t


def joined(value, separator=""):
    if isinstance(value, dict):
        return joined(value.get("content"), separator)
    if isinstance(value, list):
        return separator.join(p for p in (joined(x) for x in value) if p).strip()
    return "" if value is None else str(value).strip()


def some(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(["", " a ", 'q"uo\\te', "表 1", "x\ny", "tab\t", "[not json", "a, b: {c}", 12, 1.5, True, False, None])
    if rng.random() < 0.5:
        return [some(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    own = {"type": some(rng, 1), "content": some(rng, depth - 1), "other": some(rng, depth - 1)}
    return {k: own[k] for k in rng.sample(sorted(own), rng.randint(0, 3))}


def test_nested_fragments(spark):
    rng = random.Random(8)
    values = [[{"type": "text", "content": [{"content": [["deep", {"content": " er "}], None]}, "x"]}, {"content": "second"}]]
    values += [v for v in (some(rng, 5) for _ in range(400)) if isinstance(v, (dict, list))]
    table = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=bool(i % 2), indent=i % 3 or None)) for i, v in enumerate(values)], "i int, t string")
    for separator in ("", "\n"):
        got = {r["i"]: r["u"] for r in table.select("i", markup.nested_text(F.col("t"), N.strip, separator).alias("u")).collect()}
        for i, v in enumerate(values):
            assert got[i] == joined(v, separator), v


def test_table_text_keeps_empty_cells(spark):
    rows = ["<table><tr><td>a</td><td></td><td>c&mdash;d</td></tr><tr><td>x<b>y</b>z</td><td>1<br/>2</td></tr></table>", "<tr><td></td><td></td></tr>", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "h string").select(artifacts.report_table_text(F.col("h"))).collect()]
    assert got == ["a | | c—d\nx y z | 1\n2", "", ""]
