"""Column functions on marked-up text: character references, nested fragments of JSON."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Numbers in 0x80..0x9f stand for the characters that Windows-1252 has there.
WINDOWS = {str(n): bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
TOKEN = r'"(?:[^"\\\\]|\\\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+'.replace("\\\\", "\\")
#: Kinds of open brackets: a list, an object; whether what they hold is text that counts; whether an object's current key is the one.
LIST, COUNTS, CURRENT = 1, 2, 4


#: HTML 4's names and the apostrophe with their semicolon, and those that HTML takes without one.
NAMES = {"apos;": "'"} | {f"{name};": chr(code) for name, code in html.entities.name2codepoint.items()} | {n: v for n, v in html.entities.html5.items() if not n.endswith(";")}


def _table(entries: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def unescaped(c: Column) -> Column:
    """Character references resolved once, as HTML does: numbers, HTML 4's names, and the longest name at the beginning of an unknown one."""
    tables = F.struct(_table(NAMES).alias("names"), _table(WINDOWS).alias("windows"))
    found = F.struct(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0)).alias("found"), F.split(c, REFERENCE).alias("around"))
    whole = F.transform(F.array(F.struct(tables.alias("t"), found.alias("f"))), lambda x: _resolved(x["f"]["found"], x["f"]["around"], x["t"]["names"], x["t"]["windows"]))[0]  # binds the tables once
    return F.when(c.contains("&"), whole).otherwise(c)


def _resolved(found: Column, around: Column, names: Column, windows: Column) -> Column:
    def character(number: Column) -> Column:
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        gone = number.between(1, 8) | (number == 0x0B) | number.between(0x0E, 0x1F) | number.between(0x7F, 0x9F) | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
        own = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.coalesce(windows[number.cast("string")], F.when(~valid, "\ufffd").when(gone, "").otherwise(own))

    def resolved(m: Column) -> Column:
        body = F.substring(m, 2, 40)
        digits, hexed = F.regexp_extract(body, r"^#([0-9]+);?$", 1), F.regexp_extract(body, r"^#[xX]([0-9a-fA-F]+);?$", 1)
        number = lambda text, base: F.least(F.conv(F.when(F.length(text) > 12, "999999999999" if base == 10 else "ffffffff").otherwise(text), base, 10).cast("long"), F.lit(0x110000)).cast("int")
        lengths = F.filter(F.sequence(F.greatest(F.length(body) - 1, F.lit(1)), F.lit(1), F.lit(-1)), lambda n: (n > 1) & names[F.substring(body, F.lit(1), n)].isNotNull())
        longest = F.get(lengths, F.lit(0))
        name = F.coalesce(names[body], F.when(longest.isNotNull(), F.concat(names[F.substring(body, F.lit(1), longest)], F.substring(body, longest + 1, F.lit(40)))), m)
        return F.when(digits != "", character(number(digits, 10))).when(hexed != "", character(number(hexed, 16))).otherwise(name)

    return F.concat(F.element_at(around, 1), F.array_join(F.transform(found, lambda m, i: F.concat(resolved(m), F.element_at(around, i + 2))), ""))


def nested_text(c: Column, strip, separator: str = "") -> Column:
    """The texts of a JSON value of any depth in order: scalars, items of lists, and what objects have as ``content``.

    Each is stripped; what the items of the outermost list hold is joined by ``separator``, all else
    without.  One pass over the value's tokens, with the open brackets as state.
    """
    start = F.struct(
        F.array().cast("array<int>").alias("open"), F.lit(None).cast("string").alias("held"), F.lit(0).alias("item"), F.lit(0).alias("outer"), F.array().cast("array<struct<item:int,text:string>>").alias("out")
    )

    def counts(s: Column) -> Column:
        top = F.element_at(s["open"], -1)
        return F.when(F.size(s["open"]) == 0, True).otherwise((top.bitwiseAND(COUNTS) != 0) & (top.bitwiseAND(LIST | CURRENT) != 0))

    def step(s: Column, t: Column) -> Column:
        depth, here = F.size(s["open"]), counts(s)
        shut = t.isin("]", "}", ",")
        text = F.when(s["held"].startswith('"'), F.from_json(F.concat(F.lit("["), s["held"], F.lit("]")), "array<string>")[0]).when(s["held"] == "true", "True").when(s["held"] == "false", "False").when(s["held"] != "null", s["held"])
        out = F.when(shut & s["held"].isNotNull() & here & text.isNotNull(), F.concat(s["out"], F.array(F.struct(s["item"].alias("item"), text.alias("text"))))).otherwise(s["out"])
        kind = F.when(t == "[", LIST).otherwise(0) + F.when(here, COUNTS).otherwise(0)
        below = F.slice(s["open"], F.lit(1), F.greatest(depth - 1, F.lit(0)))
        top = F.element_at(s["open"], -1)
        key = F.when(s["held"] == '"content"', CURRENT).otherwise(0)
        opened = (
            F.when(t.isin("[", "{"), F.concat(s["open"], F.array(kind)))
            .when(t.isin("]", "}"), below)
            .when((t == ":") & (depth > 0), F.concat(below, F.array(top.bitwiseAND(LIST | COUNTS).bitwiseOR(key))))
            .when((t == ",") & (depth > 0), F.concat(below, F.array(top.bitwiseAND(LIST | COUNTS))))
            .otherwise(s["open"])
        )
        outermost = (t == "[") & (s["outer"] == 0) & here
        return F.struct(
            opened.alias("open"), F.when(t.isin("[", "{", "]", "}", ":", ","), F.lit(None).cast("string")).otherwise(t).alias("held"),
            (s["item"] + F.when((t == ",") & (depth == s["outer"]) & (depth > 0), 1).otherwise(0)).alias("item"), F.when(outermost, depth + 1).otherwise(s["outer"]).alias("outer"), out.alias("out"),
        )

    tokens = F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
    parts = F.aggregate(tokens, start, step, lambda s: s["out"])

    def together(parts: Column) -> Column:
        items = F.transform(F.array_distinct(F.transform(parts, lambda p: p["item"])), lambda i: F.array_join(F.transform(F.filter(parts, lambda p: p["item"] == i), lambda p: strip(p["text"])), ""))
        return strip(F.array_join(F.filter(items, lambda x: x != ""), separator))

    whole = F.transform(F.array(parts), together)[0]
    return F.when(c.rlike(r"^\s*[\[{]"), whole).otherwise(strip(F.coalesce(c, F.lit(""))))
