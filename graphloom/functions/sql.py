"""The functions of normative text for SQL: scalar ones, and table functions that give a row a sentence, requirement, citation or keyword.

They are SQL functions, so a query that calls them is planned as if their bodies stood in it: a table
function after LATERAL is a generator over its row, without a join or a shuffle.  Spark takes no SQL
function inside another one's arguments or lambdas, so bodies are put together as text here.  Names
begin with ``gl_``.  Arguments of table functions are columns or built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from graphloom.functions import normative as N


def words(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in values) + ")"


def any_of(s: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"contains({s}, '{w}')" for w in values) + ")"


def starts(s: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"startswith({s}, '{w}')" for w in values) + ")"


def strip(s: str) -> str:
    return rf"regexp_replace({s}, r'(?U)^\s+|\s+$', '')"


def normalize(s: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(replace({s}, '　', ' '), r'{N.CJK_GAP}', ''), r'(?U)\s+', ' ')")


def modality(s: str) -> str:
    t = strip(s)
    return (
        f"CASE WHEN {any_of(t, N.FORBIDDEN)} THEN 'forbidden' WHEN {starts(t, N.CONDITIONAL)} AND {any_of(t, N.MUST + N.SHOULD + N.MAY)} THEN 'conditional'"
        f" WHEN {any_of(t, N.MUST)} THEN 'must' WHEN {any_of(t, N.SHOULD)} THEN 'should' WHEN {any_of(t, N.MAY)} THEN 'may' END"
    )


def marker(s: str) -> str:
    """The earliest modal marker, the first listed of equal places: (at, order, size)."""
    found = ", ".join(f"named_struct('at', instr({s}, '{m}'), 'order', {i}, 'size', {len(m)})" for i, m in enumerate(N.MARKERS))
    return f"array_min(filter(array({found}), m -> m.at > 0))"


def subject(s: str) -> str:
    return f"nullif(btrim(substring({s}, 1, {marker(s)}.at - 1), '{N.EDGE_MARKS}'), '')"


def action(s: str) -> str:
    m = marker(s)
    return f"coalesce(nullif(btrim(substring({s}, {m}.at + {m}.size), '{N.EDGE_MARKS}'), ''), {strip(s)})"


def keywords(s: str, values: list[str]) -> str:
    return f"filter({words(values)}, w -> contains({s}, w))"


def sentences(s: str) -> str:
    pieces = rf"filter(transform(split(replace({s}, '\n', ' '), r'(?<=[；。])'), x -> {strip('x')}), x -> x <> '')"
    bare = rf"transform({pieces}, x -> regexp_replace(x, r'(?U)^\d+\.\d+\.\d+\s*', ''))"
    glued = "concat(slice(acc, 1, size(acc) - 1), array(concat(rtrim('。', try_element_at(acc, -1)), x)))"
    return f"aggregate({bare}, CAST(array() AS ARRAY<STRING>), (acc, x) -> CASE WHEN size(acc) > 0 AND {modality('x')} IS NULL AND length(x) < 18 THEN {glued} ELSE concat(acc, array(x)) END)"


def item_requirement(s: str, item: str) -> str:
    """What a list item asks under the first line of ``s``."""
    clean = rf"btrim(regexp_replace({item}, r'(?U)^(?:\(?\d+\)?|\d+[）\.])\s*', ''), '；;')"
    lead = rf"regexp_replace(rtrim('：:', {strip(f"substring_index({s}, '\n', 1)")}), r'(?U)^\d+\.\d+\.\d+\s*', '')"
    verb = f"CASE WHEN contains({lead}, '宜包括') THEN '宜包括' WHEN contains({lead}, '应包括') THEN '应包括' ELSE '包括' END"
    who = f"coalesce({subject(lead)}, {lead})"
    return (
        f"CASE WHEN {any_of(lead, ['包括下列', '包括以下', '应包括', '宜包括'])} THEN concat({who}, {verb}, rtrim('。', {clean}), '。')"
        f" WHEN contains({lead}, '应遵守下列') THEN concat({who}, '应遵守：', rtrim('。', {clean}), '。') WHEN endswith({clean}, '。') THEN {clean} ELSE concat({clean}, '。') END"
    )


def requirements(s: str, items: str) -> str:
    """Requirement texts with modality: of list items that an introduction asks for, else of sentences with a modal verb."""
    listed = f"transform({items}, x -> named_struct('t', {item_requirement(s, 'x')}, 'm', {modality(s)}))"
    split = f"filter(transform({sentences(s)}, x -> named_struct('t', x, 'm', {modality('x')})), r -> r.m IS NOT NULL)"
    return f"CASE WHEN size({items}) > 0 AND ({modality(s)} IS NOT NULL OR {any_of(s, N.LIST_INTRO)}) THEN {listed} ELSE {split} END"


def citations(s: str) -> str:
    code, number, year = (f"regexp_extract_all({s}, r'{N.STANDARD_CODE}', {i})" for i in (1, 2, 3))
    return f"array_distinct(zip_with(zip_with({code}, {number}, (a, b) -> concat(a, b)), {year}, (a, y) -> concat(a, CASE WHEN y <> '' THEN concat('-', y) ELSE '' END)))"


#: name: (arguments, result, body).
SCALARS = {
    "gl_normalize": ("s STRING", "STRING", normalize("s")),
    "gl_modality": ("s STRING", "STRING", modality("s")),
    "gl_subject": ("s STRING", "STRING", subject("s")),
    "gl_action": ("s STRING", "STRING", action("s")),
    "gl_citations": ("s STRING", "ARRAY<STRING>", citations("s")),
}
TABLES = {
    "gl_sentences": ("s STRING", "i INT, sentence STRING", f"SELECT * FROM posexplode({sentences('s')})"),
    "gl_requirements": ("s STRING, items ARRAY<STRING>", "i INT, requirement_text STRING, modality STRING", f"SELECT pos, col.t, coalesce(col.m, {modality('col.t')}, 'must') FROM posexplode({requirements('s', 'items')})"),
    "gl_cited": ("s STRING", "i INT, standard_code STRING", f"SELECT * FROM posexplode({citations('s')})"),
    "gl_keywords": ("s STRING", "i INT, keyword STRING", f"SELECT * FROM posexplode({keywords('s', N.OBJECTS)})"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes these and the name-stable functions callable in the session's SQL; their names."""
    for name, (args, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    for name, (args, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE({columns}) RETURN {body}")
    return sorted([*SCALARS, *TABLES, *N.register(spark)])
