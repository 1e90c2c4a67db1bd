"""Column functions on the text of normative documents; all native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, markers and word lists that results depend on.
CJK_GAP = r"(?U)(?<=[一-鿿])\s+(?=[一-鿿])"
CHAPTER = r"(?U)^(\d+)\s+(.+)$"
SECTION = r"(?U)^(\d+\.\d+)\s+(.+)$"
APPENDIX = r"(?U)^附录([A-ZＡ-Ｚ])\s*(.*)$"
CLAUSE = r"(?U)^(\d+\.\d+\.\d+)\s*(.*)$"
LIST_ITEM = r"(?U)^((?:\(?\d+\)?(?=\s|$)|\d+[）]|(?:\d+\.(?!\d))))\s*(.*)$"
PARAGRAPH_ITEM = r"(?U)^((?:\d+[）]|(?:\d+\.(?!\d))))\s*(.*)$"
STANDARD_CODE = r"(?U)\b(GB/T|GB|SL|DL/T|SDJ|SLJ|CECS|JGJ/T|JGJ)\s*(\d+(?:/\w+)?)(?:[-—](\d{2,4}))?"
TABLE_REF = r"(?U)(?i)表\s*((?:[A-Z](?:\.\s*)?)?\d+(?:\.\d+)*(?:-\d+)*)"
FORBIDDEN = ["不得", "严禁", "禁止"]
MUST = ["应当", "应", "必须"]
SHOULD = ["宜"]
MAY = ["可"]
CONDITIONAL = ["当", "若", "对", "凡", "必要时", "出现", "对于"]
LIST_INTRO = ["包括下列", "包括以下", "应包括", "宜包括", "应遵守下列", "应符合下列", "如下", "应按下列"]
OBJECTS = ["报告", "资料", "记录", "文件", "预案", "监测", "检测", "试验", "计算", "检查表", "报告书"]
APPLICABILITY = ["对于", "对", "当", "若", "凡", "大型", "中型", "小型", "土石坝", "混凝土坝", "砌石坝"]
DOMAIN = ["现场安全检查", "安全检测", "监测", "运行管理", "防洪能力", "渗流安全", "结构安全", "抗震安全", "金属结构"]
EVIDENCE = {
    "监测": ["监测资料", "监测报告", "监测记录"],
    "检查": ["检查记录", "现场检查表", "检查报告"],
    "检测": ["检测报告", "检测记录"],
    "试验": ["试验报告", "试验记录"],
    "勘察": ["勘察资料", "勘察报告"],
    "计算": ["计算书", "复核计算成果"],
    "审批": ["审批文件", "报批记录"],
    "预案": ["预案正文", "审批或备案材料"],
    "报告": ["专项报告", "总报告"],
}
EVIDENCE_DEFAULT = "相关说明资料"
EDGE_MARKS = " ：:，,；;。"
# End of fixed values.

MARKERS = FORBIDDEN + MUST + SHOULD + MAY
STRINGS = "array<string>"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_text(c: Column) -> Column:
    """Ideographic spaces become blanks, blanks between CJK characters go, white space collapses."""
    return strip(F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("　"), F.lit(" ")), CJK_GAP, ""), r"(?U)\s+", " "))


def any_of(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def starts_with_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(w) for w in words])


def title_info(c: Column) -> Column:
    """(node_type, ref, title) of an appendix, section or chapter heading, else null."""
    ref = F.regexp_extract(c, APPENDIX, 1)
    rest = strip(F.regexp_extract(c, APPENDIX, 2))
    make = lambda kind, r, t: F.struct(F.lit(kind).alias("node_type"), r.alias("ref"), t.alias("title"))
    one_dot = F.length(c) - F.length(F.replace(c, F.lit("."), F.lit(""))) == 1
    return (
        F.when(c.rlike(APPENDIX), make("appendix", ref, F.when(rest != "", rest).otherwise(F.concat(F.lit("附录"), ref))))
        .when(c.rlike(SECTION) & one_dot, make("section", F.regexp_extract(c, SECTION, 1), strip(F.regexp_extract(c, SECTION, 2))))
        .when(c.rlike(CHAPTER), make("chapter", F.regexp_extract(c, CHAPTER, 1), strip(F.regexp_extract(c, CHAPTER, 2))))
    )


def decided_title(label: Column, c: Column) -> Column:
    """The same for a label that was decided elsewhere; the reference may be missing then."""
    label = F.lower(F.trim(label))
    heuristic = title_info(c)
    make = lambda kind, r, t: F.struct(kind.alias("node_type"), r.alias("ref"), t.alias("title"))
    none = F.lit(None).cast("string")
    chapter = c.rlike(CHAPTER)
    number, rest = F.regexp_extract(c, CHAPTER, 1), strip(F.regexp_extract(c, CHAPTER, 2))
    section = c.rlike(SECTION)
    return (
        F.when(label == "appendix", F.when(c.rlike(APPENDIX), heuristic).otherwise(make(label, none, c)))
        .when(label == "section", F.when(section, make(label, F.regexp_extract(c, SECTION, 1), strip(F.regexp_extract(c, SECTION, 2)))).otherwise(make(label, none, c)))
        .when(label.isin("chapter", "reference_standard"), F.when(chapter, make(label, number, rest)).otherwise(make(label, none, c)))
    )


def group_or_null(c: Column, pattern: str, group: int) -> Column:
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def table_ref(c: Column) -> Column:
    return F.regexp_replace(group_or_null(c, TABLE_REF, 1), r"(?U)\s+", "")


def inline_title(c: Column, next_type: Column, next_text: Column) -> Column:
    """Does a heading look like one within a clause?"""
    by_next = (next_type == "table") | next_text.rlike(LIST_ITEM) | starts_with_any(next_text, ["表", "式中", "公式"])
    return c.endswith("：") | c.endswith(":") | c.contains("如下") | F.coalesce(by_next, F.lit(False))


def modality(c: Column) -> Column:
    """forbidden, conditional, must, should, may or null."""
    s = strip(c)
    return (
        F.when(any_of(s, FORBIDDEN), "forbidden")
        .when(starts_with_any(s, CONDITIONAL) & any_of(s, MUST + SHOULD + MAY), "conditional")
        .when(any_of(s, MUST), "must").when(any_of(s, SHOULD), "should").when(any_of(s, MAY), "may")
    )


def first_marker(c: Column) -> Column:
    """(at, order, size) of the earliest modal marker, the first listed of equal places; null without one."""
    found = [F.struct(F.instr(c, m).alias("at"), F.lit(i).alias("order"), F.lit(len(m)).alias("size")) for i, m in enumerate(MARKERS)]
    return F.array_min(F.filter(F.array(*found), lambda x: x["at"] > 0))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def subject(c: Column) -> Column:
    cut = lambda m: F.btrim(F.substring(c, F.lit(1), m["at"] - 1), F.lit(EDGE_MARKS))
    return blank_to_null(F.transform(F.array(first_marker(c)), cut)[0])


def action(c: Column) -> Column:
    m = first_marker(c)
    rest = F.btrim(F.substring(c, m["at"] + m["size"], F.length(c)), F.lit(EDGE_MARKS))
    return F.coalesce(blank_to_null(rest), strip(c))


def keywords(c: Column, words: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: c.contains(w))


def objects(c: Column) -> Column:
    return keywords(c, OBJECTS)


def evidence(c: Column) -> Column:
    rules = F.array(*[F.when(c.contains(k), F.array(*[F.lit(v) for v in vs])) for k, vs in EVIDENCE.items()])
    found = F.array_distinct(F.flatten(F.filter(rules, lambda x: x.isNotNull())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(EVIDENCE_DEFAULT)))


def domain_tags(heading_path: Column, c: Column) -> Column:
    return F.array_distinct(F.concat(heading_path, keywords(c, DOMAIN)))


def applicability(c: Column) -> Column:
    return F.when(starts_with_any(c, APPLICABILITY), F.substring_index(F.substring_index(c, "，", 1), "。", 1))


def citations(c: Column) -> Column:
    """Distinct standard codes in order, as ``code number[-year]`` without blanks."""
    codes, numbers, years = (F.regexp_extract_all(c, F.lit(STANDARD_CODE), F.lit(i)) for i in (1, 2, 3))
    joined = F.zip_with(F.zip_with(codes, numbers, lambda a, b: F.concat(a, b)), years, lambda a, y: F.concat(a, F.when(y != "", F.concat(F.lit("-"), y)).otherwise("")))
    return F.array_distinct(joined)


def cited_targets(codes: Column) -> Column:
    return F.transform(codes, lambda x: F.struct(x.alias("standard_code"), F.lit(None).cast("string").alias("clause_ref"), F.lit("mandatory").alias("citation_type")))


def merge_targets(*groups: Column) -> Column:
    """Ordered distinct union of cited targets; those without code go, a missing type is ``unknown``."""
    whole = [F.coalesce(g, F.array().cast("array<struct<standard_code:string,clause_ref:string,citation_type:string>>")) for g in groups]
    kept = F.filter(F.concat(*whole), lambda t: F.coalesce(t["standard_code"], F.lit("")) != "")
    return F.array_distinct(F.transform(kept, lambda t: F.struct(t["standard_code"].alias("standard_code"), t["clause_ref"].alias("clause_ref"), F.coalesce(blank_to_null(t["citation_type"]), F.lit("unknown")).alias("citation_type"))))


def dedupe_strings(c: Column) -> Column:
    """Ordered distinct of normalized, non-blank strings."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast(STRINGS)), normalize_text), lambda x: F.coalesce(x, F.lit("")) != ""))


def sentences(c: Column) -> Column:
    """Pieces after ；or 。, without clause numbers; short pieces without modality are glued to the one before."""
    pieces = F.filter(F.transform(F.split(F.replace(c, F.lit("\n"), F.lit(" ")), "(?<=[；。])"), strip), lambda x: x != "")
    bare = F.transform(pieces, lambda x: F.regexp_replace(x, r"(?U)^\d+\.\d+\.\d+\s*", ""))

    def add(acc: Column, x: Column) -> Column:
        glue = (F.size(acc) > 0) & modality(x).isNull() & (F.length(x) < 18)
        last = F.rtrim(F.try_element_at(acc, F.lit(-1)), F.lit("。"))
        return F.when(glue, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, x)))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(bare, F.array().cast(STRINGS), add)


def item_intro(intro: Column) -> Column:
    """(who, verb, following) of a sentence that introduces a list: what its items' requirements begin with; verb is null unless it says what is included."""
    lead = F.regexp_replace(F.rtrim(strip(intro), F.lit("：:")), r"(?U)^\d+\.\d+\.\d+\s*", "")
    return F.transform(F.array(lead), intro_parts)[0]


def intro_parts(lead: Column) -> Column:
    including = any_of(lead, ["包括下列", "包括以下", "应包括", "宜包括"])
    verb = F.when(lead.contains("宜包括"), "宜包括").when(lead.contains("应包括"), "应包括").otherwise("包括")
    return F.struct(F.coalesce(subject(lead), lead).alias("who"), F.when(including, verb).alias("verb"), lead.contains("应遵守下列").alias("following"))


def item_requirement(intro: Column, item: Column) -> Column:
    """The requirement that a list item makes under the sentence that introduces the list."""
    return requirement_under(item_intro(intro), item)


def requirement_under(intro: Column, item: Column) -> Column:
    """The same for the sentence's ``item_intro``, which all items of a list share."""
    clean = F.btrim(F.regexp_replace(item, r"(?U)^(?:\(?\d+\)?|\d+[）\.])\s*", ""), F.lit("；;"))
    bare = F.concat(F.rtrim(clean, F.lit("。")), F.lit("。"))
    return (
        F.when(intro["verb"].isNotNull(), F.concat(intro["who"], intro["verb"], bare))
        .when(intro["following"], F.concat(intro["who"], F.lit("应遵守："), bare))
        .otherwise(F.when(clean.endswith("。"), clean).otherwise(F.concat(clean, F.lit("。"))))
    )


def clamp(c: Column, default: float = 0.0) -> Column:
    value = F.coalesce(c.try_cast("double"), F.lit(float(default)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def segmentation_confidence(continued: Column, in_appendix: Column, blocks: Column) -> Column:
    """0.95 less 0.08, 0.04 and 0.05, at least 0.55."""
    hundredths = 95 - F.when(continued, 8).otherwise(0) - F.when(in_appendix, 4).otherwise(0) - F.when(blocks > 6, 5).otherwise(0)
    return F.greatest(hundredths, F.lit(55)).cast("double") / F.lit(100.0)


def edge_uid(kind: Column, source: Column, target: Column) -> Column:
    return F.concat(F.lit("edge:"), F.substring(F.sha1(F.concat_ws("|", kind, source, target)), 1, 16))


def concept_uid(c: Column) -> Column:
    return F.concat(F.lit("concept:"), F.substring(F.sha1(c), 1, 12))


def reference_standard_uid(code: Column) -> Column:
    return F.concat(F.lit("reference-standard:"), F.substring(F.sha1(F.lower(code)), 1, 12))


def block_id(page: Column, block: Column, item: Column, width: int = 2) -> Column:
    """``p001-b002`` and ``-i03`` for an item (0 or null: none)."""
    return F.concat(F.format_string("p%03d-b%03d", page, block), F.when(item > 0, F.format_string(f"-i%0{width}d", item)).otherwise(""))


def safe_segment(c: Column) -> Column:
    """A storage-safe name."""
    return F.lower(F.btrim(F.regexp_replace(strip(c), "[^A-Za-z0-9._-]+", "-"), F.lit("-.")))


#: Fixed value: codes of standards as file names hold them.
STANDARD_FILE = r"(?iU)(GB|SL|DL/T|SDJ|SLJ)\s*(\d+)[-—](\d{2,4})"


def file_stem(name: Column) -> Column:
    """The last part of a path without its last extension."""
    return F.regexp_replace(F.substring_index(name, "/", -1), r"(?<=.)\.[^.]+$", "")


def file_descriptor(name: Column) -> Column:
    """standard_id, code, year and title of a standard from its file name; null if the name holds no code."""
    kind, number, year = (F.regexp_extract(name, STANDARD_FILE, i) for i in (1, 2, 3))
    title = F.regexp_replace(file_stem(name), r"(?U)^\d+[_\s-]*", "")
    made = F.struct(F.concat(F.lower(F.replace(kind, F.lit("/"), F.lit(""))), number, F.lit(":"), year).alias("standard_id"), F.concat(F.upper(kind), number).alias("code"), year.alias("year"), title.alias("title"))
    return F.when(name.rlike(STANDARD_FILE), made)


#: Ids of standards as requests give them, and folders of graph spaces.
STANDARD_ID = r"^([a-z]+)(\d+):(\d{2,4})$"
SPACE_FOLDER = r"(?i)^([a-z]+\d+)-(\d{2,4})$"


def id_descriptor(standard_id: Column, name: Column) -> Column:
    """standard_id, code, year and title of a standard from a given id, the title from the file's name; null if it is no such id."""
    own = F.lower(strip(standard_id))
    kind, number, year = (F.regexp_extract(own, STANDARD_ID, i) for i in (1, 2, 3))
    return F.when(own.rlike(STANDARD_ID), F.struct(own.alias("standard_id"), F.concat(F.upper(kind), number).alias("code"), year.alias("year"), file_stem(name).alias("title")))


def space_descriptor(folder: Column) -> Column:
    """standard_id and code of a graph space from the name of its folder; any other name stands for itself."""
    kind, year = F.regexp_extract(folder, SPACE_FOLDER, 1), F.regexp_extract(folder, SPACE_FOLDER, 2)
    other = F.struct(folder.alias("standard_id"), F.upper(F.replace(folder, F.lit("-"), F.lit(""))).alias("code"))
    return F.when(folder.rlike(SPACE_FOLDER), F.struct(F.concat(F.lower(kind), F.lit(":"), year).alias("standard_id"), F.upper(kind).alias("code"))).otherwise(other)


def source_format(name: Column) -> Column:
    """docx, doc or else pdf, by the extension."""
    extension = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return F.when(extension.isin("docx", "doc"), extension).otherwise("pdf")


def document_slug(name: Column) -> Column:
    """The part of a document's id that comes from its file name; the caller adds a suffix of its own."""
    return F.substring(F.btrim(F.regexp_replace(F.lower(file_stem(name)), "[^a-zA-Z0-9._-]+", "-"), F.lit("-")), 1, 80)


#: Functions whose names can stand for themselves in SQL, as ``register`` makes them.
SQL_FUNCTIONS = {
    "gl_search_form": ("s STRING", "STRING", r"regexp_replace(trim(lower(coalesce(s, ''))), '(?U)\\s+', ' ')"),
    "gl_edge_uid": ("kind STRING, source STRING, target STRING", "STRING", "concat('edge:', substring(sha1(concat_ws('|', kind, source, target)), 1, 16))"),
    "gl_concept_uid": ("s STRING", "STRING", "concat('concept:', substring(sha1(s), 1, 12))"),
    "gl_block_id": ("page INT, block INT", "STRING", "format_string('p%03d-b%03d', page, block)"),
}


def register(spark) -> list[str]:
    """Makes the name-stable functions callable from SQL (as SQL functions, not as Python)."""
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return sorted(SQL_FUNCTIONS)
