"""Text as Column functions; everything here stays in the JVM.

White space is Unicode white space throughout, as in the class WS: Java's and RE2's ``\\s`` know ASCII only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
#: Line ends: \r\n counts as one.
EOL = r"\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}"
#: Citations, identities and the heading of references.
CITATION = r"\[(\d+(?:\s*[,–-]\s*\d+)*)\]"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
REFERENCES = r"(?im)^\s{0,3}#{0,6}\s*references\s*$"
#: Ligatures and dashes of typeset pages.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
DASHES = "−‐‑‒–—"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_ws(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), f"^{WS}+|{WS}+$", "")


def collapse_ws(text: Column | str) -> Column:
    return trim_ws(F.regexp_replace(_c(text), f"{WS}+", " "))


def clean_metadata_text(text: Column | str) -> Column:
    """Collapsed text; blank becomes null."""
    return F.nullif(collapse_ws(text), F.lit(""))


def normalize_text(text: Column | str) -> Column:
    return F.lower(collapse_ws(text))


def normalize_typeset(text: Column | str) -> Column:
    """Ligatures expanded, dashes and the minus sign as ``-``."""
    out = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), _c(text))
    return F.translate(out, DASHES, "-" * len(DASHES))


def normalize_heading(text: Column | str) -> Column:
    """Without leading hashes, collapsed, lower case."""
    return F.lower(collapse_ws(F.regexp_replace(trim_ws(text), "^#+", "")))


def strip_control(text: Column | str) -> Column:
    """Control characters but line breaks and tabs as blanks; the length stays."""
    return F.regexp_replace(_c(text), r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", " ")


def parse_year(text: Column | str) -> Column:
    """The first year from 1900 to 2099 that stands alone, else null."""
    return F.nullif(F.regexp_extract(_c(text), r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def clip(text: Column | str, width: int) -> Column:
    """Collapsed text, cut to ``width`` characters with an ellipsis."""
    flat = collapse_ws(text)
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def strip_citations(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(text), CITATION, ""), UUID, "")


def cited_numbers(text: Column | str) -> Column:
    """The sorted distinct numbers of ``[1]``, ``[2, 4]`` and ``[5-7]``; a range that runs backwards yields nothing."""
    groups = F.regexp_extract_all(_c(text), F.lit(CITATION), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))

    def numbers(part: Column) -> Column:
        ends = F.transform(F.regexp_extract_all(part, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
        lo, hi = F.try_element_at(ends, F.lit(1)), F.try_element_at(ends, F.size(ends))
        return F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))

    return F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers)))), F.array().cast("array<int>"))


def content_words(text: Column | str) -> Column:
    """The sorted distinct words of more than three characters a-z and 0-9."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(_c(text)), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) > 3)))


def body_before_references(markdown: Column | str) -> Column:
    return F.element_at(F.split(_c(markdown), REFERENCES, 2), 1)


def body_sentences(body: Column | str) -> Column:
    """Sentences of the lines that are neither blank nor headings, list marks removed."""
    lines = F.filter(F.transform(F.split(_c(body), "\n"), trim_ws), lambda x: (x != "") & ~x.startswith("#"))
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"^(?:[-*+]|\d+\.)\s+", ""))
    return F.filter(F.flatten(F.transform(bare, lambda x: F.split(x, r"(?<=[.!?])\s+(?=[A-Z])"))), lambda s: trim_ws(s) != "")


def lines_with_ends(text: Column | str) -> Column:
    """The lines with their terminators; no empty line after the last one."""
    return F.regexp_extract_all(_c(text), F.lit(rf"([^{EOL}]*(?:\r\n|[{EOL}])|[^{EOL}]+)"), F.lit(1))


def clean_reference_title(title: Column | str) -> Column:
    return F.regexp_replace(trim_ws(F.translate(_c(title), "_", " ")), f"{WS}+", " ")


def format_authors(authors: Column | str) -> Column:
    return F.when(F.coalesce(F.size(_c(authors)), F.lit(0)) <= 0, F.lit("Unknown authors")).otherwise(F.regexp_replace(F.array_join(_c(authors), ", "), r"\.+$", ""))


def file_stem(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), r"\.[^.]+$", "")


def is_filename_title(title: Column | str, file_name: Column | str) -> Column:
    """Whether a title is missing or nothing but the file's name."""
    spaced = lambda c: trim_ws(F.translate(c, "_", " "))
    return F.coalesce(_c(title) == "", F.lit(True)) | (spaced(_c(title)) == spaced(file_stem(file_name)))


def is_internal_title(title: Column | str) -> Column:
    """Titles that writing programs leave behind."""
    t = F.lower(trim_ws(title))
    # fixed values: titles of writing programs
    junk = ["no job name", "untitled", "untitled document", "untitled-1", "(no title)", "adobe pdf"]
    return t.isin(*junk) | t.startswith("microsoft word - ") | t.rlike(r"\d+\.\.\d+") | t.rlike(r"^[a-z]{1,4}\d+[a-z]?(?:\s+\d+\.\.\d+)?$")


def metadata_from_name(name: Column | str) -> dict[str, Column]:
    """authors, year and title of a file called ``authors-YEAR-title``; without a year, or a title behind it, the whole name is the title."""
    stem = collapse_ws(F.regexp_replace(F.regexp_replace(_c(name), r"(?i)\.(?:pdf|txt|md)$", ""), "_", " "))
    cut = r"^(.*?)(?:^|[\s-])((?:19|20)\d{2})(?:[\s-]|$)(.*)$"
    has = stem.rlike(r"(?:^|[\s-])(?:19|20)\d{2}(?:[\s-]|$)")
    edge = lambda c: F.nullif(F.regexp_replace(c, r"^[ \-_,]+|[ \-_,]+$", ""), F.lit(""))
    whole = F.nullif(stem, F.lit(""))
    return {"authors_text": F.when(has, edge(F.regexp_extract(stem, cut, 1))), "year": F.when(has, F.regexp_extract(stem, cut, 2).cast("int")), "title": F.when(has, F.coalesce(edge(F.regexp_extract(stem, cut, 3)), whole)).otherwise(whole)}


#: Section types by exact title.
SECTION_TITLES = {
    "abstract": "abstract", "introduction": "introduction", "related work": "related_work", "background": "related_work",
    "methods": "methods", "method": "methods", "methodology": "methods", "materials and methods": "methods", "experiments": "methods", "experimental setup": "methods",
    "results": "results", "results and discussion": "results", "findings": "results", "discussion": "discussion", "limitations": "limitations", "limitation": "limitations",
    "conclusion": "conclusion", "conclusions": "conclusion", "references": "other", "bibliography": "other", "acknowledgments": "other", "acknowledgements": "other", "acknowledgment": "other", "acknowledgement": "other", "appendix": "other", "supplementary material": "other", "supplementary materials": "other",
}
#: Section types by words of the title, the first rule that fits.
SECTION_RULES = [
    (r"\babstract\b", "abstract"),
    (r"\bintroduction\b", "introduction"),
    (r"\b(related work|prior work|background|literature)\b", "related_work"),
    (r"\bconclu", "conclusion"),
    (r"\b(limitation|failure)", "limitations"),
    (r"\b(experimental setup|implementation|experiments?|methods?|methodology|materials)\b", "methods"),
    (r"\b(results?|evaluation|ablation|tests?|findings)\b", "results"),
    (r"\bdiscussion\b", "discussion"),
    (r"\b(references|bibliography|acknowledge?ments?|appendix|supplementary|associated content|author information|funding|conflicts? of interest|notes)\b", "other"),
]
#: Numbers of sections.
SECTION_NUMBER = r"(?:[A-Z]\.)?\d{1,2}(?:\.\d{1,2}){0,3}"


def named_type(title: Column | str) -> Column:
    """Section type of a title by its name, else by the first rule that a word of it fits, else null."""
    t = normalize_text(title)
    out = F.lit(None).cast("string")
    for rule, kind in reversed(SECTION_RULES):
        out = F.when(t.rlike(rule), F.lit(kind)).otherwise(out)
    names: dict[str, list[str]] = {}
    for name, kind in SECTION_TITLES.items():
        names.setdefault(kind, []).append(name)
    for kind, found in names.items():
        out = F.when(t.isin(*found), F.lit(kind)).otherwise(out)
    return out


def classify_title(title: Column | str, parent: Column | None = None) -> Column:
    """:func:`named_type`, else the parent's type, else methods."""
    return F.coalesce(named_type(title), parent if parent is not None else F.lit("methods"), F.lit("methods"))
