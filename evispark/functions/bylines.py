"""Titles and authors from names and first pages, as Column functions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions.text import clean_metadata_text, is_internal_title, lines_with_ends, normalize_typeset, parse_year

#: What marks an affiliation or the body's begin.
AFFILIATIONS = ("abstract", "department", "university", "institute", "college", "school", "state key laboratory", "cnrs", "supporting information", "received", "revised", "keywords")
#: Marks of footnotes behind names; what a byline never holds; initials before a name; a word of a name; what parts names.
MARKS = "*†‡§¶#⊥∥‖"
NOT_IN_BYLINES = r"(?i)\b(?:abstract|keywords|introduction)\b"
INITIALS = r"\b[A-Z]\.\s*(?:[A-Z]\.\s*)?[A-Z][A-Za-z-]+"
NAME_WORD = r"^[A-Z][A-Za-z'-]*\.?$"
BETWEEN_NAMES = r"(?i)\s*(?:,|;|\band\b|&)\s*"
BETWEEN_AUTHORS = r";|,|\s+(?:and|&)\s+"
ET_AL = r"(?i)\bet\s+al\.?\b"
BYLINE_LINES, AUTHOR_LINES = 12, 4


def _edges(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \-_,]+|[ \-_,]+$", "")


def is_affiliation(line: Column) -> Column:
    low = F.lower(line)
    return reduce(or_, [low.contains(m) for m in AFFILIATIONS]) | F.trim(line).isin("*", "■")


def is_name_list(line: Column) -> Column:
    """At least two names of one to three capitalized words each, parted by commas, semicolons, ``and`` or ``&``."""
    bare = F.regexp_replace(F.regexp_replace(line, f"[{MARKS}0-9]+", ""), "^[ ,]+|[ ,]+$", "")
    names = F.filter(F.transform(F.split(bare, BETWEEN_NAMES), lambda n: F.trim(n)), lambda n: n != "")
    good = lambda n: (F.size(F.split(n, r"\s+")) <= 3) & F.forall(F.split(n, r"\s+"), lambda w: w.rlike(NAME_WORD))
    return (F.size(names) >= 2) & F.forall(names, good)


def is_byline(line: Column) -> Column:
    """A line of authors: initials before names, or a list of names; no affiliation, no heading, not too long."""
    return ~is_affiliation(line) & (F.length(line) <= 250) & ~line.rlike(NOT_IN_BYLINES) & (line.rlike(INITIALS) | is_name_list(line))


def parse_authors(text: Column | str) -> Column:
    """The authors of a byline; ``et al`` makes it one entry, two to four capitalized words without a comma or a period are names each; null has none."""
    t = F.regexp_replace(normalize_typeset(clean_metadata_text(text)), f"[{MARKS}]+", "")
    t = _edges(F.regexp_replace(F.regexp_replace(t, r"(?<=[A-Za-z])\d+\b", ""), r"([A-Z]\.)(?=[A-Z][a-z])", "$1 "))
    parts = F.filter(F.transform(F.split(t, BETWEEN_AUTHORS), _edges), lambda p: p != "")
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    names = ~t.contains(",") & ~t.contains(".") & F.size(words).between(2, 4) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}"))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(t, F.lit("")) == "", none).when(t.rlike(ET_AL), F.array(t)).when(F.size(parts) > 1, parts).when(names, words).otherwise(F.array(t))


def first_page_metadata(text: Column | str) -> dict[str, Column]:
    """title, authors and year of a first page: a byline among its first twelve lines with text, but not the first; the title before it, the year from anywhere."""
    c = F.col(text) if isinstance(text, str) else text
    lines = F.filter(F.transform(lines_with_ends(c), lambda x: clean_metadata_text(normalize_typeset(x))), lambda x: x.isNotNull())
    at = F.array_position(F.transform(F.slice(lines, 1, BYLINE_LINES), is_byline), True).cast("int")
    by = F.slice(lines, F.greatest(at, F.lit(1)), AUTHOR_LINES)
    affiliation = F.array_position(F.transform(by, is_affiliation), True)
    last = F.array_position(F.transform(by, lambda x: F.lower(x).contains(" and ") & ~F.rtrim(x).endswith(",")), True)
    n = F.least(F.when(affiliation > 0, affiliation - 1).otherwise(AUTHOR_LINES), F.when(last > 0, last).otherwise(AUTHOR_LINES)).cast("int")
    found = at > 1
    title = F.when(found, clean_metadata_text(F.array_join(F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0))), " ")))
    authors = F.when(found, parse_authors(F.array_join(F.slice(by, F.lit(1), n), " "))).otherwise(F.array().cast("array<string>"))
    return {"title": title, "authors": authors, "year": parse_year(clean_metadata_text(c))}


def best_title(document: Column, text: Column) -> Column:
    """The text's title where the document's is missing or left by a writing program, else the document's."""
    d, t = F.nullif(document, F.lit("")), F.nullif(text, F.lit(""))
    return F.when(t.isNotNull() & (d.isNull() | is_internal_title(d)), t).otherwise(F.coalesce(d, t))


def first_pages(pages: DataFrame) -> DataFrame:
    """(paper_id, title, authors, year) from the page 1 of each paper."""
    rows = pages.filter("page_number = 1").dropDuplicates(["page_id"])
    return rows.select("paper_id", *[c.alias(k) for k, c in first_page_metadata("text").items()])


def merged_metadata(papers: DataFrame, pages: DataFrame) -> DataFrame:
    """(paper_id, title, authors, year): the better title, the document's authors first, the first page's year first; empty counts as missing."""
    t = first_pages(pages).groupBy("paper_id").agg(F.min("title").alias("t_title"), F.min("authors").alias("t_authors"), F.min("year").alias("t_year"))
    rows = papers.dropDuplicates(["paper_id"]).select("paper_id", "title", "authors", "year").join(t, "paper_id", "left")
    authors = F.when(F.size("authors") > 0, F.col("authors")).otherwise(F.coalesce("t_authors", F.array().cast("array<string>")))
    return rows.select("paper_id", best_title(F.col("title"), F.col("t_title")).alias("title"), authors.alias("authors"), F.coalesce("t_year", "year").alias("year"))
