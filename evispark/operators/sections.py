"""Lines, headings and sections of page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evispark.functions.text import SECTION_NUMBER, SECTION_TITLES, WS, classify_title, lines_with_ends, named_type, normalize_text, trim_ws
from evispark.staging import stage

RUNNING_PAGES = 3


def page_lines(pages: DataFrame) -> DataFrame:
    """(paper_id, page_id, page_number, line_no, start_char, line): the lines of each page, from 0, with their places.

    A line ends as in any text with Unicode line ends; the terminator is counted in the places and not in the line. Null and
    empty texts have none; a page on several rows counts once.
    """
    rows = pages.filter("text <> ''").select("paper_id", "page_id", "page_number", "text").dropDuplicates(["page_id"])
    rows = rows.select("paper_id", "page_id", "page_number", F.posexplode(lines_with_ends("text")).alias("line_no", "raw"))
    w = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("paper_id", "page_id", "page_number", "line_no", F.coalesce(F.sum(F.length("raw")).over(w), F.lit(0)).alias("start_char"), F.regexp_replace("raw", r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}])$", "").alias("line"))


def running_headers(pages: DataFrame, least: int = RUNNING_PAGES) -> DataFrame:
    """(paper_id, line, n_pages): stripped lines on at least ``least`` different pages of a paper."""
    lines = page_lines(pages).select("paper_id", "page_number", trim_ws("line").alias("line")).filter("line <> ''")
    return lines.distinct().groupBy("paper_id", "line").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= least)


def next_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with next_line: the next line of the page that isn't blank, null at its end."""
    w = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    return lines.withColumn("next_line", F.first(F.nullif(trim_ws("line"), F.lit("")), ignorenulls=True).over(w))


def named_headings(pages: DataFrame) -> DataFrame:
    """(paper_id, page_id, page_number, line_no, start_char, title, section_type): lines that are a known section name, a number before it aside.

    Lines that run over the pages of a paper are left out.
    """
    names = "|".join(sorted(SECTION_TITLES, key=lambda t: (-len(t), t)))
    lines = page_lines(pages).withColumn("bare", trim_ws("line"))
    hits = lines.filter(F.col("bare").rlike(rf"(?i)^(?:{SECTION_NUMBER}\.?\s+)?(?:{names})$"))
    # all lines of one text are hits together, so their pages can be counted among the hits
    n_pages = F.size(F.collect_set("page_number").over(Window.partitionBy("paper_id", "bare")))
    hits = hits.withColumn("n_pages", n_pages).filter(F.col("n_pages") < RUNNING_PAGES)
    title = F.regexp_replace("bare", rf"^{SECTION_NUMBER}\.?\s+", "")
    return hits.select("paper_id", "page_id", "page_number", "line_no", "start_char", title.alias("title"), classify_title(normalize_text(title)).alias("section_type"))


def section_intervals(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """(paper_id, pos, title, section_type, page_start, start_char, page_end, end_char, confidence) from headings in order.

    A section ends on the page of the next heading, at its place if that is the section's own page, else at that page's end; the last one
    ends with the paper. A paper without headings is one section ``Full Text`` of type other, with confidence 0.3.
    """
    hits = stage(hits, "headings")
    sizes = pages.filter("page_id is not null").groupBy("paper_id", "page_number").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))
    ends = sizes.groupBy("paper_id").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.max(F.struct("page_number", "n_chars"))["n_chars"].alias("last_chars"))
    w = Window.partitionBy("paper_id").orderBy("page_number", "start_char")
    rows = hits.withColumn("next_page", F.lead("page_number").over(w)).withColumn("next_char", F.lead("start_char").over(w)).withColumn("pos", F.row_number().over(w))
    rows = rows.join(ends, "paper_id").withColumn("page_end", F.coalesce("next_page", "last_page"))
    rows = rows.join(sizes.select("paper_id", F.col("page_number").alias("page_end"), "n_chars"), ["paper_id", "page_end"])
    end = F.when(F.col("next_page") == F.col("page_number"), F.col("next_char")).otherwise(F.col("n_chars"))
    confidence = F.col("confidence") if "confidence" in hits.columns else F.lit(0.75)
    some = rows.select("paper_id", "pos", "title", "section_type", F.col("page_number").alias("page_start"), F.col("start_char").cast("bigint").alias("start_char"), "page_end", end.cast("bigint").alias("end_char"), confidence.alias("confidence"))
    none = ends.join(hits.select("paper_id").distinct(), "paper_id", "left_anti").select("paper_id", F.lit(1).alias("pos"), F.lit("Full Text").alias("title"), F.lit("other").alias("section_type"), F.col("first_page").alias("page_start"), F.lit(0).cast("bigint").alias("start_char"), F.col("last_page").alias("page_end"), F.col("last_chars").cast("bigint").alias("end_char"), F.lit(0.3).alias("confidence"))
    return some.unionByName(none)


#: Forms of headings. Numbers of sections are SECTION_NUMBER.
NUMBERED, NUMBER_ONLY = rf"^({SECTION_NUMBER})\.?{WS}+([^\s\x0b\x1c-\x1f\x85\p{{Z}}].*)$", rf"^({SECTION_NUMBER})\.?$"
KNOWN = rf"(?i)^(?:{SECTION_NUMBER}\.?{WS}+)?({'|'.join(sorted(SECTION_TITLES, key=lambda t: (-len(t), t)))})$"
INLINE_ABSTRACT = rf"(?i)^abstract{WS}*[:.—–-]{WS}*[^\s\x0b\x1c-\x1f\x85\p{{Z}}]"
ROMAN, BULLET = r"^([IVX]{1,5})\.\s+([A-Z][A-Z0-9 ,&:/\-–]+)$", rf"^[■▪]{WS}*"
CONFIDENCE = {"known": 0.75, "abstract": 0.7, "bullet": 0.7, "roman": 0.6, "numbered": 0.6, "next": 0.6}


def n_words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, f"{WS}+"), lambda w: w != ""))


def looks_like_title(line: Column) -> Column:
    """At most 90 characters and 12 words, a capital first, no punctuation at the end, mostly letters; null counts as no title."""
    letters, solid = F.length(F.regexp_replace(line, r"[^\p{L}]", "")), F.length(F.translate(line, " ", ""))
    fits = F.length(line).between(1, 90) & n_words(line).between(1, 12) & line.rlike(r"^\p{Lu}") & ~line.rlike("[.,;:]$") & (letters >= 0.6 * solid)
    return F.coalesce(fits, F.lit(False))


def plausible_number(number: Column) -> Column:
    """Whether a section's number begins, a letter aside, with 1 to 20."""
    return F.coalesce(F.regexp_extract(number, r"^(?:[A-Z]\.)?(\d+)", 1).try_cast("int").between(1, 20), F.lit(False))


def body_or_heading(line: Column) -> Column:
    """Whether a line has five words or begins with a section's number (or is one)."""
    number = F.coalesce(F.nullif(F.regexp_extract(line, NUMBERED, 1), F.lit("")), F.nullif(F.regexp_extract(line, NUMBER_ONLY, 1), F.lit("")))
    return F.coalesce((n_words(line) >= 5) | plausible_number(number), F.lit(False))


def heading_hits(pages: DataFrame) -> DataFrame:
    """(paper_id, page_id, page_number, at, line_no, start_char, title, number, kind, own_type) of the lines that announce a heading.

    ``at`` is the line that was read, line_no the one where the heading stands: the next one, where a number stands on a line of its own. Every line is
    judged by itself and what follows it on its page. Lines that run over pages are no headings.
    """
    w = Window.partitionBy("page_id").orderBy("line_no")
    after = lambda n: F.first(F.nullif(trim_ws("line"), F.lit("")), ignorenulls=True).over(w.rowsBetween(n, Window.unboundedFollowing))
    lines = page_lines(pages).withColumn("bare", trim_ws("line"))
    lines = lines.withColumn("following", after(1)).withColumn("beyond", after(2)).withColumn("next", F.lead("bare").over(w)).withColumn("next_start", F.lead("start_char").over(w)).filter("bare <> ''")
    plain = F.regexp_replace("bare", BULLET, "")
    part = lambda pattern, i: F.nullif(F.regexp_extract("plain", pattern, i), F.lit(""))
    rows = lines.withColumn("plain", plain)
    number, title = part(NUMBERED, 1), part(NUMBERED, 2)
    kind = (
        F.when(F.col("plain").rlike(KNOWN), "known")
        .when(F.col("plain").rlike(INLINE_ABSTRACT), "abstract")
        .when(F.col("bare").rlike(BULLET) & looks_like_title(F.col("plain")), "bullet")
        .when(F.col("plain").rlike(ROMAN) & body_or_heading(F.col("following")), "roman")
        .when(plausible_number(number) & looks_like_title(title) & body_or_heading(F.col("following")), "numbered")
        .when(plausible_number(part(NUMBER_ONLY, 1)) & looks_like_title(F.col("next")) & body_or_heading(F.col("beyond")), "next")
    )
    rows = rows.withColumn("kind", kind).filter("kind is not null")
    k = F.col("kind")
    title = F.when(k == "known", part(KNOWN, 1)).when(k == "abstract", "Abstract").when(k == "bullet", F.col("plain")).when(k == "roman", trim_ws(part(ROMAN, 2))).when(k == "numbered", title).otherwise(F.col("next"))
    number = F.when(k.isin("known", "numbered"), number).when(k == "roman", part(ROMAN, 1)).when(k == "next", part(NUMBER_ONLY, 1))
    step = (k == "next").cast("int")
    rows = rows.select("paper_id", "page_id", "page_number", F.col("line_no").alias("at"), (F.col("line_no") + step).alias("line_no"), F.when(k == "next", F.col("next_start")).otherwise(F.col("start_char")).alias("start_char"), title.alias("title"), number.alias("number"), "kind", F.when(k == "next", F.col("next")).otherwise(F.col("bare")).alias("bare"))
    rows = rows.join(running_headers(pages).select("paper_id", F.col("line").alias("bare")), ["paper_id", "bare"], "left_anti").drop("bare")
    return rows.withColumn("own_type", named_type(F.col("title")))


def find_headings(pages: DataFrame) -> DataFrame:
    """(paper_id, page_id, page_number, line_no, start_char, title, section_type, confidence) of all headings, one a place.

    A subsection whose title tells no type takes over that of the latest section with its number's prefix, else it is of type methods. Numbers have four
    parts at most, so types are settled level by level: each is a running last value per paper and prefix, over a few headings.
    """
    hits = stage(heading_hits(pages), "hits")
    depth = F.coalesce(F.size(F.split(F.regexp_replace("number", r"^[A-Z]\.", ""), r"\.")) - 1, F.lit(0))
    rows = hits.withColumn("depth", depth).withColumn("prefix", F.when(F.col("depth") > 0, F.regexp_replace("number", r"\.[^.]*$", ""))).withColumn("section_type", F.when(F.col("depth") <= 0, F.coalesce("own_type", F.lit("methods"))).otherwise(F.col("own_type")))
    w = Window.partitionBy("paper_id", "key").orderBy("page_number", "at").rowsBetween(Window.unboundedPreceding, -1)
    for level in (1, 2, 3):
        asks = (F.col("depth") == level) & F.col("section_type").isNull()
        tells = rows.filter(F.col("number").isNotNull()).select("paper_id", F.col("number").alias("key"), "page_number", "at", F.col("section_type").alias("told"), F.lit(None).cast("string").alias("page_id"))
        asked = rows.filter(asks).select("paper_id", F.col("prefix").alias("key"), "page_number", "at", F.lit(None).cast("string").alias("told"), "page_id")
        told = tells.unionByName(asked).withColumn("parent", F.last("told", ignorenulls=True).over(w)).filter("page_id is not null").select("page_id", "at", F.coalesce("parent", F.lit("methods")).alias("parent"))
        rows = rows.join(told, ["page_id", "at"], "left").withColumn("section_type", F.coalesce("section_type", "parent")).drop("parent")
    confidence = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])[F.col("kind")]
    first = Window.partitionBy("page_id", "start_char").orderBy("at")
    rows = rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    return rows.select("paper_id", "page_id", "page_number", "line_no", "start_char", "title", "section_type", confidence.alias("confidence"))


def detect_sections(pages: DataFrame) -> DataFrame:
    """:func:`section_intervals` of :func:`find_headings`."""
    return section_intervals(find_headings(pages), pages)
