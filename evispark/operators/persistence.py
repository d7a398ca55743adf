"""What becomes of models' answers before they are stored, and the texts that models are asked with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evispark.functions.bylines import parse_authors
from evispark.functions.text import UUID, clean_reference_title, format_authors, metadata_from_name, strip_control
from evispark.operators.provenance import links, live_claims, title_of


def accepted_claims(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """``claims`` that can be stored: a chunk's claims are kept if all of them lie on its pages and within its places, else none.

    The paper is the chunk's, whatever the claim says. Claims without a known chunk are dropped.
    """
    k = chunks.filter("chunk_id is not null").dropDuplicates(["chunk_id"]).select("chunk_id", F.col("paper_id").alias("_paper"), F.col("start_char").alias("_from"), F.col("end_char").alias("_to"), F.col("page_start").alias("_first"), F.col("page_end").alias("_last"))
    rows = claims.dropDuplicates(["claim_id"]).join(k, "chunk_id")
    good = (F.col("start_char") >= F.col("_from")) & (F.col("end_char") <= F.col("_to")) & F.col("page").between(F.col("_first"), F.col("_last"))
    bad = rows.filter(~F.coalesce(good, F.lit(False))).select("chunk_id").distinct()
    kept = rows.join(bad, "chunk_id", "left_anti").withColumn("paper_id", F.col("_paper"))
    return kept.select(*claims.columns)


def stored_syntheses(syntheses: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(syntheses with the counts of the claims that exist, links (synthesis_id, claim_id)); what the answer counted is ignored."""
    known = links(syntheses, "synthesis_id").join(live_claims(claims), "claim_id").withColumnRenamed("record_id", "synthesis_id")
    counts = known.groupBy("synthesis_id").agg(F.countDistinct("paper_id").cast("int").alias("supporting_papers"), F.countDistinct("claim_id").cast("int").alias("supporting_claims"))
    rows = syntheses.dropDuplicates(["synthesis_id"]).drop("supporting_papers", "supporting_claims", "supporting_claim_ids")
    rows = rows.join(counts, "synthesis_id", "left").na.fill(0, ["supporting_papers", "supporting_claims"])
    return rows, known.select("synthesis_id", "claim_id").distinct()


def stored_sentences(sentences: DataFrame, claims: DataFrame) -> DataFrame:
    """(sentence_id, claim_ids, is_supported): the existing claims of each sentence, sorted, and whether there is any."""
    real = links(sentences, "sentence_id").join(live_claims(claims), "claim_id", "left_semi").groupBy("record_id").agg(F.array_sort(F.collect_set("claim_id")).alias("claim_ids"))
    rows = sentences.select("sentence_id").distinct().join(real, F.col("sentence_id") == F.col("record_id"), "left")
    ids = F.coalesce("claim_ids", F.array().cast("array<string>"))
    return rows.select("sentence_id", ids.alias("claim_ids"), (F.size(ids) > 0).alias("is_supported"))


def claim_text(normalized: str = "normalized_text", plain: str = "claim_text") -> Column:
    """The normalized text, else the claim's own; empty counts as missing."""
    return F.coalesce(F.nullif(F.col(normalized), F.lit("")), F.col(plain))


def synthesis_text(title: str = "title", body: str = "body") -> Column:
    return F.concat_ws("\n", F.col(title), F.col(body))


def chunk_requests(chunks: DataFrame, heading: str) -> DataFrame:
    """(chunk_id, request): the heading, the section type and the chunk's text without control characters."""
    rows = chunks.filter("chunk_id is not null").dropDuplicates(["chunk_id"])
    return rows.select("chunk_id", F.concat(F.lit(heading + "\n\nsection_type: "), F.coalesce("section_type", F.lit("unknown")), F.lit("\n\nChunk text:\n"), strip_control("text")).alias("request"))


def paper_label(number: Column) -> Column:
    """A to Z for 1 to 26, then P27 and so on."""
    return F.when(number <= 26, F.char(number + 64)).otherwise(F.concat(F.lit("P"), number.cast("string")))


def synthesis_requests(pools: DataFrame, claims: DataFrame, papers: DataFrame, heading: str) -> DataFrame:
    """(pool_id, request) from the claims of each pool (pool_id, pos, claim_id): labelled papers in order of first use, and a line a claim."""
    c = claims.dropDuplicates(["claim_id"]).select("claim_id", "paper_id", "claim_type", "confidence", claim_text().alias("text"))
    p = papers.dropDuplicates(["paper_id"]).select("paper_id", title_of().alias("name"))
    rows = pools.groupBy("pool_id", "claim_id").agg(F.min("pos").alias("pos")).join(c, "claim_id")
    first = rows.groupBy("pool_id", "paper_id").agg(F.min("pos").alias("first"))
    labels = first.withColumn("label", paper_label(F.row_number().over(Window.partitionBy("pool_id").orderBy("first", "paper_id")))).join(p, "paper_id", "left")
    lines = rows.join(labels.select("pool_id", "paper_id", "label"), ["pool_id", "paper_id"])
    line = F.concat(F.lit("- claim_id="), F.col("claim_id"), F.lit("; paper="), F.col("label"), F.lit("; type="), F.coalesce("claim_type", F.lit("")), F.lit("; text="), F.coalesce("text", F.lit("")))
    claim_part = lines.groupBy("pool_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))["line"], "\n").alias("claims"))
    paper_part = labels.groupBy("pool_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("first", "paper_id", F.concat(F.lit("["), F.col("label"), F.lit("] "), F.coalesce("name", "paper_id")).alias("line"))))["line"], "\n").alias("papers"))
    return paper_part.join(claim_part, "pool_id").select("pool_id", F.concat(F.lit(heading + "\n\nPapers:\n"), F.col("papers"), F.lit("\n\nClaims:\n"), F.col("claims")).alias("request"))


def named_claims(texts: DataFrame, key: str, text: str, claims: DataFrame) -> DataFrame:
    """(key, claim_id): the existing claims whose identities stand in a text, each once."""
    ids = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"({UUID})"), F.lit(1)))
    return texts.select(key, F.explode(ids).alias("claim_id")).join(live_claims(claims).select("claim_id"), "claim_id", "left_semi").select(key, "claim_id")


def batches(rows: DataFrame, group: str, order: list[str], size: int = 12) -> DataFrame:
    """``rows`` with ``batch`` from 0: slices of ``size`` rows of each group in order."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("batch", F.floor((n - 1) / F.lit(size)).cast("int"))


def draft_label(created_at: str = "created_at", title: str = "title") -> Column:
    return F.concat(F.coalesce(F.date_format(created_at, "yyyy-MM-dd HH:mm"), F.lit("unknown time")), F.lit(" - "), F.coalesce(F.col(title), F.lit("")))


def error_message(body: Column | str) -> Column:
    """The message of a failed call's JSON body: of its error, else its own; null if there is none."""
    c = F.col(body) if isinstance(body, str) else body
    return F.coalesce(F.get_json_object(c, "$.error.message"), F.get_json_object(c, "$.message"))


def improved_reference(line: Column) -> Column:
    """A reference line of unknown authors and year, with what its title tells as a file's name; other lines stay."""
    # fixed value: a line of unknown authors
    pattern = r"^(-\s*)?(\[\d+\]\s+)Unknown authors\. \(n\.d\.\)\. (.+?)\.?$"
    raw = F.regexp_extract(line, pattern, 3)
    named = metadata_from_name(raw)
    authors = parse_authors(named["authors_text"])
    better = F.concat(F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2), format_authors(authors), F.lit(". ("), F.coalesce(named["year"].cast("string"), F.lit("n.d.")), F.lit("). "), clean_reference_title(F.coalesce(named["title"], raw)), F.lit("."))
    return F.when(line.rlike(pattern) & (named["authors_text"].isNotNull() | named["year"].isNotNull()), better).otherwise(line)


