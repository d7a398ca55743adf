"""Repair of text from scanned pages.

Evidence is counted over all pages and joined in SQL; single pages are only read for their lines and words.

* Running lines: edge lines that come again on other pages of their paper, a few letters aside, that give the paper's title or
  its authors, or that stand at the edges of other papers too, as a volume's name does (with a capital first and no end of a sentence).
* Page numbers: edge lines whose number runs with the pages; each paper prints one style at one edge.
* Broken words: a hyphen at a line's end, where the joined form has more evidence than the hyphenated one.
* Misread letters: rare words are joined with frequent ones by the difference of their anagram hashes (sum of
  the fifth powers of the characters), one difference for each confusion of letters and each pair of confusions, all in SQL; the best
  ranked variant must be far more frequent and is the correction. Of a word with a sign in it that no word has, any plain variant is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evispark.functions.text import SECTION_TITLES
from evispark.operators.selection import round_robin
from evispark.staging import broadcast_if_small, stage

#: Letters and what scanners are known to make of them.
CONFUSIONS = [
    ("a", "�"), ("e", "�"), ("i", "|"), ("l", "|"), ("t", "†"), ("ti", "π"), ("o", "0"), ("l", "1"), ("i", "1"), ("s", "5"), ("g", "9"), ("b", "6"), ("b", "8"), ("z", "2"),
    ("e", "c"), ("c", "e"), ("h", "b"), ("n", "ri"), ("ri", "n"), ("m", "rn"), ("rn", "m"), ("u", "ii"), ("d", "cl"), ("cl", "d"), ("li", "h"), ("h", "li"), ("in", "m"), ("m", "in"), ("w", "vv"), ("i", "l"), ("l", "i"), ("n", "u"), ("u", "n"), ("q", "g"), ("nn", "m"), ("m", "nn"), ("fi", "h"), ("ti", "h"),
    ("ff", "ﬀ"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ffi", "ﬃ"), ("ffl", "ﬄ"), ("st", "ﬅ"), ("st", "ﬆ"), ("s", "ſ"), ("c", "¢"), ("s", "$"), ("e", "€"), ("a", "@"), ("i", "!"), ("c", "("), ("y", "¥"),
]
#: Characters that never belong inside a printed word.
_SIGNS = "�|†πﬀﬁﬂﬃﬄﬅﬆſ¢€¥"
#: Section headings, which may stand at a page's edge and come again: the known titles and some that papers use besides.
HEADINGS = [*SECTION_TITLES, "introduction and motivation", "motivation", "prior work", "literature review", "implementation", "evaluation"]
_HEADING_KEYS = {re.sub("[^a-z]", "", h) for h in HEADINGS}
#: What may follow a hyphen that stands for a part left out.
_SUSPENDED = ("and", "or", "to", "und", "et", "y")
_BREAK = "-­¬‐"
_DIGITS = str.maketrans({"l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "b": "6", "g": "9", "q": "9", "Z": "2", "z": "2"})
_NUM = r"[0-9lIi|!OoSsBbgqZz]{1,6}"
_ROMAN = r"[ivxlcdm1|]{1,12}"
_STYLES = [
    ("page", re.compile(rf"^p\wge\s+({_NUM})(?:\s+[o0]f\s+{_NUM})?$", re.IGNORECASE)),
    ("p", re.compile(rf"^p\.\s*({_NUM})$", re.IGNORECASE)),
    ("bracket", re.compile(rf"^\[\s*({_NUM}|{_ROMAN})\s*\]$")),
    ("dash", re.compile(rf"^[-–—]\s*({_NUM}|{_ROMAN})\s*[-–—]$")),
    ("plain", re.compile(rf"^({_NUM}|{_ROMAN})$")),
]
_BESIDE = re.compile(rf"^(?:(?P<a>{_NUM})\s{{1,}}(?P<x>\D.{{3,}})|(?P<y>.{{3,}}\D)\s{{1,}}(?P<b>{_NUM}))$")


def roman(text: str) -> int | None:
    values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    n = [values[c] for c in text]
    total = sum(-a if i + 1 < len(n) and a < n[i + 1] else a for i, a in enumerate(n))
    return total if to_roman(total) == text else None


def to_roman(n: int) -> str:
    out = ""
    for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), ("m", "cm", "d", "cd", "c", "xc", "l", "xl", "x", "ix", "v", "iv", "i"), strict=True):
        out += sign * (n // value)
        n %= value
    return out


def printed_numbers(line: str) -> list[tuple[str, int, str]]:
    """(style, value, core) of each way to read ``line`` as a printed page number."""
    text, out = line.strip(), []
    for style, pattern in _STYLES:
        if m := pattern.match(text):
            core = m[1]
            digits = core.translate(_DIGITS)
            if digits.isdigit():  # perhaps not a digit of it was read as one
                out.append((style, int(digits), core))
            letters = core.lower().replace("1", "l").replace("|", "i")
            for r in {core.lower(), letters, core.lower().replace("1", "i").replace("|", "i")}:
                if re.fullmatch("[ivxlcdm]+", r) and (n := roman(r)) is not None:
                    out.append((style + " roman", n, core))
                    break
    if (m := _BESIDE.match(text)) and not out:
        core, rest = (m["a"], m["x"]) if m["a"] else (m["b"], m["y"])
        digits = core.translate(_DIGITS)
        if any(c.isdigit() for c in core) and not re.search(r"vol\.?\s*$", rest, re.IGNORECASE):
            out.append(("beside", int(digits), core))
    return out


def key_of(line: Column) -> Column:
    """The letters of a line, in lower case: what running lines are compared by."""
    return F.lower(F.regexp_replace(line, r"[^\p{L}]", ""))


def edge_lines(pages: DataFrame) -> DataFrame:
    """The two first and two last lines with text of each page: (paper_id, page_id, page_number, line_no, line, side, slot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, no, line, side, slot = [], [], [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                lines = [(j, x) for j, x in enumerate(text.split("\n")) if x.strip()]
                for where, edge in (("top", lines[:2]), ("bottom", lines[:-3:-1])):
                    for k, (j, x) in enumerate(edge):
                        of.append(i), no.append(j), line.append(x), side.append(where), slot.append(k + 1)
            at = pa.array(of, pa.int32())
            yield pa.record_batch([*(batch.column(c).take(at) for c in range(3)), pa.array(no, pa.int32()), pa.array(line, pa.string()), pa.array(side, pa.string()), pa.array(slot, pa.int32())], names=["paper_id", "page_id", "page_number", "line_no", "line", "side", "slot"])

    return pages.select("paper_id", "page_id", "page_number", "text").mapInArrow(run, "paper_id string, page_id string, page_number int, line_no int, line string, side string, slot int")


def page_numbers(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(page_id, line_no, beside): the edge lines that hold the page's number, alone or beside other text. ``sizes`` is (paper_id, n_pages)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, style, value, core = [], [], [], []
            for i, line in enumerate(batch.column("line").to_pylist()):
                for s, v, c in printed_numbers(line) if len(line) < 200 else ():
                    of.append(i), style.append(s), value.append(v), core.append(c)
            at = pa.array(of, pa.int32())
            names = ["paper_id", "page_id", "page_number", "line_no", "side", "slot"]
            yield pa.record_batch([*(batch.column(c).take(at) for c in names), pa.array(style, pa.string()), pa.array(value, pa.int32()), pa.array(core, pa.string())], names=[*names, "style", "value", "core"])

    read = stage(edges.mapInArrow(run, "paper_id string, page_id string, page_number int, line_no int, side string, slot int, style string, value int, core string"), "numbers")
    offset = F.col("value") - F.col("page_number")
    decorated = ~F.col("style").isin("plain", "plain roman", "beside")
    votes = read.groupBy("paper_id", "side", "style", offset.alias("offset")).agg(F.countDistinct("page_number").alias("votes"), F.min("slot").alias("slot"))
    votes = votes.join(sizes, "paper_id").filter(((F.col("votes") >= 2) & (F.col("votes") >= 0.3 * F.col("n_pages"))) | (decorated & (F.col("votes") >= 0.2 * F.col("n_pages"))))
    best = votes.groupBy("paper_id").agg(F.max(F.struct("votes", decorated.alias("decorated"), (-F.col("slot")).alias("outer"), "offset", "side", "style")).alias("b")).select("paper_id", "b.offset", F.col("b.side").alias("s"), F.col("b.style").alias("st"))
    rows = read.join(best, "paper_id").withColumn("expected", (F.col("page_number") + F.col("offset")).cast("string"))
    same = (F.col("style") == F.col("st")) & (F.col("side") == F.col("s"))
    fits = (F.col("value") == F.col("page_number") + F.col("offset")) | (decorated & ~F.col("style").endswith("roman")) | ((F.length("expected") >= 2) & (F.length("core") == F.length("expected")) & (F.levenshtein("core", "expected") <= 1) & ~F.col("style").endswith("roman"))
    rows = rows.filter(same & fits)
    outer = rows.groupBy("page_id").agg(F.min(F.struct((F.col("value") != F.col("page_number") + F.col("offset")).alias("off"), "slot", "line_no", (F.col("style") == "beside").alias("beside"))).alias("x"))
    return outer.select("page_id", "x.line_no", "x.beside")


#: In papers of at most so many pages keys are compared pair by pair, in longer ones through an index of blocks; the results are the same.
PAIRED_PAGES = 30


#: Frequent letters, by whose counts keys are told apart before they are compared letter by letter.
LETTERS = "etaoinsr"


def _edits(n: Column) -> Column:
    """The letters that may differ from a running line of ``n`` letters."""
    return F.greatest(F.lit(1), F.floor(0.15 * n)).cast("int")


def _blocks(n: int) -> tuple[int, int]:
    """(number, length) of the blocks that a key of ``n`` letters is cut into: one more than letters may differ, so one block at least stays whole."""
    d = max(1, int(0.15 * n))
    return d + 1, n // (d + 1)


def near_keys(keys: DataFrame) -> DataFrame:
    """(paper_id, kid, tid): candidates, of ``keys`` (paper_id, kid, key, n), for keys that stand on one page (n = 1) and are near another key t.

    None that is near is missed: with at most d edits one of the d + 1 blocks of t, the one with number i, stands whole in the key, moved by at most i letters.
    """

    def cut(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, key in enumerate(batch.column(2).to_pylist()):
                    n = len(key)
                    if whole:
                        count, size = _blocks(n)
                        rows = [(key[j * size : (j + 1) * size], j * size, j) for j in range(count)]
                    else:
                        sizes = {_blocks(m)[1] for m in range(max(3, int(n / 1.15) - 2), int(n / 0.85) + 3)}
                        rows = [(key[at : at + size], at, 0) for size in sizes for at in range(n - size + 1)]
                    of = pa.array([i] * len(rows), pa.int32())
                    block, at, number = zip(*rows, strict=True)
                    yield pa.record_batch([batch.column(0).take(of), batch.column(1).take(of), pa.array([n] * len(rows), pa.int32()), pa.array(block, pa.string()), pa.array(at, pa.int32()), pa.array(number, pa.int32())], names=names)

        return run

    names = ["paper_id", "kid", "size", "block", "at", "number"]
    kinds = "paper_id string, kid bigint, size int, block string, at int, number int"
    index = keys.select("paper_id", "kid", "key").mapInArrow(cut(True), kinds).select("paper_id", F.col("kid").alias("tid"), F.col("size").alias("t_size"), "block", F.col("at").alias("t_at"), "number")
    asking = keys.filter("n = 1").select("paper_id", "kid", "key").mapInArrow(cut(False), kinds).drop("number")
    fits = (F.abs(F.col("at") - F.col("t_at")) <= F.col("number")) & (F.abs(F.col("size") - F.col("t_size")) <= _edits(F.col("t_size"))) & (F.col("kid") != F.col("tid"))
    return asking.join(index, ["paper_id", "block"]).filter(fits).select("paper_id", "kid", "tid").distinct()


def running_lines(edges: DataFrame, numbers: DataFrame, sizes: DataFrame, papers: DataFrame) -> DataFrame:
    """(page_id, line_no) of the running headers: first or last lines, a page number aside."""
    alone = numbers.filter("not beside").select("page_id", "line_no", F.lit(True).alias("is_number"))
    rows = edges.join(alone, ["page_id", "line_no"], "left").withColumn("is_number", F.coalesce("is_number", F.lit(False)))
    opened = rows.filter("is_number and slot = 1").select("page_id", "side", F.lit(2).alias("first"))
    rows = rows.join(opened, ["page_id", "side"], "left").filter("not is_number").filter(F.col("slot") <= F.coalesce("first", F.lit(1)))
    rows = rows.withColumn("key", key_of(F.col("line"))).filter((F.length("key") >= 3) & ~F.col("key").isin(*_HEADING_KEYS)).select("paper_id", "page_id", "page_number", "line_no", "key", F.trim("line").rlike(r"^[^\p{L}]*\p{Lu}.*[^.,;:!?]$").alias("name")).dropDuplicates(["page_id", "line_no"])
    rows = stage(rows, "edges")
    # a page that prose ends or begins: its line is long and comes once; what comes again, a few letters aside, is a template
    keys = rows.groupBy("paper_id", "key").agg(F.countDistinct("page_number").alias("n"), F.min("page_number").alias("page"), F.min("name").alias("name")).join(sizes, "paper_id").withColumn("kid", F.xxhash64("key"))
    keys = stage(keys.select("*", *[(F.length("key") - F.length(F.translate("key", x, ""))).alias(f"c{i}") for i, x in enumerate(LETTERS)]), "keys")
    volumes = keys.filter("name").groupBy("key").agg(F.min("paper_id").alias("p0"), F.max("paper_id").alias("p1")).filter("p0 <> p1").select("key")
    counts = [f"c{i}" for i in range(len(LETTERS))]
    other = keys.select("paper_id", F.col("kid").alias("tid"), F.col("key").alias("t"), F.when(F.col("n") == 1, F.col("page")).alias("only"), "n_pages", *[F.col(c).alias(f"t{c}") for c in counts])
    once = keys.filter("n = 1").select("paper_id", "kid", "key", "page", *counts)
    short, long = F.col("n_pages") <= PAIRED_PAGES, keys.filter(F.col("n_pages") > PAIRED_PAGES)
    # an edit changes the counts of two letters by one at most: that is cheap to see
    unlike = reduce(add, [F.abs(F.col(c) - F.col(f"t{c}")) for c in counts])
    may = (F.abs(F.length("key") - F.length("t")) <= _edits(F.length("t"))) & (unlike <= 2 * _edits(F.length("t")))
    pairs = once.join(other.filter(short), "paper_id").filter(may).select("paper_id", "key", "page", "t", "only")
    pairs = pairs.unionByName(near_keys(long).join(once, ["paper_id", "kid"]).join(other.filter(~short), ["paper_id", "tid"]).filter(may).select(*pairs.columns))
    title, last = F.col("title"), F.transform(F.filter("authors", lambda a: F.length(F.trim(a)) > 0), lambda a: F.element_at(F.split(F.trim(a), r"\s+"), -1))
    lasts = F.coalesce(last, F.array().cast("array<string>"))
    known = papers.select("paper_id", F.explode(F.array(title, F.element_at(F.split(title, ":"), 1), F.try_element_at(lasts, F.lit(1)), F.concat(F.try_element_at(lasts, F.lit(1)), F.lit("etal")), F.concat(F.try_element_at(lasts, F.lit(1)), F.lit("and"), F.try_element_at(lasts, F.lit(2))), F.array_join(lasts, ""))).alias("t"))
    known = known.select("paper_id", key_of(F.col("t")).alias("t"), F.lit(None).cast("int").alias("only")).filter(F.length("t") >= 3)
    edits = _edits(F.length("t"))
    near = (F.abs(F.length("key") - F.length("t")) <= edits) & (F.expr("levenshtein(key, t, cast(greatest(1, floor(0.15D * length(t))) as int))") >= 0)
    hit = pairs.unionByName(keys.select("paper_id", "key", "page").join(known.distinct(), "paper_id")).filter((F.col("only").isNull() | (F.col("only") != F.col("page"))) & near)
    again = keys.filter("n > 1").select("paper_id", "key").unionByName(keys.join(volumes, "key", "left_semi").select("paper_id", "key"))
    hit = hit.select("paper_id", "key").unionByName(again).distinct()
    return rows.join(hit, ["paper_id", "key"], "left_semi").select("page_id", "line_no").distinct()


_OUTER = "()[]{},.;:\"'!?“”‘’*"


def _bare(x: str) -> str:
    return x.strip(_OUTER)


_RING = 2**31 - 1
#: Up to so many rows of a few numbers each are sent to the texts, more meet them by a shuffled join.
SMALL_TABLE = 500_000
#: Up to so many corrections are looked up where pages are read; more are joined.
SMALL_CORRECTIONS = 100_000


def anagram(word: str) -> int:
    """The sum of the fifth powers of the characters, each within 31 bits."""
    return sum(pow(ord(c), 5, _RING) for c in word)


def anagram_of(word: Column) -> Column:
    """:func:`anagram` in SQL."""
    ring = F.lit(_RING)
    power = lambda x: x * x % ring * x % ring * x % ring * x % ring
    return F.aggregate(F.transform(F.split(word, ""), lambda c: F.ascii(c).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + power(x))


def _page_words(lines: list[str], skip: set[int]) -> tuple[list[tuple[int, str]], list[tuple[int, str, int, str]], tuple[int, str] | None, tuple[int, str] | None]:
    """(words as (line, word), breaks as (line, tail, next line, head), head of the page, tail that the page ends with)."""
    body = [(i, x.rstrip()) for i, x in enumerate(lines) if i not in skip and x.strip()]
    words, breaks, first, open_ = [], [], None, None
    for i, line in body:
        tokens = line.split()
        prose = any(c.isalpha() for c in line)
        if open_ is not None and prose:
            breaks.append((*open_, i, tokens[0].lower()))
            tokens, open_ = tokens[1:], None
        elif first is None and prose:
            first = (i, tokens[0].lower())
        if tokens and tokens[-1][-1] in _BREAK and len(tokens[-1]) > 1 and tokens[-1][-2].isalnum():
            open_ = (i, tokens[-1].lower())
            tokens = tokens[:-1]
        words += [(i, w) for x in tokens if (w := _bare(x.lower()))]
    return words, breaks, first, open_


def _may_hold(text: str, words: set[str]) -> bool:
    """Whether any word that :func:`_page_words` can read from a text is among ``words``; each different token is looked at once."""
    for x in set(text.lower().split()):
        w = _bare(x)
        if w in words or x in words or x[:-1] in words or ("-" in x and any(p in words for y in (w, x, x[:-1]) for p in _parts(y))):
            return True
    return False


def _parts(word: str) -> list[str]:
    return [p for p in re.split("[-‐/]", word) if p]


def page_evidence(pages: DataFrame) -> DataFrame:
    """Rows of (kind, ...) from (paper_id, page_id, page_number, text, skip): word counts, breaks and open ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "word", "n", "paper_id", "page_number", "page_id", "line_no", "next_line", "head"])

        for batch in batches:
            rows = []
            for paper, page, number, text, skip in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, breaks, first, open_ = _page_words(text.split("\n"), set(skip or ()))
                found = [w for _, w in words]
                counts.update(found)
                for w in found:
                    if "-" in w or "‐" in w:
                        counts.update(_parts(w))
                rows += [("break", tail, None, paper, number, page, i, j, head) for i, tail, j, head in breaks]
                if first:
                    rows.append(("first", None, None, paper, number, page, first[0], None, first[1]))
                if open_:
                    rows.append(("open", open_[1], None, paper, number, page, open_[0], None, None))
            yield out(rows)
            if len(counts) > 200_000:
                yield out([("word", w, n, None, None, None, None, None, None) for w, n in counts.items()])
                counts.clear()
        yield out([("word", w, n, None, None, None, None, None, None) for w, n in counts.items()])

    return pages.select("paper_id", "page_id", "page_number", "text", "skip").mapInArrow(run, "kind string, word string, n bigint, paper_id string, page_number int, page_id string, line_no int, next_line int, head string")


def broken_words(evidence: DataFrame, counts: DataFrame) -> DataFrame:
    """(page_id, line_no, next_page, next_line, tail, head, joined) of the breaks within words."""
    inside = evidence.filter("kind = 'break'").select("page_id", "line_no", F.col("page_id").alias("next_page"), "next_line", F.col("word").alias("tail"), "head")
    first = evidence.filter("kind = 'first'").select("paper_id", "page_number", F.col("page_id").alias("next_page"), F.col("line_no").alias("next_line"), "head")
    over = evidence.filter("kind = 'open'").select("paper_id", (F.col("page_number") + 1).alias("page_number"), "page_id", "line_no", F.col("word").alias("tail")).join(first, ["paper_id", "page_number"])
    rows = inside.unionByName(over.select(*inside.columns))
    outer = r"""^[(\[{"'“‘]+|[)\]}"'”’.,;:!?]+$"""
    rows = rows.withColumn("t", F.regexp_replace(F.expr("substring(tail, 1, length(tail) - 1)"), outer, "")).withColumn("sign", F.expr("right(tail, 1)"))
    rows = rows.withColumn("h", F.regexp_replace("head", outer, "")).filter("t <> '' and h <> ''")
    rows = rows.withColumn("joined", F.concat("t", "h")).withColumn("hyphenated", F.concat_ws("-", "t", "h")).withColumn("last", F.element_at(F.split("t", "-"), -1)).withColumn("next", F.element_at(F.split("h", "-"), 1)).withColumn("short", F.concat("last", "next"))
    # each different break asks once for its five forms, in long form: one join with the counts, whatever tails and heads are frequent
    forms = ("joined", "hyphenated", "last", "next", "short")
    asked = rows.select("t", "h", *forms).distinct()
    long = asked.select("t", "h", F.explode(F.array(*[F.struct(F.lit(i).alias("form"), F.col(c).alias("word")) for i, c in enumerate(forms)])).alias("x")).select("t", "h", "x.*")
    known = long.join(counts.select("word", "n"), "word").groupBy("t", "h").agg(*[F.coalesce(F.max(F.when(F.col("form") == i, F.col("n"))), F.lit(0)).alias(f"n_{c}") for i, c in enumerate(forms)])
    rows = rows.join(known, ["t", "h"], "left").na.fill(0, [f"n_{c}" for c in forms])
    one, two = F.greatest("n_joined", "n_short"), F.col("n_hyphenated")
    both_words = (F.col("n_last") >= 5) & (F.col("n_next") >= 5) & (F.length("last") > 2) & (F.length("next") > 2)
    suspended = F.col("h").isin(*_SUSPENDED) & (one == 0)
    hard = F.col("sign").isin("­", "¬")
    broken = F.when(F.col("h").rlike("^[0-9]"), F.col("n_joined") > two).when(hard, True).when((one > 0) | (two > 0), one >= two).when(suspended, False).otherwise(~both_words)
    return rows.filter(broken).select("page_id", "line_no", "next_page", "next_line", F.col("t").alias("tail"), F.col("h").alias("head"), "joined")


def _variants(word: Column, true: Column, seen: Column) -> Column:
    """``word`` with one place of ``seen`` read as ``true``, for each place."""
    places = F.filter(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, F.length(seen)) == seen)
    return F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), true, F.substring(word, i + F.length(seen), F.length(word))))


#: A sign within a word, before or behind letters, or a digit among letters: no word is printed so.
SIGNED = rf"\p{{L}}[{_SIGNS}]+\p{{L}}|^[{_SIGNS}]\p{{L}}{{2,}}|\p{{L}}{{2,}}[�|†πﬀ-ﬆ]$|[g-z][0-9][a-z]|[a-z][0-9][g-z]"


def corrections(rare: DataFrame, counts: DataFrame, least: int = 4, ratio: int = 10) -> DataFrame:
    """(word, target, rank): rare words with their frequent confusable variants, the best one at rank 1.

    ``rare`` is (word, n). A rare word's hash, less the difference of each confusion that its letters allow, is joined with
    the hashes of the frequent words; a pair is kept if reading the confusion backwards really gives the target, and ranked by
    the number of confusions and the target's frequency, which must be ``ratio`` times the word's own and ``least``; for a word
    with a sign that no word has (:data:`SIGNED`) any target without one will do.
    """
    table = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).alias("s"), F.lit(anagram(s) - anagram(t)).cast("bigint").alias("d")) for t, s in CONFUSIONS])
    none = F.lit(None).cast("string")
    shift = lambda h, a, t2, s2: F.struct(h.alias("hash"), a["t"].alias("t1"), a["s"].alias("s1"), t2.alias("t2"), s2.alias("s2"))
    words = rare.filter(F.length("word").between(3, 40)).select("word", "n", anagram_of(F.col("word")).alias("own"), F.col("word").rlike(SIGNED).alias("signed"), F.filter(table, lambda x: F.col("word").contains(x["s"])).alias("fit"))
    one = F.transform("fit", lambda a: shift(F.col("own") - a["d"], a, none, none))
    two = F.flatten(F.transform("fit", lambda a, i: F.transform(F.slice("fit", i + 1, F.size("fit")), lambda b: shift(F.col("own") - a["d"] - b["d"], a, b["t"], b["s"]))))
    words = words.select("word", "n", "signed", F.explode(F.when(F.length("word") > 5, F.concat(one, two)).otherwise(one)).alias("x")).select("word", "n", "signed", "x.*")
    plain = counts.filter(F.col("word").rlike(r"^\p{L}{3,40}$") & ~F.col("word").rlike(SIGNED)).select(F.col("word").alias("target"), F.col("n").alias("n_target"), "hash")
    enough = F.col("signed") | (F.col("n_target") >= F.greatest(F.lit(least), ratio * F.col("n")))
    pairs = words.join(plain, "hash").filter(enough & (F.col("word") != F.col("target")))
    first = _variants(F.col("word"), F.col("t1"), F.col("s1"))
    read = F.when(F.col("t2").isNull(), first).otherwise(F.flatten(F.transform(first, lambda x: _variants(x, F.col("t2"), F.col("s2")))))
    pairs = pairs.filter(F.array_contains(read, F.col("target")))
    w = Window.partitionBy("word").orderBy(F.col("t2").isNotNull(), F.col("n_target").desc(), "target")
    return pairs.groupBy("word", "target").agg(F.min(F.col("t2")).alias("t2"), F.max("n_target").alias("n_target")).withColumn("rank", F.row_number().over(w)).select("word", "target", "rank")


#: Marks the page that belongs to no paper: it is a paper of its own.
_ALONE = "\x00"


class Repair:
    """What is known of the noise of a set of pages; each part is a staged table.

    Null texts and pages without an id have no rows; a page without a paper is a paper of its own; a page on several rows counts once.
    """

    def __init__(self, pages: DataFrame, papers: DataFrame) -> None:
        rows = pages.filter("page_id is not null and text is not null").select(F.coalesce("paper_id", F.concat(F.lit(_ALONE), F.col("page_id"))).alias("paper_id"), "page_id", F.coalesce("page_number", F.lit(0)).cast("int").alias("page_number"), "text").dropDuplicates(["page_id"])
        self.pages = stage(rows, "pages")
        sizes = self.pages.groupBy("paper_id").agg(F.countDistinct("page_number").alias("n_pages"))
        edges = stage(edge_lines(self.pages), "lines")
        self.numbers = stage(page_numbers(edges, sizes), "numbers")
        self.headers = stage(running_lines(edges, self.numbers, sizes, papers.select("paper_id", "title", "authors").dropDuplicates(["paper_id"])), "headers")
        beside = self.numbers.filter("beside").join(self.headers, ["page_id", "line_no"], "left_semi")  # else it is a numbered heading or prose
        self.numbers = self.numbers.filter("not beside").unionByName(beside)
        flagged = self.numbers.select("page_id", "line_no").unionByName(self.headers).groupBy("page_id").agg(F.collect_set("line_no").alias("skip"))  # at most four a page
        self.marked = self.pages.join(broadcast_if_small(stage(flagged, "flagged"), SMALL_TABLE), "page_id", "left")  # the texts stay where they are
        evidence = stage(page_evidence(self.marked), "evidence")
        self.counts = stage(evidence.filter("kind = 'word'").groupBy("word").agg(F.sum("n").alias("n")).withColumn("hash", F.when(F.length("word") <= 40, anagram_of(F.col("word")))), "counts")
        self.broken = stage(broken_words(evidence, self.counts), "broken")
        # words that a misreading may have made: what is not plain, and what is rare; joined words of breaks too
        simple = self.counts.filter(F.length("word").between(3, 40)).select("word", "n")
        joined = self.broken.select(F.col("joined").alias("word")).distinct().join(self.counts.select("word"), "word", "left_anti").select("word", F.lit(0).cast("bigint").alias("n"))
        cut = joined.unionByName(simple).select(F.explode(F.concat(F.array("word"), F.when(F.col("word").rlike("[-‐]"), F.split("word", "[-‐]")).otherwise(F.array().cast("array<string>")))).alias("word"), "n")
        rare = cut.filter(F.col("word").rlike(r"\p{L}") & (F.length("word") >= 3)).groupBy("word").agg(F.min("n").alias("n"))
        self.corrections = stage(corrections(rare, self.counts).filter("rank = 1").select("word", "target"), "corrections")

    @cached_property
    def hits(self) -> DataFrame:
        """(page_id, line_no, word): words that have a correction."""
        small = self.corrections.count() <= SMALL_CORRECTIONS
        shared = self.corrections.sparkSession.sparkContext.broadcast({r["word"] for r in self.corrections.select("word").collect()} if small else None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fixes = shared.value
            for batch in batches:
                rows = set()
                for page, text, skip in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if fixes is not None and not _may_hold(text, fixes):
                        continue
                    words, breaks, _, open_ = _page_words(text.split("\n"), set(skip or ()))
                    words += [(i, t[:-1]) for i, t, _, _ in breaks] + [(j, h) for _, _, j, h in breaks] + ([(open_[0], open_[1][:-1])] if open_ else [])
                    for i, w in set(words):
                        rows.update((page, i, p) for p in ((w, *_parts(w)) if "-" in w else (w,)) if fixes is None or p in fixes)
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.string()), strict=True)], names=["page_id", "line_no", "word"])

        words = self.marked.select("page_id", "text", "skip").mapInArrow(run, "page_id string, line_no int, word string")
        return stage(words if small else words.join(self.corrections.select("word"), "word", "left_semi").select("page_id", "line_no", "word"), "hits")

    def misread(self) -> DataFrame:
        """(page_id, line_no): body lines with a word that came out wrong."""
        # ends of broken words are words of their own only by chance: they count through the joined word
        ends = self.broken.select("page_id", "line_no", F.col("tail").alias("word")).unionByName(self.broken.select(F.col("next_page").alias("page_id"), F.col("next_line").alias("line_no"), F.col("head").alias("word")))
        known = self.hits.join(ends, ["page_id", "line_no", "word"], "left_anti").select("page_id", "line_no")
        split = self.broken.join(self.corrections.withColumnRenamed("word", "joined"), "joined")
        in_tail = ~F.col("target").startswith(F.col("tail"))
        split = split.select(F.when(in_tail, F.col("page_id")).otherwise(F.col("next_page")).alias("page_id"), F.when(in_tail, F.col("line_no")).otherwise(F.col("next_line")).alias("line_no"))
        return known.unionByName(split).distinct()

    def found(self) -> DataFrame:
        """(page_id, line_no, noise_kind), each case once."""
        kinds = [("page_number", self.numbers), ("running_header", self.headers), ("broken_word", self.broken), ("misread", self.misread())]
        out = None
        for kind, rows in kinds:
            rows = rows.select("page_id", "line_no", F.lit(kind).alias("noise_kind"))
            out = rows if out is None else out.unionByName(rows)
        return out.distinct()

    def paragraphs(self) -> DataFrame:
        """(paper_id, paragraph_no, page_start, page_end, text): continuous paragraphs of each paper.

        Running lines and page numbers are gone, broken words joined, ranked corrections applied (in the case of the word), lines
        of prose put together. A paragraph ends at a blank line, at a heading, before and after rows of numbers, and goes on over a page's end
        where the page stops within a sentence.
        """
        pages = self.marked.join(self.broken.groupBy("page_id").agg(F.collect_set("line_no").alias("broken")), "page_id", "left")
        wrong = self.hits.select("page_id", "word").unionByName(self.broken.select("page_id", F.col("joined").alias("word"))).unionByName(self.broken.select(F.col("next_page").alias("page_id"), F.col("joined").alias("word")))
        fixes = wrong.distinct().join(self.corrections, "word").groupBy("page_id").agg(F.collect_list(F.struct("word", "target")).alias("fixes"))  # of one page
        pages = pages.join(fixes, "page_id", "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for paper, number, text, skip, broken, fixes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    fix = {x["word"]: x["target"] for x in fixes or ()}
                    first = True
                    for k, (para, joins) in enumerate(_paragraphs(text.split("\n"), set(skip or ()), set(broken or ()), fix)):
                        prose = any(c.isalpha() for c in para)
                        ends = re.search(r"[.!?。！？][\"')\]”’]*$", para) is None and re.search("[a-z,;-]$", para) is not None
                        out.append((paper, number, k, para, prose, first and prose and re.match("[a-z0-9(]", para) is not None, ends or joins, joins))
                        first = first and not prose
                cols = list(zip(*out, strict=True)) if out else [[]] * 8
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), *[pa.bool_()] * 4)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["paper_id", "page_number", "k", "para", "prose", "starts", "ends", "joins"])

        rows = stage(pages.select("paper_id", "page_number", "text", "skip", "broken", "fixes").mapInArrow(run, "paper_id string, page_number int, k int, para string, prose boolean, starts boolean, ends boolean, joins boolean"), "paragraphs")
        w = Window.partitionBy("paper_id").orderBy("page_number", "k")  # places only, the texts stay out
        at = rows.filter("prose").select("paper_id", "page_number", "k", "starts", "ends").withColumn("new", F.when(F.col("starts") & F.coalesce(F.lag("ends").over(w), F.lit(False)), 0).otherwise(1)).withColumn("part", F.sum("new").over(w)).drop("starts", "ends", "new")
        piece = F.struct("page_number", "k", F.concat("para", F.when(F.col("joins"), "").otherwise(" ")).alias("para"))
        whole = rows.join(at, ["paper_id", "page_number", "k"]).groupBy("paper_id", "part").agg(F.array_sort(F.collect_list(piece)).alias("parts")).drop("part")
        whole = whole.unionByName(rows.filter("not prose").select("paper_id", F.array(piece).alias("parts")))
        first, last = F.element_at("parts", 1), F.element_at("parts", -1)
        whole = whole.select("paper_id", first["page_number"].alias("page_start"), last["page_number"].alias("page_end"), first["k"].alias("k"), F.trim(F.array_join(F.col("parts.para"), "")).alias("text"))
        return round_robin(whole, "paper_id", ["page_start", "k"]).select(F.when(~F.col("paper_id").startswith(_ALONE), F.col("paper_id")).alias("paper_id"), F.col("round").cast("int").alias("paragraph_no"), "page_start", "page_end", "text")


def _paragraphs(lines: list[str], skip: set[int], broken: set[int], fix: dict[str, str]) -> list[tuple[str, bool]]:
    """(paragraph, whether its last word goes on) of a page's body lines.

    Headings stand alone. Blank lines and rows of numbers end a paragraph unless it stops within a sentence that the next line of
    prose takes up in lower case: then it goes on, and the rows come before it.
    """
    out: list[tuple[str, bool]] = []
    now, rows, soft, glue = "", [], False, False

    def close() -> None:
        nonlocal now, rows, soft, glue
        out.extend([(now, False)] if now else [])
        out.extend((r, False) for r in rows)
        now, rows, soft, glue = "", [], False, False

    for i, line in enumerate(lines):
        bare = line.strip()
        if i in skip:
            continue
        if re.sub("[^a-z]", "", bare.lower()) in _HEADING_KEYS:
            close()
            out.append((bare, False))
            continue
        if not any(c.isalpha() for c in bare):
            soft = True
            rows += [bare] if bare else []
            continue
        if soft and now:
            if glue or (not re.search(r"[.!?:。！？][\"')\]”’]*$", now) and re.match(r"[a-z(]", bare)):
                out.extend((r, False) for r in rows)
                rows = []
            else:
                close()
        elif rows:
            close()
        text = bare[:-1] if i in broken and bare[-1] in _BREAK else bare
        hyphenated = now.endswith("-") and now[-2:-1].isalnum() and bare.split()[0] not in _SUSPENDED
        now = now + text if glue or hyphenated or not now else f"{now} {text}"
        glue, soft = i in broken, False
    goes_on = glue
    if now:
        out.extend((r, False) for r in rows)
        out.append((now, goes_on))
    else:
        close()
    return [(" ".join(_fixed(w, fix) for w in para.split(" ")), joins) for para, joins in out]


def _fixed(token: str, fix: dict[str, str]) -> str:
    bare = _bare(token)
    target = fix.get(bare.lower())
    if target is None:
        return token
    target = target.upper() if bare.isupper() and len(bare) > 1 else target.capitalize() if bare[:1].isupper() else target
    return token.replace(bare, target)
