"""Web pages as sources: embedded JSON, lines under headings, candidate addresses."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from html.entities import html5
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EMBEDDED = r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'


def embedded_json(html: Column) -> Column:
    """The JSON that a page carries in its data script; null without one."""
    raw = F.regexp_extract(html, EMBEDDED, 1)
    return F.when(raw != "", raw)


def article_body(page: str) -> str | None:
    """HTML of the article within a page's data script: the longest ``body`` or ``html`` string of its tree."""
    m = re.search(EMBEDDED, page)
    best = None

    def walk(x):
        nonlocal best
        if isinstance(x, dict):
            for k, v in x.items():
                if k in ("body", "html") and isinstance(v, str) and (best is None or len(v) > len(best)):
                    best = v
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    if m:
        walk(json.loads(m.group(1)))
    return best


class _Lines(HTMLParser):
    """Lines (list items, paragraphs, quotes) under the headings they stand below."""

    LEVELS = {"h2": "section", "h3": "subject", "h4": "ability"}
    HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
    LINES = {"p", "li", "blockquote", "td"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.context = dict.fromkeys(self.LEVELS.values(), "")
        self.out: list[dict] = []
        self.open: list[tuple[str, list[str]]] = []
        self.quote = 0
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style")
        if tag == "br":
            self.handle_data(" ")
        if tag in self.HEADINGS | self.LINES:
            # what may be left unclosed ends where its like, or a heading, begins
            ends = {"p", "li", "td"} if tag in self.HEADINGS else {tag} & {"p", "li", "td"}
            while self.open and self.open[-1][0] in ends:
                self.finish()
            self.quote += tag == "blockquote"
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        self.silent = max(0, self.silent - (tag in ("script", "style")))
        while tag in ("ul", "ol", "table") and self.open and self.open[-1][0] in ("p", "li", "td"):
            self.finish()
        if any(t == tag for t, _ in self.open):
            while self.finish() != tag:
                pass

    def handle_data(self, data):
        if self.open and not self.silent:
            self.open[-1][1].append(data)

    def finish(self) -> str:
        tag, parts = self.open.pop()
        text = " ".join("".join(parts).split())
        if tag in self.HEADINGS:
            if level := self.LEVELS.get(tag):
                names = list(self.LEVELS.values())
                for lower in names[names.index(level) :]:
                    self.context[lower] = ""
                self.context[level] = text
        elif text:
            self.out.append({**self.context, "text": text, "tag": tag, "quote": self.quote > 0})
        self.quote -= tag == "blockquote"
        return tag


def lines_of(html: str | None) -> list[dict]:
    """The lines of one page, read in sequence; page_lines has them for a table of pages."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    while parser.open:
        parser.finish()
    return parser.out


# -- lines of pages as windows over their tags ------------------------------------------------------

#: A page's pieces: comments, scripts and styles, tags (a quoted value may hold >), declarations, text.
PIECE = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)|</?[a-z](?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+>|<[!?][^>]*>|[^<]+|<"
HEADING, LINE, LISTS = ("h1", "h2", "h3", "h4", "h5", "h6"), ("p", "li", "td"), ("ul", "ol", "table")
LEVELS = {"h2": "section", "h3": "subject", "h4": "ability"}


def unescaped(text: Column) -> Column:
    """text with its character references replaced: numbered ones, and named ones that end in ;.  Others stay."""
    named = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")

    def one(x: Column) -> Column:
        dec, hexa, name = (F.regexp_extract(x, p, 1) for p in (r"^&#([0-9]{1,7});$", r"^&#[xX]([0-9a-fA-F]{1,6});$", r"^&([A-Za-z0-9]+);$"))
        code = F.when(dec != "", dec.cast("long")).when(hexa != "", F.conv(hexa, 16, 10).cast("long"))
        return (
            F.when(~x.startswith("&"), x)
            .when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
            .when(name != "", F.coalesce(F.try_element_at(named, name), x))
            .otherwise(x)
        )

    pieces = F.transform(F.regexp_extract_all(text, F.lit(r"&#?[A-Za-z0-9]+;|[^&]+|&"), 0), one)
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def page_lines(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, section, subject, ability, text, tag, quote) of all lines of all pages: list items, paragraphs, cells and quotes under their headings.

    Pages are cut into tags and text natively; all else are windows over a page's pieces.  What HTML lets go
    unclosed ends where its like, a heading or the list around it does, so where an element ends is the next
    such tag.  A text belongs to the element that began last and is still open; pos counts lines in the order in which they begin.
    Pages are told apart by key, so it has to be unique.  Null and empty pages have no lines.
    """
    c, is_in = F.col, lambda kinds: F.col("tag").isin(*kinds)
    piece = F.posexplode(F.regexp_extract_all(c(html), F.lit(PIECE), 0)).alias("at", "piece")
    p = pages.select(c(key).alias("_k"), piece)
    tag = F.lower(F.regexp_extract("piece", "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    p = p.withColumn("tag", tag).withColumn("kind", F.when(tag == "", F.when(c("piece").rlike("^<[!?]"), "none").otherwise("text")).when(c("piece").startswith("</"), "end").otherwise("start"))
    p = p.withColumn("piece", F.when((c("tag") == "br") & (c("kind") == "start"), F.lit(" ")).when(c("kind") == "text", unescaped(c("piece"))))
    p = p.withColumn("kind", F.when(c("tag") == "br", "text").otherwise(c("kind")))
    p = p.where((c("kind") == "text") | is_in([*HEADING, *LINE, *LISTS, "blockquote"])).where("kind <> 'none'")
    down = Window.partitionBy("_k").orderBy("at")
    up = Window.partitionBy("_k").orderBy(c("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    start, end = c("kind") == "start", c("kind") == "end"
    above = (start & is_in(HEADING)) | (end & is_in([*LISTS, "blockquote"]))
    ends = {"p": is_in(LINE) & (c("kind") != "text") | above, "li": is_in(["li"]) & (c("kind") != "text") | above, "td": is_in(["td"]) & (c("kind") != "text") | above, "heading": is_in(HEADING) & (c("kind") != "text")}
    for name, here in ends.items():
        p = p.withColumn(f"_{name}", F.last(F.when(here, c("at")), ignorenulls=True).over(up))
    close = F.coalesce(F.when(is_in(HEADING), c("_heading")).when(c("tag") == "p", c("_p")).when(c("tag") == "li", c("_li")).when(c("tag") == "td", c("_td")), F.lit(2**31 - 1))
    p = p.withColumn("close", close)
    step = F.when(c("tag") == "blockquote", F.when(start, 1).when(end, -1)).otherwise(0)
    p = p.withColumn("_sum", F.sum(F.coalesce(step, F.lit(0))).over(down)).withColumn("depth", c("_sum") - F.least(F.lit(0), F.min("_sum").over(down)))
    for name, kinds in (("p", ["p"]), ("li", ["li"]), ("td", ["td"]), ("heading", HEADING)):
        last = F.last(F.when(start & is_in(kinds), F.struct("at", "close", "tag", "depth")), ignorenulls=True).over(down)
        p = p.withColumn(f"_{name}", F.when(last["close"] > c("at"), last))
    in_quote = Window.partitionBy("_k", "depth").orderBy("at")
    quote = F.last(F.when(start & (c("tag") == "blockquote"), F.struct("at", "close", "tag", "depth")), ignorenulls=True).over(in_quote)
    p = p.withColumn("_quote", F.when(c("depth") > 0, quote))
    text = p.where("kind = 'text'").withColumn("own", F.greatest("_p", "_li", "_td", "_heading", "_quote")).where("own IS NOT NULL")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"])
    lines = text.groupBy("_k", c("own.at").alias("at"), c("own.tag").alias("tag"), (c("own.depth") > 0).alias("quote")).agg(F.array_join(parts, "").alias("text"))
    lines = lines.withColumn("text", F.trim(F.regexp_replace("text", r"[\s\x{A0}\x{1C}-\x{1F}\x{85}\x{2000}-\x{200A}\x{1680}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " ")))
    # headings without text count as headings too
    bare = p.where(start & is_in(list(LEVELS))).select("_k", "at", "tag").join(lines.select("_k", "at"), ["_k", "at"], "left_anti")
    lines = lines.unionByName(bare.select("_k", "at", "tag", F.lit(False).alias("quote"), F.lit("").alias("text")))
    begun = Window.partitionBy("_k").orderBy("at")
    for level in LEVELS:
        lines = lines.withColumn(f"_{level}", F.last(F.when(c("tag") == level, F.struct("at", "text")), ignorenulls=True).over(begun))
    under = {"h2": F.lit(-1), "h3": F.coalesce("_h2.at", F.lit(-1)), "h4": F.greatest(F.coalesce("_h2.at", F.lit(-1)), F.coalesce("_h3.at", F.lit(-1)))}
    for level, name in LEVELS.items():
        lines = lines.withColumn(name, F.when(c(f"_{level}.at") > under[level], c(f"_{level}.text")).otherwise(""))
    lines = lines.where((c("text") != "") & ~is_in(HEADING)).withColumn("pos", (F.row_number().over(begun) - 1).cast("int"))
    return lines.select(c("_k").alias(key), "pos", *LEVELS.values(), "text", "tag", "quote")


def candidate_slugs(spark: SparkSession, years: Sequence[int], most: int, patterns: Sequence[str]) -> DataFrame:
    """(year, number, choice, slug): addresses to try, by a pattern with {year}, {yy} and {n}."""
    base = spark.createDataFrame([(y,) for y in years], "year int").select("year", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("number"))
    texts = [p.replace("{year}", "%1$d").replace("{yy}", "%2$d").replace("{n}", "%3$d") for p in patterns]
    slugs = F.array(*(F.format_string(x, F.col("year"), (F.col("year") % 100).cast("int"), F.col("number")) for x in texts))
    return base.select("year", "number", F.posexplode(slugs).alias("choice", "slug"))


def discovered(candidates: DataFrame, known: DataFrame, misses: int = 3) -> DataFrame:
    """The first slug by choice of each number that is known, up to where ``misses`` numbers in a row are missing."""
    hit = candidates.join(known.select("slug").withColumn("_hit", F.lit(1)), "slug", "left")
    per = hit.groupBy("year", "number").agg(F.min_by("slug", F.when(F.col("_hit") == 1, F.col("choice"))).alias("slug"), F.max("_hit").alias("_hit"))
    per = per.withColumn("slug", F.when(F.col("_hit") == 1, F.col("slug")))
    w = Window.partitionBy("year").orderBy("number")
    run = F.sum(F.coalesce("_hit", F.lit(0))).over(w.rowsBetween(-(misses - 1), 0))
    stopped = F.max(F.when((run == 0) & (F.col("number") >= misses), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumn("_stop", stopped).where("_stop = 0 AND slug IS NOT NULL").select("year", "number", "slug")
