"""Wikitext: infoboxes, sections, lists and titles of works."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What marks pages of books and of writers, and sections of works and awards.
BOOK_PAGE = r"Infobox (Ouvrage|Livre)|\{\{Ébauche\|livre\}\}"
WRITER_PAGE = r"Infobox Écrivain|Catégorie:Écrivain"
WORKS = r"(?iu)(œuvre|oeuvre|bibliographie|publication|ouvrage|roman|livre)"
AWARDS = r"(?iu)(prix|distinction|récompense|honneur)"


def is_book(text: Column) -> Column:
    return text.rlike(BOOK_PAGE)


def is_writer(text: Column) -> Column:
    return text.rlike(WRITER_PAGE)


def _closing(text: str, start: int) -> int:
    """The place after the braces that open at start, or -1."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return -1


def flat_lists(text: str) -> str:
    """Nested list marks as single ones; column templates replaced by what they hold."""
    text = text.replace("**", "*")
    opening = re.compile(r"\{\{colonnes\|[^\n]*\n")
    at = 0
    while m := opening.search(text, at):
        end = _closing(text, m.start())
        if end < 0:
            at = m.end()
            continue
        text = text[: m.start()] + text[m.end() : end - 2] + text[end:]
        at = m.start()
    return text


def split_infobox(text: str) -> tuple[str, str]:
    """The infobox and the rest of a page; without one, nothing and the page."""
    start = text.find("{{Infobox")
    end = _closing(text, start) if start >= 0 else -1
    return (text[:end], text[end + 1 :]) if end >= 0 else ("", text)


def infobox_fields(box: str) -> dict[str, str]:
    """Fields of an infobox; a value ends at a second equals sign."""
    parts = (p.split("=") for p in re.split(r"\n\||\n\}", box)[1:-1])
    return {p[0]: p[1] for p in parts if len(p) > 1}


def sections(text: str) -> list[dict]:
    """Sections in order: path of titles, level, own content, items of lists without italics."""
    out, path, last, level = [], [], 0, 1

    def add(end: int) -> None:
        if path:
            content = text[last:end]
            found = [re.sub("''+", "", x).strip() for x in re.findall(r"^\*+\s*(.*)$", content, re.M)]
            out.append({"path": [t for _, t in path], "level": level, "content": content.strip(), "list": found})

    for m in re.finditer(r"^(={2,6})\s*(.*?)\s*\1\s*$", text, re.M):
        add(m.start())
        level = len(m.group(1))
        while path and path[-1][0] >= level:
            path.pop()
        path.append((level, m.group(2)))
        last = m.end()
    add(len(text))
    return out


def work_title(item: str) -> str:
    """The title within an item of a list of works, not yet normalised; empty if there is none."""
    item = item.replace("\n", "")
    if re.search(r"\{\{(?:Ouvrage|Écrit)", item):
        parts = [m.group(1).strip() for k in ("titre", "sous-titre") if (m := re.search(rf"(?:^|[|{{]){k}\s*=([^|}}]*)", item))]
        if any(parts):
            return " ".join(p for p in parts if p)
    item = re.sub(r"\{\{.*?\}\}", "", item)
    item = re.sub(r"<ref[^>]*/>", "", re.sub(r"<(\w+)[^>]*>.*?</\1>", "", item))
    item = re.sub(r"\[\[([^\]]*)\]\]", lambda m: m.group(1).split("|")[-1], item)
    while (shorter := re.sub(r"\([^()]*\)", "", item)) != item:
        item = shorter
    item = re.sub(r"^\s*(?:\d{4})?\s*[-:–]?\s*", "", item.replace("''", ""))
    return item.split(",")[0].strip()


def wiki_pages(pages: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """(title, infobox, path, level, content, list, works): one row per section of each page, in Arrow batches.

    Pages without sections give one row with an empty path. A null text is an empty page.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, raw in zip(b["title"], b["text"], strict=True):
                box, rest = split_infobox(flat_lists(raw or ""))
                found = sections(rest) or [{"path": [], "level": 0, "content": rest.strip(), "list": []}]
                rows += [(t, infobox_fields(box), s["path"], s["level"], s["content"], s["list"], [w for w in map(work_title, s["list"]) if w]) for s in found]
            yield pd.DataFrame(rows, columns=["title", "infobox", "path", "level", "content", "list", "works"])

    schema = "title string, infobox map<string,string>, path array<string>, level int, content string, list array<string>, works array<string>"
    return pages.select(F.col(title).alias("title"), F.col(text).alias("text")).mapInPandas(run, schema)


def section_titles(parsed: DataFrame, deepest: int = 2) -> DataFrame:
    """(section, n): how often sections down to a level have each title."""
    return parsed.where(F.col("level").between(1, deepest)).groupBy(F.element_at("path", -1).alias("section")).agg(F.count("*").alias("n"))


def subsections(parsed: DataFrame, parents: str) -> DataFrame:
    """(title, parent, section): the sections one level below those whose title meets a pattern."""
    deep = F.size("path")
    own = parsed.where((deep > 1) & F.get("path", deep - 2).rlike(parents))
    above = parsed.select("title", F.col("path").alias("up"), F.col("level").alias("above")).distinct()
    return own.withColumn("up", F.slice("path", 1, deep - 1)).join(above, ["title", "up"]).where("level = above + 1").select("title", F.element_at("up", -1).alias("parent"), F.element_at("path", -1).alias("section"))
