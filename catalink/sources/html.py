"""Book, author, review and extract pages: fields by element, class and attribute, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Elements that never have an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    """An element with its own texts and children, in order."""

    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    @property
    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def texts(self) -> list[str]:
        """The element's own texts, not those of elements within."""
        return [c for c in self.children if isinstance(c, str)]

    def find(self, tag: str | None = None, cls: str | None = None, **attrs: str) -> list[Node]:
        """Elements below with a tag, a class and attribute values; an attribute given as * must be present."""
        out = []
        for n in self.walk():
            if tag and n.tag != tag or cls and cls not in n.classes:
                continue
            if all(k in n.attrs and v in ("*", n.attrs[k]) for k, v in attrs.items()):
                out.append(n)
        return out


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        n = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(n)
        if tag not in VOID:
            self.here = n

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.here.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag: str) -> None:
        n: Node | None = self.here
        while n and n.tag != tag:
            n = n.parent
        if n and n.parent:
            self.here = n.parent

    def handle_data(self, data: str) -> None:
        self.here.children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; broken markup gives what can be read of it."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def _first(values: list) -> str | None:
    return values[0] if values else None


def _texts(nodes: list[Node]) -> list[str]:
    return [t for n in nodes for t in n.texts()]


def _under(root: Node, outer: dict, tag: str) -> list[Node]:
    return [x for o in root.find(**outer) for x in o.find(tag)]


def _tags(root: Node) -> list[dict]:
    return [{"tag": _first(a.texts()), "info": a.attrs.get("class")} for a in _under(root, {"cls": "tags"}, "a")]


def book_page(html: str) -> dict:
    """Fields of a book page."""
    root = parse(html)
    names = [n for o in root.find("span", itemprop="author") for a in o.find("a") for n in a.find("span", itemprop="name")]
    first, last = _texts(names), _texts([b for n in names for b in n.find("b")])
    refs = root.find(cls="livre_refs")
    infos = [t for r in refs for c in r.children for t in ([c] if isinstance(c, str) else c.texts() if c.tag == "a" else [])]
    return {
        "title": _first(_texts(_under(root, {"tag": "h1"}, "a"))),
        "author": [f"{first[i] if i < len(first) else ''} {x}" for i, x in enumerate(last)],
        "author_id": [a.attrs["href"] for o in root.find("span", itemprop="author") for a in o.find("a", href="*")],
        "infos": "".join(infos),
        "editor": _first(_texts([a for r in refs for a in r.find("a")])),
        "rating": _first(_texts(root.find(cls="texte_t2", itemprop="ratingValue"))),
        "nb_rating": _first(_texts([n for o in root.find(cls="livre_con") for n in o.find("span", itemprop="ratingCount")])),
        "resume": " ".join(_texts(root.find(cls="livre_resume", id="d_bio"))),
        "tags": _tags(root),
    }


def author_page(html: str) -> dict:
    """Fields of an author page."""
    root = parse(html)
    told = [t for d in root.find("div", "livre_resume") for t in d.texts() + _texts(d.find("span"))]
    friends = root.find(cls="list_trombi")[:1]
    awards = []
    for d in root.find("div", "livre_award"):
        after = d.parent.children[d.parent.children.index(d) + 1 :] if d.parent else []
        n = next((x for x in after if isinstance(x, Node)), None)
        if n is not None and n.tag == "a":
            awards += n.texts()
    return {
        "name": _first(_texts(_under(root, {"tag": "h1"}, "a"))),
        "infos": " ".join(told),
        "bio": " ".join(_texts(root.find(id="d_bio"))),
        "tags": _tags(root),
        "friends": [a.attrs["href"] for f in friends for a in f.find("a", href="*")],
        "rating": _first(_texts(root.find(cls="rating"))),
        "nb_rating": _first(_texts(root.find("span", "votes", itemprop="ratingCount"))),
        "awards": awards,
        "bibliography": [a.attrs["href"] for t in root.find("td", "titre_livre") for a in t.find("a", "titre_v2", href="*")],
    }


def reviews(html: str) -> list[dict]:
    """Reviews of a page; a text is made of its first ten pieces."""
    out = []
    for post in parse(html).find(cls="post_con"):
        rows = [n for n in post.find("div") if {"text", "row"} <= n.classes]
        firsts = [d for r in rows for d in r.find("div") if d.parent and next((c for c in d.parent.children if isinstance(c, Node)), None) is d]
        out.append(
            {
                "id": post.attrs.get("id"),
                "author": _texts([n for a in post.find(cls="author") for n in a.find("span", itemprop="name")]),
                "date": _first(_texts([n for a in post.find(cls="no_img") for n in a.find("span", "gris")])),
                "rating": _first([n.attrs["data-rateit-value"] for n in post.find(cls="rateit") if "data-rateit-value" in n.attrs]),
                "pop": _first(_texts([n for a in post.find(cls="post_items_like") for n in a.find("span")])),
                "content": " ".join(_texts(firsts)[:10]),
            }
        )
    return out


def extracts(html: str) -> list[dict]:
    """Quotations of a page."""
    out = []
    for post in parse(html).find(cls="post_con"):
        inner = [d for r in post.find("div") if {"text", "row"} <= r.classes for d in r.find("div")]
        out.append(
            {
                "id": _first([d.attrs["id"] for d in inner if "id" in d.attrs]),
                "author": _first(_texts(post.find(cls="author"))),
                "date": _first(_texts([n for a in post.find(cls="no_img") for n in a.find("span", "gris")])),
                "pop": _first(_texts([n for a in post.find(cls="post_items_like") for n in a.find("span")])),
                "content": " ".join(_texts(inner)[:10]),
            }
        )
    return out


def media(html: str) -> list[dict]:
    """Videos of an author."""
    out = []
    for post in parse(html).find("div", "post_con"):
        described = []
        for m in post.find(cls="actualite_media"):
            after = m.parent.children[m.parent.children.index(m) + 1 :] if m.parent else []
            n = next((x for x in after if isinstance(x, Node)), None)
            described += n.texts() if n is not None and n.tag == "div" else []
        out.append({"url": _first([a.attrs["href"] for a in post.find("a", "actualite_media", href="*")]), "date": _first(_texts([s for h in post.find(cls="actalite_post_head") for s in h.find("span")])), "description": " ".join(described)})
    return out


def hits(html: str) -> list[dict]:
    """Titles and addresses in a list of search results or in the listing of a tag."""
    links = [a for t in parse(html).find("td", "titre_livre") for a in t.find("a", "titre_v2", href="*")]
    return [{"title": _first(a.texts()), "href": a.attrs["href"]} for a in links]


def card(html: str) -> dict[str, str]:
    """The labelled values of a card: each description under its term, several of one term joined by line ends."""
    out: dict[str, str] = {}
    for d in parse(html).find("dl"):
        term = None
        for n in d.walk():
            if n.tag == "dt":
                term = "".join(n.texts()).strip()
            elif n.tag == "dd" and term is not None:
                told = "".join(n.texts() + _texts(list(n.walk()))).strip()
                out[term] = f"{out[term]}\n{told}" if term in out else told
    return out


def next_page(html: str) -> str | None:
    """Where the next page of a list is."""
    return _first([a.attrs["href"] for d in parse(html).find("div", "pagination") for a in d.find("a", "icon-next", href="*")])


#: Spark types of what the parsers return.
TYPES = {
    "book_page": "struct<title:string,author:array<string>,author_id:array<string>,infos:string,editor:string,rating:string,nb_rating:string,resume:string,tags:array<struct<tag:string,info:string>>>",
    "author_page": "struct<name:string,infos:string,bio:string,tags:array<struct<tag:string,info:string>>,friends:array<string>,rating:string,nb_rating:string,awards:array<string>,bibliography:array<string>>",
    "reviews": "array<struct<id:string,author:array<string>,date:string,rating:string,pop:string,content:string>>",
    "extracts": "array<struct<id:string,author:string,date:string,pop:string,content:string>>",
    "media": "array<struct<url:string,date:string,description:string>>",
    "hits": "array<struct<title:string,href:string>>",
    "card": "map<string,string>",
    "next_page": "string",
}
PARSERS: dict[str, Callable] = {f.__name__: f for f in (book_page, author_page, reviews, extracts, media, hits, card, next_page)}


def parsed(pages: DataFrame, key: str, html: str, parser: str) -> DataFrame:
    """(key, found): what a parser reads from each page; pages that are null give empty fields."""
    name, made = parser, PARSERS[parser]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "found": [made(h) for h in b["html"]]})

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.selectExpr(f"`{key}` as key", f"`{html}` as html")
    return rows.mapInPandas(run, f"key {kind}, found {TYPES[name]}").withColumnRenamed("key", key)


def gathered(pages: DataFrame, key: str, order: str, html: str, parser: str) -> DataFrame:
    """(key, found): the lists of all pages of one thing, joined in order of the pages."""
    from pyspark.sql import functions as F

    one = parsed(pages.withColumn("__k", F.struct(key, order)).select("__k", html), "__k", html, parser)
    return one.groupBy(F.col(f"__k.{key}").alias(key)).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(f"__k.{order}").alias("o"), "found"))), lambda x: x.found)).alias("found"))
