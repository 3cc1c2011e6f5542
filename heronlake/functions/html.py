"""HTML parsed with the standard library, a batch at a time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

#: Tags whose content isn't text of the page; tags that end a line; tags without an end.
DROPPED = {"script", "style", "nav", "footer", "header", "aside", "noscript", "iframe"}
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "br", "section", "article", "blockquote", "pre", "td"}
VOID = {"br", "img", "meta", "link", "input", "hr", "source", "area", "base", "col", "embed", "track", "wbr"}


#: Tags whose text is a block of its own; where an article is looked for, first of all of these; the same for
#: Markdown; tags without content for either; endings of linked documents; first path parts of languages; tags of one kind
#: that end the one before them.
TEXT_BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "blockquote", "pre", "code"}
ARTICLE = ("article", "main", ".content", ".post", ".article", ".entry-content", "#content", "#main", ".entry", ".post-content")
MAIN = ("main", "article", "[role='main']", "#content", ".content", "#main")
NOT_READ = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript"}
NOT_MARKDOWN = NOT_READ | {"iframe", "svg", "button", "select", "textarea"}
LINKED = (".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".zip")
LANGUAGES = ("en", "fr", "de", "es")
SCHEMES = ("javascript:", "mailto:", "tel:")
CLOSING = {"li": {"ul", "ol"}, "p": set(), "td": {"tr"}, "th": {"tr"}, "tr": {"table", "tbody", "thead"}, "option": {"select"}}


class Element:
    """An element of a page: its tag, attributes and children, which are elements and strings."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self, without: frozenset | set = frozenset()) -> Iterator[Element]:
        """The elements below this one, in the order of the text, without those tags and what is in them."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Element) and child.tag not in without:
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def strings(self, without: frozenset | set = frozenset()) -> Iterator[str]:
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, str):
                    yield child
                elif child.tag not in without:
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def text(self, joint: str = "", without: frozenset | set = frozenset()) -> str:
        """The trimmed strings below, joined; blank ones are left out."""
        return joint.join(x for s in self.strings(without) if (x := s.strip()))

    def find(self, selector: str, without: frozenset | set = frozenset()) -> Element | None:
        """The first element that a simple selector (a tag, .class, #id or [name='value']) chooses."""
        for e in self.walk(without):
            if selector[0] == ".":
                hit = selector[1:] in e.attrs.get("class", "").split()
            elif selector[0] == "#":
                hit = e.attrs.get("id") == selector[1:]
            elif selector[0] == "[":
                name, value = selector[1:-1].split("=")
                hit = e.attrs.get(name) == value.strip("'")
            else:
                hit = e.tag == selector
            if hit:
                return e
        return None


class Page(HTMLParser):
    """A page as a tree, with what is read from it. Addresses are made absolute by ``url`` where it is given."""

    def __init__(self, markup: str, url: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.url, self.root = url, Element("", {})
        self.open = [self.root]
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSING:  # an end tag that was left out
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in CLOSING[tag] or (tag == "p" and self.open[i].tag in BLOCKS - {"p"}):
                    break
                if self.open[i].tag == tag:
                    del self.open[i:]
                    break
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1].children.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def absolute(self, address: str) -> str:
        try:
            return urljoin(self.url, address.strip())
        except ValueError:
            return address.strip()

    @property
    def title(self) -> str:
        found = self.root.find("title")
        return " ".join(found.text(" ").split()) if found else ""

    @property
    def text(self) -> str:
        """Headings, paragraphs, list items, cells and quotes, a line each; blocks within blocks are repeated."""
        return "\n".join(x for e in self.root.walk(DROPPED) if e.tag in TEXT_BLOCKS and (x := " ".join(e.text(" ", DROPPED).split())))

    @property
    def links(self) -> list[str]:
        return list(dict.fromkeys(a.attrs["href"] for a in self.root.walk(DROPPED) if a.tag == "a" and a.attrs.get("href")))

    @property
    def images(self) -> list[str]:
        return [self.absolute(e.attrs["src"]) for e in self.root.walk(DROPPED) if e.tag == "img" and e.attrs.get("src")]

    @property
    def meta(self) -> dict[str, str]:
        """Meta tags by name or property, in lower case."""
        found = {}
        for e in self.root.walk():
            name = (e.attrs.get("name") or e.attrs.get("property") or "").lower() if e.tag == "meta" else ""
            if name and e.attrs.get("content"):
                found[name] = e.attrs["content"]
        return found

    @property
    def canonical(self) -> str | None:
        for e in self.root.walk():
            if e.tag == "link" and "canonical" in e.attrs.get("rel", "").split():
                return e.attrs.get("href", "")
        return None

    @property
    def anchors(self) -> list[dict]:
        """(url, text, domain, is_pdf) of the links, by absolute address, each once; scripts, mail and phone are left out."""
        found: dict[str, dict] = {}
        for a in self.root.walk():
            href = a.attrs.get("href", "").strip() if a.tag == "a" else ""
            if href and not href.startswith(SCHEMES):
                url = self.absolute(href)
                if url not in found:
                    found[url] = {"url": url, "text": a.text()[:200], "domain": domain(url), "is_pdf": url.lower().endswith(".pdf")}
        return list(found.values())

    @property
    def variants(self) -> list[str]:
        """Addresses of other languages: alternates of the same domain, or else links whose path begins with a language."""
        own = domain(self.url)
        links = [e.attrs.get("href", "").strip() for e in self.root.walk() if e.tag == "link" and "alternate" in e.attrs.get("rel", "").split() and e.attrs.get("hreflang")]
        if found := [x for x in dict.fromkeys(links) if x and own in x]:
            return found
        return [a["url"] for a in self.anchors if own in a["url"] and path_of(a["url"]).strip("/").split("/")[0] in LANGUAGES]

    @property
    def assets(self) -> dict[str, list[str]]:
        """Addresses of images, vector graphics (their ids), videos, audio and linked documents."""
        found: dict[str, list[str]] = {k: [] for k in ("images", "svgs", "videos", "audio", "documents")}
        for e in self.root.walk():
            src = e.attrs.get("src")
            if e.tag == "img" and src:
                found["images"].append(self.absolute(src))
            elif e.tag == "svg":
                found["svgs"].append(e.attrs.get("id", ""))
            elif e.tag in ("video", "audio"):
                kind = "videos" if e.tag == "video" else "audio"
                inner = [x.attrs["src"] for x in e.walk() if x.tag == "source" and x.attrs.get("src")]
                found[kind] += [self.absolute(x) for x in ([src] if src else []) + inner]
            elif e.tag == "a" and (href := e.attrs.get("href", "").strip()) and not href.startswith(SCHEMES):
                if path_of(url := self.absolute(href)).lower().endswith(LINKED):
                    found["documents"].append(url)
        return found

    @property
    def readable(self) -> str:
        """The article's text: of the first container with more than 100 characters, else of the page, else all text."""

        def blocks(e: Element) -> str:
            return "\n".join(x for t in e.walk(NOT_READ) if t.tag in TEXT_BLOCKS | {"div"} and (x := t.text(" ", NOT_READ)))

        for selector in ARTICLE:
            if (e := self.root.find(selector, NOT_READ)) and len(found := blocks(e)) > 100:
                return found
        return found if len(found := blocks(self.root)) > 100 else self.root.text(" ", NOT_READ)

    @property
    def markdown(self) -> tuple[str, str]:
        """(markdown, plain text) of the main part."""
        root = next((e for x in MAIN if (e := self.root.find(x, NOT_MARKDOWN))), self.root)
        marked, plain = [], []

        def of(e: Element) -> str:
            inner = []
            for child in e.children:
                if isinstance(child, str):
                    inner.append(re.sub(r"\s+", " ", child) if child.strip() else "")
                elif child.tag not in NOT_MARKDOWN:
                    inner.append(of(child))
            text = " ".join(x for x in inner if x).strip()
            if e.tag == "img" and e.attrs.get("src"):
                shown = f"![{e.attrs.get('alt', '').strip() or 'image'}]({self.absolute(e.attrs['src'])})"
                marked.append(f"\n{shown}\n")
                return shown
            if not text:
                return ""
            if e.tag in ("strong", "b"):
                return f"**{text}**"
            if e.tag in ("em", "i"):
                return f"*{text}*"
            if e.tag == "a" and e.attrs.get("href"):
                return f"[{text}]({self.absolute(e.attrs['href'])})"
            if re.fullmatch("h[1-6]", e.tag):
                marked.append(f"\n\n{'#' * int(e.tag[1])} {text}\n")
                plain.append(text)
            elif e.tag in ("p", "div", "section", "article"):
                marked.append(f"\n\n{text}\n")
                plain.append(text)
            elif e.tag == "li":
                marked.append(f"\n- {text}")
                plain.append(text)
            return text

        of(root)
        bare = "\n".join(plain).strip() or root.text("\n", NOT_MARKDOWN)
        return re.sub(r"\n{3,}", "\n\n", "".join(marked).strip()) or bare, re.sub(r"\n{3,}", "\n\n", bare)


def domain(url: str) -> str:
    try:
        return urlsplit(url).netloc
    except ValueError:
        return ""


def path_of(url: str) -> str:
    try:
        return urlsplit(url).path
    except ValueError:
        return ""


class Nodes(HTMLParser):
    """All text nodes, those of scripts and styles too, trimmed, without blank ones."""

    def __init__(self, markup: str) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.feed(markup)
        self.close()

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.nodes.append(data.strip())


def read(pages: DataFrame, schema: str, make: Callable[[Page], Iterator[tuple]], key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows of the key and what ``make`` yields for each page; a null page is empty. No shuffle."""
    kind = pages.schema[key].dataType.simpleString()
    names = [key, *(part.split()[0] for part in re.split(r",\s*(?![^<]*>)", schema))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *row) for k, u, x in zip(b[key], b[url], b[html], strict=True) for row in make(Page(x or "", u or ""))]
            yield pd.DataFrame(rows, columns=names)

    return pages.select(key, url, html).mapInPandas(run, f"`{key}` {kind}, {schema}")


def parsed(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, title, text, links, images, meta) of each page; see :class:`Page`."""
    return read(pages, "title string, text string, links array<string>, images array<string>, meta map<string,string>", lambda p: [(p.title, p.text, p.links, p.images, p.meta)], key, html=html)
