"""Reading HTML pages as trees, in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from gristmill.functions.dom import Tree

DROPPED = ["script", "style", "nav", "header", "footer", "aside", "noscript", "template", "title"]
NOISE_CLASSES = {"ad", "ads", "banner", "menu", "sidebar", "breadcrumb", "share", "comment"}
BLOCKS = {"p", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "dd", "dt", "pre", "figcaption"}


def blocks(tree: Tree) -> list[str]:
    """The texts of block elements in order, each without the blocks inside it, links and what is no content; one character is no text."""
    noisy = [k for k in range(1, len(tree)) if NOISE_CLASSES & {x.lower() for x in tree.classes(k)}]
    dropped = tree.marked([*tree.within(0, [*DROPPED, "a"]), *noisy])
    held: dict[int, list[str]] = {}
    for piece, node in zip(tree.pieces, tree.owner, strict=True):
        if not dropped[node]:
            block = next((k for k in (node, *tree.ancestors(node)) if tree.tag[k] in BLOCKS), None)
            if block is not None:
                held.setdefault(block, []).append(piece)
    return [text for pieces in held.values() if len(text := " ".join(" ".join(pieces).split())) > 1]


#: Pages whose rows are given out together.
AT_ONCE = 200


def read_pages(pages: DataFrame, rows_of: Callable[[int, str, Tree], list[tuple]], schema: str) -> DataFrame:
    """``rows_of`` (page_id, url, tree) over all pages, each parsed once; null html is an empty page.

    A task holds one batch of pages and what ``AT_ONCE`` of them give.
    """
    names = [x.strip().split(" ")[0] for x in _top_level(schema)]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            given = list(zip(batch["page_id"].tolist(), batch["url"], batch["html"], strict=True))
            for k in range(0, len(given), AT_ONCE):
                out = [row for ident, url, html in given[k:k + AT_ONCE] for row in rows_of(ident, url or "", Tree(html or ""))]
                yield pd.DataFrame(out, columns=names)

    return pages.select("page_id", "url", "html").mapInPandas(read, schema)


def _top_level(schema: str) -> list[str]:
    """The fields of a schema string; commas inside ``<>`` part none."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


#: What ``facts`` reads from a page, by name, as (type, function of tree and URL).
def _facts() -> dict[str, tuple[str, Callable[[Tree, str], object]]]:
    from gristmill.functions import page_parts as P
    from gristmill.functions.detail_evidence import detail_marks
    from gristmill.functions.list_posts import list_posts

    def named(names: str, rows: list[tuple]) -> list[dict]:
        return [dict(zip(names.split(), row, strict=True)) for row in rows]

    return {
        "content": ("string", lambda t, u: P.content(t)),
        "blocks": ("array<string>", lambda t, u: blocks(t)),
        "title": ("struct<title string, stage string>", lambda t, u: dict(zip(("title", "stage"), P.title(t), strict=True))),
        "titles": ("array<struct<title string, place string, score int, reasons array<string>>>",
                   lambda t, u: named("title place score reasons", P.scored_titles(t))),
        "attachments": ("array<struct<url string, name string, reason string, unsure boolean>>", lambda t, u: named("url name reason unsure", P.attachments(t, u))),
        "links": ("array<struct<url string, anchor string, in_menu boolean>>", lambda t, u: named("url anchor in_menu", P.links(t, u))),
        "posts": ("array<struct<url string, title string, date string>>", lambda t, u: named("url title date", list_posts(t, u)["posts"])),
        "pairs": ("array<struct<label string, value string>>", lambda t, u: named("label value", P.labelled_pairs(t))),
        "trail": ("array<string>", lambda t, u: P.trail(t)),
        "category": ("string", lambda t, u: P.category_of(P.trail(t))),
        "menu": ("array<struct<depth int, label string, url string>>", lambda t, u: named("depth label url", P.menu(t, u))),
        "fast": ("struct<title string, content string, place string, day string, links array<string>, ok boolean>", lambda t, u: P.fast_parse(t, u)),
        "favicon": ("string", lambda t, u: P.favicon(t, u)),
        "marks": ("array<string>", lambda t, u: detail_marks(t, u)),
        "nodes": ("array<struct<node int, parent int, depth int, tag string, id string, classes array<string>, first int, last int, text string>>",
                  lambda t, u: named("node parent depth tag id classes first last text", t.flat())),
    }


def facts(pages: DataFrame, *names: str) -> DataFrame:
    """(page_id, url, one column for each name): what is asked of each page, from one parse of it.

    Names are those of ``_facts``: content, blocks, title, titles, attachments,
    links, posts, pairs, trail, category, menu, fast, favicon, marks, nodes. A null or blank page has no
    title, links or nodes and an empty content.
    """
    wanted = [(name, *_facts()[name]) for name in names]
    schema = ", ".join(["page_id long", "url string", *(f"{name} {kind}" for name, kind, _ in wanted)])
    return read_pages(pages, lambda i, url, tree: [(i, url, *(f(tree, url) for _, _, f in wanted))], schema)


def board_lists(pages: DataFrame, start: str = "", end: str = "", old_rows: int = 3) -> DataFrame:
    """(page_id, url, posts, old, new, stopped) of each page of a board's list, with the posts of a range of days; see ``list_posts``."""
    from gristmill.functions.list_posts import list_posts

    entry = "array<struct<url string, title string, date string>>"
    return read_pages(pages, lambda i, url, tree: [(i, url, *list_posts(tree, url, start, end, old_rows).values())],
                      f"page_id long, url string, posts {entry}, old {entry}, new {entry}, stopped boolean")


def dates(pages: DataFrame, now: str) -> DataFrame:
    """(page_id, day, source, modified, event_start, event_end, apply_start, apply_end) of each page as of a day; see ``page_dates``."""
    import datetime

    from gristmill.functions.page_dates import page_dates

    today = datetime.date.fromisoformat(now)
    return read_pages(pages, lambda i, url, tree: [(i, *page_dates(tree, today).values())],
                      "page_id long, day date, source string, modified date, event_start date, event_end date, apply_start date, apply_end date")
