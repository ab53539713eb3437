"""Cutting texts into chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.columns import as_column

SIZE, OVERLAP = 1000, 50


def fixed_chunks(c: Column | str, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of windows of ``size`` characters that overlap by ``overlap``; none for an empty text."""
    text, step = as_column(c), size - overlap
    n = F.when(F.length(text) <= size, 1).otherwise(F.ceil((F.length(text) - overlap) / step)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(text, k * step + 1, F.lit(size)))
    return F.when(F.length(text) > 0, windows).otherwise(F.array().cast("array<string>"))


def envelope(title: Column | str, content: Column | str) -> Column:
    """Title and squeezed content as one text."""
    body = F.trim(F.regexp_replace(as_column(content), r"\s+", " "))
    return F.concat(F.lit("Title: "), as_column(title), F.lit("\n\nContent: "), body)


HEADING, TABLE_ROW = re.compile(r"#{1,3}\s+\S"), re.compile(r"\s*\|.+\|\s*$")


def markdown_blocks(text: str) -> Iterator[str]:
    """Headings alone, runs of table rows together, other lines up to a blank one."""
    held: list[str] = []
    for line in [*text.splitlines(), ""]:
        starts = not line.strip() or HEADING.match(line) or (held and bool(TABLE_ROW.match(line)) != bool(TABLE_ROW.match(held[-1])))
        if held and starts:
            yield "\n".join(held).strip()
            held = []
        if HEADING.match(line):
            yield line.strip()
        elif line.strip():
            held.append(line)


def windows(text: str, size: int, overlap: int) -> list[str]:
    """The fixed windows of ``fixed_chunks`` on a string."""
    return [text[a:a + size] for a in range(0, max(1, len(text) - overlap), size - overlap)]


def semantic_chunks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Blocks gathered up to ``size`` characters; a heading starts a chunk and is carried into the next ones below it."""
    chunks: list[str] = []
    held: list[str] = []
    heading, length = "", 0

    def flush() -> None:
        if held and held != [heading]:
            chunks.append("\n\n".join(held))
        held.clear()

    for block in markdown_blocks(text):
        if HEADING.match(block):
            flush()
            heading, length = block, len(block)
            held.append(block)
        elif len(block) > size:
            flush()
            chunks += [f"{heading}\n\n{part}" if heading else part for part in windows(block, size, overlap)]
            length = 0
        else:
            if held and length + len(block) + 2 > size:
                flush()
                held += [heading] if heading else []
                length = len(heading)
            held.append(block)
            length += len(block) + 2
    if held:
        chunks.append("\n\n".join(held))
    return chunks


def exploded_semantic_chunks(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """(id, chunk_no, chunk) of each text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, k, chunk) for i, t in zip(batch[ident], batch[text].fillna(""), strict=True) for k, chunk in enumerate(semantic_chunks(t))]
            yield pd.DataFrame(out, columns=[ident, "chunk_no", "chunk"])

    kind = rows.schema[ident].dataType.simpleString()
    return rows.select(ident, text).mapInPandas(cut, f"{ident} {kind}, chunk_no int, chunk string")


def segment_chunks(texts: list[str], size: int = SIZE) -> list[str]:
    """Transcript segments gathered to chunks of two or more and about ``size`` characters; a short last one joins the one before."""
    texts = [t.strip() for t in texts if t and t.strip()]
    out: list[list[str]] = []
    held: list[str] = []
    for t in texts:
        if held and sum(map(len, held)) + len(t) > size and len(held) >= min(2, len(texts)):
            out.append(held)
            held = []
        held.append(t)
    if held:
        if out and len(held) < 2:
            out[-1] += held
        else:
            out.append(held)
    return [" ".join(x) for x in out]


def dispatched_chunks(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, by_blocks, n_chunks): how each text is cut: Markdown by its blocks, other text in windows."""
    from gristmill.functions.texts import looks_like_markdown

    marked = rows.withColumn("by_blocks", F.coalesce(looks_like_markdown(text), F.lit(False)))
    blocks = exploded_semantic_chunks(marked.where("by_blocks"), ident, text).groupBy(ident).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    plain = F.when(F.col("by_blocks"), 0).otherwise(F.size(fixed_chunks(text)))
    return marked.select(ident, "by_blocks", plain.alias("_w")).join(blocks, ident, "left").select(ident, "by_blocks", F.coalesce("_n", "_w").alias("n_chunks"))
