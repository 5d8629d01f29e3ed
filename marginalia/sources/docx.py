"""Word documents as tables: paragraphs, tables, footnotes and figure counts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest file that is admitted, in bytes.
MAX_BYTES = 100 * 1024 * 1024

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BLOCKS = "path string, kind string, idx int, id string, text string, style_id string, style_name string, outline int, rows array<array<string>>, error string"


def _text(node: ElementTree.Element) -> str:
    signs = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "".join(x.text or "" if x.tag == f"{_W}t" else signs.get(x.tag, "") for x in node.iter()).strip()


def _blocks(parent: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Paragraphs and tables of the body; content controls are transparent."""
    for child in parent:
        if child.tag in (f"{_W}p", f"{_W}tbl"):
            yield child
        elif child.tag in (f"{_W}sdt", f"{_W}sdtContent"):
            yield from _blocks(child)


def _styles(xml: bytes | None) -> dict[str, str]:
    found = {}
    for style in ElementTree.fromstring(xml).iter(f"{_W}style") if xml else ():
        key, name = style.get(f"{_W}styleId"), style.find(f"{_W}name")
        if key:
            found[key] = (name.get(f"{_W}val") if name is not None else None) or key
    return found


def _value(node: ElementTree.Element | None) -> str | None:
    return None if node is None else node.get(f"{_W}val")


def blocks_of(content: bytes) -> Iterator[dict]:
    """Rows of one file; a file that can't be read gives one row with the reason."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as packed:
            parts = {n: packed.read(n) for n in ("word/document.xml", "word/styles.xml", "word/footnotes.xml") if n in packed.namelist()}
        if "word/document.xml" not in parts:
            raise ValueError("no word/document.xml")
        root = ElementTree.fromstring(parts["word/document.xml"])
        body = root.find(f"{_W}body")
        if body is None:
            raise ValueError("no body")
        styles = _styles(parts.get("word/styles.xml"))
        notes = parts.get("word/footnotes.xml")
        foot = list(ElementTree.fromstring(notes).iter(f"{_W}footnote")) if notes else []
    except (zipfile.BadZipFile, ElementTree.ParseError, ValueError) as e:
        yield {"kind": "error", "error": str(e)}
        return
    n_paragraphs = n_tables = 0
    for block in _blocks(body):
        if block.tag == f"{_W}p":
            n_paragraphs += 1
            properties = block.find(f"{_W}pPr")
            style = _value(properties.find(f"{_W}pStyle")) if properties is not None else None
            outline = _value(properties.find(f"{_W}outlineLvl")) if properties is not None else None
            level = int(outline) if outline is not None and re.fullmatch(r"\d+", outline) else None
            yield {"kind": "paragraph", "idx": n_paragraphs, "id": f"p{n_paragraphs}", "text": _text(block), "style_id": style or "", "style_name": styles.get(style, style or "") if style else "", "outline": level}
        else:
            n_tables += 1
            rows = [[_text(cell) for cell in row.findall(f"{_W}tc")] for row in block.findall(f"{_W}tr")]
            yield {"kind": "table", "idx": n_tables, "id": f"table{n_tables}", "rows": rows, "text": "\n".join(" | ".join(r) for r in rows)}
    kept = [x for x in foot if x.get(f"{_W}type") in (None, "normal") and _text(x)]
    for at, note in enumerate(kept, 1):
        yield {"kind": "footnote", "idx": at, "id": note.get(f"{_W}id") or str(at), "text": _text(note)}
    figures = sum(1 for x in root.iter() if x.tag in (f"{_W}drawing", f"{_W}pict"))
    yield {"kind": "figures", "idx": figures}


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _BLOCKS.split(", ")]
    for batch in batches:
        rows = [{"path": path, **row} for path, content in zip(batch["path"], batch["content"]) for row in blocks_of(content)]
        frame = pd.DataFrame(rows, columns=names)
        frame[["idx", "outline"]] = frame[["idx", "outline"]].astype("Int32")
        yield frame.astype(object).where(frame.notna(), None).assign(idx=frame["idx"], outline=frame["outline"])


def read_blocks(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows of all .docx files below ``path`` that are not larger than ``max_bytes``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return parsed_blocks(files.where(F.col("length") <= max_bytes))


def parsed_blocks(files: DataFrame) -> DataFrame:
    """Rows of Word files that a table holds: path, content."""
    return files.select("path", "content").mapInPandas(_parsed, _BLOCKS)


def paragraphs(blocks: DataFrame) -> DataFrame:
    """Paragraphs keyed by ``doc_id`` (a hash of the path), with heading flags and levels."""
    from marginalia.operators.structure import with_headings

    found = blocks.where("kind = 'paragraph'").select(_doc_id(), F.col("id").alias("p_id"), "idx", "text", "style_id", "style_name", "outline")
    return with_headings(found)


def tables(blocks: DataFrame) -> DataFrame:
    return blocks.where("kind = 'table'").select(_doc_id(), F.col("id").alias("table_id"), "idx", "rows", "text")


def footnotes(blocks: DataFrame) -> DataFrame:
    return blocks.where("kind = 'footnote'").select(_doc_id(), F.col("id").alias("fn_id"), "text")


def figure_counts(blocks: DataFrame) -> DataFrame:
    return blocks.where("kind = 'figures'").select(_doc_id(), F.col("idx").alias("figures"))


def _doc_id():
    return F.xxhash64("path").alias("doc_id")
