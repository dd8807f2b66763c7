"""Splitting of texts and sections into overlapping chunks; sequential within a document, parallel over documents."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Separators from coarse to fine, sizes in characters.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
SIZE, OVERLAP, MIN_SECTION = 1000, 150, 200
SCHEMA = "document_id long, place long, section_index int, heading_path array<string>, content string, parent_text string"


def atoms(text: str, size: int, level: int = 0) -> Iterator[tuple[str, str]]:
    """(separator before, piece) for pieces of at most `size` characters; the first has no separator."""
    if len(text) <= size:
        yield "", text
        return
    separator = SEPARATORS[level]
    parts = [part for part in text.split(separator) if part] if separator else list(text)
    for n, part in enumerate(parts):
        before = separator if n else ""
        for inner, piece in atoms(part, size, level + 1):
            yield before or inner, piece
            before = ""


def chunks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of about `size` characters. Joints count as one character; the end of a chunk, up to `overlap`
    characters but at least one piece, starts the next.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    text = text.strip()
    out: list[str] = []
    held: deque[tuple[str, str]] = deque()
    length = 0
    for separator, piece in atoms(text, size) if text else ():
        if held and length + 1 + len(piece) > size:
            out.append(joined(held))
            while held and (overlap <= 0 or (len(held) > 1 and length > overlap)):
                length -= len(held.popleft()[1]) + (1 if held else 0)
        length += len(piece) + (1 if held else 0)
        held.append((separator, piece))
    return out + [joined(held)] if held else out


def joined(pieces: deque[tuple[str, str]]) -> str:
    return "".join(piece if n == 0 else (separator or " ") + piece for n, (separator, piece) in enumerate(pieces))


def merged_sections(sections: list[tuple[list[str], str]], least: int = MIN_SECTION) -> list[tuple[list[str], str]]:
    """Sections with small ones put before the next, or after the last full one where none follows."""
    out: list[tuple[list[str], str]] = []
    waiting = ""
    for n, (path, text) in enumerate(sections):
        text = f"{waiting}\n\n{text}" if waiting else text
        waiting = ""
        if len(text) >= least or (n == len(sections) - 1 and not out):
            out.append((path, text))
        elif n == len(sections) - 1:
            out[-1] = (out[-1][0], f"{out[-1][1]}\n\n{text}")
        else:
            waiting = text
    return out


def pieces_of(text: str, sections: list[tuple[list[str], str]] | None, size: int, overlap: int, least: int) -> Iterator[tuple[int, list[str] | None, str, str | None]]:
    """(section_index, heading_path, chunk, parent text) of a document; the parent only where a section was split."""
    if not sections:
        yield from ((0, None, chunk, None) for chunk in chunks(text, size, overlap))
        return
    for n, (path, whole) in enumerate(merged_sections(sections, least)):
        found = chunks(whole, size, overlap)
        yield from ((n, path, chunk, whole if len(found) > 1 else None) for chunk in found)


def chunk_documents(docs: DataFrame, least: int = MIN_SECTION) -> DataFrame:
    """Chunks of docs(document_id, text, sections, chunk_size, chunk_overlap) in order."""
    kinds = pa.schema([
        ("document_id", pa.int64()), ("place", pa.int64()), ("section_index", pa.int32()), ("heading_path", pa.list_(pa.string())), ("content", pa.string()), ("parent_text", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sections = [(s["heading_path"], s["text"]) for s in row["sections"] or []]
                found = pieces_of(row["text"] or "", sections, row["chunk_size"], row["chunk_overlap"], least)
                rows = [(row["document_id"], n, section, path, content, parent) for n, (section, path, content, parent) in enumerate(found)]
                yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], kinds)

    return docs.select("document_id", "text", "sections", F.col("chunk_size").cast("int"), F.col("chunk_overlap").cast("int")).mapInArrow(run, SCHEMA)
