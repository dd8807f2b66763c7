"""HTML pages to title, text, sections, canonical link and time of change; one pass of the standard parser.

The parser keeps no tree. Open elements are a stack; noise elements switch text off until they close;
headings close a section; text is put on one line as long as its nearest block element stays the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements, classes, phrases and names that extraction knows.
NOISE = {"script", "style", "nav", "footer", "header", "noscript", "svg", "form"}
HIDDEN_CLASSES = ("visually-hidden", "sr-only")
INLINE = set(
    "a span strong em b i u sup sub small mark abbr cite q time code kbd var samp label s strike wbr ins del font big tt bdi bdo".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
SKIP_LINKS = {"skip to main content", "skip to the main content", "skip to content", "skip navigation", "skip to navigation"}
TIME_NAMES = ("last-modified", "revised", "date", "dcterms.modified")
TIME_PROPERTIES = ("article:modified_time", "article:published_time")
SCHEMA = "url string, title string, text string, last_updated timestamp, canonical_url string, sections array<struct<heading_path: array<string>, text: string>>"


def clean(raw: str) -> str:
    """The same as functions.text.clean_text."""
    text = re.sub(r"\r\n?", "\n", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", raw))
    text = "\n".join(line.strip() for line in re.sub(r"[ \t\xa0]+", " ", text).split("\n"))
    return re.sub(r" +([.,;:!?])", r"\1", re.sub(r"\n{3,}", "\n\n", text)).strip()


def parse_time(value: str) -> datetime | None:
    try:
        found = datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return found if found.tzinfo else found.replace(tzinfo=UTC)


class Page(HTMLParser):
    def __init__(self, base_url: str, noise_classes: tuple[str, ...] = ()) -> None:
        super().__init__(convert_charrefs=True)
        self.base_url, self.hidden = base_url, HIDDEN_CLASSES + noise_classes
        self.canonical: str | None = None
        self.times: dict[tuple[str, str], str] = {}
        self.stack: list[tuple[str, int, bool]] = []  # name, serial number, whether it switches text off
        self.serial = self.noise = 0
        self.all_text: list[str] = []
        self.title_parts: list[str] = []
        self.h1: str | None = None
        self.sections: list[tuple[tuple[str, ...], str]] = []
        self.path: list[tuple[int, str]] = []
        self.lines: list[str] = []
        self.line: list[str] = []
        self.line_of = -1
        self.heading: list[str] | None = None
        self.rows: list[list[tuple[str, list[str]]]] | None = None
        self.tables = 0
        self.skip_from: tuple[int, int, int] | None = None

    # Structure

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found = {k: v or "" for k, v in attrs}
        if tag == "link" and "canonical" in found.get("rel", "").lower().split() and found.get("href") and self.canonical is None:
            self.canonical = urljoin(self.base_url, found["href"])
        if not self.noise and tag == "meta":
            self.times.setdefault(("name", found.get("name", "")), found.get("content", ""))
            self.times.setdefault(("property", found.get("property", "")), found.get("content", ""))
        if not self.noise and tag == "time" and found.get("datetime"):
            self.times.setdefault(("time", ""), found["datetime"])
        if tag in VOID:
            return
        off = tag in NOISE or any(c in found.get("class", "") for c in self.hidden)
        self.serial += 1
        self.stack.append((tag, self.serial, off))
        self.noise += off
        if self.noise:
            return
        if tag == "a" and found.get("href", "").startswith("#"):
            self.skip_from = (self.serial, len(self.line), len(self.all_text))
        if tag in HEADINGS and self.heading is None:
            self.close_section()
            self.heading = []
        elif tag == "table":
            self.tables += 1
            if self.tables == 1:
                self.rows = []
        elif self.tables == 1 and tag == "tr":
            self.rows.append([])
        elif self.tables == 1 and tag in ("td", "th") and self.rows:
            self.rows[-1].append((tag, []))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not any(name == tag for name, _, _ in self.stack):
            return
        while self.stack:
            name, serial, off = self.stack.pop()
            self.noise -= off
            if not off and not self.noise:
                self.closed(name, serial)
            if name == tag:
                return

    def closed(self, tag: str, serial: int) -> None:
        if self.skip_from and self.skip_from[0] == serial:
            _, line_at, all_at = self.skip_from
            if " ".join(self.all_text[all_at:]).strip().lower() in SKIP_LINKS:
                del self.line[line_at:], self.all_text[all_at:]
            self.skip_from = None
        if tag in HEADINGS and self.heading is not None:
            text = " ".join(self.heading)
            if tag == "h1" and self.h1 is None and text:
                self.h1 = text
            while self.path and self.path[-1][0] >= HEADINGS[tag]:
                self.path.pop()
            if text:
                self.path.append((HEADINGS[tag], text))
            self.heading = None
        elif tag == "table":
            self.tables -= 1
            if self.tables == 0:
                self.add_table()

    # Text

    def handle_data(self, data: str) -> None:
        inside = {name for name, _, _ in self.stack}
        if self.noise:
            return
        self.all_text.append(data)
        if "title" in inside and "svg" not in inside:
            self.title_parts.append(data)
            return
        text = data.strip()
        if not text or "head" in inside:
            return
        if self.heading is not None:
            self.heading.append(text)
        elif self.tables:
            if self.rows and self.rows[-1]:
                self.rows[-1][-1][1].append(text)
        else:
            block = next((serial for name, serial, _ in reversed(self.stack) if name not in INLINE), 0)
            if block != self.line_of:
                self.close_line()
                self.line_of = block
            self.line.append(text)

    def close_line(self) -> None:
        if self.line:
            self.lines.append(" ".join(self.line))
            self.line = []
        self.line_of = -1

    def close_section(self) -> None:
        self.close_line()
        text = clean("\n".join(self.lines))
        if text:
            self.sections.append((tuple(h for _, h in self.path), text))
        self.lines = []

    def add_table(self) -> None:
        """Rows of the outermost table as lines: `label: header: value, ...`, or cells between bars."""
        rows = [[(kind, clean(" ".join(parts))) for kind, parts in row] for row in self.rows or []]
        self.rows = None
        headers = [text for _, text in rows[0]] if rows and any(kind == "th" for kind, _ in rows[0]) else []
        lines = []
        for row in rows[1:] if headers else rows:
            cells = [text for _, text in row]
            if not any(cells):
                continue
            if len(headers) > 1:
                named = [f"{headers[i]}: {c}" if i < len(headers) and headers[i] else c for i, c in enumerate(cells) if i and c]
                lines.append(f"{cells[0]}: {', '.join(named)}" if named else cells[0])
            else:
                lines.append(" | ".join(c for c in cells if c))
        if lines:
            self.close_line()
            self.lines += [x for line in lines for x in ("", line)][0 if self.lines else 1 :]

    # Results

    def last_updated(self) -> datetime | None:
        keys = [("name", n) for n in TIME_NAMES] + [("property", p) for p in TIME_PROPERTIES] + [("time", "")]
        return next((t for key in keys if (t := parse_time(self.times.get(key, "")))), None)


def parse_page(html: str, base_url: str, fallback_title: str = "Untitled", noise_classes: tuple[str, ...] = ()) -> dict:
    page = Page(base_url, noise_classes)
    page.feed(html)
    page.close()
    page.close_section()
    title = "".join(page.title_parts).strip() or page.h1 or fallback_title
    sections = [{"heading_path": list(path), "text": text} for path, text in page.sections]
    return {"title": title, "text": clean("\n".join(page.all_text)), "last_updated": page.last_updated(), "canonical_url": page.canonical, "sections": sections}


def parse_pages(pages: DataFrame, noise_classes: tuple[str, ...] = ()) -> DataFrame:
    """pages(url, html) parsed, a batch at a time; a null page counts as empty."""
    kinds = pa.schema([
        ("url", pa.string()), ("title", pa.string()), ("text", pa.string()), ("last_updated", pa.timestamp("us", "UTC")), ("canonical_url", pa.string()),
        ("sections", pa.list_(pa.struct([("heading_path", pa.list_(pa.string())), ("text", pa.string())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"url": url, **parse_page(html or "", url or "", noise_classes=noise_classes)} for url, html in zip(*(batch.column(c).to_pylist() for c in ("url", "html")), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return pages.select("url", "html").mapInArrow(run, SCHEMA)
