"""Document formats, parsed in plain Python inside Arrow batches: bytes of a file to a package as a dict.

Spark's own readers cannot serve here: its XML reader loses the order of mixed content, and rows of one table need not have
the columns of the next. What Spark can parse (delimited files, plain text, JSON) has native readers in ``readers``."""

from __future__ import annotations

import csv
import html
import io
import json
import re
import subprocess
import tempfile
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

from assaykit.sources.figures import series_of


class FormatError(ValueError):
    """A file is not what its suffix says, or needs a parser that is not installed."""


def squeeze(text: str) -> str:
    return " ".join(text.split())


def table(number: int | str, matrix: list[list[str]], headers: list[str] | None = None, **more) -> dict:
    """A table of a rectangular matrix: blank headers are named by position, short rows padded, a repeated header keeps its
    first place and its last value."""
    width = max((len(r) for r in matrix), default=0)
    width = max(width, len(headers or []))
    names = headers if headers is not None else matrix[0]
    names = [(names[k] if k < len(names) else "") or f"column_{k + 1}" for k in range(width)]
    body = matrix if headers is not None else matrix[1:]
    rows = [dict(zip(names, r + [""] * (width - len(r)), strict=False)) for r in body]
    name = number if isinstance(number, str) else f"Table {number}"
    return {"id": name, "page": 0, "columns": names, "rows": [[{"name": k, "value": v} for k, v in r.items()] for r in rows], **more}


def numbered(texts: list[str], page: int = 0) -> list[dict]:
    return [{"id": f"p{k}", "page": page, "text": t, "section_path": []} for k, t in enumerate(texts, 1)]


# HTML


class _Page(HTMLParser):
    """Blocks of a page. ``strict`` forgets the text before any end tag, inline ones too; otherwise inline tags are
    transparent and only block tags delimit text."""

    BLOCKS = ("p", "h1", "h2", "h3", "td", "th", "caption", "title", "tr", "table", "li", "div")

    def __init__(self, strict: bool):
        super().__init__(convert_charrefs=True)
        self.strict, self.title, self.blocks, self.tables = strict, "", [], []
        self.text, self.open_title, self.grid, self.row = "", False, None, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("td", "th", "p", "h1", "h2", "h3", "caption"):
            self.text = ""
        self.open_title |= tag == "title"
        if tag == "table":
            self.grid = []
        elif tag == "tr" and self.grid is not None:
            self.row = []

    def handle_data(self, data: str) -> None:
        self.text += data
        if self.open_title:
            self.title += data

    def handle_endtag(self, tag: str) -> None:
        value = squeeze(self.text)
        if tag == "title":
            self.open_title = False
        elif tag in ("p", "h1", "h2", "h3"):
            self.blocks += [value] if value else []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append(value)
        elif tag == "tr" and self.grid is not None and self.row:
            self.grid.append(self.row)
            self.row = None
        elif tag == "table" and self.grid is not None:
            self.tables.append(self.grid)
            self.grid = None
        if self.strict or tag in self.BLOCKS:
            self.text = ""


def from_html(data: bytes, name: str, meta: dict, strict: bool = True) -> dict:
    page = _Page(strict)
    page.feed(data.decode("utf-8", "replace"))
    grids = [table(k, grid) for k, grid in enumerate(page.tables, 1) if grid]
    out = {"paragraphs": numbered(page.blocks), "tables": grids, "metadata": {"adapter": "html"}}
    return out | ({"title": squeeze(page.title)} if page.title else {})


# JATS


def _name(node: ElementTree.Element) -> str:
    return str(node.tag).rpartition("}")[2]


def _text(node: ElementTree.Element | None) -> str:
    return html.unescape(squeeze("".join(node.itertext()))) if node is not None else ""


def _all(root: ElementTree.Element, *names: str):
    return (n for n in root.iter() if _name(n) in names)


def _first(root: ElementTree.Element, name: str) -> str:
    return next((t for n in _all(root, name) if (t := _text(n))), "")


def _cells(row: ElementTree.Element) -> list[ElementTree.Element]:
    return [c for c in row if _name(c) in ("td", "th")]


def _header_names(head: ElementTree.Element, width: int) -> list[str]:
    """Header rows laid on a grid with their spans; a column's distinct parts read from top to bottom."""
    lines = list(_all(head, "tr"))
    grid = [[""] * width for _ in lines]
    for y, line in enumerate(lines):
        x = 0
        for cell in _cells(line):
            while x < width and grid[y][x]:
                x += 1
            across, down = (max(1, int(cell.get(k, "1"))) for k in ("colspan", "rowspan"))
            for covered in grid[y : y + down]:
                covered[x : x + across] = [_text(cell)] * len(covered[x : x + across])
            x += across
    return [" / ".join(dict.fromkeys(part for line in grid if (part := line[k]))) for k in range(width)]


def license_of(text: str) -> str:
    from assaykit.functions.text import LICENSE_RULES

    low = text.casefold()
    return next((label for texts, label in LICENSE_RULES if any(t in low for t in texts)), "unknown")


def from_jats(data: bytes, name: str, meta: dict) -> dict:
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError as error:
        raise FormatError(f"not XML: {error}") from error
    parent = {child: node for node in root.iter() for child in node}

    def sections(node: ElementTree.Element) -> list[str]:
        out: list[str] = []
        while (node := parent.get(node)) is not None:
            if (kind := _name(node)) in ("sec", "abstract"):
                heading = next((_text(c) for c in node if _name(c) == "title"), "Abstract" if kind == "abstract" else "")
                out = ([heading] if heading else []) + out
        return out

    found: dict = {"metadata": {"adapter": "jats"}}
    if title := _first(root, "article-title"):
        found["title"] = title
    ids = {n.get("pub-id-type", "").lower(): t for n in _all(root, "article-id") if (t := _text(n))}
    if "pmcid" in ids:
        found["doc_id"] = ids["pmcid"] if ids["pmcid"].startswith("PMC") else f"PMC{ids['pmcid']}"
    elif "doi" in ids:
        found["doc_id"] = f"doi:{ids['doi']}"
    found["metadata"] |= {k: ids[k] for k in ("doi", "pmid") if k in ids}
    if (year := _first(root, "year")).isdigit():
        found["year"] = int(year)
    found["license"] = license_of(" ".join(_text(n) for n in _all(root, "license", "license-p")).strip())

    inside = {id(n) for wrap in _all(root, "table-wrap") for n in wrap.iter()}
    texts = [(t, sections(n)) for n in _all(root, "p") if id(n) not in inside and (t := _text(n))]
    found["paragraphs"] = [{"id": f"p{k}", "page": 0, "text": t, "section": s[-1] if s else "", "section_path": s} for k, (t, s) in enumerate(texts, 1)]
    figs = [(n, alt) for n in _all(root, "fig") if (alt := _first(n, "alt-text"))]
    found["figures"] = [
        {"id": n.get("id") or f"fig{k}", "label": _first(n, "label"), "caption": _first(n, "caption"), "alt_text": alt, "page": 0, "section_path": sections(n)} for k, (n, alt) in enumerate(figs, 1)
    ]
    extra = []
    for n in _all(root, "supplementary-material"):
        href = next((v for k, v in n.attrib.items() if k.rpartition("}")[2] == "href"), None)
        if _text(n) or href:
            extra.append({"id": n.get("id") or f"supp{len(extra) + 1}", "label": _first(n, "label"), "caption": _first(n, "caption"), "href": href, "text": _text(n), "section_path": sections(n)})
    found["supplements"] = extra
    grids: list[dict] = []
    for wrap in _all(root, "table-wrap"):
        grid = next(_all(wrap, "table"), None)
        if grid is None:
            continue
        part = lambda kind, grid=grid: [[_text(c) for c in _cells(r)] for s in _all(grid, kind) for r in _all(s, "tr") if _cells(r)]
        head, body = part("thead"), part("tbody")
        lines = head + body if body else part("table")
        if not lines:
            continue
        width = max(map(len, lines))
        names = _header_names(next(_all(grid, "thead")), width) if head else [""] * width
        grids.append(table(_first(wrap, "label") or f"Table {len(grids) + 1}", lines[len(head) :], names, caption=_first(wrap, "caption"), section_path=sections(wrap)))
    found["tables"] = grids
    return found


# Spreadsheets, delimited files, texts, portable documents


def from_xlsx(data: bytes, name: str, meta: dict) -> dict:
    """The first sheet; cells by position in their row, so blank cells that the file leaves out shift the others."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as book:
            read = lambda path: ElementTree.fromstring(book.read(path))
            shared = [("".join(n.itertext())) for n in read("xl/sharedStrings.xml") if _name(n) == "si"] if "xl/sharedStrings.xml" in book.namelist() else []
            sheet = next(_all(read("xl/workbook.xml"), "sheet"))
            key = next(v for k, v in sheet.attrib.items() if k.rpartition("}")[2] == "id")
            target = next(n.get("Target") for n in read("xl/_rels/workbook.xml.rels") if n.get("Id") == key)
            rows = []
            for row in _all(read(target if target.startswith("xl/") else "xl/" + target.lstrip("/")), "row"):
                values = [(c.get("t"), next((n.text or "" for n in c if _name(n) == "v"), "")) for c in row if _name(c) == "c"]
                rows.append([shared[int(v)] if t == "s" and v.isdigit() else v for t, v in values])
    except (KeyError, StopIteration, IndexError, zipfile.BadZipFile, ElementTree.ParseError) as error:
        raise FormatError(f"not a workbook: {error!r}") from error
    if not rows:
        raise FormatError("the sheet is empty")
    return {"tables": [table(1, rows)], "metadata": {"adapter": "xlsx"}}


def from_delimited(data: bytes, name: str, meta: dict) -> dict:
    """All values stay text; cells beyond the header are dropped and counted."""
    lines = list(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline=""), delimiter="\t" if name.lower().endswith(".tsv") else ","))
    lines = [x for x in lines if x]
    if not lines:
        raise FormatError("no header")
    width = len(lines[0])
    over = sum(len(x) > width for x in lines[1:])
    body = [x[:width] for x in lines[1:]]
    return {"tables": [table("Table 1", body, lines[0], caption=name)], "metadata": {"adapter": "delimited", "overlong_rows": str(over)}}


def blocks(text: str) -> list[str]:
    return re.split(r"\n\s*\n", text)


def from_text(data: bytes, name: str, meta: dict) -> dict:
    """Paragraphs between blank lines; empty ones keep their number."""
    return {"paragraphs": [p for p in numbered([b.strip() for b in blocks(data.decode("utf-8", "replace"))]) if p["text"]], "metadata": {"adapter": "text"}}


def from_pages(text: str) -> list[dict]:
    """Paragraphs of a text whose pages end with form feeds; numbers run on over non-empty ones."""
    found = [(page, b.strip()) for page, part in enumerate(text.split("\f"), 1) for b in blocks(part) if b.strip()]
    return [{"id": f"p{k}", "page": page, "text": b, "section_path": []} for k, (page, b) in enumerate(found, 1)]


def from_pdf(data: bytes, name: str, meta: dict, command: tuple[str, ...] = ("pdftotext", "-layout")) -> dict:
    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
        f.write(data)
        f.flush()
        try:
            text = subprocess.run([*command, f.name, "-"], check=True, capture_output=True).stdout.decode("utf-8", "replace")
        except (OSError, subprocess.CalledProcessError) as error:
            raise FormatError("PDF needs the pdftotext program, or a layout converter") from error
    return {"paragraphs": from_pages(text), "metadata": {"adapter": "pdf", "page_count": str(len(text.split("\f")))}}


def from_package(data: bytes, name: str, meta: dict) -> dict:
    """A package in JSON; its rows are objects and become ordered cells."""
    raw = json.loads(data)
    if not isinstance(raw, dict):
        raise FormatError("a package is an object")
    return package_of(raw)


def package_of(raw: dict) -> dict:
    """A package as our schema has it, of the JSON form with rows as objects and free-form figures."""
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    out = {k: raw[k] for k in ("doc_id", "title", "year", "license", "local_path") if raw.get(k) not in (None, "")}
    out["paragraphs"] = [p | {"id": str(p.get("id")), "page": int(p.get("page", 0)), "text": str(p.get("text", "")), "section_path": p.get("section_path") or []} for p in raw.get("paragraphs") or []]
    out["tables"] = [
        t
        | {"id": str(t.get("id", "")), "page": int(t.get("page", 0)), "section_path": t.get("section_path") or [], "columns": t.get("columns") or list((t.get("rows") or [{}])[0])}
        | {"rows": [[{"name": str(k), "value": text(v)} for k, v in r.items()] if isinstance(r, dict) else r for r in t.get("rows") or []]}
        for t in raw.get("tables") or []
    ]
    out["figures"] = [{k: f.get(k) for k in ("id", "label", "caption", "alt_text")} | {"page": int(f.get("page", 0)), "section_path": f.get("section_path") or []} | series_of(f) for f in raw.get("figures") or []]
    out["supplements"] = raw.get("supplements") or []
    out["metadata"] = {str(k): text(v) for k, v in (raw.get("metadata") or {}).items()}
    return out


FORMATS = {
    ".json": from_package,
    ".csv": from_delimited,
    ".tsv": from_delimited,
    ".html": from_html,
    ".htm": from_html,
    ".xml": from_jats,
    ".nxml": from_jats,
    ".txt": from_text,
    ".md": from_text,
    ".pdf": from_pdf,
    ".xlsx": from_xlsx,
}


def parse(data: bytes, name: str, meta: dict | None = None, adapters: tuple = (), adapter: str | None = None) -> dict:
    """A file as a package: by the adapter named, or by suffix. Given metadata wins over what the file says."""
    meta = {k: v for k, v in (meta or {}).items() if v is not None}
    if adapter is not None:
        own = next((a for a in adapters if a.name == adapter), None)
        if own is None or not own.supports(name):
            raise FormatError(f"adapter {adapter} does not take {name}")
        found = package_of(own.load(data, name, meta))
        found["metadata"]["adapter"] = own.name
    else:
        suffix = "." + name.lower().rpartition(".")[2]
        if suffix not in FORMATS:
            raise FormatError(f"no format has suffix {suffix}")
        found = FORMATS[suffix](data, name, meta)
    fields = ("doc_id", "title", "year", "license", "local_path")
    base = {"doc_id": f"file:{name}", "title": name.rpartition("/")[2], "year": 0, "license": "unknown", "local_path": name}
    over = {k: meta[k] for k in fields if k in meta}
    out = base | found | over
    out["year"] = int(out["year"])
    out["metadata"] = (found.get("metadata") or {}) | {k: str(v) for k, v in meta.items()} | {"adapter": (found.get("metadata") or {}).get("adapter", "package")}
    return out
