"""Exports of layout converters (texts, pictures and tables of cells with spans) as packages."""

from __future__ import annotations

from collections.abc import Callable

from assaykit.sources.formats import FormatError, blocks, numbered, squeeze, table

#: Words that mark a first row as a header where the export does not say.
HEADER_WORDS = ("sample", "compound", "name", "id", "batch", "group", "specimen", "material", "treatment", "condition", "value", "ic50", "mean")


def _words(item: dict, *keys: str) -> str:
    return next((squeeze(str(item[k])) for k in keys if item.get(k) and squeeze(str(item[k]))), "")


def _place(item: dict) -> dict:
    prov = (item.get("prov") or [{}])[0]
    box = prov.get("bbox") or {}
    return {"page": int(prov.get("page_no") or prov.get("page") or 0), "bbox": [float(box[k]) for k in "lbrt"] if all(k in box for k in "lbrt") else None}


def dense(cells: list[dict]) -> list[list[str]]:
    """Cells with spans as a full matrix; a later cell overwrites."""
    grid: dict[tuple[int, int], str] = {}
    for c in cells:
        y, x = (int(c.get(a, c.get(b, 0)) or 0) for a, b in (("start_row_offset_idx", "row"), ("start_col_offset_idx", "col")))
        down, across = (max(1, int(c.get(k) or 1)) for k in ("row_span", "col_span"))
        grid |= {(y + i, x + j): _words(c, "text", "value") for i in range(down) for j in range(across)}
    if not grid:
        return []
    height, width = max(y for y, _ in grid) + 1, max(x for _, x in grid) + 1
    return [[grid.get((y, x), "") for x in range(width)] for y in range(height)]


def has_header(export: dict, cells: list[dict], first: list[str]) -> bool:
    """A flag on any cell decides, then a hint on the table, then the words of the first row."""
    flags = [bool(c[k]) for c in cells for k in ("column_header", "is_header") if k in c]
    if flags:
        return any(flags)
    hint = next((export[k] for k in ("has_header", "header") if isinstance(export.get(k), bool)), None)
    return hint if hint is not None else any(w in cell.casefold() for cell in first for w in HEADER_WORDS)


def from_export(export: dict | str) -> dict:
    """A converter's export; a markdown text is split into blocks."""
    if isinstance(export, str):
        return {"paragraphs": [p for p in numbered([squeeze(b) for b in blocks(export)]) if p["text"]], "metadata": {"adapter": "layout"}}
    texts = [(t, w) for t in export.get("texts") or [] if (w := _words(t, "text", "orig", "content"))]
    pictures = [(p, _words(p, "alt_text", "description", "text", "caption")) for p in export.get("pictures") or export.get("figures") or []]
    grids = []
    for k, t in enumerate(export.get("tables") or [], 1):
        cells = (t.get("data") or t).get("table_cells") or (t.get("data") or t).get("cells") or []
        lines = dense(cells)
        if lines:
            named = has_header(t, cells, lines[0])
            grids.append(table(_words(t, "id", "label") or f"Table {k}", lines[1:] if named else lines, lines[0] if named else [""] * len(lines[0]), caption=_words(t, "caption"), section_path=[]) | _place(t))
    return {
        "paragraphs": [{"id": f"p{k}", "text": w, "section_path": []} | _place(t) for k, (t, w) in enumerate(texts, 1)],
        "figures": [{"id": _words(p, "id") or f"fig{k}", "label": _words(p, "label"), "caption": _words(p, "caption"), "alt_text": w, "section_path": []} | {"page": _place(p)["page"]} for k, (p, w) in enumerate(pictures, 1)],
        "tables": grids,
        "metadata": {"adapter": "layout"},
    }


class LayoutAdapter:
    """An adapter over a converter callable; without one it fails rather than fall back."""

    name = "layout"

    def __init__(self, convert: Callable[[bytes, str], dict | str] | None = None, suffixes: tuple[str, ...] = (".pdf", ".docx", ".pptx", ".png")):
        self.convert, self.suffixes = convert, suffixes

    def supports(self, source: str) -> bool:
        return source.lower().endswith(self.suffixes)

    def load(self, data: bytes, source: str, metadata: dict) -> dict:
        if self.convert is None:
            raise FormatError("no layout converter is installed")
        return from_export(self.convert(data, source))
