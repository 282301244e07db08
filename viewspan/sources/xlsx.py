"""A small reader and writer of xlsx workbooks with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_workbook(data: bytes) -> dict[str, list[list]]:
    """Sheets by name, rows of cells (numbers, text or None)."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(_NS + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_NS + "sheet"):
        target = targets[sheet.get(_REL + "id")].lstrip("/")
        rows: list[list] = []
        for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else "xl/" + target)).iter(_NS + "row"):
            at = int(row.get("r", len(rows) + 1))
            rows += [[] for _ in range(at - len(rows))]
            cells = rows[at - 1]
            for c in row.iter(_NS + "c"):
                k = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (k + 1 - len(cells))
                v, kind = c.find(_NS + "v"), c.get("t")
                if kind == "inlineStr":
                    cells[k] = "".join(t.text or "" for t in c.iter(_NS + "t"))
                elif v is not None and v.text is not None:
                    cells[k] = shared[int(v.text)] if kind == "s" else v.text if kind in ("str", "e") else float(v.text)
        out[sheet.get("name")] = rows
    return out


def write_workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of plain cells; names are cut to the 31 characters that the format allows."""
    letters = lambda k: (letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)

    def cell(ref, v):
        if v is None or v != v:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        n = len(sheets)
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, n + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, n + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(name[:31])}" sheetId="{k}" r:id="rId{k}"/>' for k, name in enumerate(sheets, 1)) + "</sheets></workbook>")
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{i}">' + "".join(cell(f"{letters(j)}{i}", v) for j, v in enumerate(row)) + "</row>" for i, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'{head}<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return buffer.getvalue()
