"""A small workbook writer on the standard library: sheets of rows with a styled, frozen header."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: Cell formats by number: plain, bold, bold and filled, bordered, date, bold with border.
PLAIN, BOLD, HEADER, BORDERED, DATE, BOLD_BORDERED = range(6)
_STYLES = f"""{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFDDDDDD"/></patternFill></fill></fills><borders count="2"><border/><border><bottom style="thin"/></border></borders><cellXfs count="6"><xf/><xf fontId="1"/><xf fontId="1" fillId="2"/><xf borderId="1"/><xf numFmtId="14"/><xf fontId="1" borderId="1"/></cellXfs></styleSheet>"""


@dataclass
class Cell:
    """A cell with a style, and for a formula its cached value."""

    value: object = None
    style: int = PLAIN
    formula: str | None = None


@dataclass
class Table:
    """A declared table of a sheet."""

    name: str
    ref: str
    columns: list[str]


@dataclass
class Sheet:
    name: str
    rows: Iterable[Iterable[object]]
    state: str = "visible"
    merges: list[str] = field(default_factory=list)
    tables: list[Table] = field(default_factory=list)
    freeze: bool = False
    widths: tuple[int, ...] = ()


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _clean(text: str) -> str:
    return escape(re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "", text))


def _cell(ref: str, x: object) -> str:
    c = x if isinstance(x, Cell) else Cell(x)
    if c.value is None and c.formula is None:
        return ""
    style = f' s="{c.style}"' if c.style else ""
    formula = f"<f>{_clean(c.formula)}</f>" if c.formula is not None else ""
    v = c.value
    if isinstance(v, bool):
        return f'<c r="{ref}"{style} t="b">{formula}<v>{int(v)}</v></c>'
    if isinstance(v, int | float):
        return f'<c r="{ref}"{style}>{formula}<v>{v!r}</v></c>'
    if v is None:
        return f'<c r="{ref}"{style}>{formula}</c>'
    if formula:
        return f'<c r="{ref}"{style} t="{"e" if str(v).startswith("#") else "str"}">{formula}<v>{_clean(str(v))}</v></c>'
    if str(v).startswith("#") and str(v).endswith(("!", "?", "A")):
        return f'<c r="{ref}"{style} t="e"><v>{_clean(str(v))}</v></c>'
    return f'<c r="{ref}"{style} t="inlineStr"><is><t xml:space="preserve">{_clean(str(v))}</t></is></c>'


def write(target, sheets: list[Sheet], creator: str = "", links: tuple[str, ...] = (), connections: tuple[dict, ...] = (), vba: bool = False, parts: dict[str, bytes] | None = None) -> None:
    """Write the sheets, row by row, to a path or a binary file. parts: further parts of the package as they are, by name."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        book, relations, kinds, n_tables = [], [], [], 0
        for i, s in enumerate(sheets, 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                put = lambda text, out=out: out.write(text.encode())
                put(f'{_HEAD}<worksheet xmlns="{_MAIN}" xmlns:r="{_REL}">')
                if s.freeze:
                    put('<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>')
                if s.widths:
                    put("<cols>" + "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(s.widths, 1)) + "</cols>")
                put("<sheetData>")
                n = wide = 0
                for n, row in enumerate(s.rows, 1):
                    cells = [_cell(f"{letters(k)}{n}", x) for k, x in enumerate(row, 1)]
                    wide = max(wide, len(cells))
                    put(f'<row r="{n}">{"".join(cells)}</row>')
                put("</sheetData>")
                if s.freeze and n and wide:
                    put(f'<autoFilter ref="A1:{letters(wide)}{n}"/>')
                if s.merges:
                    put("<mergeCells>" + "".join(f"<mergeCell ref={quoteattr(m)}/>" for m in s.merges) + "</mergeCells>")
                if s.tables:
                    put("<tableParts>" + "".join(f'<tablePart r:id="t{k}"/>' for k in range(len(s.tables))) + "</tableParts>")
                put("</worksheet>")
            own = []
            for k, t in enumerate(s.tables):
                n_tables += 1
                columns = "".join(f'<tableColumn id="{j}" name={quoteattr(c)}/>' for j, c in enumerate(t.columns, 1))
                z.writestr(f"xl/tables/table{n_tables}.xml", f'{_HEAD}<table xmlns="{_MAIN}" id="{n_tables}" name="{t.name}" displayName="{t.name}" ref="{t.ref}"><tableColumns>{columns}</tableColumns></table>')
                own.append(f'<Relationship Id="t{k}" Type="{_REL}/table" Target="../tables/table{n_tables}.xml"/>')
                kinds.append(f'<Override PartName="/xl/tables/table{n_tables}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.table+xml"/>')
            if own:
                z.writestr(f"xl/worksheets/_rels/sheet{i}.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{"".join(own)}</Relationships>')
            state = "" if s.state == "visible" else f' state="{s.state}"'
            book.append(f'<sheet name={quoteattr(s.name)} sheetId="{i}"{state} r:id="r{i}"/>')
            relations.append(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>')
            kinds.append(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
        for k, link in enumerate(links, 1):
            z.writestr(f"xl/externalLinks/externalLink{k}.xml", f'{_HEAD}<externalLink xmlns="{_MAIN}"/>')
            z.writestr(f"xl/externalLinks/_rels/externalLink{k}.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="x" Type="{_REL}/externalLinkPath" Target={quoteattr(link)} TargetMode="External"/></Relationships>')
            relations.append(f'<Relationship Id="e{k}" Type="{_REL}/externalLink" Target="externalLinks/externalLink{k}.xml"/>')
        if connections:
            rows = "".join(f"<connection id=\"{i}\" name={quoteattr(c.get('name') or '')} type=\"{c.get('type') or '1'}\"><dbPr connection={quoteattr(c.get('connection') or '')}/></connection>" for i, c in enumerate(connections, 1))
            z.writestr("xl/connections.xml", f'{_HEAD}<connections xmlns="{_MAIN}">{rows}</connections>')
        if vba:
            z.writestr("xl/vbaProject.bin", b"\0")
        for name, content in (parts or {}).items():
            z.writestr(name, content)
        relations.append(f'<Relationship Id="s" Type="{_REL}/styles" Target="styles.xml"/>')
        z.writestr("xl/styles.xml", _STYLES)
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{"".join(book)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{"".join(relations)}</Relationships>')
        z.writestr("docProps/core.xml", f'{_HEAD}<cp:coreProperties xmlns:cp="{_PACKAGE}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>{_clean(creator)}</dc:creator></cp:coreProperties>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="b" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{"".join(kinds)}</Types>')


def table_sheet(name: str, df, widths: tuple[int, ...] = ()) -> Sheet:
    """A sheet with a frame's rows below its column names; rows come one partition at a time."""

    def rows():
        yield [Cell(c, HEADER) for c in df.columns]
        for r in df.toLocalIterator():
            yield [x if x is None or isinstance(x, bool | int | float) else str(x) for x in r]

    return Sheet(name[:31], rows(), freeze=True, widths=widths)
