"""Sheets of workbooks: xlsx by the standard library (driver: a form is small), or bundles of CSV files by Spark."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession

from ..operators.form import Form, canonical_header
from ..plans.explore import Workbook
from ..plans.patches import InvalidForm, TooLarge

MOST_BYTES = 50 << 20  # fixed value: the largest workbook
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_xlsx(data: bytes) -> dict[str, list[dict]]:
    """Sheet: rows as {header: text}, with excel_row; blank rows are left out, numbers are text as they read."""
    if len(data) > MOST_BYTES:
        raise TooLarge(f"{len(data)} bytes")
    try:
        book = zipfile.ZipFile(io.BytesIO(data))
        workbook = ET.fromstring(book.read("xl/workbook.xml"))
    except (zipfile.BadZipFile, KeyError) as err:
        raise InvalidForm(f"no workbook: {err}") from err
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for s in workbook.iter(f"{_MAIN}sheet"):
        target = targets[s.get(f"{_REL}id")].lstrip("/")
        tree = ET.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        grid = {}
        for row in tree.iter(f"{_MAIN}row"):
            for c in row.iter(f"{_MAIN}c"):
                v = c.find(f"{_MAIN}v")
                kind = c.get("t")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is None or v.text is None:
                    continue
                else:
                    text = shared[int(v.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(v.text, v.text) if kind == "b" else re.sub(r"\.0+$", "", v.text)
                if text.strip():
                    grid[int(row.get("r")), _column(c.get("r"))] = text
        heads = {k: canonical_header(v) for (r, k), v in grid.items() if r == 1}
        rows: dict[int, dict] = {}
        for (r, k), v in sorted(grid.items()):
            if r > 1 and k in heads:
                rows.setdefault(r, {"excel_row": r})[heads[k]] = v
        out[s.get("name")] = list(rows.values())
    return out


def write_xlsx(sheets: dict[str, list[dict]]) -> bytes:
    """A plain workbook with inline texts; excel_row is not written."""
    esc = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def letters(k: int) -> str:
        out = ""
        while k >= 0:
            out, k = chr(65 + k % 26) + out, k // 26 - 1
        return out

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        head = '<?xml version="1.0" encoding="UTF-8"?>'
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        rels = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{rels}"><Relationship Id="r1" Type="{_REL[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{rels}">' + "".join(f'<Relationship Id="r{k}" Type="{_REL[1:-1]}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>' + "".join(f'<sheet name="{esc(n)}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        for k, n in enumerate(names, 1):
            heads = list(dict.fromkeys(c for r in sheets[n] for c in r if c != "excel_row"))
            lines = [heads, *([r.get(c) for c in heads] for r in sheets[n])]
            rows = "".join(f'<row r="{i}">' + "".join(f'<c r="{letters(j)}{i}" t="inlineStr"><is><t xml:space="preserve">{esc(v)}</t></is></c>' for j, v in enumerate(line) if v is not None) + "</row>" for i, line in enumerate(lines, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'{head}<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{rows}</sheetData></worksheet>')
    return buffer.getvalue()


def form_of(data: bytes) -> Form:
    sheets = read_xlsx(data)
    if "survey" not in sheets:
        raise InvalidForm("no survey sheet")
    return Form(sheets["survey"], sheets.get("choices", []), (sheets.get("settings") or [{}])[0])


def workbook_of(data: bytes) -> Workbook:
    """An exploration workbook from its sheets."""
    s = read_xlsx(data)
    return Workbook.of_rows(s.get("summaries", []), s.get("global_filters", []), s.get("global_exclusions", []), (s.get("settings") or [{}])[0])


def sheet_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows of a sheet as a DataFrame of texts."""
    heads = list(dict.fromkeys(c for r in rows for c in r if c != "excel_row"))
    data = [(r.get("excel_row", k + 2), *[None if r.get(h) is None else str(r[h]) for h in heads]) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, "excel_row int" + "".join(f", `{h}` string" for h in heads))


def read_attachment(spark: SparkSession, path: str) -> DataFrame:
    """A CSV attachment: texts only, since pre-loaded data is text until it is converted."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
