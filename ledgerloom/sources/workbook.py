"""Workbooks (xlsx: zipped XML) with what the standard library has. A sheet holds 1,048,576 rows at most by its format, so one task reads it."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the format allows.
ROWS = 1_048_576

# The format's namespaces.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_DOC = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _column(reference: str) -> int:
    """The number, from 0, of a cell's column: A is 0, AA is 26."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def cells(content: bytes, sheet: str | int = 0) -> list[list[object]]:
    """The rows of a sheet, by name or number: text, float, bool or None (empty and error cells)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        listed = ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
        sheets = {s.get("name"): s.get(f"{_DOC}id") for s in listed}
        if isinstance(sheet, str) and sheet not in sheets:
            raise KeyError(f"no sheet {sheet!r}; there are {list(sheets)}")
        wanted = sheets[sheet] if isinstance(sheet, str) else list(sheets.values())[sheet]
        target = next(r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{_REL}Relationship") if r.get("Id") == wanted)
        shared = [_text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        rows = []
        for row in ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{_MAIN}row"):
            out: list[object] = []
            for c in row.iter(f"{_MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(out)
                out += [None] * (at + 1 - len(out))
                kind, value = c.get("t", "n"), c.findtext(f"{_MAIN}v")
                if kind == "inlineStr":
                    out[at] = _text(c)
                elif value is None or kind == "e":
                    out[at] = None
                else:
                    out[at] = shared[int(value)] if kind == "s" else value == "1" if kind == "b" else float(value) if kind == "n" else value
            at = int(row.get("r", len(rows) + 1))
            rows += [[] for _ in range(at - 1 - len(rows))] + [out]
    return rows


#: Rows of a sheet that leave a task together.
FRAME = 4096


def _kind(value: object) -> str:
    return "-" if value is None else "b" if isinstance(value, bool) else "n" if isinstance(value, float) else "s"


def _shown(value: object) -> str | None:
    """A value as text; whole numbers without a point."""
    return None if value is None else str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def _rows(sheet: str | int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of every workbook: its path, the row's number (-1: there is no such sheet), cells as text, and a letter for the kind of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = cells(bytes(content), sheet)
                except KeyError as e:
                    yield pd.DataFrame([(path, -1, [e.args[0]], "")], columns=["path", "nth", "cells", "kinds"])
                    continue
                for at in range(0, len(found), FRAME):
                    own = found[at : at + FRAME]
                    yield pd.DataFrame({"path": path, "nth": range(at, at + len(own)), "cells": [[*map(_shown, r)] for r in own], "kinds": ["".join(map(_kind, r)) for r in own]})

    return run


def read_sheet(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet with a header row, of one workbook or of all that ``path`` (a folder or pattern) names; these must have the same header.

    A column of numbers only is double, of truths only boolean, any other text (whole numbers without a point); rows without a
    value are left out. Workbooks are read by tasks, one each; the driver learns the header and the kinds of columns.
    """
    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_rows(sheet), "path string, nth long, cells array<string>, kinds string")
    heads = rows.where("nth <= 0").select(F.col("nth") < 0, "cells").distinct().limit(2).collect()
    if missing := next((r for r in heads if r[0]), None):
        raise KeyError(missing["cells"][0])
    if len(heads) > 1:
        raise ValueError("the workbooks have different headers")
    names = [h if h is not None else f"column{i}" for i, h in enumerate(heads[0]["cells"])] if heads else []
    body = rows.where((F.col("nth") > 0) & F.col("kinds").rlike("[^-]"))
    met = body.select(F.posexplode(F.split("kinds", "")).alias("i", "kind")).where("kind not in ('-', '')").groupBy("i").agg(F.collect_set("kind").alias("kinds")).collect()
    kinds = {r["i"]: r["kinds"] for r in met}
    cast = lambda i: {"b": "boolean", "n": "double"}.get("".join(kinds.get(i, [])), "string")
    return body.select(*(F.get("cells", F.lit(i)).cast(cast(i)).alias(n) for i, n in enumerate(names)))


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) < 1e308:
        return f"<c><v>{value!r}</v></c>"
    clean = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", str(value))  # XML has no such characters
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def _sheet_xml(names: list[str], rows: list[tuple]) -> str:
    body = "".join(f"<row>{''.join(map(_cell, r))}</row>" for r in [names, *rows])
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns={quoteattr(_MAIN[1:-1])}><sheetData>{body}</sheetData></worksheet>'


def write_sheets(path: str, sheets: dict[str, DataFrame]) -> None:
    """K1: a workbook with one sheet per table, for readers outside Spark. Arrays and the like become text. A table of more rows than the format allows is an error."""
    spark = next(iter(sheets.values())).sparkSession
    parts = {}
    for i, df in enumerate(sheets.values(), 1):
        plain = df.select(*(F.col(f"`{f.name}`") if f.dataType.typeName() in ("string", "boolean", "byte", "short", "integer", "long", "float", "double") else F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema))
        rows = [tuple(r) for r in plain.limit(ROWS).collect()]  # no more than a sheet holds
        if len(rows) >= ROWS:
            raise ValueError(f"a sheet holds {ROWS - 1} rows below its header")
        parts[f"xl/worksheets/sheet{i}.xml"] = _sheet_xml(df.columns, rows)
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    mime = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<workbook xmlns={quoteattr(_MAIN[1:-1])} xmlns:r={quoteattr(_DOC[1:-1])}><sheets>{listed}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f"<Relationships xmlns={quoteattr(_REL[1:-1])}>" + "".join(f'<Relationship Id="rId{i}" Type="{kind}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>"
    parts["_rels/.rels"] = f'<Relationships xmlns={quoteattr(_REL[1:-1])}><Relationship Id="rId1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{mime}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
    parts["[Content_Types].xml"] = f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{mime}.sheet.main+xml"/>{types}</Types>'
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(made.getvalue()))
    finally:
        out.close()
