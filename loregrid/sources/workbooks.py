"""Workbooks (xlsx, xlsm) read with the standard library: visible sheets with computed values, merged ranges and pictures."""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DAY_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


@dataclass
class Picture:
    index: int
    row: int
    col: int
    data: bytes


@dataclass
class Sheet:
    """rows: all cells from A1 to the last used one, as stripped text ('' for nothing), merged ranges filled; merges: (row, column, last row, last column) from 0."""

    name: str
    rows: list[list[str]]
    merges: list[tuple[int, int, int, int]] = field(default_factory=list)
    pictures: list[Picture] = field(default_factory=list)


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in e.iter() if _local(x) == name]


def cell_place(ref: str) -> tuple[int, int]:
    """(row, column) from 0 of a reference such as B3."""
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits) - 1, col - 1


class _Book:
    def __init__(self, data: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())
        self.strings = ["".join(t.text or "" for t in _all(si, "t") if t is not None) for si in _all(self.xml("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in self.names else []
        self.day_styles = self._day_styles()
        book = self.xml("xl/workbook.xml")
        self.epoch = dt.datetime(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in _all(book, "workbookPr")) else dt.datetime(1899, 12, 30)
        links = self.links("xl/workbook.xml")
        self.sheets = [(s.get("name"), s.get("state", "visible"), links.get(s.get(f"{_REL}id"), "")) for s in _all(book, "sheet")]

    def xml(self, name: str) -> ET.Element:
        return ET.fromstring(self.zip.read(name))

    def links(self, name: str) -> dict[str, str]:
        folder, base = posixpath.split(name)
        rels = f"{folder}/_rels/{base}.rels"
        if rels not in self.names:
            return {}
        place = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
        return {r.get("Id"): place(r.get("Target", "")) for r in _all(self.xml(rels), "Relationship") if r.get("TargetMode") != "External"}

    def _day_styles(self) -> set[int]:
        if "xl/styles.xml" not in self.names:
            return set()
        styles = self.xml("xl/styles.xml")
        own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in _all(styles, "numFmt")}
        days = _DAY_FORMATS | {k for k, v in own.items() if re.search("[ymdhs]", v, re.I)}
        return {i for xfs in _all(styles, "cellXfs") for i, xf in enumerate(xfs) if int(xf.get("numFmtId", 0)) in days}

    def value(self, cell: ET.Element) -> str:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in _all(cell, "t")).strip()
        raw = next((v.text for v in cell if _local(v) == "v"), None)
        if raw is None:
            return ""
        if kind == "s":
            return self.strings[int(raw)].strip()
        if kind == "b":
            return "True" if raw == "1" else "False"
        if kind == "n":
            number = float(raw)
            if int(cell.get("s", 0)) in self.day_styles:
                at = self.epoch + dt.timedelta(seconds=round(number * 86400, 3))
                return str(at.time() if 0 <= number < 1 else at)
            return str(int(number)) if re.fullmatch(r"-?\d+", raw) else str(number)
        return raw.strip()

    def sheet(self, name: str, part: str) -> Sheet:
        page = self.xml(part)
        cells: dict[tuple[int, int], str] = {}
        row = -1
        for r in _all(page, "row"):
            row = int(r.get("r")) - 1 if r.get("r") else row + 1
            col = -1
            for c in r:
                if _local(c) == "c":
                    col = cell_place(c.get("r"))[1] if c.get("r") else col + 1
                    cells[row, col] = self.value(c)
        merges = []
        for m in _all(page, "mergeCell"):
            first, _, last = m.get("ref").partition(":")
            a, b = cell_place(first), cell_place(last or first)
            merges.append((*a, *b))
            for i in range(a[0], b[0] + 1):
                for j in range(a[1], b[1] + 1):
                    cells[i, j] = cells.get(a, "")
        height, width = (max(k[i] for k in cells) + 1 if cells else 0 for i in (0, 1))
        return Sheet(name, [[cells.get((i, j), "") for j in range(width)] for i in range(height)], merges, self.pictures(part, page))

    def pictures(self, part: str, page: ET.Element) -> list[Picture]:
        found = []
        links = self.links(part)
        for drawing in _all(page, "drawing"):
            at = links.get(drawing.get(f"{_REL}id"), "")
            if at not in self.names:
                continue
            media = self.links(at)
            for anchor in (a for a in self.xml(at) if _local(a).endswith("Anchor")):
                blip, start = next(iter(_all(anchor, "blip")), None), next(iter(_all(anchor, "from")), None)
                target = media.get(blip.get(f"{_REL}embed"), "") if blip is not None else ""
                if target not in self.names or not self.zip.getinfo(target).file_size:
                    continue
                number = lambda name: int(next((x.text for x in start if _local(x) == name), 0)) if start is not None else 0  # noqa: E731, B023
                found.append(Picture(len(found), number("row"), number("col"), self.zip.read(target)))
        return found


def visible_sheets(data: bytes) -> list[Sheet]:
    """The visible sheets of a workbook, in order."""
    book = _Book(data)
    return [book.sheet(name, part) for name, state, part in book.sheets if state == "visible" and part in book.names]
