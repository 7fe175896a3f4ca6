"""Sheets to Markdown: cleaning, typing, rendering and the tables of sheets and pictures that come of it."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregrid.functions import text as X
from loregrid.sources.workbooks import Picture, Sheet, visible_sheets

EMPTY = "*(空表)*"
#: What a formatter is given at once.
FORMAT_CHARS = 100_000
#: Words in a sheet's name that settle its type, in the order in which types are tried.
NAMED = (
    ("version_log", "版本 更新 变更 changelog version log 记录"),
    ("config_table", "配置 config 参数 parameter setting 设置"),
    ("enum_table", "枚举 enum 常量 const 类型 type 定义"),
)
TABLES = ("data_table", "config_table", "enum_table")
SHEETS = "source string, sheet_index int, name string, type string, content string, markdown string, row_count int, estimated_tokens int, images array<struct<index:int,row:int,col:int,data:binary>>, error string"

Merge = tuple[int, int, int, int]
Rows, Places = list[list[str]], list[int]


def clean(rows: Rows) -> tuple[Rows, Places, Places]:
    """(rows, columns kept, rows kept): without empty columns, with at most one blank row in a run, none at either end."""
    width = max(map(len, rows), default=0)
    cols = [c for c in range(width) if any(c < len(r) and r[c] for r in rows)]
    full = [i for i, r in enumerate(rows) if any(r)]
    if not full:
        return [], cols, []
    kept = [i for i in range(full[0], full[-1] + 1) if any(rows[i]) or any(rows[i - 1])]
    return [[rows[i][c] if c < len(rows[i]) else "" for c in cols] for i in kept], cols, kept


def moved_merges(merges: list[Merge], cols: Places, rows: Places) -> list[Merge]:
    """Merged ranges in the places of what was kept; those without any of it are gone."""
    col_at, row_at = {c: i for i, c in enumerate(cols)}, {r: i for i, r in enumerate(rows)}
    out = []
    for top, left, bottom, right in merges:
        r = [row_at[i] for i in range(top, bottom + 1) if i in row_at]
        c = [col_at[j] for j in range(left, right + 1) if j in col_at]
        if r and c:
            out.append((r[0], c[0], r[-1], c[-1]))
    return out


def collapsed(index: int, row: list[str], merges: list[Merge]) -> list[str]:
    """A row with each range that is merged across columns given once."""
    until = {}
    for top, left, bottom, right in merges:
        if top <= index <= bottom and right > left:
            until[left] = max(right, until.get(left, left))
    out, at = [], 0
    while at < len(row):
        out.append(row[at])
        at = until.get(at, at) + 1
    return out


def is_number(s: str) -> bool:
    try:
        float(s.strip().translate({ord(c): None for c in ",%¥$"}))
    except ValueError:
        return False
    return True


def sheet_type(name: str, rows: Rows) -> str:
    """By the name, else by the shape of cleaned rows."""
    for kind, words in NAMED:
        if any(w in name.lower() for w in words.split()):
            return kind
    filled = [[c for c in r if c] for r in rows if any(r)]
    if not filled:
        return "document"
    total, width = len(filled), max(map(len, rows))
    if width <= 3 and total >= 3 and sum(bool(r[0]) and not is_number(r[0]) for r in rows if r) > 0.7 * total:
        return "config_table"
    body = list(filter(any, rows[1:]))
    head = [c for c in rows[0] if c]
    if width >= 2 and total >= 3 and body and head and not any(map(is_number, head)) and sum(is_number(r[0]) for r in body) > 0.7 * len(body):
        return "enum_table"
    if sum(sum(map(is_number, r)) > len(r) / 2 for r in filled) > 0.4 * total:
        return "data_table"
    sizes = [len(r) for r in filled]
    if sum(sizes) <= 3 * total:
        return "document"
    common = Counter(sizes)
    size, times = max(common.items(), key=lambda x: (x[1], -x[0]))
    return "data_table" if times > total / 2 and size >= 3 else "document"


def picture_marks(rows: Rows, kept: Places, pictures: list[Picture], name: str) -> dict[int, list[str]]:
    """Marks to be placed behind cleaned rows: the last filled one at or above a picture's anchor, or -1 if all are below."""
    marks: dict[int, list[str]] = {}
    for p in sorted(pictures, key=lambda p: (p.row, p.index)) if kept else []:
        above = [i for i, r in enumerate(rows) if kept[i] <= p.row and any(r)]
        marks.setdefault(above[-1] if above else -1, []).append("{{IMG:%s:%d}}" % (name, p.index))
    return marks


def as_table(rows: Rows, merges: list[Merge], marks: dict[int, list[str]]) -> str:
    """A Markdown table; the first filled row is its head."""
    lines = [(i, collapsed(i, r, merges)) for i, r in enumerate(rows) if any(r)]
    width = max((len(r) for _, r in lines), default=0)
    if not width:
        return ""
    draw = lambda cells: f"| {' | '.join(cells)} |"
    out = list(marks.get(-1, []))
    for n, (i, r) in enumerate(lines):
        out.append(draw(r + [""] * (width - len(r))))
        if n == 0:
            out.append(draw(["---"] * width))
        out += marks.get(i, [])
    return "\n".join(out)


def as_outline(rows: Rows, cols: Places, merges: list[Merge], marks: dict[int, list[str]]) -> str:
    """Lines indented by how far to the right their first cell stands, among the columns in use."""
    used = sorted({cols[i] for r in rows for i, c in enumerate(r) if c})
    if not used:
        return ""
    out = list(marks.get(-1, []))
    for i, r in enumerate(rows):
        if any(r):
            depth = used.index(next(cols[j] for j, c in enumerate(r) if c))
            out += ["  " * depth + " | ".join(c for c in collapsed(i, r, merges) if c), *marks.get(i, [])]
        elif out and out[-1]:
            out.append("")
    return "\n".join(out)


def as_markdown(name: str, kind: str, content: str) -> str:
    """A sheet's Markdown: a heading and its table, its log, or its outline as headings and list items."""
    out = [f"## {name}\n"]
    if kind in TABLES:
        return "\n".join([*out, content])
    if kind == "version_log":
        return "\n".join([*out, "*版本记录*\n", content])
    for line in content.split("\n"):
        inner = line.lstrip()
        depth = (len(line) - len(inner)) // 2
        if not inner:
            out.append("")
        elif depth:
            out.append("  " * (depth - 1) + "- " + inner)
        else:
            out.append(inner if inner[0] in "·-" or inner[0].isdigit() else f"### {inner}")
    return "\n".join(out)


def processed(sheet: Sheet) -> dict:
    pictures = [{"index": p.index, "row": p.row, "col": p.col, "data": p.data} for p in sheet.pictures]
    if not any(any(r) for r in sheet.rows):
        return {"name": sheet.name, "type": "document", "content": EMPTY, "markdown": as_markdown(sheet.name, "document", EMPTY), "row_count": 0, "estimated_tokens": 5, "images": pictures}
    rows, cols, kept = clean(sheet.rows)
    merges = moved_merges(sheet.merges, cols, kept)
    kind = sheet_type(sheet.name, rows)
    marks = picture_marks(rows, kept, sheet.pictures, sheet.name)
    content = as_table(rows, merges, marks) if kind in TABLES else as_outline(rows, cols, merges, marks)
    return {"name": sheet.name, "type": kind, "content": content, "markdown": as_markdown(sheet.name, kind, content), "row_count": sum(map(any, rows)), "estimated_tokens": len(content) // 2, "images": pictures}


def sheets(files: DataFrame, source: str = "source", content: str = "content") -> DataFrame:
    """One row for each visible sheet of each workbook (binary content); a workbook that can't be read has one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SHEETS.split(", ")]
        blank = dict.fromkeys(names)
        for frame in frames:
            for path, data in zip(frame[source], frame[content]):
                try:
                    rows = [{**blank, "source": path, "sheet_index": i, **processed(s)} for i, s in enumerate(visible_sheets(bytes(data)))]
                except Exception as error:  # whatever a broken file brings about is told in its row
                    rows = [{**blank, "source": path, "error": f"{type(error).__name__}: {error}"}]
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("sheet_index", "row_count", "estimated_tokens")})

    return files.select(source, content).mapInPandas(run, SHEETS)


def split_content(content: str, most: int = FORMAT_CHARS) -> list[str]:
    """Pieces of at most `most` characters, cut between paragraphs, then between lines where a paragraph is longer."""
    out: list[str] = []
    for sep, pieces in (("\n\n", [content]), ("\n", None)):
        pieces, out = (out if pieces is None else pieces), []
        for piece in pieces:
            held = ""
            for part in piece.split(sep) if len(piece) > most else [piece]:
                if held and len(held) + len(sep) + len(part) > most:
                    out.append(held)
                    held = part
                else:
                    held = f"{held}{sep}{part}" if held else part
            out.append(held)
    return out


def formatted(sheet_rows: DataFrame, formatter: Callable[[str, str, str], str], waits: tuple[float, ...] = (5, 10, 15), most: int = FORMAT_CHARS) -> DataFrame:
    """sheet_rows with Markdown by a model: formatter(name, type, piece of content). A call that fails is made again after each wait but the last; a PermissionError isn't. A sheet for which it fails keeps what the rules made of it."""

    def call(name: str, kind: str, piece: str) -> str:
        for n, wait in enumerate(waits):
            try:
                return formatter(name, kind, piece)
            except PermissionError:
                raise
            except Exception:
                if n == len(waits) - 1:
                    raise
                time.sleep(wait)
        raise ValueError("there has to be a wait for each call")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for name, kind, content, old in zip(frame["name"], frame["type"], frame["content"], frame["markdown"]):
                try:
                    made.append(old if content is None or content == EMPTY else "\n\n".join(call(name, kind, piece) for piece in split_content(content, most)))
                except Exception:
                    made.append(old)
            yield frame.assign(markdown=made)

    return sheet_rows.mapInPandas(run, SHEETS)


def image_path(source, name, index, data):
    """Where a sheet's picture goes, relative to the Markdown file."""
    return F.concat(F.lit("images/"), X.safe_name(name), F.lit("_"), index.cast("string"), F.lit("."), X.image_kind(data))


def images(sheet_rows: DataFrame) -> DataFrame:
    """(source, sheet, index, row, col, path, data) of all pictures."""
    one = sheet_rows.where("error IS NULL").select("source", F.col("name").alias("sheet"), F.explode("images").alias("i"))
    return one.select("source", "sheet", "i.index", "i.row", "i.col", image_path(F.col("source"), F.col("sheet"), F.col("i.index"), F.col("i.data")).alias("path"), "i.data")


def converted(sheet_rows: DataFrame) -> DataFrame:
    """(source, target, text): one Markdown document for each workbook, its sheets in order and its picture marks replaced by links."""
    good = sheet_rows.where("error IS NULL")
    mark = lambda i: F.concat(F.lit("{{IMG:"), F.col("name"), F.lit(":"), i["index"].cast("string"), F.lit("}}"))
    link = lambda i: F.concat(F.lit("!["), F.col("name"), F.lit("]("), image_path(F.col("source"), F.col("name"), i["index"], i["data"]), F.lit(")"))
    body = F.aggregate("images", F.col("markdown"), lambda s, i: F.replace(s, mark(i), link(i)))
    parts = good.select("source", F.struct("sheet_index", body.alias("body")).alias("p")).groupBy("source").agg(F.sort_array(F.collect_list("p")).alias("p"))
    title = F.concat(F.lit("# "), X.stem(F.col("source")), F.lit("\n\n"))
    return parts.select("source", X.converted_path(F.col("source")).alias("target"), F.concat(title, F.array_join(F.col("p.body"), "\n\n")).alias("text"))
