"""Exports that are one file, written by many tasks: spreadsheets (Office Open XML) and comma-separated text.

    spark.dataSource.register(Sheets)
    rows.write.format("sheets").mode("append").save("/exports/july.xlsx")
    spark.read.format("sheets").schema("ID string, Total double").load("/exports/july.xlsx")

Each task writes its rows as parts, at most ``PART_ROWS`` rows a part, next to the target under a name of the write's own; the
commit strings the parts together in the order of the partitions, block by block, under a temporary name (a sheet's are deflated where they are written), and renames
the file: a reader sees all of it or nothing, and a part that a lost task left is not named by anyone.

A sheet holds 1,048,576 rows at most; further rows go to further sheets. Rows whose first cell is ``TOTAL`` are set in bold
on a grey ground, as the headings are in white on blue. Numbers are numbers; days are texts; nothing is an empty cell.
"""

from __future__ import annotations

import csv
import datetime
import decimal
import io
import re
import uuid
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, LongType, StructType

from tallyspark.sources.page_files import open_fs

PART_ROWS = 100_000
SHEET_ROWS = 1 << 20
BLOCK = 1 << 20
# ---- fixed values: the parts of the container -----------------------------------------------------
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
HEADING_GROUND, TOTALS_GROUND = "FF1F4E78", "FFE4E9E3"
# ---------------------------------------------------------------------------------------------------
_BAD = re.compile("[^\\t\\n\\r\\x20-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]")  # what no XML document may hold
HEADING, TOTALS = 1, 2


def cell(value: object, style: int = 0) -> str:
    s = f' s="{style}"' if style else ""
    if value is None:
        return f"<c{s}/>"
    if isinstance(value, bool):
        return f'<c{s} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, decimal.Decimal)) and value == value and abs(value) != float("inf"):
        return f"<c{s}><v>{value!r}</v></c>" if not isinstance(value, decimal.Decimal) else f"<c{s}><v>{value}</v></c>"
    text = value.isoformat(" ") if isinstance(value, datetime.datetime) else value.isoformat() if isinstance(value, datetime.date) else str(value)
    return f'<c{s} t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("\ufffd", text))}</t></is></c>'


def row_xml(values: tuple, style: int | None = None) -> bytes:
    if style is None:
        style = TOTALS if values and values[0] == "TOTAL" else 0
    return f"<row>{''.join(cell(v, style) for v in values)}</row>".encode()


@dataclass
class Part:
    """A part's file and what is in it: rows; for packed ones the bytes before and after, and their checksum."""

    name: str
    rows: int = 0
    plain: int = 0
    packed: int = 0
    crc: int = 0


class Packer:
    """A piece of a deflate stream that others may follow: it ends on a whole byte and refers to nothing before it."""

    def __init__(self, out: BinaryIO, part: Part):
        self.out, self.part, self.z = out, part, zlib.compressobj(wbits=-15)

    def _put(self, packed: bytes) -> None:
        self.part.packed += len(packed)
        self.out.write(packed)

    def write(self, plain: bytes) -> None:
        self.part.plain += len(plain)
        self.part.crc = zlib.crc32(plain, self.part.crc)
        self._put(self.z.compress(plain))

    def close(self, last: bool = False) -> None:
        self._put(self.z.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH))
        self.out.close()


def _packed(plain: bytes, last: bool = False) -> tuple[Part, bytes]:
    part, z = Part("", 0, len(plain), 0, zlib.crc32(plain)), zlib.compressobj(wbits=-15)
    packed = z.compress(plain) + z.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)
    part.packed = len(packed)
    return part, packed


def crc_of_both(first: int, second: int, size: int) -> int:
    """The checksum of two texts in a row by theirs and the second's size: size zero bytes shift the first, by squares of a matrix of bits."""

    def times(m: list[int], v: int) -> int:
        out = 0
        for row in m:
            if v & 1:
                out ^= row
            v >>= 1
        return out

    shift = [0xEDB88320, *(1 << k for k in range(31))]  # a bit
    for _ in range(3):
        shift = [times(shift, row) for row in shift]
    while size:
        if size & 1:
            first = times(shift, first)
        shift, size = [times(shift, row) for row in shift], size >> 1
    return first ^ second


@dataclass
class Written(WriterCommitMessage):
    partition: int
    parts: list[Part]


def _styles() -> str:
    fill = lambda rgb: f'<fill><patternFill patternType="solid"><fgColor rgb="{rgb}"/></patternFill></fill>'
    return (
        f'{HEAD}<styleSheet xmlns="{MAIN}"><fonts count="3"><font/><font><b/><color rgb="FFFFFFFF"/></font><font><b/></font></fonts>'
        f'<fills count="4"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fill(HEADING_GROUND)}{fill(TOTALS_GROUND)}</fills>'
        '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        '<cellXfs count="3"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/><xf fontId="2" fillId="3" applyFont="1" applyFill="1"/></cellXfs></styleSheet>'
    )


class PartWriter(DataSourceWriter):
    """Tasks write parts; a subclass says how a row looks and how the parts become the file."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.names, self.options = options["path"], schema.fieldNames(), dict(options)
        self.write_id = uuid.uuid4().hex
        self.sheet_rows = min(SHEET_ROWS, int(options.get("sheet_rows", SHEET_ROWS)))
        self.part_rows = min(PART_ROWS, self.sheet_rows - 1)

    def row(self, values: tuple) -> bytes:
        raise NotImplementedError

    def opened(self, out: BinaryIO, part: Part) -> BinaryIO | Packer:
        return out

    def assemble(self, files: fs.FileSystem, whole: str, messages: list[Written]) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator) -> Written:
        files, path = open_fs(self.path)
        partition = TaskContext.get().partitionId()
        parts: list[Part] = []
        out = None
        for row in iterator:
            if out is None:
                # a task that is tried again writes under another name
                parts.append(Part(f"{path}.{self.write_id}.{partition}.{len(parts)}.{uuid.uuid4().hex}"))
                out = self.opened(files.open_output_stream(parts[-1].name), parts[-1])
            out.write(self.row(tuple(row)))
            parts[-1].rows += 1
            if parts[-1].rows == self.part_rows:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(partition, parts)

    def commit(self, messages: list[Written | None]) -> None:
        files, path = open_fs(self.path)
        done = sorted((m for m in messages if m), key=lambda m: m.partition)
        whole = f"{path}.{self.write_id}.whole"
        self.assemble(files, whole, done)
        files.move(whole, path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = open_fs(self.path)
        for m in messages:
            for part in m.parts if m else ():
                files.delete_file(part.name)


def copy(files: fs.FileSystem, part: str, out: BinaryIO) -> None:
    with files.open_input_stream(part) as stream:
        while block := stream.read(BLOCK):
            out.write(block)


class CsvWriter(PartWriter):
    """Comma-separated text with headings; option ``bom``: with the mark by which spreadsheets know UTF-8."""

    def row(self, values: tuple) -> bytes:
        line = io.StringIO()
        csv.writer(line, lineterminator="\n").writerow(["" if v is None else v for v in values])
        return line.getvalue().encode()

    def assemble(self, files: fs.FileSystem, whole: str, messages: list[Written]) -> None:
        with files.open_output_stream(whole) as out:
            out.write((b"\xef\xbb\xbf" if self.options.get("bom") == "true" else b"") + self.row(tuple(self.names)))
            for m in messages:
                for part in m.parts:
                    copy(files, part.name, out)


class CsvFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csv_file"

    def writer(self, schema: StructType, overwrite: bool) -> CsvWriter:
        return CsvWriter(self.options, schema)


class SheetWriter(PartWriter):
    def row(self, values: tuple) -> bytes:
        return row_xml(values)

    def opened(self, out: BinaryIO, part: Part) -> Packer:
        return Packer(out, part)

    def _sheets(self, messages: list[Written]) -> list[list[Part]]:
        sheets: list[list[Part]] = [[]]
        room = self.sheet_rows - 1
        for m in messages:
            for part in m.parts:
                if part.rows > room:
                    sheets.append([])
                    room = self.sheet_rows - 1
                sheets[-1].append(part)
                room -= part.rows
        return sheets

    def assemble(self, files: fs.FileSystem, whole: str, messages: list[Written]) -> None:
        sheets, name = self._sheets(messages), self.options.get("sheet", "Invoices")
        ids = range(1, len(sheets) + 1)
        title = lambda i: escape(name if i == 1 else f"{name} {i}", {'"': "&quot;"})
        texts = {
            "[Content_Types].xml": f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{TYPE}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{TYPE}.styles+xml"/>{"".join(f"""<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{TYPE}.worksheet+xml"/>""" for i in ids)}</Types>',
            "_rels/.rels": f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{"".join(f"""<sheet name="{title(i)}" sheetId="{i}" r:id="rId{i}"/>""" for i in ids)}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">{"".join(f"""<Relationship Id="rId{i}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>""" for i in ids)}<Relationship Id="rId{len(sheets) + 1}" Type="{OFFICE}/styles" Target="styles.xml"/></Relationships>',
            "xl/styles.xml": _styles(),
        }
        with files.open_output_stream(whole) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for member, text in texts.items():
                z.writestr(member, text)
            for i, parts in zip(ids, sheets, strict=True):
                head, begin = _packed(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>'.encode() + row_xml(tuple(self.names), HEADING))
                foot, end = _packed(b"</sheetData></worksheet>", last=True)
                # sizes and checksum are known from the parts, so packed bytes go in as they are
                info = zipfile.ZipInfo(f"xl/worksheets/sheet{i}.xml")
                info.compress_type, info.header_offset = zipfile.ZIP_DEFLATED, z.fp.tell()
                for p in (head, *parts, foot):
                    info.CRC = crc_of_both(info.CRC, p.crc, p.plain) if p is not head else p.crc
                    info.file_size += p.plain
                    info.compress_size += p.packed
                z.fp.write(info.FileHeader())
                z.fp.write(begin)
                for part in parts:
                    copy(files, part.name, z.fp)
                z.fp.write(end)
                z.filelist.append(info)
                z.NameToInfo[info.filename] = info
                z.start_dir = z.fp.tell()


class SheetPart(InputPartition):
    def __init__(self, name: str):
        self.name = name


class SheetReader(DataSourceReader):
    """A task for each sheet, which streams its rows; columns are found by the headings in the first row."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.fields = options["path"], schema.fields

    def partitions(self) -> list[SheetPart]:
        files, path = open_fs(self.path)
        with files.open_input_file(path) as raw, zipfile.ZipFile(raw) as z:
            return [SheetPart(n) for n in sorted(z.namelist()) if n.startswith("xl/worksheets/")]

    def read(self, partition: SheetPart) -> Iterator[tuple]:
        files, path = open_fs(self.path)
        tag = lambda x: f"{{{MAIN}}}{x}"
        places: list[int] | None = None
        with files.open_input_file(path) as raw, zipfile.ZipFile(raw) as z, z.open(partition.name) as sheet:
            for _, row in ET.iterparse(sheet):
                if row.tag != tag("row"):
                    continue
                values = [c.findtext(f"{tag('is')}/{tag('t')}") if c.get("t") == "inlineStr" else c.findtext(tag("v")) for c in row]
                row.clear()
                if places is None:
                    places = [values.index(f.name) for f in self.fields]
                    continue
                yield tuple(self._typed(values[p], f.dataType) for p, f in zip(places, self.fields, strict=True))

    @staticmethod
    def _typed(value: str | None, kind: object) -> object:
        if value is None or value == "" and isinstance(kind, (DoubleType, LongType)):
            return None
        return float(value) if isinstance(kind, DoubleType) else int(value) if isinstance(kind, LongType) else value


class Sheets(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheets"

    def reader(self, schema: StructType) -> SheetReader:
        return SheetReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(self.options, schema)
