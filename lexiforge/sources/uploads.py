"""Readers of uploaded files: gate, checks, encodings, and text out of the accepted formats."""

from __future__ import annotations

import csv
import io
import os
import re
import tomllib
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from pathlib import Path
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upload limits, extensions with their MIME types, magic numbers, and image types.
MAX_BYTES = 20 * 1024 * 1024
MIME = {
    "pdf": ("application/pdf",), "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",),
    "pptx": ("application/vnd.openxmlformats-officedocument.presentationml.presentation",), "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",),
    "md": ("text/markdown", "text/plain"), "html": ("text/html",), "htm": ("text/html",), "csv": ("text/csv", "text/plain", "application/vnd.ms-excel"),
}
MAGIC = {"pdf": "255044462D", "docx": "504B0304", "pptx": "504B0304", "xlsx": "504B0304"}
IMAGES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif"}
BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
#: Double-byte codes with their family and the lead bytes of their common characters.
ZONES = {"gb18030": ("chinese", 0xB0, 0xD7), "big5": ("chinese", 0xA4, 0xC6), "euc_kr": ("korean", 0xB0, 0xC8), "euc_jp": ("japanese", 0xA4, 0xCF), "shift_jis": ("japanese", 0x82, 0x97)}
MARK_LEADS = {"gb18030": (0xA1, 0xA3), "big5": (0xA1, 0xA2), "euc_kr": (0xA1, 0xA3), "euc_jp": (0xA1, 0xA3), "shift_jis": (0x81,)}
MARKS = "，。！？、；：（）“”《》「」『』・ー〜…—　"
MIN_WIDE, SURE = 50, 0.95
#: Items of parsed files, and their characters, that go back to Spark at once.
ITEMS, ITEM_CHARS = 4096, 1 << 20
#: Least share of characters whose last byte is above ASCII: accented capitals of a single-byte code mostly
#: stand before an ASCII letter.  Common characters of GB never end in one, of Big5 two in five do.
HIGH_TRAILS = {"gb18030": SURE, "big5": 0.25}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def basename(name: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(name, r"\\", "/"), r"([^/]*)$", 1)


def gate(name: Column, mime: Column) -> Column:
    """ok, or why an upload is refused by its name and MIME type."""
    ext = extension(basename(name))
    plausible = F.lit(False)
    for e, types in MIME.items():
        plausible = plausible | ((ext == e) & mime.isin(*types))
    open_type = mime.isNull() | mime.isin("", "application/octet-stream")
    return F.when(basename(name) == "", "bad_name").when(~ext.isin(*MIME), "bad_extension").when(~(open_type | plausible), "bad_mime").otherwise("ok")


def check(ext: Column, content: Column) -> Column:
    """ok, or why the bytes are refused: empty, too_large or bad_magic."""
    magic = F.lit(True)
    for e, m in MAGIC.items():
        magic = magic & ((ext != e) | F.startswith(F.hex(F.substring(content, 1, 8)), F.lit(m)))
    n = F.octet_length(content)
    return F.when(n == 0, "empty").when(n > MAX_BYTES, "too_large").when(~magic, "bad_magic").otherwise("ok")


def _zone_family(text: str, codec: str) -> bool:
    """Whether the characters of two bytes or more lie in the part of their code that common text uses."""
    name, low, high = ZONES[codec]
    inside = total = trails = 0
    for c, n in Counter(text).items():
        if ord(c) > 127:
            raw = c.encode(codec)
            total += n
            trails += n * (raw[-1] > 127)
            inside += n * (len(raw) == 2 and (low <= raw[0] <= high or raw[0] in MARK_LEADS[codec]))
    return total >= MIN_WIDE and inside >= SURE * total and trails >= HIGH_TRAILS.get(codec, 0) * total


def _script_family(text: str) -> str | None:
    """The family that the scripts of the decoded text speak for."""
    wide = Counter(c for c in text if ord(c) > 127)
    total = wide.total()
    if total < MIN_WIDE:
        return None
    share = lambda low, high: sum(n for c, n in wide.items() if low <= c <= high) / total
    marks = sum(n for c, n in wide.items() if c in MARKS) / total
    han, kana, hangul = share("\u4e00", "\u9fff"), share("\u3040", "\u30ff"), share("\uac00", "\ud7a3")
    if hangul + marks >= SURE:
        return "korean"
    if kana >= 0.2 and kana + han + marks >= SURE:
        return "japanese"
    return "chinese" if han + marks >= SURE else None


def sniff(raw: bytes) -> str | None:
    """A BOM's encoding, utf-8 where it decodes, else the double-byte code on which two tests agree:
    where its bytes lie in the code, and which scripts the decoded text is in.  None is a refusal:
    for too little text, for single-byte codes, which decode to other letters without a trace, and
    where two codes pass."""
    for bom, name in BOMS:
        if raw.startswith(bom):
            return name
    try:
        raw.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    agreed: dict[str, str] = {}
    for codec, (family, _, _) in ZONES.items():
        try:
            text = raw.decode(codec)
        except UnicodeDecodeError:
            continue
        if _script_family(text) == family and _zone_family(text, codec):
            agreed.setdefault(family, codec)
    if "korean" in agreed and agreed.get("chinese") == "gb18030":
        del agreed["chinese"]  # Hangul is in the first half of GB's zone, where Chinese text does not stay
    return next(iter(agreed.values())) if len(agreed) == 1 else None


def transcode(raw: bytes | None) -> str | None:
    """The text of the bytes without a BOM; null for null and where the encoding is refused."""
    name = None if raw is None else sniff(raw)
    return None if name is None else raw.decode(name).removeprefix("\ufeff")


def transcoded(files: DataFrame) -> DataFrame:
    """files (document_id, content binary) to (document_id, encoding, text), by file in Arrow batches."""
    key = files.schema["document_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = b.column("content").to_pylist()
            found = [None if r is None else sniff(r) for r in raws]
            texts = [None if e is None else r.decode(e).removeprefix("\ufeff") for r, e in zip(raws, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("document_id"), pa.array(found, pa.string()), pa.array(texts, pa.string())], ["document_id", "encoding", "text"])

    return files.select("document_id", "content").mapInArrow(run, f"document_id {key}, encoding string, text string")


#: The XML names of office files.
WORD = {"w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main"}
SHEET = {"s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
SLIDE = {"a": "http://schemas.openxmlformats.org/drawingml/2006/main", "p": "http://schemas.openxmlformats.org/presentationml/2006/main"}


def docx_units(raw: bytes) -> list[tuple[str, int, str]]:
    """(text, page, tag) of each body child; none without a body.

    A child that asks for a page break before it is on the new page; page breaks inside it count
    once, for what comes after."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        children = ElementTree.fromstring(z.read("word/document.xml")).findall("w:body/*", WORD)
    kind = f"{{{WORD['w']}}}type"
    turned = [c.find(".//w:pageBreakBefore", WORD) is not None for c in children]
    ended = [any(b.get(kind) == "page" for b in c.iterfind(".//w:br", WORD)) for c in children]
    pages = 1 + np.cumsum(turned, dtype=int) + np.cumsum([0, *ended[:-1]] if ended else [], dtype=int)
    texts = ["".join(t.text or "" for t in c.iterfind(".//w:t", WORD)).strip() for c in children]
    return [(text, int(page), c.tag.rpartition("}")[2]) for text, page, c in zip(texts, pages, children, strict=True)]


def xlsx_items(raw: bytes) -> list[tuple[str, int | None, str]]:
    """A heading for each sheet and a table line for each row below the first: header: cell."""
    items: list[tuple[str, int | None, str]] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        xml = lambda name: ElementTree.fromstring(z.read(name))
        words = [" ".join("".join(t.text or "" for t in si.iterfind(".//s:t", SHEET)).split()) for si in xml("xl/sharedStrings.xml").iterfind("s:si", SHEET)] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in xml("xl/_rels/workbook.xml.rels")}
        for sheet in xml("xl/workbook.xml").iterfind("s:sheets/s:sheet", SHEET):
            items.append(("heading", 1, sheet.get("name") or ""))
            rows = []
            for row in xml(f"xl/{targets[sheet.get(f'{{{SHEET['r']}}}id')]}").iterfind("s:sheetData/s:row", SHEET):
                cells: dict[int, str] = {}
                for place, c in enumerate(row.iterfind("s:c", SHEET)):
                    letters = re.match(r"[A-Z]*", c.get("r") or "")[0]
                    column = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else place
                    value = "".join(t.text or "" for t in c.iter() if t.tag.endswith(("}v", "}t")))
                    cells[column] = words[int(value)] if c.get("t") == "s" and value else value
                rows.append(cells)
            head = rows[0] if rows else {}
            items += [("table", None, " | ".join(f"{head.get(k, f'col{k + 1}')}: {v}" for k, v in sorted(r.items()) if v.strip())) for r in rows[1:] if any(v.strip() for v in r.values())]
    return items


def pptx_items(raw: bytes) -> list[tuple[str, int | None, str]]:
    """Of each slide in order, its title as a heading, paragraphs, and table rows."""
    items: list[tuple[str, int | None, str]] = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for _, name in slides:
            root = ElementTree.fromstring(z.read(name))
            for shape in root.iterfind(".//p:sp", SLIDE):
                place = shape.find(".//p:nvPr/p:ph", SLIDE)
                title = place is not None and place.get("type") in ("title", "ctrTitle")
                for para in shape.iterfind(".//a:p", SLIDE):
                    text = " ".join("".join(t.text or "" for t in para.iterfind(".//a:t", SLIDE)).split())
                    if text:
                        items.append(("heading", 1, text) if title else ("paragraph", None, text))
            for table in root.iterfind(".//a:tbl", SLIDE):
                rows = [[" ".join("".join(t.text or "" for t in c.iterfind(".//a:t", SLIDE)).split()) for c in r.iterfind("a:tc", SLIDE)] for r in table.iterfind("a:tr", SLIDE)]
                items += [("table", None, " | ".join(f"{h}: {c}" for h, c in zip(rows[0], r, strict=False) if c)) for r in rows[1:]]
    return items


_PDF_TEXT = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|\bT[jJdD*]|\bTm|['\"]|\bET\b", re.S)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_items(raw: bytes) -> list[tuple[str, int | None, str]]:
    """The lines of text that a PDF's plain or deflated content streams show, in stream order.

    Strings count as Latin-1 or, with a BOM, UTF-16; fonts with their own codes are not mapped, and
    layout, tables and formulas are not recognised."""
    items: list[tuple[str, int | None, str]] = []

    def shown(token: bytes) -> str:
        if token.startswith(b"<"):
            digits = re.sub(rb"\s", b"", token[1:-1])
            body = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        else:
            octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1] in b"\r\n" else _PDF_ESCAPES.get(m[1], m[1])
            body = re.sub(rb"\\([0-7]{1,3}|.)", octal, token[1:-1], flags=re.S)
        return body[2:].decode("utf-16-be", "replace") if body.startswith(b"\xfe\xff") else body.decode("latin-1")

    for m in re.finditer(rb"<<(?P<head>(?:(?!endobj).)*?)>>\s*stream\r?\n(?P<body>.*?)\r?\n?endstream", raw, re.S):
        body = m["body"]
        if b"FlateDecode" in m["head"]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        for part in re.findall(rb"\bBT\b(.*?\bET\b)", body, re.S):
            held, line = [], ""
            for token in _PDF_TEXT.findall(part):
                if token[:1] in b"(<":
                    held.append(shown(token))
                elif token in (b"Tj", b"TJ"):
                    line, held = line + "".join(held), []
                else:
                    if " ".join(line.split()):
                        items.append(("paragraph", None, " ".join(line.split())))
                    line, held = "".join(held) if token in (b"'", b'"') else "", []
    return items


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[tuple[str, int | None, str]] = []
        self.kind: tuple[str, int | None] = ("paragraph", None)
        self.text: list[str] = []
        self.skip = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.items.append((*self.kind, text))
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "head"):
            self.skip += 1
        elif re.fullmatch(r"h[1-6]|p|li|td|th|div|tr|caption|br|article|nav|footer|section|ul|ol|table", tag):
            self.flush()
            level = int(tag[1]) if re.fullmatch(r"h[1-6]", tag) else None
            self.kind = ("heading", level) if level else ("list_item" if tag == "li" else "caption" if tag == "caption" else "paragraph", None)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head"):
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch(r"h[1-6]|p|li|td|th|div|tr|caption", tag):
            self.flush()
            self.kind = ("paragraph", None)

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)


BINARY = {"docx": lambda raw: [("paragraph", None, t) for t, _, _ in docx_units(raw) if t], "xlsx": xlsx_items, "pptx": pptx_items, "pdf": pdf_items}


def parse_file(raw: bytes | None, kind: str) -> list[tuple[str, int | None, str]]:
    """(type, level, text) items of a file of any accepted kind; none of one that can't be read."""
    if raw is None:
        return []
    if kind in BINARY:
        try:
            return BINARY[kind](raw)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError, AttributeError):
            return []
    return parse(transcode(raw) or "", kind)


def parse(text: str, kind: str) -> list[tuple[str, int | None, str]]:
    """(type, level, text) items of an HTML, Markdown or CSV text."""
    if kind in ("html", "htm"):
        p = _Html()
        p.feed(text)
        p.close()
        p.flush()
        return p.items
    if kind == "csv":
        rows = list(csv.reader(io.StringIO(text)))
        head = rows[0] if rows else []
        return [("table", None, " | ".join(f"{h}: {c}" for h, c in zip(head, r, strict=False) if c.strip())) for r in rows[1:]]
    items: list[tuple[str, int | None, str]] = []
    for block in re.split(r"\n\s*\n|\n(?=#{1,6} |[-*] )", text):
        block = block.strip()
        heading = re.match(r"(#{1,6})\s+(.*)", block)
        if heading:
            items.append(("heading", len(heading[1]), heading[2].strip()))
            block = block[heading.end() :].strip()
        if block:
            items.append(("list_item" if re.match(r"[-*] ", block) else "paragraph", None, re.sub(r"^[-*] ", "", block)))
    return items


def parsed(files: DataFrame) -> DataFrame:
    """files (document_id, kind, content string or binary) to (document_id, ordinal, type, level, text)."""
    binary = files.schema["content"].dataType.typeName() == "binary"
    key = files.schema["document_id"].dataType.simpleString()
    names = ["document_id", "ordinal", "type", "level", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            kinds = [b.schema.field("document_id").type, pa.int64(), pa.string(), pa.int32(), pa.string()]
            out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)  # noqa: B023, E731
            size = 0
            for d, kind, content in zip(*(b.column(c) for c in ("document_id", "kind", "content")), strict=True):
                kind, content = kind.as_py(), content.as_py()
                for k, item in enumerate(parse_file(content, kind) if binary else parse(content or "", kind)):
                    rows.append((d.as_py(), k, *item))
                    size += len(item[-1] or "")
                    # An input batch may hold thousands of packed files; their items are not held together.
                    if len(rows) >= ITEMS or size >= ITEM_CHARS:
                        yield out()
                        rows, size = [], 0
            if rows:
                yield out()
                rows = []

    return files.select("document_id", "kind", "content").mapInArrow(run, f"document_id {key}, ordinal long, type string, level int, text string")


def attachment(name: Column) -> Column:
    """A download header's value: the name percent-encoded as UTF-8."""
    quoted = F.regexp_replace(F.url_encode(name), r"\+", "%20")
    for kept, code in (("~", "%7E"), ("/", "%2F")):
        quoted = F.replace(quoted, F.lit(code), F.lit(kept))
    quoted = F.replace(quoted, F.lit("*"), F.lit("%2A"))
    return F.concat(F.lit('attachment; filename="'), quoted, F.lit("\"; filename*=UTF-8''"), quoted)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(name, media_type, length) of a folder's images; content is fetched by name only."""
    files = spark.read.format("binaryFile").load(folder).select(basename(F.col("path")).alias("name"), "length")
    media = F.lit(None).cast("string")
    for e, m in IMAGES.items():
        media = F.when(extension(F.col("name")) == e, m).otherwise(media)
    return files.withColumn("media_type", media).where("media_type is not null")


def model_of(role: Column, config: dict) -> Column:
    """The model of each role by the configuration; the default's for a role that has none."""
    out = F.lit(config["roles"].get("default", "default"))
    for name, model in config["roles"].items():
        out = F.when(role == name, model).otherwise(out)
    return out


def read_config(path: str | Path) -> dict:
    return parse_config(Path(path).read_text())


def parse_config(text: str) -> dict:
    """A TOML text with ${NAME} taken from the environment; a role without a model has the default."""
    config = tomllib.loads(re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), text))
    roles = config.setdefault("roles", {})
    for role in ("chat", "router", "summary"):
        roles.setdefault(role, roles.get("default", "default"))
    return config
