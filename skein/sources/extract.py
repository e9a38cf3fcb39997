"""Text of files: decoding, sniffing, office formats, routing of PDF pages, statuses.

Parsers of formats without plain text run as Arrow UDFs over the bytes; the rest are column expressions. PDF parsing and
character recognition are left to parsers that a caller passes in.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Limits of extraction, and the share of control bytes from which a file isn't text.
SOURCE_BYTES, CHARACTERS, OCR_PAGES, PAGE_CHARS = 100 * 1024 * 1024, 20_000_000, 100, 32
SNIFFED, CONTROL_SHARE = 8192, 0.02
# Fixed value: the version of extraction by file type; types that aren't named have 0.
RECIPES = dict.fromkeys("doc docx docm odt rtf ppt pps pot pptx pptm ppsx ppsm odp xls xlsx xlsm xlsb ods epub pdf".split(), 1)


def looks_binary(content: Column) -> Column:
    """Whether more than a fiftieth of the first 8,192 bytes are control bytes."""
    head = F.decode(F.substring(content, 1, SNIFFED), "ISO-8859-1")
    n = F.length(head)
    bad = F.length(F.translate(head, "".join(map(chr, [*range(0, 9), *range(14, 32)])), "Ā" * 0))
    return (n > 0) & ((n - bad) > CONTROL_SHARE * n)


def decode_text(content: Column) -> Column:
    """UTF-16 by its mark, or by zero bytes where a third of the head are such; UTF-8 where valid; else Latin-1."""
    text = F.decode(content, "UTF-8")
    mark = F.hex(F.substring(content, 1, 2))
    head = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    zeros = 3 * (F.length(head) - F.length(F.replace(head, F.lit("\0"), F.lit("")))) >= F.length(head)
    bare = F.when((F.octet_length(content) > 1) & zeros & (mark.endswith("00") != mark.startswith("00")), F.when(mark.endswith("00"), F.decode(content, "UTF-16LE")).otherwise(F.decode(content, "UTF-16BE")))
    other = F.when(mark.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.when(bare.isNotNull(), bare).when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.coalesce(other, text))


def read_text(spark: SparkSession, root: str, whole: bool = False) -> DataFrame:
    """path, text and availability of the plain texts below a folder. With `whole` files of any size are read, and none is cut."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = rows if whole else rows.filter(F.col("length") <= SOURCE_BYTES)
    binary, text = looks_binary(F.col("content")), decode_text(F.col("content"))
    return rows.select("path", F.when(~binary, text if whole else F.substring(text, 1, CHARACTERS)).alias("text"), F.when(binary, "unsupported").otherwise("available").alias("availability"))


def extraction_status(error: Column, text: Column) -> Column:
    """The availability that an error code and a text come to."""
    return (
        F.when(error == "encrypted", "contentLocked").when(error.isin("resource_limit", "panic"), "extractionFailed")
        .when(error.isNotNull(), "unsupported").when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, "filenameOnly").otherwise("available")
    )


def route_pages(pages: DataFrame) -> DataFrame:
    """pages(doc, page, structured, needs_ocr, viewer, has_ink): the text to take of each page and where it comes from."""
    blank = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) == 0
    good = ~F.col("needs_ocr") & ~blank(F.col("structured"))
    seen = F.length(F.trim(F.coalesce("viewer", F.lit("")))) >= PAGE_CHARS
    ocr = (F.col("page") < OCR_PAGES) & F.col("has_ink")
    route = F.when(good, "structured").when(seen, "viewer").when(ocr, "ocr").otherwise("viewer")
    return pages.withColumn("route", route).withColumn("text", F.when(route == "structured", F.col("structured")).when(route == "viewer", F.col("viewer")))


def page_budget(pages: DataFrame, budget: int) -> DataFrame:
    """pages(doc, page, text) with texts cut where the characters of a document's pages exceed a budget."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pages.withColumn("text", F.substring(F.col("text"), F.lit(1), F.greatest(F.lit(0), F.lit(budget) - before).cast("int")))


def envelope(value: Column, error: Column) -> Column:
    """A result or an error as JSON."""
    return F.to_json(F.struct(error.isNull().alias("ok"), F.when(error.isNull(), value).alias("value"), error.alias("error")))


# --- formats ------------------------------------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_T = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"


def _xml(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name))


def _docx(z: zipfile.ZipFile) -> str:
    def text(e) -> str:
        return "".join(t.text or "" if t.tag == _W + "t" else "\t" if t.tag == _W + "tab" else "\n" if t.tag == _W + "br" else "" for t in e.iter())

    blocks = []
    for e in _xml(z, "word/document.xml").find(_W + "body"):
        if e.tag == _W + "p":
            blocks.append(("- " if e.find(f"{_W}pPr/{_W}numPr") is not None else "") + text(e))
        elif e.tag == _W + "tbl":
            blocks += ["\t".join(text(c) for c in row.iter(_W + "tc")) for row in e.iter(_W + "tr")]
    for notes in ("word/footnotes.xml", "word/endnotes.xml"):
        if notes in z.namelist():
            blocks += [text(p) for p in _xml(z, notes).iter(_W + "p")]
    return "\n\n".join(b for b in blocks if b.strip(" -"))


def _pptx(z: zipfile.ZipFile) -> str:
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    return "\n\n".join("\n".join("".join(t.text or "" for t in p.iter(_A + "t")) for p in _xml(z, n).iter(_A + "p")) for n in slides)


def _xlsx(z: zipfile.ZipFile) -> str:
    shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in _xml(z, "xl/sharedStrings.xml").iter(_S + "si")] if "xl/sharedStrings.xml" in z.namelist() else []

    def cell(c) -> str:
        v = c.find(_S + "v")
        if c.get("t") == "s" and v is not None:
            return shared[int(v.text)]
        return v.text or "" if v is not None else "".join(t.text or "" for t in c.iter(_S + "t"))

    sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    return "\n\n".join("\n".join("\t".join(map(cell, row.iter(_S + "c"))) for row in _xml(z, n).iter(_S + "row")) for n in sheets)


def _odf(z: zipfile.ZipFile) -> str:
    blocks, rows = [], set()
    for e in _xml(z, "content.xml").iter():
        if e.tag == _TABLE + "table-row":
            blocks.append("\t".join("".join(c.itertext()) for c in e.iter(_TABLE + "table-cell")))
            rows.update(e.iter())
        elif e.tag in (_T + "p", _T + "h") and e not in rows:
            blocks.append("".join(e.itertext()))
    return "\n\n".join(b for b in blocks if b.strip())


class _Html(HTMLParser):
    """Text of HTML; scripts and styles are left out, blocks end lines. Nothing is fetched."""

    def __init__(self):
        super().__init__()
        self.parts, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style") and self.silent > 0
        if tag in ("p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "title"):
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def html_text(html: str) -> str:
    p = _Html()
    p.feed(html)
    return "\n".join(s for line in "".join(p.parts).split("\n") if (s := " ".join(line.split())))


def _epub(z: zipfile.ZipFile) -> str:
    return "\n\n".join(html_text(z.read(n).decode("utf-8", "replace")) for n in sorted(z.namelist()) if n.endswith((".xhtml", ".html", ".htm")))


def rtf_text(data: bytes) -> str:
    """Text of RTF: control words go, their characters stay, groups that aren't text are skipped."""
    out, skip, stack = [], False, []
    for m in re.finditer(rb"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?\??|\\([a-z]+)(-?\d+)? ?|\\([^a-z])|([{}])|([^\\{}\r\n]+)", data):
        code, uni, word, _, symbol, brace, text = m.groups()
        if brace == b"{":
            stack.append(skip)
        elif brace == b"}":
            skip = stack.pop() if stack else False
        elif symbol == b"*" or word in (b"fonttbl", b"colortbl", b"stylesheet", b"info", b"pict"):
            skip = True
        elif not skip:
            out.append(bytes([int(code, 16)]).decode("cp1252", "replace") if code else chr(int(uni) % 65536) if uni else "\n" if word in (b"par", b"line") else "\t" if word == b"tab" else symbol.decode() if symbol in (b"\\", b"{", b"}") else text.decode("cp1252", "replace") if text else "")
    return "".join(out).strip()


_ZIPPED: dict[str, Callable] = {"docx": _docx, "docm": _docx, "pptx": _pptx, "xlsx": _xlsx, "odt": _odf, "ods": _odf, "odp": _odf, "epub": _epub}


def parse(data: bytes, ext: str) -> tuple[str | None, str | None]:
    """(text, error code) of a structured file."""
    try:
        if ext == "rtf":
            return rtf_text(data)[:CHARACTERS], None
        if ext in ("html", "htm"):
            return html_text(data.decode("utf-8", "replace"))[:CHARACTERS], None
        if ext not in _ZIPPED:
            return None, "unsupported"
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if sum(i.file_size for i in z.infolist()) > 4 * SOURCE_BYTES:
                return None, "resource_limit"
            if any(i.flag_bits & 1 for i in z.infolist()):
                return None, "encrypted"
            return _ZIPPED[ext](z)[:CHARACTERS], None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError, ValueError):
        return None, "malformed"


def extract_structured(files: DataFrame, parser: Callable[[bytes, str], tuple[str | None, str | None]] = parse) -> DataFrame:
    """files(content, extension, ...) with text, error and availability. Files go to Python by the hundred, not in Arrow's batches of thousands."""

    @F.udf("text string, error string", useArrow=False)
    def run(content: bytes | None, ext: str | None) -> tuple[str | None, str | None]:
        return tuple(parser(bytes(content), ext)) if content is not None else (None, "missing")

    x = files.withColumn("_x", run("content", "extension"))
    return x.select(*files.columns, "_x.text", "_x.error", extraction_status(F.col("_x.error"), F.col("_x.text")).alias("availability"))


def ink_ratio(pixels: Column, dark: int = 242) -> Column:
    """The share of grey values below `dark`."""
    return F.coalesce(F.try_divide(F.size(F.filter(pixels, lambda p: p < dark)), F.size(pixels)), F.lit(0.0))


def ink_share(pixel: Column, dark: int = 242) -> Column:
    """The same as an aggregate, for pixels that are rows."""
    return F.coalesce(F.avg((pixel < dark).cast("int")), F.lit(0.0))


def nested_text(rows: DataFrame, document: str, key: str, deepest: int = 64) -> DataFrame:
    """rows with `found`: the value of a key wherever it is first met in JSON documents, as text; null where it isn't met.

    An object's own keys come before what is below them, and that in the keys' order or the list's. Documents are walked as
    variants, a level at a time, as far as any goes; no level needs more than the one above it, and values are picked before
    they are dealt out, one for each row. Text that isn't JSON holds nothing.
    """
    spark, path = rows.sparkSession, "$." + json.dumps(key) if not re.fullmatch(r"\w+", key) else f"$.{key}"
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    level = numbered.select("_row", F.try_parse_json(document).alias("_v"), F.array().cast("array<int>").alias("_at")).filter("_v is not null")
    found = None
    for _ in range(deepest):
        kind = F.schema_of_variant("_v")
        own = F.when(kind.startswith("OBJECT"), F.try_variant_get("_v", path, "string"))
        here = level.withColumn("_found", own)
        hits = here.filter("_found is not null").select("_row", F.struct(F.col("_at").alias("at"), F.col("_found").alias("value")).alias("hit"))
        found = hits if found is None else found.unionByName(hits)
        open_ = here.filter(F.col("_found").isNull() & (kind.startswith("OBJECT") | kind.startswith("ARRAY")))
        if open_.isEmpty():
            break
        below = open_.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        level = below.select("_row", F.col("value").alias("_v"), F.concat("_at", F.array("pos")).alias("_at"))
    first = found.groupBy("_row").agg(F.min("hit").alias("hit"))
    return numbered.join(first, "_row", "left").select(*rows.columns, F.col("hit.value").alias("found"))
