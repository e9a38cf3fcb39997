"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _folding() -> tuple[str, str]:
    """Letters and what is left of them without their marks, as Unicode decomposes them; then the marks themselves, which go."""
    letters, marks = {}, []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
        elif unicodedata.category(c)[0] == "L":
            bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn").lower()
            if bare != c and len(bare) == 1:
                letters[c] = bare
    return "".join(letters) + "".join(marks), "".join(letters.values())


ACCENTED, PLAIN = _folding()
# The forms of full and half width, and the usual ones.
WIDE = "".join(c for c in map(chr, range(0xFF01, 0xFFEF)) if len(unicodedata.normalize("NFKC", c)) == 1 and unicodedata.normalize("NFKC", c) != c) + "\u3000"
NARROW = "".join(unicodedata.normalize("NFKC", c) for c in WIDE)
ESCAPED = "\\`*_[]()#|<>~!"
WORD = r"[\p{L}\p{N}]+"


def fold(text: Column) -> Column:
    """Lower case without accents. Texts that are all ASCII have none to look for."""
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(F.translate(low, ACCENTED, PLAIN))


def fold_width(text: Column) -> Column:
    """Letters, digits and signs of full or half width as usual ones."""
    return F.translate(text, WIDE, NARROW)


def tokens(text: Column) -> Column:
    """The index's terms in order: runs of letters and digits, folded. A null text has none."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def first_words(text: Column, n: int) -> Column:
    """The first n runs of anything but white space, with one blank between them; the text beyond isn't looked at."""
    head = F.regexp_extract(text, rf"^\s*(?:\S++\s++){{0,{n - 1}}}\S*", 0)
    return F.array_join(F.slice(F.regexp_extract_all(head, F.lit(r"\S+"), F.lit(0)), 1, n), " ")


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def filename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(filename(path), r"\.[^.]+$", "")


def canonical_path(path: Column) -> Column:
    """Without doubled slashes, `/./` steps, a slash at the end, or the private alias of var and tmp."""
    out = F.regexp_replace(path, r"/+", "/")
    out = F.regexp_replace(out, r"(/\.)+(/|$)", "$2")
    out = F.regexp_replace(out, r"^/private/(var|tmp)(/|$)", "/$1$2")
    return F.when(F.length(out) > 1, F.regexp_replace(out, r"/$", "")).otherwise(out)


def excerpt(body: Column, terms: list[str], size: int = 500, before: int = 100) -> Column:
    """Short texts whole; else `size` characters from `before` ahead of the first term, with ellipses where cut."""
    low = fold(body)
    found = [F.nullif(F.locate(t, low), F.lit(0)) for t in terms]
    first = F.coalesce(F.least(*found) if len(found) > 1 else found[0] if found else F.lit(None), F.lit(1))
    start = F.greatest(F.lit(0), first - 1 - before)
    text = F.concat(F.when(start > 0, "… ").otherwise(""), F.substring(body, start + 1, F.lit(size)), F.when(start + size < F.length(body), " …").otherwise(""))
    return F.when(F.length(body) <= size, body).otherwise(text)


def short_excerpt(body: Column, size: int = 420) -> Column:
    flat = collapse(body)
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size - 3), F.lit("…"))).otherwise(flat)


def occurrences(low: Column, term: str) -> Column:
    """Positions from 0 at which the folded term begins in a folded text, without overlaps: a running sum over the stretches between them."""
    parts = F.split(low, r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E", -1)
    n = len(term)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(state: Column, part: Column) -> Column:
        at = state["at"] + F.length(part)
        return F.struct((at + n).alias("at"), F.array_append(state["found"], at).alias("found"))

    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), begin, step, lambda s: s["found"])


def highlights(text: Column, terms: list[str]) -> Column:
    """(location, length) of every occurrence of every term, by location; overlaps stay. Code points."""

    def spans(low: Column, term: str) -> Column:
        found = F.transform(occurrences(low, term), lambda p: F.struct(p.cast("int").alias("location"), F.lit(len(term)).alias("length")))
        return F.when(F.contains(low, F.lit(term)), found).otherwise(F.array().cast("array<struct<location:int,length:int>>"))

    # the text is folded once
    return F.transform(F.array(fold(text)), lambda low: F.array_sort(F.concat(*(spans(low, t) for t in terms))))[0]


def wide_places(text: Column) -> Column:
    """Where in a text, from 0, the code points beyond U+FFFF stand: a sum over the stretches between them."""
    parts = F.split(text, r"[\x{10000}-\x{10FFFF}]", -1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda s, p: F.struct((s["at"] + F.length(p) + 1).alias("at"), F.array_append(s["found"], s["at"] + F.length(p)).alias("found"))
    return F.aggregate(F.slice(parts, 1, F.size(parts) - 1), begin, step, lambda s: s["found"])


def with_utf16(ranges: Column, text: Column) -> Column:
    """Ranges (location, length) in code points, with the same in UTF-16 units: those beyond U+FFFF are two units each."""
    wide = F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), wide_places(text)).otherwise(F.array().cast("array<int>"))

    def both(r: Column, places: Column) -> Column:
        before = F.size(F.filter(places, lambda p: p < r["location"]))
        within = F.size(F.filter(places, lambda p: (p >= r["location"]) & (p < r["location"] + r["length"])))
        return F.struct(r["location"].alias("location"), r["length"].alias("length"), (r["location"] + before).alias("location16"), (r["length"] + within).alias("length16"))

    # the text is looked at once
    return F.transform(F.array(wide), lambda places: F.transform(ranges, lambda r: both(r, places)))[0]


def snippet(text: Column, terms: list[str], size: int = 36, before: int = 6) -> Column:
    """A run of `size` words beginning at most `before` ahead of the first one that is a term; cut ends get ` … `."""
    words = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    hit = F.array_position(F.transform(words, lambda w: F.arrays_overlap(tokens(w), F.array(*map(F.lit, terms)))), True)
    start = F.greatest(F.lit(1), F.greatest(F.lit(1), hit.cast("int")) - before)
    return F.concat(F.when(start > 1, " … ").otherwise(""), F.array_join(F.slice(words, start, F.lit(size)), " "), F.when(start + size - 1 < F.size(words), " … ").otherwise(""))


def markdown_to_text(text: Column) -> Column:
    """Plain text of Markdown, blocks parted by blank lines: no marks of headings and quotes, table cells by tabs, labels for links."""
    escapes, bare = F.contains(text, F.lit("\\")), text
    for k, c in enumerate(ESCAPED):  # an escaped sign is no mark; it comes back at the end
        bare = F.replace(bare, F.lit("\\" + c), F.lit(chr(0xE000 + k)))
    text = F.when(escapes, bare).otherwise(text)
    lines = F.transform(F.split(text, "\n"), lambda s: F.trim(s))  # F.trim by itself would take a line's number for what to trim
    kept = F.filter(lines, lambda s: (s != "") & ~(s.contains("|") & s.rlike(r"^[|:\- \t]+\z")))

    def inline(s: Column) -> Column:
        s = F.regexp_replace(s, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
        s = F.regexp_replace(s, r"<[^>]*>", "")
        s = F.regexp_replace(s, r"(?s)\*\*(.*?)\*\*", "$1")
        s = F.regexp_replace(s, r"(?s)~~(.*?)~~", "$1")
        s = F.regexp_replace(s, r"(?s)`(.*?)`", "$1")
        return F.trim(F.regexp_replace(s, r"(?s)\*(.*?)\*", "$1"))

    def block(s: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(s, r"^#+[ \t\n\f\r]*", ""), r"^>+[ \t\n\f\r]*", "")
        cells = F.array_join(F.transform(F.split(F.regexp_replace(s, r"^\|+|\|+\z", ""), r"\|"), lambda c: inline(F.trim(c))), "\t")
        return F.when(s.rlike(r"(?s)^\|.*\|\z"), cells).otherwise(inline(s))

    out = F.array_join(F.filter(F.transform(kept, block), lambda s: s != ""), "\n\n")
    return F.when(escapes, F.translate(out, "".join(chr(0xE000 + k) for k in range(len(ESCAPED))), ESCAPED)).otherwise(out)


def html_to_text(html: Column) -> Column:
    """Text of HTML: scripts, styles and comments go, tags part words, the common entities are resolved."""
    s = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return collapse(s)


def fnv1a_key(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes with the highest bit set, as an unsigned number in a decimal.

    The product modulo 2**64 is put together from the value's halves, which stay within 64 signed bits.
    """
    data = F.hex(F.encode(text, "UTF-8"))
    byte = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(data) / 2).cast("int")), lambda i: F.conv(F.substring(data, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"))
    low32 = F.lit(0xFFFFFFFF)

    def step(state: Column, b: Column) -> Column:
        high, low = state["high"], state["low"].bitwiseXOR(b)
        wide = low * F.lit(0x1B3)  # the prime is 2**40 + 0x1B3
        up = high * F.lit(0x1B3) + F.shiftright(wide, 32) + F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(up.bitwiseAND(low32).alias("high"), wide.bitwiseAND(low32).alias("low"))

    start = F.struct(F.lit(0xCBF29CE4).alias("high"), F.lit(0x84222325).alias("low"))
    bytes_ = F.when(F.length(data) > 0, byte).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(bytes_, start, step, lambda s: s["high"].bitwiseOR(F.lit(0x80000000)).cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(20,0)") + s["low"].cast("decimal(20,0)")).cast("decimal(20,0)")
