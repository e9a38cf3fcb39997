"""The search syntax: words, "phrases", prefix*, -excluded, OR, and name:, path:, title: before a word."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from skein.functions.text import ACCENTED, PLAIN

# Field names in queries and the fields they search.
FIELDS = {"name": "filename", "path": "path", "title": "title"}
_FOLD = str.maketrans(ACCENTED[: len(PLAIN)], PLAIN, ACCENTED[len(PLAIN) :])


class QueryError(ValueError):
    """A query without anything to search for."""


@dataclass(frozen=True)
class Term:
    """Successive folded words, in one field or in any; `prefix` lets the last one go on."""

    words: tuple[str, ...]
    field: str | None = None
    prefix: bool = False


@dataclass(frozen=True)
class Query:
    positives: tuple[Term, ...]
    negatives: tuple[Term, ...] = ()
    any_of: bool = False
    highlights: tuple[str, ...] = field(default=())

    @property
    def ranking(self) -> tuple[tuple[str, ...], ...]:
        """The distinct phrases that coverage and proximity look for."""
        return tuple(dict.fromkeys(w for h in self.highlights if (w := split_words(h))))


def split_words(text: str) -> tuple[str, ...]:
    low = text.lower().translate(_FOLD)
    return tuple("".join(c if c.isalpha() or c.isnumeric() else " " for c in low).split())


# A stretch of a query: anything but white space, or what quotation marks hold; the last mark may be missing.
_PIECE = re.compile(r'(?:"[^"]*"?|[^\s"])+')
# Of a stretch: whether it is excluded, its field, and what to look for.
_PARTS = re.compile(rf"(?P<minus>-?)(?:(?P<field>{'|'.join(FIELDS)}):)?(?P<value>.*)", re.IGNORECASE | re.DOTALL)


def pieces(text: str) -> list[str]:
    """Stretches between white space outside quotation marks; the marks stay."""
    return _PIECE.findall(text)


def _indexable(c: str) -> bool:
    """Letters, digits, their marks, and what parts words."""
    return c in "_- " or unicodedata.category(c)[0] in "LNM"


def _term(piece: str) -> Term | None:
    """What one stretch looks for; nothing if no word is left of it."""
    part = _PARTS.fullmatch(piece)
    value = part["value"]
    bare = value.strip('"*')
    words = split_words("".join(filter(_indexable, bare)))
    if not words:
        return None
    quoted = len(value) >= 2 and value.startswith('"') and value.endswith('"')
    open_ended = value.endswith("*") and not quoted and " " not in value
    return Term(words, FIELDS.get((part["field"] or "").lower()), open_ended)


def read(text: str) -> Query:
    """What a query says; there may be nothing in it to look for."""
    positives, negatives, marks, any_of = [], [], [], False
    for p in pieces(text):
        if p.upper() == "OR":
            any_of = True
            continue
        excluded = p.startswith("-")
        if not excluded and (mark := p.partition(":")[2].strip('"*') if ":" in p else p.strip('"*')):
            marks.append(mark)
        if term := _term(p):
            (negatives if excluded else positives).append(term)
    return Query(tuple(positives), tuple(negatives), any_of, tuple(marks))


def parse(text: str) -> Query:
    """The query that a text is; without a word to look for it is an error."""
    query = read(text)
    if not query.positives:
        raise QueryError("the query has no word to look for")
    return query
