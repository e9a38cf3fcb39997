"""The second ranker's query syntax, and what it means over postings: words are joined by `and` unless `OR` stands between
them, groups nest, `+` demands and `-` or `NOT` excludes, `field:` limits a word, a phrase or a group to a field, `"..."~2` lets
the words of a phrase lie two places further apart in all, and `^2` weighs a part.

    (quarterly OR "annual report"~2) +budget^3 -title:(draft OR old)

A part that doesn't match as a whole adds nothing to a score. A group of exclusions alone matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import inverted as I
from . import lexical as L
from .query import QueryError, Term, split_words

# The fields of the second ranker.
FIELDS = I.SECOND
_TOKEN = re.compile(r'\s+|(?P<sign>[+-])(?=\S)|(?P<open>\()|(?P<close>\))|(?P<boost>\^\d+(?:\.\d+)?)|(?P<field>(?:%s):)(?=\S)|"(?P<phrase>[^"]*)"?(?:~(?P<slop>\d+))?|(?P<word>[^\s()"^]+)' % "|".join(FIELDS))


@dataclass(frozen=True)
class Leaf:
    words: tuple[str, ...]
    field: str | None = None
    slop: int = 0
    boost: float = 1.0


@dataclass(frozen=True)
class Group:
    """What must, may and must not match; where anything must, what may only adds to the score."""

    must: tuple = ()
    may: tuple = ()
    never: tuple = ()
    boost: float = 1.0


def leaves(node, excluded: bool = False) -> Iterator[Leaf]:
    """The words and phrases of an expression; with `excluded`, of exclusions too."""
    if isinstance(node, Leaf):
        yield node
    else:
        for x in (*node.must, *node.may, *(node.never if excluded else ())):
            yield from leaves(x, excluded)


def _pieces(text: str) -> list[tuple[str, str, int]]:
    out = []
    for m in _TOKEN.finditer(text):
        if m.lastgroup:
            kind = "phrase" if m["phrase"] is not None else m.lastgroup
            value = m[kind]
            if kind == "word" and value in ("AND", "OR", "NOT"):
                kind = value
            out.append((kind, value, int(m["slop"] or 0)))
    return out


class _Reader:
    def __init__(self, text: str):
        self.pieces, self.at = _pieces(text), 0

    def peek(self) -> str:
        return self.pieces[self.at][0] if self.at < len(self.pieces) else "end"

    def take(self) -> tuple[str, str, int]:
        self.at += 1
        return self.pieces[self.at - 1]

    def group(self, field: str | None) -> Group | Leaf | None:
        """Up to a closing bracket or the end: runs that `OR` parts, each of which is demanded as a whole."""
        runs, signs = [[]], False
        while self.peek() not in ("close", "end"):
            if self.peek() in ("OR", "AND"):
                if self.take()[0] == "OR":
                    runs.append([])
                continue
            sign = ""
            while self.peek() in ("sign", "NOT"):
                sign = "-" if self.take()[1] in ("-", "NOT") else "+"
            node = self.atom(field)
            if node is not None:
                signs = signs or sign == "+"
                runs[-1].append((sign, node))
        runs = [r for r in runs if r]
        if not runs:
            return None
        if len(runs) == 1:
            return _joined(runs[0])
        never = tuple(x for r in runs for sign, x in r if sign == "-" and len(r) == 1)
        demanded = tuple(x for r in runs for sign, x in r if sign == "+" and len(r) == 1)
        may = tuple(x for r in runs if not (len(r) == 1 and r[0][0]) and (x := _joined(r)) is not None)
        return Group(demanded, may, never)

    def atom(self, field: str | None):
        if self.peek() in ("close", "end"):
            return None
        kind, value, slop = self.take()
        if kind == "field":
            return self.atom(value[:-1])
        if kind == "open":
            node = self.group(field)
            if self.peek() == "close":
                self.take()
        elif kind in ("phrase", "word"):
            words = split_words(value)
            node = Leaf(words, field, slop) if words else None
        else:
            return None  # a sign or a weight of nothing
        if self.peek() == "boost":
            weight = float(self.take()[1][1:])
            node = replace(node, boost=node.boost * weight) if node else None
        return node


def _joined(run: list[tuple[str, object]]):
    must, never = tuple(x for sign, x in run if sign != "-"), tuple(x for sign, x in run if sign == "-")
    return must[0] if len(must) == 1 and not never else Group(must, (), never)


def parse(text: str) -> Group | Leaf:
    reader = _Reader(text)
    node = reader.group(None)
    while reader.peek() == "close":  # brackets that nothing opened
        reader.take()
        rest = reader.group(None)
        node = Group((node, rest)) if node and rest else node or rest
    if node is None or not list(leaves(node)):
        raise QueryError("the query has no word to look for")
    return node


# --- over postings ------------------------------------------------------------------------------------------------------


class _Columns:
    """What an expression is over looked-up rows; a column t{i}_{field} has each leaf's frequency."""

    def __init__(self, index: I.Index, node):
        self.index, self.node = index, node
        self.all = list(dict.fromkeys(replace(x, boost=1.0) for x in leaves(node, True)))
        self.number = {x: i for i, x in enumerate(self.all)}
        self.words = list(dict.fromkeys((w, False) for x in self.all for w in x.words))

    def _starts(self, leaf: Leaf, places: I._Places) -> Column:
        if not leaf.slop or len(leaf.words) == 1:
            return places.starts(leaf.words)
        own = [F.col(f"w{places.number[w, False]}") for w in leaf.words]

        def spread(x: Column) -> Column:  # the nearest next word, and the next after that
            after = lambda at, c: F.array_min(F.filter(c, lambda y: (y > at) & (F.shiftright(y, I.SHIFT) == F.shiftright(x, I.SHIFT))))
            return reduce(after, own[1:], x) - x - (len(own) - 1)

        return F.filter(own[0], lambda x: F.coalesce(spread(x) <= leaf.slop, F.lit(False)))

    def rows(self) -> DataFrame:
        places, out = I._Places(self.words), I._looked_up(self.index, self.words)
        begin = lambda f: I.FIELDS[f] << I.SHIFT
        out = out.withColumns({f"s{i}": self._starts(x, places) for i, x in enumerate(self.all)})
        inside = lambda i, f: F.size(F.filter(f"s{i}", lambda y: (y >= begin(f)) & (y < begin(f) + (1 << I.SHIFT))))
        return out.withColumns({f"t{i}_{f}": inside(i, f) if x.field in (None, f) else F.lit(0) for i, x in enumerate(self.all) for f in FIELDS})

    def matches(self, node) -> Column:
        if isinstance(node, Leaf):
            i = self.number[replace(node, boost=1.0)]
            return reduce(lambda a, b: a | b, (F.col(f"t{i}_{f}") > 0 for f in FIELDS))
        join = lambda op, xs: reduce(op, map(self.matches, xs))
        out = join(lambda a, b: a & b, node.must) if node.must else join(lambda a, b: a | b, node.may) if node.may else F.lit(False)
        return out & ~join(lambda a, b: a | b, node.never) if node.never else out

    def score(self, node, weight: float = 1.0) -> Column:
        weight = weight * node.boost
        if isinstance(node, Leaf):
            return self._leaf(self.number[replace(node, boost=1.0)], weight)
        parts = [F.when(self.matches(x), self.score(x, weight)).otherwise(0.0) if isinstance(x, Group) else self.score(x, weight) for x in (*node.must, *node.may)]
        return reduce(lambda a, b: a + b, parts, F.lit(0.0))

    def _leaf(self, i: int, weight: float) -> Column:
        n, out = self.index.counts["n"], F.lit(0.0)
        for f in FIELDS:
            tf, d = F.col(f"t{i}_{f}"), F.col(f"d{i}_{f}")
            norm = tf + L.K1 * (1 - L.B + L.B * F.col(f"len_{f}") / F.lit(self.index.average(f)))
            out = out + weight * L.WEIGHTS[f] * F.log(1 + (n - d + 0.5) / (d + 0.5)) * tf * (L.K1 + 1) / norm
        return out

    def frequencies(self, rows: DataFrame) -> DataFrame:
        """One row: how many passages hold each leaf in each field. The dictionary knows words; phrases are counted."""
        words = [x.words[0] for x in self.all if len(x.words) == 1]
        known = self.index.frequencies(words) if self.index.terms is not None and len(words) == len(self.all) else None
        if known is None:
            return rows.agg(*(F.count_if(F.col(f"t{i}_{f}") > 0).alias(f"d{i}_{f}") for i in range(len(self.all)) for f in FIELDS))
        return rows.sparkSession.range(1).select(*(F.lit(known[x.words[0]][f"df_{f}"] if x.field in (None, f) else 0).alias(f"d{i}_{f}") for i, x in enumerate(self.all) for f in FIELDS))


def scored(index: I.Index, node) -> DataFrame:
    """passage_id, source_id and bm25 of the passages that an expression matches."""
    c = _Columns(index, node)
    rows = c.rows()
    found = rows.filter(c.matches(node)).crossJoin(F.broadcast(c.frequencies(rows)))  # one row
    return found.select("passage_id", "source_id", c.score(node).alias("bm25"))


def search(index: I.Index, passages: DataFrame, node, limit: int = 20, offset: int = 0, after: Column | None = None) -> DataFrame:
    """source_id, score, best_passage, reranked as `lexical.rerank_v2` does by the words that aren't excluded."""
    from skein.functions.text import tokens

    from .query import Query

    best = scored(index, node).orderBy(F.desc("bm25"), "passage_id").limit(L.candidates_v2(limit, offset)).select("passage_id", "bm25")
    rows = passages.join(F.broadcast(best), "passage_id").withColumn("body_t", tokens(F.col("body")))  # at most 20,000 rows
    query = Query(tuple(Term(x.words, x.field) for x in leaves(node)))
    return L.page(L.rerank_v2(rows if after is None else rows.filter(after), query), limit, offset)
