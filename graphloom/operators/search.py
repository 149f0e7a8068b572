"""Full-text search: a token index as a DataFrame, a query language, boolean and phrase evaluation.

Grammar: words and quoted phrases in sequence mean AND; ``OR``, ``NOT``, ``AND``, parentheses; ``prefix*``; ``a + b``
for one phrase of two; ``^a`` for one at the start of a field; ``column:``, ``{c1 c2}:`` and, for all but these,
``- c:`` before a phrase, NEAR or parenthesis (of one inside another both hold); ``NEAR(a b, n)``.  Text and queries are
folded alike; a quoted or bare term that folds to several tokens is a phrase.  What can't be parsed is
QUERY_SYNTAX_INVALID.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CodedError
from ..functions import text
from .postings import Stored, matching

FIELDS = ("name", "qualified_name", "file_path", "content_hash")


def words(nodes: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "node_id") -> DataFrame:
    """(node_id, field, words) of the text fields, words in their order."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), text.tokens(F.col(f)).alias("words")) for f in fields)))
    return nodes.select(F.col(key).alias("node_id"), each.alias("x")).select("node_id", "x.field", "x.words")


def index(nodes: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "node_id") -> DataFrame:
    """(node_id, field, pos, token) of the text fields."""
    return words(nodes, fields, key).select("node_id", "field", F.posexplode("words").alias("pos", "token"))


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    columns: tuple[str, ...] | None = None
    first: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int


@dataclass(frozen=True)
class Both:
    op: str  # AND, OR, NOT
    left: object
    right: object


_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"(\s*\*)?|([\w\u0080-\U0010ffff]+)(\s*\*)?|([():,^+{}-]))')


class _Parser:
    def __init__(self, query: str, fields: tuple[str, ...]):
        self.fields, self.items, at = fields, [], 0
        while query[at:].strip():
            m = _LEX.match(query, at)
            if not m:
                raise CodedError("QUERY_SYNTAX_INVALID", at=at)
            quoted, star1, bare, star2, mark = m.groups()
            self.items.append(("mark", mark, False) if mark else ("quoted", quoted.replace('""', '"'), bool(star1)) if quoted is not None else ("bare", bare, bool(star2)))
            at = m.end()
        self.i = 0

    def peek(self, value: str | None = None):
        item = self.items[self.i] if self.i < len(self.items) else ("end", "", False)
        return item if value is None else item[0] in ("bare", "mark") and item[1] == value

    def take(self, value: str) -> bool:
        if self.peek(value):
            self.i += 1
            return True
        return False

    def need(self, ok) -> None:
        if not ok:
            raise CodedError("QUERY_SYNTAX_INVALID", at=self.i)

    def either(self, column=None):
        out = self.all(column)
        while self.take("OR"):
            out = Both("OR", out, self.all(column))
        return out

    def all(self, column):
        out = self.without(column)
        while self.take("AND"):
            out = Both("AND", out, self.without(column))
        return out

    def without(self, column):
        out = self.row(column)
        while self.take("NOT"):
            out = Both("NOT", out, self.row(column))
        return out

    def row(self, column):
        out = self.one(column)
        while self.peek()[0] != "end" and not any(map(self.peek, (")", "OR", "AND", "NOT", ",", "+", "}", ":"))):
            out = Both("AND", out, self.one(column))
        return out

    def filtered(self):
        """The columns that a filter at this place lets in; None if there is none."""
        at, without = self.i, self.take("-")
        if self.take("{"):
            names = []
            while not self.take("}"):
                names.append(self.name())
        elif self.peek()[0] in ("quoted", "bare") and self.i + 1 < len(self.items) and self.items[self.i + 1][:2] == ("mark", ":"):
            names = [self.name()]
        else:
            self.need(not without)
            self.i = at
            return None
        self.need(self.take(":"))
        return tuple(f for f in self.fields if (f in names) != without)

    def name(self) -> str:
        kind, value, _ = self.peek()
        self.need(kind in ("quoted", "bare") and value in self.fields)
        self.i += 1
        return value

    def phrase(self, columns) -> Phrase:
        first, words = self.take("^"), []
        while True:
            kind, value, star = self.peek()
            self.need(kind in ("quoted", "bare") and (kind == "quoted" or value not in ("AND", "OR", "NOT")))
            self.i += 1
            words += text.fold(value)
            if star or not self.take("+"):
                return Phrase(tuple(words), star, columns, first)

    def one(self, columns):
        own = self.filtered()
        if own is not None:
            return self.one(own if columns is None else tuple(c for c in columns if c in own))
        if self.take("("):
            out = self.either(columns)
            self.need(self.take(")"))
            return out
        if self.peek()[:2] == ("bare", "NEAR") and self.items[self.i + 1 : self.i + 2] == [("mark", "(", False)]:
            self.i += 2
            phrases = []
            while not self.peek(")") and not self.peek(","):
                phrases.append(self.phrase(columns))
            distance = 10
            if self.take(","):
                kind, value, _ = self.peek()
                self.need(value.isdigit())
                distance, self.i = int(value), self.i + 1
            self.need(self.take(")") and phrases)
            return Near(tuple(phrases), distance)
        return self.phrase(columns)


def parse(query: str, fields: tuple[str, ...] = FIELDS):
    parser = _Parser(query, fields)
    parser.need(parser.items)
    out = parser.either()
    parser.need(parser.i == len(parser.items))
    return out


def starts(tokens: DataFrame | Stored, phrase: Phrase) -> DataFrame:
    """(node_id, field, start) of each place where the phrase begins; of a stored index only the phrase's words are read."""
    if isinstance(tokens, Stored):
        tokens = tokens.tokens(phrase.words, phrase.prefix, phrase.columns)
    elif phrase.columns is not None:
        tokens = tokens.where(F.col("field").isin(*phrase.columns) if phrase.columns else F.lit(False))
    last, parts = len(phrase.words) - 1, []
    for i, word in enumerate(phrase.words):
        parts.append(F.when(matching(F.col("token"), word, phrase.prefix and i == last), F.lit(i)))
    at = (F.col("pos") - F.col("i")).alias("start")
    if not parts:
        return tokens.where("false").select("node_id", "field", F.col("pos").alias("start"))
    if last == 0:
        runs = tokens.where(parts[0].isNotNull()).select("node_id", "field", F.col("pos").alias("start"))
    else:
        own = tokens.where(F.coalesce(*parts).isNotNull())  # the phrase's words alone are dealt by place
        own = own.select("node_id", "field", "pos", F.explode(F.array_compact(F.array(*parts))).alias("i"))
        runs = own.groupBy("node_id", "field", at).agg(F.count_distinct("i").alias("n")).where(F.col("n") == last + 1).select("node_id", "field", "start")
    return runs.where("start = 0") if phrase.first else runs


def matches(tokens: DataFrame | Stored, query) -> DataFrame:
    """node_id of each node that the parsed query matches, once; ``tokens`` are rows of ``index`` or an index stored."""
    if isinstance(query, Phrase):
        return starts(tokens, query).select("node_id").distinct()
    if isinstance(query, Near):
        every = None
        for i, p in enumerate(query.phrases):
            own = starts(tokens, p).select("node_id", "field", "start", F.lit(i).alias("i"))
            every = own if every is None else every.unionByName(own)
        # from the leftmost phrase: at most ``distance`` tokens between its end and each other's start
        place, near = Window.partitionBy("node_id", "field").orderBy("start"), F.lit(False)
        for i, p in enumerate(query.phrases):
            reach = place.rangeBetween(0, len(p.words) + query.distance)
            near = near | ((F.col("i") == i) & (F.size(F.collect_set("i").over(reach)) == len(query.phrases)))
        return every.withColumn("near", near).where("near").select("node_id").distinct()
    left, right = matches(tokens, query.left), matches(tokens, query.right)
    if query.op == "OR":
        return left.union(right).distinct()
    return left.join(right, "node_id", "left_anti" if query.op == "NOT" else "left_semi")


def search(nodes: DataFrame, tokens: DataFrame | Stored, query: str, limit: int = 20, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The first ``limit`` matching nodes by node_id, with constant matched_fields and score."""
    found = nodes.join(matches(tokens, parse(query, fields)), "node_id", "left_semi").orderBy("node_id").limit(limit)
    return found.withColumns({"matched_fields": F.array(F.lit("name"), F.lit("qualified_name")), "score": F.lit(1.0)})


def search_or_fail(nodes: DataFrame, tokens: DataFrame | Stored, query: str, limit: int = 20) -> DataFrame:
    """``search``; with no hit and no index rows at all, INDEX_UNAVAILABLE."""
    out = search(nodes, tokens, query, limit)
    if out.isEmpty() and tokens.isEmpty():
        raise CodedError("INDEX_UNAVAILABLE")
    return out
