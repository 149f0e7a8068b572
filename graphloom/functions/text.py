"""Text functions: token folding, canonical JSON and its hash, paths."""

from __future__ import annotations

import hashlib
import json
import posixpath
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@cache
def _folding() -> tuple[str, str]:
    """The lower-case letters of the basic plane that stand for an accented ASCII or other base letter, and these."""
    pairs = []
    for i in range(0x80, 0xD800):
        base = unicodedata.normalize("NFD", chr(i))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]) and unicodedata.category(base[0])[0] == "L" and chr(i) == chr(i).lower():
            pairs.append((chr(i), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def ascii_only(text: Column) -> Column:
    """Whether each character is a byte."""
    return F.octet_length(text) == F.char_length(text)


def folded(text: Column) -> Column:
    """Lower case without accents, in the JVM."""
    source, target = _folding()
    low = F.lower(text)
    return F.when(ascii_only(text), low).otherwise(F.regexp_replace(F.translate(low, source, target), r"\p{Mn}", ""))


def tokens(text: Column) -> Column:
    """The runs of letters and digits of folded text, in order; null gives none."""
    runs = lambda x, letters: F.regexp_extract_all(x, F.lit(f"[{letters}]+"), F.lit(0))
    return F.when(ascii_only(text), runs(F.lower(text), "a-z0-9")).otherwise(runs(F.coalesce(folded(text), F.lit("")), r"\p{L}\p{N}"))


def fold(text: str) -> list[str]:
    """``tokens`` for one string on the driver."""
    source, target = _folding()
    low = text.lower().translate(dict(zip(map(ord, source), target, strict=True)))
    low = "".join(c for c in low if unicodedata.category(c) != "Mn")
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in low).split()


def canonical_json(value) -> str:
    """JSON with sorted keys."""
    return json.dumps(value, sort_keys=True)


def digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def canonical(values: pd.Series) -> pd.Series:
    """Canonical JSON of JSON text: Spark's own ``to_json`` neither sorts keys nor keeps nulls."""
    return values.map(lambda x: None if x is None else canonical_json(json.loads(x)))


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def under(path: Column, prefixes: list[str]) -> Column:
    """Whether a path is one of the prefixes or lies under one, by whole components; ``.`` is everything."""
    out = F.lit(False)
    for prefix in prefixes:
        prefix = posixpath.normpath(prefix).strip("/")
        out = out | (F.lit(True) if prefix in ("", ".") else (path == prefix) | path.startswith(f"{prefix}/"))
    return out


def module_name(path: str) -> str:
    """Dotted name of a Python file; a package's ``__init__`` is the package."""
    name = posixpath.splitext(path)[0].strip("/").removesuffix("/__init__")
    return name.replace("/", ".")


# fixed values: the suffixes of ECMAScript sources
SCRIPT_SUFFIXES = (".js", ".jsx", ".ts", ".tsx")


def script_targets(importer: str, source: str) -> list[str]:
    """The files that a relative import of ``source`` in ``importer`` may mean."""
    wanted = posixpath.normpath(posixpath.join(posixpath.dirname(importer), source))
    if posixpath.splitext(wanted)[1].lower() in SCRIPT_SUFFIXES:
        return [wanted]
    return [f"{wanted}{x}" for x in SCRIPT_SUFFIXES] + [posixpath.join(wanted, f"index{x}") for x in SCRIPT_SUFFIXES]


@F.pandas_udf(T.ArrayType(T.StringType()))
def script_targets_of(importers: pd.Series, sources: pd.Series) -> pd.Series:
    """``script_targets`` of columns; none unless the import is relative."""
    return pd.Series([script_targets(a, b) if a and b and b.startswith(".") else [] for a, b in zip(importers, sources, strict=True)])


@F.pandas_udf(T.StringType())
def module(paths: pd.Series) -> pd.Series:
    """``module_name`` of a column of paths."""
    return paths.map(lambda p: None if p is None else module_name(p))
