"""Column expressions (JVM built-ins only) shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import lexicon as L


def decode_text(raw: Column) -> Column:
    """Bytes -> text: invalid UTF-8 replaced by U+FFFD, then CRLF / CR -> LF."""
    text = F.make_valid_utf8(raw.cast("string"))
    return F.regexp_replace(text, r"\r\n?", "\n")


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def strip_scheme(path: Column) -> Column:
    """``file:/a/b`` or ``file:///a/b`` -> ``/a/b`` (binaryFile returns URIs)."""
    return F.regexp_replace(path, r"^file:(?://)?", "")


def file_name(path: Column) -> Column:
    """Last path segment."""
    return F.substring_index(path, "/", -1)


def file_stem(name: Column) -> Column:
    """Name without its last suffix; a suffix needs a char before the dot and after it."""
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def file_suffix(name: Column) -> Column:
    """Last suffix including the dot, or empty (``.env`` has none)."""
    return F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)


def analyze(text: Column, analyzer: str = "standard") -> Column:
    """Text -> array of lower-cased terms."""
    return F.regexp_extract_all(F.lower(text), F.lit(L.ANALYZERS[analyzer]), 0)


def key_terms(question: Column) -> Column:
    """Question -> first distinct words that are not stop words and longer than 2."""
    stop = F.array(*[F.lit(w) for w in L.STOP_WORDS])
    words = F.split(F.translate(F.lower(question), "?,", ""), r"(?U)\s+")
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    return F.slice(F.array_distinct(kept), 1, L.MAX_KEY_TERMS)


def normalize_path(path: Column) -> Column:
    """Lexical absolute path: collapse '', '.', '..' segments (no symlinks)."""
    segs = F.split(path, "/")
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        segs,
        empty,
        lambda acc, s: F.when((s == "") | (s == "."), acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.lit("/"), F.array_join(folded, "/"))
