"""String expressions with the semantics of Python's str methods, inside the JVM."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Python's str.strip() and str.split() take as white space.
SPACE = "[\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Marks where a text is cut: a private-use character and another. The first alone may stand in a text: there
#: it gets a third for company while the text is cut.
MARK = "\ue000"
CUT, KEPT = MARK + "\ue001", MARK + "\ue002"


def strip(text: Column) -> Column:
    """str.strip()"""
    return F.btrim(text, F.lit(SPACES))


def filled(text: Column) -> Column:
    """Null for null and for the empty string."""
    return F.nullif(text, F.lit(""))


def not_blank(text: Column) -> Column:
    """Null where nothing but white space is left."""
    return F.when(strip(text) != "", text)


def n_words(text: Column) -> Column:
    """len(text.split())"""
    return F.regexp_count(text, F.lit(SPACE.replace("[", "[^", 1) + "+"))


def quoted(literal: str) -> str:
    """A Java pattern that matches the literal."""
    return "".join(f"\\{c}" if not c.isalnum() and ord(c) < 128 and c not in " \n\t" else c for c in literal)


def split_sentences(text: Column, delimiters: list[str], include: str | None, least: int) -> Column:
    """array<string>: the text cut at delimiters, the longest tried first.

    ``include`` puts a delimiter at the end of the part before ("prev"), at the head of the
    part after ("next"), or nowhere (None). Parts are stripped; those shorter than ``least``
    are left out. If no part is left, the stripped text is the only one.
    """
    pattern = "(" + "|".join(quoted(d) for d in sorted(delimiters, key=len, reverse=True)) + ")"
    with_cuts = {"prev": "$1" + CUT, "next": CUT + "$1", None: CUT}[include]

    def cut(t: Column) -> Column:
        return F.split(F.regexp_replace(t, pattern, with_cuts), CUT)

    held = F.transform(cut(F.replace(text, F.lit(MARK), F.lit(KEPT))), lambda p: F.replace(p, F.lit(KEPT), F.lit(MARK)))
    parts = F.when(F.contains(text, F.lit(MARK)), held).otherwise(cut(text))
    parts = F.filter(F.transform(parts, strip), lambda p: F.length(p) >= least)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(strip(text)))


@lru_cache(256)
def _pattern(delimiters: tuple[str, ...]) -> re.Pattern:
    return re.compile("(" + "|".join(re.escape(d) for d in sorted(delimiters, key=len, reverse=True)) + ")")


def split_sentences_py(text: str, delimiters: list[str], include: str | None, least: int) -> list[str]:
    """The same in Python, for folds that need it there."""
    with_cuts = {"prev": "\\1" + CUT, "next": CUT + "\\1", None: CUT}[include]
    parts = (p.replace(KEPT, MARK).strip() for p in _pattern(tuple(delimiters)).sub(with_cuts, text.replace(MARK, KEPT)).split(CUT))
    return [p for p in parts if len(p) >= least] or [text.strip()]


def trim_middle(text: Column, most: int, head: float = 0.4) -> Column:
    """A text longer than ``most`` is cut in the middle to exactly that length."""
    first = int(most * head)
    last = most - first - 5
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(first)), F.lit(" […] "), F.right(text, F.lit(last)) if last > 0 else F.lit("")))


def trim_middle_py(text: str, most: int, head: float = 0.4) -> str:
    """The same in Python."""
    first = int(most * head)
    last = most - first - 5
    return text if len(text) <= most else text[:first] + " […] " + (text[-last:] if last > 0 else "")


def extension(path: Column) -> Column:
    """The last suffix of a path's name, lower-cased, with its dot; '' without one."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*[^.])$", 1))


def web_file_name(url: Column, suffix: str, keep_query: bool = True) -> Column:
    """A file name for a URL: authority and path with '_' for '/', then the query's hash.

    ``keep_query=False`` leaves the query out, so that URLs which differ in it share a name.
    """
    path = F.replace(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"), F.lit("_"))
    name = F.concat(F.parse_url(url, F.lit("AUTHORITY")), path)
    if keep_query:
        query = F.parse_url(url, F.lit("QUERY"))
        name = F.concat(name, F.when(query.isNotNull(), F.concat(F.lit("_"), F.substring(F.sha2(query, 256), 1, 8))).otherwise(""))
    return F.concat(name, F.lit("." + suffix))
