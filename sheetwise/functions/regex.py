"""Regex helpers: keep Python-style match semantics on Java's engine.

* ``(?d)`` makes ``.`` and ``$`` treat only ``\\n`` as a line end, as Python does.
* ``match`` anchors at the start, ``fullmatch`` at both ends (``\\z``: no
  trailing newline allowance), ``search`` is unanchored -- Spark's
  ``regexp_extract``/``rlike`` use ``find()``, i.e. search.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``\\s`` / ``str.isspace()`` set, spelled out for Java.
PY_SPACE = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"

PY_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def search(pattern: str) -> str:
    return "(?d)" + pattern


def match(pattern: str) -> str:
    return "(?d)^(?:" + pattern + ")"


def fullmatch(pattern: str) -> str:
    return "(?d)^(?:" + pattern + ")\\z"


def extract(col: Column, pattern: str, idx: int) -> Column:
    """Group ``idx`` of the first match; NULL when the pattern does not match.

    ``regexp_extract`` alone returns '' both for "no match" and for an empty
    group, so the match is tested separately.
    """
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, idx))


def py_strip(col: Column) -> Column:
    """``str.strip()``: remove Unicode whitespace at both ends (Spark ``trim``
    removes only ASCII spaces)."""
    return F.btrim(col, F.lit(PY_SPACES))


def begins_visibly(v: Column) -> Column:
    """True only if ``v`` begins with a character that is no white space: printable
    ASCII, or beyond U+3000, the last of ``PY_SPACES`` (strings compare by code point).
    A few byte comparisons; '' and the characters between give False."""
    return ((v >= "!") & (v < "\x7f")) | (v >= chr(ord(PY_SPACES[-1]) + 1))


def strip_plain(col: Column) -> Column:
    """``py_strip`` of a plain column (it is read more than once): values that begin
    and end visibly, nearly all, are passed on without a search of their ends."""
    seen = begins_visibly(col) & begins_visibly(F.substring(col, -1, 1))
    return F.when(seen, col).otherwise(py_strip(col))


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` (a Column -> Column
    function that may use it many times).  Without this, chaining steps that
    each read their input several times grows the expression tree
    exponentially."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def callback_replace(col: Column, pattern: str, fn) -> Column:
    """``re.sub(pattern, fn, text)`` with ``fn`` a Column -> Column function of
    the matched text, natively: split around the matches, map the matches,
    zip the two lists back together.  Both ``split`` and
    ``regexp_extract_all`` scan left to right with the same non-overlapping
    ``find()``, so pieces and matches line up; pattern must not match empty.
    """
    def run(x):
        pieces = F.split(x, pattern, -1)
        found = F.regexp_extract_all(x, F.lit(pattern), 0)
        repl = F.concat(F.transform(found, fn), F.array(F.lit("")))
        return F.array_join(F.flatten(F.zip_with(pieces, repl, lambda p, r: F.array(p, r))), "")
    return let(col, run)
