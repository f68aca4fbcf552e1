"""Japanese text normalization as Spark column expressions.

Order of steps (it matters):

1. circled digits ``①`` .. ``⑳`` -> ``"1. "`` .. ``"20. "`` (before NFKC, which would fold them)
2. NFKC (the one Python step: Arrow-batched, only for values with non-ASCII text)
3. tilde variants with surrounding whitespace -> ``～``
4. era year ranges -> calendar ranges, 5. single era years -> calendar years
6. bare ``NN年度`` -> calendar fiscal year
7. repair of a misspelt group label, 8. protected group label (kept as written)
9. hyphens: katakana-hyphen-katakana -> long vowel mark, other hyphens -> ``-``,
   ``-`` between kana/kanji removed
10. Unicode whitespace strip

Every step except 2 is a JVM expression; the callback-style replacements
(steps 1, 4-6) are done with ``split``/``regexp_extract_all``/``zip_with`` and
are guarded by ``rlike`` so text without a hit pays one scan only.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise import constants as K
from sheetwise.functions.regex import PY_SPACE, callback_replace, let, py_strip

@lru_cache(maxsize=1)
def nfkc_unstable() -> str:
    """Every code point NFKC can change: those whose NFKC form differs, all
    combining marks (they may compose with what precedes them), and the
    conjoining Hangul jamo blocks.  Built from the Unicode database by rule."""
    jamo = [(0x1100, 0x11FF), (0xA960, 0xA97F), (0xD7B0, 0xD7FF)]
    out = []
    for cp in range(0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        c = chr(cp)
        if (unicodedata.combining(c) or unicodedata.category(c).startswith("M")
                or any(a <= cp <= b for a, b in jamo) or unicodedata.normalize("NFKC", c) != c):
            out.append(c)
    return "".join(out)


def __getattr__(name: str):
    if name == "NFKC_UNSTABLE":  # built on first use, on the driver
        return nfkc_unstable()
    raise AttributeError(name)


# Wide forms with one plain form: full-width ASCII and the wide space.  Putting the
# plain form in their place leaves the NFKC of a text as it is, wherever they stand,
# because both have the same decomposition; so most of the folding stays in the JVM.
_WIDE = "\u3000" + "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = unicodedata.normalize("NFKC", _WIDE)
# Blocks NFKC leaves alone (a test compares them with ``nfkc_unstable``): ASCII, CJK
# punctuation, kana and unified ideographs.  Texts of these need no look-up per character.
NFKC_STABLE = "\\x00-\\x7F\\u3001-\\u3029\\u3041-\\u3096\\u30A1-\\u30FE\\u4E00-\\u9FFF"


def is_ascii(t: Column) -> Column:
    return F.octet_length(t) == F.length(t)


def narrowed(t: Column) -> Column:
    """The part of NFKC that replaces one character by one."""
    return F.when(is_ascii(t), t).otherwise(F.translate(t, _WIDE, _NARROW))


def needs_nfkc(t: Column) -> Column:
    """True when NFKC may change ``t`` (one hash lookup per character, in the JVM,
    for texts beyond the stable blocks)."""
    return ~is_ascii(t) & ~t.rlike("^[" + NFKC_STABLE + "]*\\z") & (F.length(F.translate(t, nfkc_unstable(), "")) < F.length(t))


HY = "[" + "".join("\\x{%X}" % cp for cp in K.HYPHEN_CODEPOINTS) + "]"
NON_ASCII = "[^\\x00-\\x7F]"

_ERA_ALT = "|".join(name for name, _ in K.ERA_OFFSETS)
_YEAR = "[0-9]{1,2}|" + K.ERA_FIRST_YEAR
RE_CIRCLED = "[" + K.CIRCLED_DIGITS[0][0] + "-" + K.CIRCLED_DIGITS[-1][0] + "]"
RE_TILDE = PY_SPACE + "*[~" + K.TILDE + "]" + PY_SPACE + "*"
RE_ERA_RANGE = "(" + _ERA_ALT + ")(" + _YEAR + ")" + PY_SPACE + "*" + K.TILDE + PY_SPACE + "*([0-9]{1,2})"
RE_ERA_SINGLE = "(" + _ERA_ALT + ")(" + _YEAR + ")"
RE_BARE_YEAR = "(?<![0-9])([0-9]{1,2})年度"
RE_LABEL_REPAIR = HY.join(K.GROUP_LABEL_REPAIR[0].split("-"))
RE_LABEL_PROTECTED = HY.join(K.GROUP_LABEL_PROTECTED.split("-"))
RE_KATAKANA_HYPHEN = "([" + K.KATAKANA_RANGE + "])" + HY + "(?=[" + K.KATAKANA_RANGE + "])"
RE_KANA_DASH = "([" + K.KANA_KANJI_RANGE + "])-(?=[" + K.KANA_KANJI_RANGE + "])"


def _circled_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in K.CIRCLED_DIGITS for x in pair])


def _era_map() -> Column:
    return F.create_map(*[F.lit(x) for pair in K.ERA_OFFSETS for x in pair])


_ERA_LETTERS = [name for name, _ in K.ERA_OFFSETS if len(name) == 1]


def _split_era(m: Column) -> tuple[Column, Column]:
    """(era, rest) of a matched text that starts with an era letter (one
    character) or an era name (two characters) -- substring arithmetic, no
    second regex pass over the match."""
    letter = F.substring(m, 1, 1).isin(*_ERA_LETTERS)
    era = F.when(letter, F.substring(m, 1, 1)).otherwise(F.substring(m, 1, 2))
    rest = F.when(letter, m.substr(F.lit(2), F.length(m))).otherwise(m.substr(F.lit(3), F.length(m)))
    return era, rest


def _year_number(y: Column) -> Column:
    return F.when(y == K.ERA_FIRST_YEAR, F.lit(1)).otherwise(y.cast("int"))


def _era_single(m: Column) -> Column:
    """N5 for one match ``era + year``."""
    era, rest = _split_era(m)
    return F.element_at(_era_map(), era) + _year_number(rest)


def _era_range(m: Column) -> Column:
    """N4 for one match ``era + year ～ year`` (both years in the same era)."""
    era, rest = _split_era(m)
    ys = F.split(rest, PY_SPACE + "*" + K.TILDE + PY_SPACE + "*", 2)
    base = F.element_at(_era_map(), era)
    y1 = base + _year_number(F.element_at(ys, 1))
    y2 = base + F.element_at(ys, 2).cast("int")
    return F.concat(y1.cast("string"), F.lit(K.TILDE), y2.cast("string"))


def _guarded(col: Column, pattern: str, fn) -> Column:
    return let(col, lambda x: F.when(x.rlike(pattern), callback_replace(x, pattern, fn)).otherwise(x))


def pre_nfkc(t: Column) -> Column:
    """Step 1."""
    return _guarded(t, RE_CIRCLED, lambda m: F.concat(F.element_at(_circled_map(), m), F.lit(K.CIRCLED_MARKER_SUFFIX)))


def _hyphens(p: Column) -> Column:
    p = F.regexp_replace(p, RE_KATAKANA_HYPHEN, "$1" + K.LONG_VOWEL_MARK)
    p = F.regexp_replace(p, HY, "-")
    return F.regexp_replace(p, RE_KANA_DASH, "$1")


# Any character some step of 3-10 reacts to, or whitespace at either end.
# A value without one is returned as it is after one scan.
# The hyphen steps change text only where a non-ASCII hyphen occurs or an
# ASCII "-" touches kana/kanji; a plain "-" in Latin text needs nothing.
_HY_NON_ASCII = "".join("\\x{%X}" % cp for cp in K.HYPHEN_CODEPOINTS if cp != 0x2D)
RE_KANA_NEAR_DASH = "[" + K.KANA_KANJI_RANGE + "]-|-[" + K.KANA_KANJI_RANGE + "]"
RE_HYPHEN_WORK = "[" + _HY_NON_ASCII + "]|" + RE_KANA_NEAR_DASH
# Last characters of the era names and letters; an era year needs one of them
# right before a digit or the first-year mark.
_ERA_LAST_CHARS = "".join(sorted({name[-1] for name, _ in K.ERA_OFFSETS}))
# Characters whose mere presence can call for a step (tilde forms, non-ASCII
# hyphens); found with byte searches, no regex.
_TRIGGER_CHARS = ["~", K.TILDE] + [chr(cp) for cp in K.HYPHEN_CODEPOINTS if cp != 0x2D]
RE_ERA_YEAR_HINT = "[" + _ERA_LAST_CHARS + "][0-9" + K.ERA_FIRST_YEAR + "]"


def post_trigger(x: Column) -> Column:
    """Could any of steps 3-9 change ``x``?  Cheap checks only (a superset):
    byte searches for single characters and 年度, one short regex for era
    years and the kana-dash regex only when a "-" is present.  ASCII text can
    only hold a tilde or an era letter with a year."""
    hit = None
    for ch in _TRIGGER_CHARS + ["年度"]:
        c = F.instr(x, ch) > 0
        hit = c if hit is None else hit | c
    era = x.rlike(RE_ERA_YEAR_HINT)
    return F.when(is_ascii(x), (F.instr(x, "~") > 0) | era).otherwise(hit | ((F.instr(x, "-") > 0) & x.rlike(RE_KANA_NEAR_DASH)) | era)


def _when_has(x: Column, pattern: str, step) -> Column:
    """Run ``step`` only when ``pattern`` occurs (a scan instead of a copy)."""
    return F.when(x.rlike(pattern), step(x)).otherwise(x)


def post_nfkc(t: Column) -> Column:
    """Steps 3-10.  White space at the ends has no part in steps 3-9 but beside a
    tilde, where it goes either way; so it is stripped first, and a value with
    nothing else to do is done after one scan."""
    return let(py_strip(t), lambda x: F.when(post_trigger(x), _post_chain(x)).otherwise(x))


def _post_chain(t: Column) -> Column:
    t = let(t, lambda x: _when_has(x, "[~" + K.TILDE + "]", lambda y: F.regexp_replace(y, RE_TILDE, K.TILDE)))

    t = _guarded(t, RE_ERA_RANGE, _era_range)
    t = _guarded(t, RE_ERA_SINGLE, lambda m: _era_single(m).cast("string"))

    def bare_year(m):
        y = F.regexp_extract(m, RE_BARE_YEAR, 1).cast("int")
        cal = F.when(y <= K.BARE_YEAR_REIWA_MAX, y + K.BARE_YEAR_REIWA_OFFSET).otherwise(y + K.BARE_YEAR_HEISEI_OFFSET)
        return F.concat(cal.cast("string"), F.lit("年度"))

    t = _guarded(t, RE_BARE_YEAR, bare_year)
    t = let(t, lambda x: _when_has(x, K.GROUP_LABEL_REPAIR[0][0],
                                   lambda y: F.regexp_replace(y, RE_LABEL_REPAIR, K.GROUP_LABEL_REPAIR[1])))

    # The protected label is cut out, the pieces between labels get the hyphen
    # rules on their own (a neighbour of the label never sees it), and the
    # labels are put back exactly as written.
    def shield(x):
        shielded = F.array_join(F.flatten(F.zip_with(
            F.transform(F.split(x, RE_LABEL_PROTECTED, -1), _hyphens),
            F.concat(F.regexp_extract_all(x, F.lit(RE_LABEL_PROTECTED), 0), F.array(F.lit(""))),
            lambda p, lab: F.array(p, lab))), "")
        return F.when(x.rlike(RE_LABEL_PROTECTED), shielded).when(x.rlike(RE_HYPHEN_WORK), _hyphens(x)).otherwise(x)

    return py_strip(let(t, shield))


# --- step 2: NFKC -----------------------------------------------------------------

def _nfkc_values(values: pa.Array) -> pa.Array:
    """NFKC for a flat string array; NULL and ASCII entries are passed through."""
    if len(values) == 0:
        return values
    mask = pc.fill_null(pc.match_substring_regex(values, NON_ASCII), False)
    if not pc.any(mask).as_py():
        return values
    out = values.to_pylist()
    for i in pc.indices_nonzero(mask).to_pylist():
        out[i] = unicodedata.normalize("NFKC", out[i])
    return pa.array(out, type=pa.string())


@F.arrow_udf(T.StringType())
def nfkc(a: pa.Array) -> pa.Array:
    return _nfkc_values(a.cast(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def nfkc_cells(a: pa.Array) -> pa.Array:
    a = a.cast(pa.list_(pa.string()))
    values = _nfkc_values(a.flatten())
    offsets = pc.subtract(a.offsets, a.offsets[0])
    return pa.ListArray.from_arrays(offsets, values, mask=a.is_null())


# --- whole function -----------------------------------------------------------------

def normalize_text(t: Column) -> Column:
    """Normalize one string column (NULL and '' pass through unchanged)."""
    pre = F.when(t.rlike(RE_CIRCLED), pre_nfkc(t)).otherwise(t)
    # values NFKC cannot change reach the UDF as NULL: Python sees only the rest
    folded = let(narrowed(pre), lambda x: F.struct(x.alias("x"), F.when(needs_nfkc(x), x).alias("sent")))
    folded = F.coalesce(nfkc(folded["sent"]), folded["x"])
    return F.when((t.isNull()) | (t == ""), t).otherwise(post_nfkc(folded))


def _any_cell(cells: Column, test) -> Column:
    """Does ``test`` hold for some cell?  Asked once of all cells in one text: for
    tests that look at characters and their neighbours the line feed between two
    cells changes nothing, or makes it a superset."""
    return let(F.array_join(cells, "\n"), test)


def pre_cells(cells: Column) -> Column:
    # ``c`` is a lambda variable: guard it directly, no single-evaluation wrapper needed
    circled = lambda c: narrowed(F.when(c.rlike(RE_CIRCLED), pre_nfkc(c)).otherwise(c))
    return F.when(_any_cell(cells, lambda t: t.rlike(RE_CIRCLED)), F.transform(cells, circled)).otherwise(F.transform(cells, narrowed))


def nfkc_sent(pre: Column) -> Column:
    """The NFKC-sensitive cells of a row (others NULL), or one NULL for a row
    without any -- that row then costs Python nothing but a NULL."""
    return nfkc_cells(F.when(_any_cell(pre, needs_nfkc), F.transform(pre, lambda c: F.when(needs_nfkc(c), c))))


def post_cells(pre: Column, sent: Column) -> Column:
    folded = F.when(sent.isNull(), pre).otherwise(F.zip_with(pre, sent, lambda p, n: F.coalesce(n, p)))
    steps = lambda cells: F.transform(cells, lambda c: F.when(post_trigger(c), _post_chain(c)).otherwise(c))
    return let(F.transform(folded, py_strip), lambda cells: F.when(_any_cell(cells, post_trigger), steps(cells)).otherwise(cells))
