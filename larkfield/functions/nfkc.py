"""Unicode's compatibility composition (NFKC) as a column function.

Spark brings ICU, whose composition takes and returns a string, so it is called as a function of SQL: a text is read once in
the JVM, and a plan holds one short call. ICU may know more characters than the Unicode database of Python, by which
``normalize_text`` goes; texts with such a character are cut there, and it stays as it is, as unassigned ones do.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# What Unicode 16 added that is decomposed, composed or ordered.
_ADDED = (
    (0x897, 0x897), (0x105C9, 0x105C9), (0x105D2, 0x105D2), (0x105DA, 0x105DA), (0x105E4, 0x105E4), (0x10D69, 0x10D6D), (0x11382, 0x11385),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x11391), (0x113B8, 0x113B8), (0x113BB, 0x113BB), (0x113C2, 0x113C2), (0x113C5, 0x113C5),
    (0x113C7, 0x113C9), (0x113CE, 0x113D0), (0x1611E, 0x16129), (0x1612F, 0x1612F), (0x16D63, 0x16D63), (0x16D67, 0x16D6A), (0x1CCD6, 0x1CCF9), (0x1E5EE, 0x1E5EF),
)
_NEWER = [chr(c) for a, b in _ADDED for c in range(a, b + 1) if unicodedata.category(chr(c)) == "Cn"]


def ranges(characters, gap: int = 1) -> str:
    """The inside of a regex class that holds the characters, and the ones between any two of them less than ``gap`` apart."""
    codes, out = sorted(map(ord, characters)), []
    for c in codes:
        if out and c - out[-1][1] <= gap:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


_N = ranges(_NEWER)
#: a class of few ranges that holds all of these, so that texts without them take one cheap test
_COARSE = "[" + ranges(_NEWER, 1 << 15) + "]"


def __getattr__(name: str):
    """The characters of the database, and those that may join the one before: only tests ask for them."""
    if name not in ("_PLACES", "_FOLLOW"):
        raise AttributeError(name)
    places = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    if name == "_PLACES":
        return places
    second = {chr(int(p[1], 16)) for c in places if len(p := unicodedata.decomposition(c).split()) == 2 and "<" not in p[0]}
    return {*second, *(c for c in places if unicodedata.combining(c)), *map(chr, range(0x1161, 0x1176)), *map(chr, range(0x11A8, 0x11C3))}


def _icu(text: Column, method: str, compatibility: bool) -> Column:
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), text, F.lit(compatibility))


def _normal(text: Column, *form) -> Column:
    def whole(text: Column) -> Column:
        out = _icu(text, *form)
        if _NEWER:
            pieces = F.transform(F.regexp_extract_all(text, F.lit(f"[{_N}]+|[^{_N}]+"), F.lit(0)), lambda p: F.when(F.rlike(p, F.lit(f"[{_N}]")), p).otherwise(_icu(p, *form)))
            out = F.when(F.rlike(text, F.lit(_COARSE)) & F.rlike(text, F.lit(f"[{_N}]")), F.array_join(pieces, "")).otherwise(out)
        return F.when(text.isNotNull(), out)

    return F.element_at(F.transform(F.array(text), whole), 1)  # so that what makes the text is computed once


def nfkc(text: Column) -> Column:
    """NFKC of a text; null stays null."""
    return _normal(text, "compose", True)


def nfd(text: Column) -> Column:
    """A text with its letters and their marks apart (NFD); null stays null."""
    return _normal(text, "decompose", False)
