"""Text functions as Columns: normalisation, tokens, sentences.

White space is that of Unicode (SPACE), not Java's. normalize() can apply NFKC by an Arrow UDF; corpora stored in NFKC
form, as all here are, stay inside the JVM without it.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lexicons

#: The members of a white-space class, for Java, RE2 and Python patterns alike.
SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# Fixed value: the pattern of a sentence.
SENTENCE = rf"[^.?!।॥\n\r]+[.?!।॥]+(?:[{SPACE}]+|\z)|[^\n\r]+(?:\n+|\z)"
#: Word boundary as the patterns mean it: between ASCII word characters and anything else.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def clean(c: Column) -> Column:
    """White space collapsed and trimmed; null becomes empty."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), rf"[{SPACE}]+", " "))


def first_filled(*columns: Column) -> Column:
    """The first that is not blank, cleaned; null if all are."""
    return F.coalesce(*[F.nullif(clean(c), F.lit("")) for c in columns])


def normalize(c: Column, compose: bool = False) -> Column:
    """Lower case, [NFKC,] only letters, marks, digits and single spaces."""
    lower = F.lower(F.coalesce(c, F.lit("")))
    lower = nfkc(lower) if compose else lower
    return clean(F.regexp_replace(lower, rf"[^\p{{L}}\p{{M}}\p{{N}}{SPACE}]", " "))


_plain = str.maketrans({chr(i): " " for i in range(128) if not chr(i).isalnum()})


@lru_cache(maxsize=20_000)
def py_normalize(s: str) -> str:
    """normalize() with NFKC, for constants and small sets of candidates."""
    if s.isascii():
        return " ".join(s.lower().translate(_plain).split())
    composed = unicodedata.normalize("NFKC", s.lower())
    kept = "".join(c if c.isalnum() or c.isspace() or unicodedata.category(c)[0] in "LMN" else " " for c in composed)
    return " ".join(kept.split())


_latin = bytes(ord(c.lower()) if c.isalnum() else 32 for c in map(chr, range(256)))
_alnum, _high = re.compile(r"[^\W_]+"), re.compile("[\u0300-\U0010ffff]")


@lru_cache(maxsize=1)
def _marked() -> re.Pattern:
    marks = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "M"]
    starts = [c for c, before in zip(marks, [-1, *marks]) if c != before + 1]
    ends = [c for c, after in zip(marks, [*marks[1:], -1]) if c + 1 != after]
    ranges = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))
    return re.compile(rf"(?:[^\W_]+|[{ranges}]+)+")


def py_runs(s: str, compose: bool = False, marks: bool = True) -> list[str]:
    """The words of normalize(), or with marks parting them, of many texts: Latin ones by a table of bytes."""
    if not compose or s.isascii():
        try:
            return s.encode("latin-1").translate(_latin).decode("latin-1").split()
        except UnicodeEncodeError:
            pass
    s = s.lower()
    s = unicodedata.normalize("NFKC", s) if compose else s
    # Below U+0300 there are no marks.
    return (_marked() if marks and _high.search(s) else _alnum).findall(s)


def squeezed(normal: Column) -> Column:
    """A normalised text without its spaces."""
    return F.regexp_replace(normal, r"[^\p{L}\p{M}\p{N}]", "")


def literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.expr("cast(array() as array<string>)")


def tokens(normal: Column, stop: list[str] = lexicons.BM25_STOP, least: int = 2) -> Column:
    """Words of a normalised text of at least so many characters that are not stop words, repeats kept."""
    return F.filter(F.split(normal, " "), lambda w: (F.length(w) >= least) & ~w.isin(stop))


def sentences(c: Column) -> Column:
    """Sentences end at . ! ? । ॥ before white space or the end; where no such end follows, at the end of the line."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, strip), lambda s: s != "")


def stem(c: Column) -> Column:
    """The first ending that fits is cut."""
    n = F.length(c)
    cut = lambda k, more="": F.concat(F.substring(c, F.lit(1), n - k), F.lit(more))
    return (
        F.when(c.endswith("ies") & (n > 4), cut(3, "y"))
        .when(c.endswith("ing") & (n > 5), cut(3))
        .when(c.endswith("ied") & (n > 4), cut(3, "y"))
        .when(c.endswith("ed") & (n > 4), cut(2))
        .when(c.endswith("es") & (n > 4), cut(2))
        .when(c.endswith("s") & (n > 3), cut(1))
        .otherwise(c)
    )


def has_devanagari(c: Column) -> Column:
    return c.rlike(r"[\x{0900}-\x{097F}]")
