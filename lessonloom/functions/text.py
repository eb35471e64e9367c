"""Text columns: composed form, letter keys, line and word splitting, normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts of these code points only are composed as they are. One anchored, possessive class is a single tight pass.
_COMPOSED = r"\A[\x{0}-\x{2ff}\x{1e00}-\x{1eff}\x{2010}-\x{2027}\x{2030}-\x{205e}]*+\z"


@F.pandas_udf(T.StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    def one(x):
        if x is None:
            return None
        y = unicodedata.normalize("NFD", x).replace("đ", "d").replace("Đ", "D")
        return " ".join("".join(c for c in y if not unicodedata.category(c).startswith("M")).lower().split())

    return s.map(one)


@F.pandas_udf(T.StringType())
def _compat(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfc(c: Column) -> Column:
    """Composed form. Only texts that may change leave the JVM; all others pass the Arrow step as nulls."""
    return F.coalesce(_compose(F.when(~c.rlike(_COMPOSED), c)), c)


def nfkc(c: Column) -> Column:
    """Compatibility form, by the same route."""
    return F.coalesce(_compat(F.when(c.rlike(r"[^ -~\n]"), c)), c)


def search_fold(c: Column) -> Column:
    """Lower case without marks and with single spaces: the form in which search terms are compared."""
    return _fold(c)


def letter_key(c: Column) -> Column:
    """The letters of a composed text, lower case; digits, punctuation and spacing are dropped."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}]+", "")


def lines(c: Column) -> Column:
    """Lines of a text, ended by line feeds only; empty lines count."""
    return F.split(c, "\n", -1)


def normalize_text(c: Column) -> Column:
    """Line ends to LF, runs of blanks to one, at most one empty line, outer white space off."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Runs of letters, digits and low lines."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def nullif_blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)
