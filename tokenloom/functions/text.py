"""Text functions that Spark has under other names or not at all."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FINAL_MARKS

#: Unicode White_Space; Spark's trim() knows U+0020 alone.
WHITE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _ends(white: str) -> str:
    """White space at either end; a run in the middle is looked at from its start alone, so long ones don't cost their square."""
    return f"^[{white}]+|(?<![{white}])[{white}]+$"


def trim_white(c):
    return F.regexp_replace(c, _ends(WHITE), "")


def strip(c):
    """As trim_white, with U+001C to U+001F."""
    return F.regexp_replace(c, _ends(WHITE + r"\x{1C}-\x{1F}"), "")


def ends_with_punctuation(sentence):
    last = F.right(strip(sentence), F.lit(1))
    return (F.length(last) > 0) & F.lit(FINAL_MARKS).contains(last)


# Marks that compare equal to plainer ones.
PLAIN = {
    "\u2019": "'", "\u2018": "'", "\u201C": '"', "\u201D": '"', "\u2013": "-", "\u2014": "-", "\u2026": "...", "\u00A0": " ", "\u202F": " ", "\u2009": " ", "\u200A": " ", "\u200B": "", "\u3000": " ",
}


def normal(text: str) -> str:
    """Without combining marks (after canonical decomposition), quotes, dashes and spaces made plain."""
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M"))
    return text.translate({ord(k): v for k, v in PLAIN.items()})


@F.pandas_udf(T.StringType())
def normalize_unicode(texts: pd.Series) -> pd.Series:
    return texts.map(normal, na_action="ignore")
