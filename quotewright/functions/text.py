"""Text functions as column expressions.

Patterns carry ``(?U)`` where classes must be those of Unicode.  Only NFC has no built-in function; it is a pandas UDF."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_DOUBLE, _SINGLE = "\u201c\u201d\u201e\u00ab\u00bb", "\u2018\u2019\u201a\u201b\u0060\u00b4"
_DASHES = "\u2013\u2014\u2012\u2015\u2212\u2011"
#: The characters that part tokens in lexical matching.  Line breaks, tabs and double quotes don't.
SEPARATORS = " \u2014?!-,.()[]:;'/\u201c\u201d\u201e"
SEPARATOR_CLASS = "[ \u2014?!\\-,.()\\[\\]:;'/\u201c\u201d\u201e]"
SENTENCE_GAP = r"(?U)(?<=[.!?;])\s+"

#: Prefixes that are assimilated, with what stands for them.
ASSIMILATED = {
    "adt": "att", "adp": "app", "adc": "acc", "adg": "agg", "adf": "aff", "adl": "all", "adr": "arr", "adqu": "acqu",
    "inm": "imm", "inl": "ill", "inr": "irr", "inb": "imb", "conm": "comm", "conl": "coll", "conr": "corr", "conb": "comb", "conp": "comp",
}


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition."""
    return text.map(lambda t: unicodedata.normalize("NFC", t) if isinstance(t, str) else t)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def quotes(text: Column) -> Column:
    """Typographic quotation marks as ``"`` and ``'``."""
    return F.translate(text, _DOUBLE + _SINGLE, '"' * len(_DOUBLE) + "'" * len(_SINGLE))


def dashes(text: Column) -> Column:
    """Dashes of all lengths as hyphens."""
    return F.translate(text, _DASHES, "-" * len(_DASHES))


def clean(text: Column, *, unicode: bool = True, quote: bool = True, dash: bool = True, spaces: bool = True, ends: bool = True) -> Column:
    """The chosen steps, in this order: NFC, quotes, dashes, white space, ends."""
    for wanted, step in ((unicode, nfc), (quote, quotes), (dash, dashes), (spaces, collapse), (ends, strip)):
        text = step(text) if wanted else text
    return text


def sentences(text: Column) -> Column:
    """Parts between white space that follows ``. ! ? ;``, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, SENTENCE_GAP), strip), lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def latin(text: Column, *, lowercase: bool = True, fold: bool = True) -> Column:
    """Lower case, j and v as i and u, all but letters as spaces, single spaces.

    Without ``lowercase`` capitals are no letters of the pattern and go."""
    text = F.lower(text) if lowercase else text
    text = F.translate(text, "jvJV", "iuIU") if fold else text
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[^a-z]", " "), " +", " "))


def latin_tokens(text: Column, **kw) -> Column:
    return F.filter(F.split(latin(text, **kw), " "), lambda t: t != "")


def _transformed(token: Column) -> Column:
    low, first = F.lower(token), F.substring(token, 1, 1)
    out = token
    for prefix, new in reversed([*ASSIMILATED.items()]):
        out = F.when(low.startswith(prefix), F.concat(first, F.lit(new[1:]), F.substring(token, len(prefix) + 1, 1 << 30))).otherwise(out)
    after = F.substring(low, 4, 1)
    ads = F.when(after == "", token).when(after.rlike("[aeiou]"), F.concat(first, F.lit("ss"), F.substring(token, 4, 1 << 30))).otherwise(F.concat(first, F.lit("s"), F.substring(token, 4, 1 << 30)))
    return F.when(low.startswith("ads"), ads).otherwise(out)


def assimilate(text: Column) -> Column:
    """Prefixes of the tokens assimilated in turn, each in every place of the text where the token's letters stand.

    Only tokens that begin with one of the prefixes are looked at, each distinct one once: replacing it again changes nothing."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]"), 0)
    some = "(?i)^(" + "|".join([*ASSIMILATED, "ads"]) + ")"
    wanted = F.filter(tokens, lambda t: t.rlike(some))
    return F.aggregate(wanted, text, lambda now, t: F.replace(now, t, _transformed(t)))


def phrased(text: Column, *, poetry: bool) -> Column:
    """Quotation marks as ``'``, enclitics joined to the word before, stripped; verse gets `` /`` at its end."""
    text = F.concat(text, F.lit(" /")) if poetry else text
    text = F.translate(text, '"\u201c\u201d\u201e\'\u2018\u2019', "'" * 7)
    return strip(F.regexp_replace(text, r" (que|ve|ue)([ ,.!?])", "$1$2"))


def folded(text: Column) -> Column:
    """As compared in lexical matching: v and j as u and i, lower case."""
    return F.regexp_replace(F.lower(F.translate(text, "vjVJ", "uiUI")), "\u00e2\u0080\u009c|\u00e2\u0080\u009d|\u009c|\u009d|\u00ef\u00bb\u00bf", "")


def tokens(text: Column) -> Column:
    """Tokens between the separators of lexical matching."""
    return F.filter(F.split(text, SEPARATOR_CLASS + "+"), lambda t: t != "")


def clamped_cosine(c: Column) -> Column:
    """(cosine + 1) / 2 within [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c + 1) / 2))
