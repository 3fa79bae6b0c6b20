"""Text cleaning and measuring as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the characters that count as white space in Unicode text stripping.
WHITE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = "".join(f"\\x{{{ord(c):X}}}" for c in WHITE_CHARS)
#: Control characters but tab, line feed and carriage return.
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


@dataclass(frozen=True)
class CleanRules:
    strip_controls: bool = True
    require_valid: bool = True
    min_chars: int = 16


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, "")


def unicode_strip(text: Column) -> Column:
    """In one pass from either end, however many blanks there are."""
    return F.btrim(text, F.lit(WHITE_CHARS))


def unicode_rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE_CHARS))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{WHITE}]+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def cleaned(text: Column, rules: CleanRules = CleanRules()) -> Column:
    """The cleaned text; whether it is kept, ``kept`` says."""
    return unicode_strip(strip_controls(text) if rules.strip_controls else text)


def drop_reason(text: Column, rules: CleanRules = CleanRules()) -> Column:
    """Why cleaning drops a text, or ``kept``."""
    t = cleaned(text, rules)
    reason = F.when(text.isNull() | (text == ""), "missing").when(t == "", "blank").when(F.length(t) < rules.min_chars, "short")
    if rules.require_valid:
        reason = reason.when(~F.is_valid_utf8(text), "invalid")
    return reason.otherwise("kept")


def clean(df: DataFrame, rules: CleanRules = CleanRules(), text_col: str = "text") -> DataFrame:
    """Replaces the text by its cleaned form and drops rows that are missing, blank, short or invalid.

    Validity is asked of the text as it came, since regular expressions repair it.
    """
    out = df.where(F.col(text_col).isNotNull())
    out = out.where(F.is_valid_utf8(text_col)) if rules.require_valid else out
    out = out.withColumn(text_col, cleaned(F.col(text_col), rules))
    return out.where((F.col(text_col) != "") & (F.length(text_col) >= rules.min_chars))


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it."""
    import unicodedata

    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def language_tag(name: Column, subset: Column, code: str = "ko", other: str = "en") -> Column:
    """``code`` wherever it is part of the source's name or subset, else ``other``."""
    return F.when(F.lower(F.concat_ws(" ", name, subset)).contains(code), code).otherwise(other)


def source_label(run_name: Column, checkpoint: Column, file: Column) -> Column:
    """The run's name, else the checkpoint's folder and stem, else the file's stem; blank values fall through."""
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")
    parts = F.split(checkpoint, "/")
    folder = F.when(F.size(parts) >= 2, F.concat(F.try_element_at(parts, F.lit(-2)), F.lit("/"), stem(checkpoint))).otherwise(stem(checkpoint))
    return F.coalesce(F.nullif(run_name, F.lit("")), F.when(checkpoint != "", folder), stem(file))
