"""Column expressions that read values written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for a missing value, and the spellings of split names.
MISSING_WORDS = ("", "-", "--", "–", "—", "unknown", "n/a", "na", "none", "null", "nil", "nan", "missing", "undefined")
SPLIT_NAMES = {
    "train": ("train", "training"),
    "validation": ("validation", "valid", "val", "dev"),
    "test": ("test", "testing", "eval", "evaluation"),
}


def trimmed(col: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col, r"^[\s ​﻿]+|[\s ​﻿]+$", "")


def present(col: Column) -> Column:
    """The value as written, or NULL where it only says that there is none."""
    return F.when(~F.lower(trimmed(col)).isin(*MISSING_WORDS), col)


def name_key(col: Column) -> Column:
    """One spelling for a name: trimmed, lower case, runs of separators as one hyphen; missing values are NULL."""
    return F.regexp_replace(F.lower(trimmed(present(col))), r"[\s_\-]+", "-")


def hex_key(col: Column, digits: int) -> Column:
    """The last ``digits`` hex digits, whatever the case, separators, padding and prefix; NULL where there are fewer."""
    packed = F.regexp_replace(F.lower(present(col)), r"[^0-9a-z]", "")
    found = F.regexp_extract(packed, rf"([0-9a-f]{{{digits}}})$", 1)
    return F.when(found != "", found)


def split_key(col: Column) -> Column:
    """``train``, ``validation``, ``test`` or NULL."""
    word = F.lower(trimmed(col))
    out = F.lit(None).cast("string")
    for name, spellings in reversed(SPLIT_NAMES.items()):
        out = F.when(word.isin(*spellings), F.lit(name)).otherwise(out)
    return out
