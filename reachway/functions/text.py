"""Text expressions: names, codes, numbers in text, mis-decoded text."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from reachway import config

#: White space at the ends of names, by Unicode, with the separators of ASCII.
_ENDS = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"


@functools.cache
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition is one letter but for combining marks, these letters, and the decompositions of several letters. Hangul, whose letters decompose by a
    rule, and the ideographs of the planes beyond the first are left out: no name here is compared in them."""
    one, bare, several = [], [], {}
    for code in [*range(0xA0, 0xAC00), *range(0xF900, 0xFFFE)]:
        c = chr(code)
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(d) == 1 and d != c:
            one.append(c)
            bare.append(d)
        elif len(d) > 1 and d.isascii():
            several[c] = d
    return "".join(one), "".join(bare), several


#: Combining marks that may follow a letter in decomposed text.
_COMBINING = "[\\u0300-\\u036f\\u1ab0-\\u1aff\\u1dc0-\\u1dff\\u20d0-\\u20ff\\ufe20-\\ufe2f]"


def lookup(key: Column, table: Mapping, default=None) -> Column:
    """table[key], or default where the key is missing or null."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.coalesce(key, F.lit("\x00")))
    return found if default is None else F.coalesce(found, F.lit(default))


def norm_name(s: Column) -> Column:
    """Trimmed, upper-cased, in compatibility decomposition (NFKD) without its combining marks; null gives ''. Plain ASCII names, which are most, skip the decomposition."""
    upper = F.upper(F.regexp_replace(F.coalesce(s, F.lit("")), _ENDS, ""))
    one, bare, several = _decompositions()
    wide = F.regexp_replace(F.translate(upper, one, bare), _COMBINING, "")
    # a character of several letters becomes an entry of a map, one split text at a time
    letters = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])
    spelt = F.array_join(F.transform(F.split(wide, ""), lambda c: F.coalesce(F.element_at(letters, c), c)), "")
    rare = "[" + "".join(several) + "]"
    return F.when(upper.rlike("^\\p{ASCII}*$"), upper).when(wide.rlike(rare), spelt).otherwise(wide)


def to_number(s: Column) -> Column:
    """A double, or null where the text is no number; 'NaN' is no number."""
    return F.nanvl(s.try_cast("double"), F.lit(None).cast("double"))


def zero_padded(s: Column, width: int = 6) -> Column:
    """Zeros in front up to the width; longer codes stay whole."""
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def half_even_count(x: Column) -> Column:
    """Rounded half to even, as a whole number; null gives 0."""
    return F.coalesce(F.bround(x), F.lit(0)).cast("bigint")


def repaired(s: Column) -> Column:
    """UTF-8 text that was once read as Latin-1, put right; anything else stays."""
    narrow = F.when(s.rlike("^[\\x{00}-\\x{FF}]*$"), s)
    return F.coalesce(F.try_validate_utf8(F.encode(narrow, "ISO-8859-1").cast("string")), s)


def maxspeed_kmh(raw: Column) -> Column:
    """The first number of a speed tag in km/h ('30 mph' is converted); null without a number."""
    text = F.lower(F.trim(raw.cast("string")))
    number = F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    return number * F.when(text.contains("mph"), config.MPH_IN_KMH).otherwise(1.0)


def normalised_category(c: Column) -> Column:
    """A category in its canonical spelling; a null one is the text 'None'."""
    text = F.trim(F.coalesce(c, F.lit("None")))
    return F.coalesce(lookup(text, {k.strip(): v for k, v in config.CATEGORY_VARIANTS.items()}), text)


def settlement_weight(kind: Column, capital: Column, corrected: bool = False) -> Column:
    """The population weight of a settlement. The table's key 'CASERÍO' never meets an accent-free name, so that such places weigh 1; corrected gives them their 2."""
    table = {(k.replace("Í", "I") if corrected else k): v for k, v in config.SETTLEMENT_WEIGHTS.items()}
    weight = lookup(norm_name(kind), table, config.DEFAULT_WEIGHT)
    return weight * F.when(F.coalesce(capital, F.lit(False)), config.CAPITAL_BONUS).otherwise(1)


def capacity(category: Column) -> Column:
    """The capacity proxy of a category as it is written (before normalisation); 1 for others."""
    return lookup(category, config.CAPACITY_BY_CATEGORY, 1).cast("double")


def shown(value: Column, digits: int = 1) -> Column:
    """A number for display: rounded, and nothing where it is null or zero."""
    return F.when(value != 0, F.round(value, digits))
