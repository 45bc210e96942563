"""Text functions that have no single built-in, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of MySQL's DATE_FORMAT and the pattern of date_format for each.
DATE_CODES = {"Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "h": "hh", "i": "mm", "s": "ss", "j": "DDD", "W": "EEEE", "a": "EEE", "M": "MMMM", "b": "MMM", "p": "a"}


def mysql_date_format(ts: Column, codes: str) -> Column:
    """ts formatted by MySQL codes; other text, and a code without meaning, is kept as it is."""
    parts = []
    for part in re.findall(r"%.|[^%]+", codes):
        known = DATE_CODES.get(part[1:]) if part[0] == "%" else None
        parts.append(F.date_format(ts, known) if known else F.lit(part[1:] if part[0] == "%" else part))
    return F.concat(*parts)


def truncate(x: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def trigrams(s: Column) -> Column:
    padded = F.concat(F.lit(" "), s, F.lit(" "))
    return F.when(F.length(padded) >= 3, F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def similarity(a: Column, b: Column) -> Column:
    """Dice coefficient of trigram multisets."""
    x, y = trigrams(a), trigrams(b)
    times = lambda grams, g: F.size(F.filter(grams, lambda t: t == g))
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda acc, g: acc + F.least(times(x, g), times(y, g)))
    total = F.size(x) + F.size(y)
    return F.when(total == 0, 0.0).otherwise(2.0 * common / total)


def snippet(text: Column, query: str, length: int = 150) -> Column:
    """length characters from 30 before the first place where a word of the query occurs, else the text's front.

    An ellipsis stands for what is left out on either side.  Signs before words play no part.
    """
    words = [w for w in (x.removeprefix(x[0]) if x[0] in "+-" else x for x in query.lower().split()) if w]
    low = F.lower(text)
    places = [F.when(F.locate(w, low) > 0, F.locate(w, low)) for w in words]
    first = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(1)) if places else F.lit(1)
    start = F.greatest(F.lit(1), first - 30)
    front, behind = F.when(start > 1, "...").otherwise(""), F.when(start - 1 + length < F.length(text), "...").otherwise("")
    return F.concat(front, F.substring(text, start, F.lit(length)), behind)
