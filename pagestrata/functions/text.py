"""Column expressions over text: whitespace, truncation, script ratio and cleaning route."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$".replace("|(?U)", "|"), "")


def squeeze(text: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{_SPACE}+", " "))


def is_blank(text: Column) -> Column:
    """Null, empty or only blanks."""
    return F.coalesce(~text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(True))


def shorten(text: Column, size: int = 200) -> Column:
    """The first ``size`` characters with an ellipsis where there are more."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def cyrillic_share(html: Column, window: int = 2000) -> Column:
    """Cyrillic over Cyrillic and Latin letters in the first ``window`` characters; null where there are none."""
    head = F.substring(html, 1, window)
    cyrillic = F.regexp_count(head, F.lit(r"[Ѐ-ӿ]"))
    latin = F.regexp_count(head, F.lit(r"[A-Za-zİK]"))
    return F.try_divide(cyrillic, cyrillic + latin)


def is_cyrillic(html: Column, threshold: float = 0.2) -> Column:
    """Whether the share of Cyrillic letters is above the threshold."""
    return F.coalesce(cyrillic_share(html) > threshold, F.lit(False))


def clean_route(html: Column, has_metadata: Column, force_basic: bool = False, prefer_basic: bool = False, threshold: float = 0.2) -> Column:
    """(route, reason): basic where it is forced or preferred, for archived pages and Cyrillic text, else ai."""
    answer = lambda route, why: F.struct(F.lit(route).alias("route"), F.lit(why).alias("reason"))
    if force_basic:
        return answer("basic", "forced")
    if prefer_basic:
        return answer("basic", "preferred")
    return F.when(has_metadata, answer("basic", "archived")).when(is_cyrillic(html, threshold), answer("basic", "cyrillic")).otherwise(answer("ai", "default"))
