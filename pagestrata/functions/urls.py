"""Column expressions over urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)([^#]*)"


def url_key(url: Column) -> Column:
    """The url without scheme, leading ``www.``, port, fragment and trailing slashes; host in lower case, query kept.

    Null for a null url; an empty url gives an empty key.
    """
    host = F.lower(F.regexp_extract(url, _SPLIT, 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":[0-9]*$", "")
    return F.regexp_replace(F.concat(host, F.regexp_extract(url, _SPLIT, 2)), r"/+$", "")
