"""Numbers of JSON documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRING = r'"(?:[^"\\]|\\.)*+"'
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def collect_numbers(document: Column) -> Column:
    """Every number of a JSON document, however deep it stands, in the document's order; null if it isn't JSON.

    Outside of its strings a document holds no digits but those of numbers, so names and texts are cut
    out first. Numbers beyond a double's range are left out.
    """
    plain = F.regexp_replace(document, STRING, "")
    found = F.transform(F.regexp_extract_all(plain, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))
    return F.when(F.try_parse_json(document).isNotNull(), F.filter(found, lambda x: F.abs(x) < float("inf")))
