"""Names, contract symbols and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions import clock


def slug(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def asset_symbol(x) -> Column:
    return F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")


# Quarterly month codes.
QUARTER_CODES = {3: "H", 6: "M", 9: "U", 12: "Z"}


def quarterly_contract(day: Column, root: str) -> tuple[Column, Column]:
    """Front quarterly contract symbol of a date and its third-Friday expiration."""
    month = (F.ceil(F.month(day) / 3.0) * 3).cast("int")
    code = F.element_at(F.create_map(*[F.lit(v) for kv in QUARTER_CODES.items() for v in kv]), month)
    year = F.year(day)
    symbol = F.concat(F.lit(root), code, F.floor(F.pmod(year, F.lit(100)) / 10).cast("string"), F.pmod(year, F.lit(10)).cast("string"))
    return symbol, clock.third_friday(F.make_date(year, month, F.lit(1)))


def content_hash(fields: dict[str, Column]) -> Column:
    """sha256 of the JSON object with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)
