"""Publication dates in the forms that feeds use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WEEKDAY = r"^[A-Za-z]{3},\s*"
#: Patterns tried in order; those with seconds need no weekday, those without do.
WITH_SECONDS = ("d MMM yyyy H:mm:ss Z", "d MMM yyyy H:mm:ss z")
WITHOUT_SECONDS = ("d MMM yyyy H:mm Z", "d MMM yyyy H:mm z")
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"


def parse_date(raw: Column) -> Column:
    """A timestamp, or null if no form fits. Dates without a zone are UTC's."""
    text = F.trim(raw)
    day = F.regexp_replace(text, _WEEKDAY, "")
    iso = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    whole = F.when(text.rlike(ISO), F.try_to_timestamp(iso))
    known = text.rlike(r"^([A-Za-z]{3},\s*)?\d{1,2} [A-Za-z]{3} \d{4} ")
    tries = [F.when(known, F.try_to_timestamp(day, F.lit(p))) for p in WITH_SECONDS]
    tries += [F.when(known & text.rlike(_WEEKDAY), F.try_to_timestamp(day, F.lit(p))) for p in WITHOUT_SECONDS]
    plain = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} "), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss Z")))
    only = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(text, F.lit("T00:00:00Z"))))
    return F.coalesce(whole, *tries, plain, only)


def parse_pub_date(published: Column, updated: Column, pub_date: Column) -> Column:
    """The first of the three that can be read; null (which sorts last) if none can."""
    return F.coalesce(*[F.when(c != "", parse_date(c)) for c in (published, updated, pub_date)])


def edition_date(published_at: Column) -> Column:
    """The local day, so that a day of 23 or 25 hours is still one edition."""
    return F.to_date(published_at)
