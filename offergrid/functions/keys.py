"""The four identities of a listing; they are kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def term_id(term: Column, term_code: Column) -> Column:
    """The term code, or the term name where the code is null or blank."""
    return F.coalesce(F.when(term_code != "", term_code), term)


def physical_key(term: Column, term_code: Column, schedule: Column) -> Column:
    return F.concat_ws("|", term_id(term, term_code), schedule)


def offering_key(term: Column, term_code: Column, subject: Column, crse_id: Column, code: Column,
                 offer: Column, career: Column) -> Column:
    return F.concat_ws("|", term_id(term, term_code), subject, F.coalesce(crse_id, code), filled(offer),
                       filled(career))


def detail_key(subject: Column, crse_id: Column, code: Column, offer: Column, career: Column) -> Column:
    return F.concat_ws("|", subject, F.coalesce(crse_id, code), filled(offer), filled(career))


def snapshot_key(subject: Column, crse_id: Column, number: Column, offer: Column, career: Column) -> Column:
    """As ``detail_key``, but a missing id falls back to the catalog number."""
    return F.concat_ws("|", subject, F.coalesce(crse_id, F.concat(F.lit("catalog:"), number)), filled(offer),
                       filled(career))


def catalog_identity(subject: Column, number: Column, career: Column) -> Column:
    return F.concat_ws("|", subject, number, filled(career))
