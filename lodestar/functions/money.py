"""Money amounts in text, and unit conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wordlists import TURNOVER_UNITS

#: fixed pattern of an amount with its unit
AMOUNT = r"(?<![0-9])([0-9]+(?:\.[0-9]+)?)\s*(lakh|lakhs|lac|lacs|crore|crores|cr)\b"


def amounts_in_lakh(text: Column) -> Column:
    """Distinct amounts of the text, in lakh: ``1 crore`` is 100. Amounts beyond 22 digits are left out."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    numbers = F.regexp_extract_all(lowered, F.lit(AMOUNT), 1)
    units = F.regexp_extract_all(lowered, F.lit(AMOUNT), 2)
    lakhs = F.zip_with(
        numbers,
        units,
        lambda n, u: (
            n.try_cast("decimal(28,6)") * F.when(u.startswith("cr"), F.lit(100)).otherwise(F.lit(1))
        ).try_cast("decimal(28,6)"),
    )
    return F.array_distinct(F.array_compact(lakhs))


#: fixed values: written forms searched for one requested amount
LAKH_FORMS = ("lakh", "lakhs", "lac", "lacs")
CRORE_FORMS = ("crore", "crores", "cr")
AMOUNT_PREFIXES = ("", "rs ", "rs. ", "₹", "₹ ")


def amount_variants(number: Column, unit: Column) -> Column:
    """Spellings of an amount: number forms x unit forms x currency prefixes."""
    two = F.format_string("%.2f", number.cast("double"))
    short = F.when(two.endswith(".00"), two).otherwise(F.regexp_replace(two, r"\.?0+$", ""))
    numbers = F.array_distinct(F.array(number, short, two))
    units = F.when(
        unit.startswith("cr"), F.array(*[F.lit(u) for u in CRORE_FORMS])
    ).otherwise(F.array(*[F.lit(u) for u in LAKH_FORMS]))
    prefixes = F.array(*[F.lit(p) for p in AMOUNT_PREFIXES])
    return F.flatten(
        F.transform(
            numbers,
            lambda n: F.flatten(
                F.transform(
                    units,
                    lambda u: F.transform(prefixes, lambda p: F.concat(p, n, F.lit(" "), u)),
                )
            ),
        )
    )


def turnover_in_rupees(amount: Column, unit: Column) -> Column:
    factor = F.lit(1)
    for name, value in TURNOVER_UNITS.items():
        factor = F.when(unit == name, F.lit(value)).otherwise(factor)
    return (amount.cast("decimal(16,2)") * factor).cast("decimal(24,2)")


def age_in_months(years: Column) -> Column:
    """Whole months of an age given in (fractional) years."""
    return F.floor(years.cast("decimal(10,4)") * 12).cast("int")
