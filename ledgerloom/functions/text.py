"""Text normalisation and numeric literals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a standalone number, optionally signed, grouped, with currency sign or percent.
NUMBER = (
    r"(?<![A-Za-z0-9_])[₹$€£]?\s*-?"
    r"(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?|\.[0-9]+)"
    r"%?(?![A-Za-z0-9_])"
)


def squeezed(text: Column) -> Column:
    """Lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def normalise_text(text: Column) -> Column:
    """Lower case; commas and percent signs dropped; other punctuation to spaces; squeezed."""
    bare = F.regexp_replace(F.lower(text), "[,%]", "")
    return F.trim(F.regexp_replace(bare, r"[^a-z0-9._\-]+", " "))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may use it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def canonical_number(text: Column) -> Column:
    """Exact decimal text: no grouping, signs or units, no padding zeros. ``10,000.00`` is ``10000``."""

    def joined(bare: Column) -> Column:
        whole = F.ltrim(F.regexp_extract(bare, r"^-?([0-9]*)", 1), F.lit("0"))
        part = F.rtrim(F.regexp_extract(bare, r"\.([0-9]*)", 1), F.lit("0"))
        size = once(
            F.struct(whole.alias("w"), part.alias("p")),
            lambda x: F.concat(
                F.when(x["w"] == "", "0").otherwise(x["w"]), F.when(x["p"] == "", "").otherwise(F.concat(F.lit("."), x["p"]))
            ),
        )
        return once(size, lambda n: F.when(bare.startswith("-") & (n != "0"), F.concat(F.lit("-"), n)).otherwise(n))

    return once(F.translate(text, "₹$€£%, \t\n\x0b\f\r", ""), joined)


def numeric_literals(text: Column) -> Column:
    """Distinct standalone numbers of a text as canonical decimals; digits inside identifiers do not count."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, canonical_number))


def contains_normalised(text: Column, value: Column) -> Column:
    return F.contains(squeezed(text), squeezed(value))
