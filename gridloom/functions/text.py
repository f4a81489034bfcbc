"""Scalar expressions on text: names, codes, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.numbers import safe_number

#: Texts that mean "not known", and what they become.
MISSING_TEXTS = ("unknown", "don't know", "nan")
NUMERIC_TEXTS = {"none": "0", "95 or more": "95"}
COUNTRY_CODES = {"sg": "Senegal", "gh": "Ghana"}


def prefix(c: Column, n: int = 2) -> Column:
    return F.substring(c, 1, n)


def country_year(name: Column, codes: dict[str, str] | None = None) -> tuple[Column, Column]:
    """Country and year of a name such as sg2019; an unknown code raises."""
    known = F.create_map(*[F.lit(x) for kv in (codes or COUNTRY_CODES).items() for x in kv])
    code = F.lower(F.substring(name, 1, 2))
    country = F.coalesce(F.try_element_at(known, code), F.raise_error(F.concat(F.lit("unknown country code: "), code)).cast("string"))
    return country, safe_number(F.substring(name, 3, 4)).cast("int")


def year_in_name(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(20\d{2})", 1), F.lit("")).cast("int")


def kind_in_name(c: Column) -> Column:
    """inferred or labelled, as a file's name says; else null."""
    return F.when(c.contains("inferred"), "inferred").when(c.contains("labelled"), "labelled")


def part(c: Column, separator: str, i: int) -> Column:
    return F.get(F.split(c, separator), F.lit(i))


def case_variants(values: list[str]) -> list[str]:
    """Each value as it is, in lower and in upper case and capitalized; other mixtures aren't among them."""
    return list(dict.fromkeys(v for x in values for v in (x, x.lower(), x.upper(), x.capitalize())))


def null_texts(c: Column, values: tuple[str, ...] = MISSING_TEXTS) -> Column:
    return F.when(~c.isin(case_variants(list(values))), c)


def numeric_texts(c: Column, values: dict[str, str] | None = None) -> Column:
    """Texts that name a number become its digits."""
    out = c
    for k, v in (values or NUMERIC_TEXTS).items():
        out = F.when(c.isin(case_variants([k])), v).otherwise(out)
    return out


def mapped(c: Column, codes: dict[str, str]) -> Column:
    """The code's label; codes that aren't known stay, null stays null."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), c), c)


def typed(c: Column, kind: str) -> Column:
    """A filled value in the type of its column: whole numbers rounded, numbers as they are, all else as text."""
    if kind in ("int", "bigint"):
        return F.round(c).cast(kind)
    return c.cast(kind)


def percent_text(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", c)


def unquoted_list(c: Column) -> Column:
    """The doubles of a list written as text, with single or double quotes around or without."""
    return F.from_json(F.translate(c, "'\"", ""), "array<double>")


def listed_texts(c: Column) -> Column:
    return F.from_json(F.translate(c, "'", '"'), "array<string>")
