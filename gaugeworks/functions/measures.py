"""Measurement texts, fixed-point scaling and quality flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gaugeworks.schemas import QC_BITS, SCALES

# The strict decoder takes a number only when it begins with a digit or a minus.
STRICT_NUMBER = r"^(-(?=[0-9.])|(?=[0-9]))([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
_LARGEST = 1.7976931348623157e308


def _is_plain(text: Column) -> Column:
    """Whether a text that casts to a double is a decimal number without padding.

    The cast also takes padding, a type's letter at the end, names of infinity and hex
    digits.  Looking at both ends for those costs half of what a pattern does.
    """
    last = F.substring(text, -1, 1)
    return (
        (text >= "+") & (last.between("0", "9") | (last == "."))
        & ~text.contains("x") & ~text.contains("X")
    )


def parse_number(text: Column) -> Column:
    """Number in ``text``; 0 for missing or malformed texts, infinite on overflow."""
    value = F.when(_is_plain(text), text).try_cast("double")
    return F.coalesce(value, F.lit(0.0))


def measure_value(measure: Column) -> Column:
    """Value of a measurement; 0 when it is missing, malformed or overflows."""
    value = parse_number(measure["Value"])
    return F.when(F.abs(value) <= _LARGEST, value).otherwise(F.lit(0.0))


def is_strict_number(text: Column) -> Column:
    value = text.try_cast("double")
    return F.coalesce(text.rlike(STRICT_NUMBER) & (F.abs(value) <= _LARGEST), F.lit(False))


def to_int(value: Column) -> Column:
    """Truncate toward zero; a number that no INT can hold becomes 0."""
    return F.coalesce(value.try_cast("int"), F.lit(0))


def scale(value: Column, kind: str) -> Column:
    """Fixed-point form of ``value``: 32-bit multiply, then truncate."""
    return to_int(value.cast("float") * F.lit(SCALES[kind]).cast("float"))


def unscale(raw: Column, kind: str) -> Column:
    return raw.cast("double") / F.lit(SCALES[kind])


def qc_flagged(measure: Column) -> Column:
    """True when the quality code marks a problem; blank and empty are good."""
    return ~F.coalesce(measure["Qc"], F.lit("")).isin("", " ")


def qc_bits(**flagged: Column) -> Column:
    """Bit set with the bit of each named measurement whose flag is true."""
    bits = F.lit(0)
    for name, flag in flagged.items():
        bits = bits.bitwiseOR(F.when(flag, F.lit(QC_BITS[name])).otherwise(F.lit(0)))
    return bits


def qc_names(flags: Column) -> Column:
    """Names of the bits set in ``flags``, lowest bit first."""
    named = F.array(*(
        F.when(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in QC_BITS.items()
    ))
    return F.array_compact(named)


def format_measure(value: Column, qc: Column) -> Column:
    """Numeric measurement as a text measurement with two decimals, no unit."""
    return F.when(
        value.isNotNull(),
        F.struct(
            F.format_string("%.2f", value).alias("Value"),
            qc.alias("Qc"),
            F.lit("").alias("Unit"),
        ),
    )
