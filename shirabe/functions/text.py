"""Text cleansing, validation, masking and small conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Full-width digits and hyphen with their ASCII forms.
WIDE = "０１２３４５６７８９－"
NARROW = "0123456789-"

# Shapes of valid and of leaked personal data.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_DOMESTIC = r"^\d{2,4}-\d{4}-\d{4}$"
PHONE_INTERNATIONAL = r"^\+\d{1,3}-\d{2,4}-\d{4}-\d{4}$"

# Factor per (from, to) unit.
UNIT_FACTORS = {
    ("g", "kg"): 0.001,
    ("m", "km"): 0.001,
    ("cm", "m"): 0.01,
    ("seconds", "hours"): 1 / 3600,
}

BLANKS = ["", "N/A"]


def cleanse(text: Column) -> Column:
    """Trim, collapse blanks of any width to one, narrow full-width digits and hyphens."""
    single = F.regexp_replace(text, r"(?U)[\s\x{1c}-\x{1f}]+", " ")
    return F.translate(F.trim(single), WIDE, NARROW)


def normalise_key(text: Column) -> Column:
    """Cleansed and lower-cased text, for comparing names."""
    return F.lower(cleanse(text))


def zero_pad(value: Column, width: int) -> Column:
    """The last ``width`` digits of a number, with zeros before a shorter one."""
    return F.right(F.concat(F.lit("0" * width), value.cast("string")), F.lit(width))


def numbered(value: Column, width: int) -> Column:
    """A number with zeros to at least ``width`` digits; a longer one is not cut."""
    digits = value.cast("string")
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def phone_jp(text: Column) -> Column:
    """Mobile number as XXX-XXXX-XXXX, a leading country code 81 stripped, else NULL."""
    digits = F.regexp_replace(text, r"\D", "")
    local = F.when(digits.startswith("81") & (F.length(digits) > 11), F.substring(digits, 3, 64)).otherwise(digits)
    shaped = F.concat_ws("-", F.substring(local, 1, 3), F.substring(local, 4, 4), F.substring(local, 8, 4))
    return F.when(local.rlike(r"^0[789]0\d{8}$"), shaped)


def fill_blank(value: Column, default: object, blanks: list[str] = BLANKS) -> Column:
    """``default`` where the value is NULL, empty or a stand-in for 'no value'."""
    return F.when(value.isNull() | value.cast("string").isin(blanks), F.lit(default)).otherwise(value)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def convert_unit(value: Column, src: Column, dst: Column, factors: dict = UNIT_FACTORS) -> Column:
    """Value times the factor of its (from, to) pair; unknown pairs pass through."""
    pairs = [x for (a, b), f in factors.items() for x in (F.lit(f"{a}>{b}"), F.lit(f))]
    factor = F.try_element_at(F.create_map(*pairs), F.concat_ws(">", src, dst))
    return value * F.coalesce(factor, F.lit(1.0))


def encode(value: Column, mapping: dict[str, int], default: int = 0) -> Column:
    """Number of a category by dictionary, ``default`` if unknown."""
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(default))


def is_email(text: Column) -> Column:
    return F.coalesce(text.rlike(EMAIL), F.lit(False))


def is_phone(text: Column) -> Column:
    return F.coalesce(text.rlike(PHONE_DOMESTIC) | text.rlike(PHONE_INTERNATIONAL), F.lit(False))


def in_range(value: Column, low: float, high: float) -> Column:
    return F.coalesce(value.between(low, high), F.lit(False))


def has_required(df: DataFrame, fields: list[str]) -> Column:
    """True when every field exists, is not NULL and not blank."""
    if any(f not in df.columns for f in fields):
        return F.lit(False)
    out = F.lit(True)
    for f in fields:
        out = out & F.coalesce(F.length(cleanse(F.col(f).cast("string"))) > 0, F.lit(False))
    return out


def mask_name(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.concat(F.left(text, F.lit(1)), F.repeat(F.lit("*"), F.length(text) - 1)))


def mask_email(text: Column) -> Column:
    """First letter and domain stay, the rest of the local part is starred."""
    at = F.instr(text, "@")
    masked = F.concat(F.left(text, F.lit(1)), F.repeat(F.lit("*"), at - 2), F.substring(text, at, F.length(text)))
    return F.when(text.rlike(r"^[^@]+@[^@]+$"), masked)


def mask_phone(text: Column) -> Column:
    return F.concat(F.left(text, F.lit(3)), F.lit("-****-"), F.right(text, F.lit(4)))


def mask_card(text: Column) -> Column:
    return F.concat(F.repeat(F.lit("*"), F.lit(12)), F.right(text, F.lit(4)))


def safe_cast(value: Column, to: str) -> Column:
    """Cast that yields NULL instead of failing."""
    return value.try_cast(to)
