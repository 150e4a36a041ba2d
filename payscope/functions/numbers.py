"""Numbers stated in running text: find them, read them, compare them with evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from payscope.functions.text import WHITE_SPACE

# The spellings of a stated number (money, grouped, decimal, bare) and of a
# citation marker. A bare number may not follow a letter or a hyphen (the 1 of "ABC-1").
NUMBER = (
    r"\$\d[\d,]*(?:\.\d+)?"
    r"|\d{1,3}(?:,\d{3})+(?:\.\d+)?%?"
    r"|\d+\.\d+%?"
    r"|(?<![A-Za-z-])\d+%?"
)
MARKER = r"\[([A-Za-z0-9_-]+)\]"

# The same with a look-ahead in front, so that most characters of a text cost one test.
FAST_NUMBER = rf"(?=[$0-9])(?:{NUMBER})"
FAST_TOKEN = rf"(?=[\[$0-9])(?:\[[A-Za-z0-9_-]+\]|{NUMBER})"
HAS_DIGIT = "[0-9]"
HAS_DIGIT_OR_MARKER = r"[0-9\[]"

# Spellings that scoring looks for (see operators/scoring.py and canary.py).
SCORED_NUMBER = r"\$?-?\d[\d,]*(?:\.\d+)?%?"
CANARY_NUMBER = r"(?<![A-Za-z0-9-])-?\d[\d,]*(?:\.\d+)?"

# Tolerances.
RELATIVE_TOLERANCE = 0.005
DERIVATION_TOLERANCE = 1e-6

_BLANK = "^[" + "".join(f"\\u{ord(c):04x}" for c in WHITE_SPACE) + "]*$"


def is_blank(gap: Column) -> Column:
    return gap.rlike(_BLANK)


def is_year(raw: Column) -> Column:
    """A bare year from 1900 to 2099, which states no amount."""
    return raw.rlike(r"^(?:19|20)\d\d%?$")


def is_year_strict(raw: Column) -> Column:
    """The rule of the web variant: no percent sign, but leading zeros."""
    return raw.rlike(r"^0*(?:19|20)\d\d$")


def stated_value(raw: Column) -> Column:
    return F.regexp_replace(raw, "[$,%]", "").try_cast("double")


def stated_decimals(raw: Column) -> Column:
    """Digits after the decimal point of a stated number."""
    tail = F.regexp_extract(raw, r"\.(\d+)", 1)
    return F.length(tail)


def all_numbers(text: Column, pattern: str) -> Column:
    """Every match of the pattern as text, in order of appearance."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def numeric_leaves(payload: Column) -> Column:
    """All numbers in a JSON document of any shape and depth, as `array<double>`.

    Numbers count as they are, texts are searched for stated numbers, keys and booleans do not
    count. The document is read as a flat run of its keys, texts and numbers, so that nesting
    needs neither recursion nor a depth limit. Two control characters, which JSON does not allow
    inside a text, stand in for escaped backslashes and quotes meanwhile.
    """
    flat = F.replace(
        F.replace(payload, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02")
    )
    scalars = F.regexp_extract_all(
        flat, F.lit(r'"[^"]*"\s*:|"[^"]*"|-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?'), F.lit(0)
    )
    values = F.filter(scalars, lambda s: ~s.endswith(":"))

    def text_numbers(scalar: Column) -> Column:
        quoted = F.replace(
            F.replace(scalar, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\")
        )
        texts = F.from_json(F.concat(F.lit("["), quoted, F.lit("]")), "array<string>")
        plain = F.get(texts, F.lit(0))
        stated = F.filter(all_numbers(plain, FAST_NUMBER), lambda n: ~is_year(n))
        return F.transform(stated, stated_value)

    return F.flatten(
        F.transform(
            values,
            lambda s: F.when(s.startswith('"'), text_numbers(s)).otherwise(
                F.array(s.try_cast("double"))
            ),
        )
    )


def whole_number_leaves(payload: Column) -> Column:
    """The web variant: a text counts only when all of it is one number."""
    flat = F.replace(
        F.replace(payload, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02")
    )
    scalars = F.regexp_extract_all(
        flat, F.lit(r'"[^"]*"\s*:|"[^"]*"|-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?'), F.lit(0)
    )
    values = F.filter(scalars, lambda s: ~s.endswith(":"))
    bare = F.transform(values, lambda s: F.replace(F.replace(s, F.lit('"')), F.lit(",")))
    plain = F.filter(
        bare, lambda s: s.rlike(r"^\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*$")
    )
    return F.transform(plain, lambda s: F.trim(s).try_cast("double"))


def _halves(x: Column) -> tuple[Column, Column]:
    """A double as the exact sum of two of half its digits (Veltkamp)."""
    wide = x * 134217729.0
    high = wide - (wide - x)
    return high, x - high


def rounds_to(candidate: Column, claim: Column, decimals: Column) -> Column:
    """Is the claim the candidate rounded to that many decimals, exact halves to even?

    Decided on the exact product of the candidate and the power of ten (Dekker): plain double
    arithmetic would err for values such as 0.345, which is a little less than it looks.
    """
    power = F.pow(F.lit(10.0), decimals.cast("double"))
    shown = F.rint(claim * power)
    product = candidate * power
    (c_high, c_low), (p_high, p_low) = _halves(candidate), _halves(power)
    lost = c_low * p_low - (((product - c_high * p_high) - c_low * p_high) - c_high * p_low)
    off = product - shown
    beyond_half = (F.abs(off) - 0.5) + F.when(off < 0, -lost).otherwise(lost)
    return (beyond_half < 0) | ((beyond_half == 0) & (F.pmod(shown, F.lit(2.0)) == 0))


def close(claim: Column, candidate: Column, decimals: Column) -> Column:
    """Is the candidate what the claim states?

    Equal, or within half a percent, or equal once rounded to the decimals the claim shows.
    """
    base = F.when(candidate != 0, F.abs(candidate)).when(claim != 0, F.abs(claim)).otherwise(1.0)
    return (
        (candidate == claim)
        | (F.abs(candidate - claim) <= base * RELATIVE_TOLERANCE)
        | rounds_to(candidate, claim, decimals)
    )


def close_strict(claim: Column, candidate: Column) -> Column:
    """The web variant: within half a percent of the larger of both, no rounding."""
    larger = F.greatest(F.abs(candidate), F.abs(claim))
    return (candidate == claim) | (F.abs(candidate - claim) <= larger * RELATIVE_TOLERANCE)
