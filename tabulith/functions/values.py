"""Numbers in table cells: the number grammar, metric conversion, score strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number with optional sign, thousands commas, fraction and exponent.
NUMBER = "[+-]?(?:(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_EXACT = "decimal(30,10)"


def _number(text: Column) -> Column:
    """An exact decimal of what NUMBER matched; null if nothing."""
    plain = F.nullif(F.replace(text, F.lit(","), F.lit("")), F.lit(""))
    return F.coalesce(plain.try_cast(_EXACT), plain.try_cast("double").try_cast(_EXACT))


def clean_value(raw: Column) -> Column:
    out = F.replace(F.regexp_replace(raw, "(?U)\\s+%", "%"), F.lit(","), F.lit(""))
    return F.trim(F.translate(out, "()", "  "))


def format_pattern(form: str) -> tuple[str, int]:
    """the regular expression of a format such as '{x} %' and the power of ten to scale by.

    Group 1 is the first value; {} is a number that is skipped; white space is free.
    """
    import re

    out, scale, at = "^", 0, 0
    for found in [*re.finditer(r"\{([^}]*)\}", form.strip()), None]:
        piece = form.strip()[at : found.start() if found else None]
        if piece.strip():
            out += "\\s*".join(re.escape(p) for p in re.split(r"\s+", piece))
        elif piece:
            out += "\\s+"
        if found:
            inner = found[1].strip()
            out += f"(?:{NUMBER})" if not inner else f"({NUMBER})"
            scale = 2 if inner in ("100*x", "100x") else -2 if inner == "x/100" else scale
            at = found.end()
    return out, scale


def extract_value(raw: Column, form: str = "{x}") -> Column:
    """the value of a cell in a format; null where it does not begin so."""
    pattern, scale = format_pattern(form)
    value = _number(F.regexp_extract(clean_value(raw), pattern, 1))
    factor = {0: "1", 2: "100", -2: "0.01"}[scale]
    return (value * F.lit(factor).cast("decimal(5,2)")).cast(_EXACT) if scale else value


def convert_metric(raw: Column, range_: Column, complement: Column | bool = False) -> Column:
    """a raw cell as a number in a metric's range ('0-1', '1-100', 'abs' or '')."""
    percent = raw.contains("%")
    hundred, one = F.lit(100).cast(_EXACT), F.lit(1).cast(_EXACT)
    flip = F.lit(complement) if isinstance(complement, bool) else complement

    def turned(x: Column) -> Column:
        other = F.when(percent | ((x > 1) & (x < 100)), hundred - x).otherwise(one - x)
        return F.when(flip, other).otherwise(x).cast(_EXACT)

    def ranged(x: Column) -> Column:
        as_percent = F.when(~percent & (x > 0) & (x < 1), x * 100).otherwise(x).cast(_EXACT)
        return (
            F.when(range_ == "0-1", as_percent / 100)
            .when(range_ == "1-100", as_percent)
            .when(range_ == "abs", F.when(percent, x / 100).otherwise(x))
            .otherwise(x)
            .cast(_EXACT)
        )

    # each step is computed once, for all that the next one says about it
    parsed = F.array(F.when(percent, extract_value(raw, "{x}%")).otherwise(extract_value(raw, "{x}")))
    return F.transform(F.transform(parsed, turned), ranged)[0]


def plus_minus_values(raw: Column) -> Column:
    """the numbers of a cell that no ± precedes, percentages as fractions."""
    pattern = "(±?)([+-]?\\s*(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\\s*(%?)"
    whole = F.regexp_extract_all(raw, F.lit(pattern), F.lit(0))
    plain = F.filter(whole, lambda m: ~m.startswith("±"))

    def value(m: Column) -> Column:
        number = F.regexp_replace(m, "[\\s%]", "").try_cast("double")
        return F.when(m.contains("%"), number / 100).otherwise(number)

    return F.transform(plain, value)


def norm_score(text: Column) -> Column:
    """a score string without what floating point leaves at its end."""
    whole = F.regexp_extract(text, "^([+-]?)([0-9]+)\\.9{5,}$", 2)
    sign = F.regexp_extract(text, "^([+-]?)([0-9]+)\\.9{5,}$", 1)
    up = F.concat(sign, (whole.try_cast("decimal(38,0)") + 1).cast("decimal(38,0)").cast("string"))
    digit = F.regexp_extract(text, "([0-8])9+$", 1)
    carried = F.concat(F.regexp_replace(text, "[0-8]9+$", ""), (digit.try_cast("int") + 1).cast("string"))
    out = F.when(whole != "", up).when(text.endswith("99999") & text.contains(".") & (digit != ""), carried).otherwise(text)
    out = F.when(out.contains("."), F.regexp_replace(out, "0+$", "")).otherwise(out)
    out = F.regexp_replace(out, "\\.$", "")
    return F.when(out == "-0", "0").otherwise(out)
