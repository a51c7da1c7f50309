"""Numbers as JavaScript writes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integers up to here are exact doubles.
EXACT = 2**53
LEAST_NORMAL = 2.0**-1022


def js_text(x: float) -> str:
    """The shortest text that reads back as x, laid out by JavaScript's rules; js_column is held against it."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    sign, x = ("-", -x) if x < 0 else ("", x)
    mantissa, _, exponent = repr(float(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" and not whole.strip("0") == "" else part
    digits = (whole + part).lstrip("0")
    # the value is 0.digits * 10 ** point
    point = int(exponent or 0) + (len(whole) if whole.strip("0") else -(len(part) - len(part.lstrip("0"))))
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    e = point - 1
    tail = f".{digits[1:]}" if n > 1 else ""
    return f"{sign}{digits[0]}{tail}e{'+' if e > 0 else '-'}{abs(e)}"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _laid_out(text: Column, minus: Column) -> Column:
    """d.ddde+xx by JavaScript's rules."""
    digits = F.rtrim(F.translate(F.substring_index(text, "e", 1), ".", ""), F.lit("0"))
    point = F.substring_index(text, "e", -1).cast("int") + 1

    def body(d: Column) -> Column:
        digits, point, n = d["digits"], d["point"], F.length(d["digits"])
        e = point - 1
        exponent = F.concat(F.when(e > 0, F.lit("e+")).otherwise(F.lit("e-")), F.abs(e).cast("string"))
        return F.concat(
            minus,
            F.when((n <= point) & (point <= 21), F.concat(digits, F.repeat(F.lit("0"), point - n)))
            .when((point > 0) & (point <= 21), F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
            .when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .otherwise(F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(F.lit("")), exponent)),
        )

    return _let(F.struct(digits.alias("digits"), point.alias("point")), body)


def _long_text(n: Column) -> Column:
    """The text of a double beyond EXACT that is the whole number n: its nearest 15, 16 or 17 digits that read back."""

    def nearest(digits: int) -> Column:
        def of(step: Column) -> Column:
            rest = F.pmod(n, step)
            return n - rest + F.when(rest * 2 >= step, step).otherwise(F.lit(0))

        return _let(F.pow(F.lit(10.0), F.greatest(F.length(n.cast("string")) - digits, F.lit(0))).cast("long"), of)

    texts = [nearest(k) for k in (15, 16, 17)]
    back = [t.cast("double") == n.cast("double") for t in texts]
    return F.when(back[0], texts[0]).when(back[1], texts[1]).otherwise(texts[2]).cast("string")


def js_column(x: Column) -> Column:
    """js_text of finite doubles (null of null), in the JVM: the fewest of 15 to 17 digits that read back as x (15 hold any shorter text)."""
    size = F.abs(x)
    written = {k: F.format_string(f"%.{k - 1}e", size) for k in range(1, 18)}
    reads_back = lambda text: text.try_cast("double") == size
    # of 17 digits the JVM may write some where 16 do; rounded up or down these are the 16
    down = F.regexp_replace(written[17], r"\de", "e")
    shortest = F.when(reads_back(written[15]), written[15]).when(reads_back(written[16]), written[16]).when(reads_back(down), down).otherwise(written[17])
    # 15 digits aren't told apart below the least normal number: there all lengths are tried
    shortest = F.when(size < LEAST_NORMAL, F.get(F.filter(F.array(*written.values()), reads_back), 0)).otherwise(shortest)
    minus = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    whole = (x == F.floor(x)) & (size <= EXACT)
    return F.when(whole, x.cast("long").cast("string")).when((size > EXACT) & (size < 2.0**63), F.concat(minus, _let(size.cast("long"), _long_text))).when(x.isNotNull(), _laid_out(shortest, minus))


def js_texts(numbers: Column) -> Column:
    """An array of finite doubles as texts."""
    return F.transform(numbers, js_column)
