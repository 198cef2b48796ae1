"""Numeric functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def mod(n: Column, d: Column) -> Column:
    """The remainder; n itself for d = 0."""
    return F.when(d == 0, n).otherwise(n % F.nullif(d, F.lit(0)))


def divide(a: Column, b: Column, zero_is_null: bool = False) -> Column:
    """Real division; by zero an error, or null."""
    a, b = a.cast("double"), b.cast("double")
    return F.try_divide(a, b) if zero_is_null else a / b


def trunc(n: Column, scale: int = 0) -> Column:
    """Toward zero at a number of decimals, in decimal arithmetic (1.15 at two is 1.15)."""
    size = F.floor(F.abs(n), F.lit(scale))
    return F.when(n < 0, -size).otherwise(size)


def add(a: Column, b: Column) -> Column:
    """Integers are added as bigint."""
    return a.cast("bigint") + b.cast("bigint")


def multiply(a: Column, b: Column) -> Column:
    return a.cast("bigint") * b.cast("bigint")


def inet_aton(s: Column) -> Column:
    """Null for what is no address."""
    part = F.split(s, "[.]")
    number = sum((F.get(part, F.lit(i)).cast("bigint") * (256 ** (3 - i)) for i in range(1, 4)), F.get(part, F.lit(0)).cast("bigint") * 256**3)
    return F.when(s.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.|$)){4}$") & ~s.endswith("."), number)


def inet_ntoa(n: Column) -> Column:
    """Null for null and for what is no address."""
    return F.when(n.between(0, 2**32 - 1), F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]))


def _model(model: str) -> tuple[str, bool, int]:
    """A number model as Spark has it, whether it fills (no FM), and its decimals."""
    fills = not model.upper().startswith("FM")
    body = model.upper() if fills else model.upper()[2:]
    body = body.replace("G", ",").replace("D", ".")
    return body, fills, sum(c in "09" for c in body.partition(".")[2])


def to_char(n: Column, model: str) -> Column:
    """A number by a model of 9 0 , . G D $ S MI PR and FM: a blank or a minus before the first digit where the model has no
    sign; # where the number doesn't fit."""
    body, fills, decimals = _model(model)
    n = F.round(n.cast(f"decimal(38,{max(decimals, 10)})"), decimals).cast(f"decimal(38,{decimals})")
    if any(x in body for x in ("S", "MI", "PR")):
        out = F.to_char(n, F.lit(body))
        return out if fills else F.trim(out)
    digits = F.trim(F.to_char(F.abs(n), F.lit(body)))
    digits = F.when(digits == "", F.lit("0")).otherwise(digits)  # zero under nines
    signed = F.concat(F.when(n < 0, F.lit("-")).otherwise(F.lit("")), digits)
    return F.lpad(signed, len(body) + 1, " ") if fills else signed


def to_number(s: Column, model: str | None = None) -> Column:
    """Text as a number, by a model or as it stands; an error for other text."""
    if model is None:
        return F.trim(s).cast("decimal(38,10)")
    return F.to_number(F.trim(s), F.lit(_model(model)[0]))
