"""JSON of typed columns in the order of their fields (ID15, ID16, ID19, PRJ23, VAL33, SNK05): compact or with two
spaces, nulls kept or left out by name, and digests of a value without one of its keys.

``to_json`` differs from what digests are made of: it writes control characters in upper-case digits
and whole doubles with a fraction. Here text is escaped by replacement only where it needs it, numbers
are written in their shortest form, and everything stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegralType, NullType, StringType, StructType

#: fixed values: short escapes of JSON; other control characters are written as \u00xx
SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def quoted(text: Column) -> Column:
    """A string of JSON."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = out
    for code in range(32):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(SHORT.get(chr(code), f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(F.regexp_like(text, F.lit(r"[\x00-\x1F]")), escaped).otherwise(out), F.lit('"'))


def number(value: Column) -> Column:
    """A double in its shortest form: plain up to 21 digits before and 7 after the point, else with an exponent."""
    written = F.abs(value).cast("string")
    digits = F.regexp_replace(F.regexp_extract(written, r"^([0-9.]+)", 1), r"\.0$", "")
    point = F.when(F.contains(digits, F.lit(".")), F.instr(digits, ".") - 1).otherwise(F.length(digits))
    exponent = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(written, r"E(-?\d+)$", 1), F.lit("")), F.lit("S999")).cast("int"), F.lit(0))
    plain = F.replace(digits, F.lit("."), F.lit(""))
    zeros = F.length(F.regexp_extract(plain, "^(0*)", 1))
    figures = F.regexp_replace(F.regexp_replace(plain, "^0+", ""), "0+$", "")
    n, at = F.length(figures), point + exponent - zeros  # the point stands after so many figures
    whole = F.concat(figures, F.repeat(F.lit("0"), at - n))
    split = F.concat(F.substr(figures, F.lit(1), at), F.lit("."), F.substr(figures, at + 1))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), figures)
    power = F.concat(F.when(at > 0, "e+").otherwise("e-"), F.abs(at - 1).cast("string"))
    far = F.concat(F.substr(figures, F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(figures, F.lit(2)))).otherwise(""), power)
    body = F.when(at > 21, far).when(at >= n, whole).when(at > 0, split).when(at > -6, small).otherwise(far)
    finite = F.concat(F.when(value < 0, "-").otherwise(""), body)
    return F.when(value == 0, "0").when(F.isnan(value) | (F.abs(value) == float("inf")), "null").otherwise(finite)


def json_text(value: Column, kind: DataType, spaces: int = 0, absent: tuple[str, ...] = (), level: int = 0) -> Column:
    """``value`` of type ``kind`` as JSON. Fields that ``absent`` names, at any depth, are left out where they
    are null; other nulls are written. With ``spaces``, every element has a line of its own."""
    line, inner, last = (F.lit("\n" + " " * spaces * (level + 1)), ",\n" + " " * spaces * (level + 1), F.lit("\n" + " " * spaces * level)) if spaces else (F.lit(""), ",", F.lit(""))
    deeper = lambda x, k: json_text(x, k, spaces, absent, level + 1)
    if isinstance(kind, StructType):
        label = lambda name: quoted(F.lit(name)) if any(c < " " or c in '"\\' for c in name) else F.lit(f'"{name}"')
        fields = [(f.name, F.concat(label(f.name), F.lit(": " if spaces else ":"), deeper(value[f.name], f.dataType))) for f in kind.fields]
        parts = F.array_compact(F.array(*[F.when(value[name].isNotNull(), text) if name in absent else text for name, text in fields]))
        body = F.when(value.isNull(), None).when(F.size(parts) == 0, "{}").otherwise(F.concat(F.lit("{"), line, F.array_join(parts, inner), last, F.lit("}")))
    elif isinstance(kind, ArrayType):
        parts = F.transform(value, lambda x: deeper(x, kind.elementType))
        body = F.when(F.size(parts) == 0, "[]").otherwise(F.concat(F.lit("["), line, F.array_join(parts, inner), last, F.lit("]")))
    elif isinstance(kind, StringType):
        body = quoted(value)
    elif isinstance(kind, BooleanType | IntegralType):
        body = value.cast("string")
    elif isinstance(kind, DoubleType | FloatType):
        body = number(value)
    elif isinstance(kind, NullType):
        return F.lit("null")
    else:
        raise TypeError(f"no JSON form is stated for {kind.simpleString()}")
    return F.coalesce(body, F.lit("null"))


def digest(value: Column, kind: StructType, without: str | None = None, **form) -> Column:
    """The sha256 of a struct's JSON, one of its keys left out if named."""
    kept = StructType([f for f in kind.fields if f.name != without])
    return F.sha2(json_text(value, kept, **form), 256)
