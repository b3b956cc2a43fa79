"""Values of configurations: typed equality, canonical text, literals, and the text format of a configuration.

Equality is that of numbers (1 = 1.0 = true, exactly: 2^53 + 1 isn't 2^53), of strings ("520" isn't 520), and of whole lists and
maps, whatever they hold. Strings, whole numbers and booleans are dealt with by built-in functions; decimals and
nested values of any depth in Arrow batches. A whole number of more than 38 digits is a double in a variant.
"""

from __future__ import annotations

import decimal
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(v: Column) -> Column:
    """'number' (booleans too), 'string', 'null' or 'nested'."""
    schema = F.schema_of_variant(v)
    return (
        F.when(schema.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"), "number")
        .when(schema == "STRING", "string")
        .when(schema.isNull() | (schema == "VOID"), "null")
        .otherwise("nested")
    )


def number(v: Column) -> Column:
    """The number that a value is, else null; a string of digits isn't one."""
    return F.when(kind(v) == "number", F.try_variant_get(v, "$", "double"))


def text(v: Column) -> Column:
    return F.when(kind(v) == "string", F.try_variant_get(v, "$", "string"))


def equals(v: Column, literal) -> Column:
    """Typed equality with a Python value; false, never null, where the value is missing."""
    if isinstance(literal, (bool, int, float)):
        same = number(v) == F.lit(float(literal))
        if isinstance(literal, int) and abs(literal) < 10**38:  # doubles can't tell large whole numbers apart
            same &= F.coalesce(F.try_variant_get(v, "$", "decimal(38,0)") == F.lit(decimal.Decimal(literal)).cast("decimal(38,0)"), F.lit(True))
    elif isinstance(literal, str):
        same = text(v) == F.lit(literal)
    else:
        same = typed(v) == F.lit(encoded(literal))
    return F.coalesce(same, F.lit(False))


def same(a: Column, b: Column) -> Column:
    """Typed equality of two values; two nulls are equal."""
    return typed(a).eqNullSafe(typed(b))


def float_text(x: Column) -> Column:
    """A double as Python and JSON write it: 0.0001, 1e-05, 520.0, 1e+16. The digits are those of the JVM (shortest since Java 19)."""
    java, size = x.cast("string"), F.abs(x)
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    short = F.regexp_replace(java, r"\.0E", "E")
    power = F.regexp_extract(short, r"E(-?)(\d+)$", 2)
    sign = F.when(F.contains(short, F.lit("E-")), "-").otherwise("+")
    scientific = F.concat(F.regexp_extract(short, "^[^E]+", 0), F.lit("e"), sign, F.when(F.length(power) < 2, F.lit("0")).otherwise(""), power)
    return (
        F.when(x.isNull() | F.isnan(x), java)
        .when(size == float("inf"), F.when(x > 0, "Infinity").otherwise("-Infinity"))
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def _elements(v: Column) -> Column:
    """The elements of a list, else null."""
    return F.try_variant_get(v, "$", "array<variant>")


def _plain(v):
    """A value as Python's JSON reader gives it: a number with a point or exponent is a float."""
    if isinstance(v, decimal.Decimal):
        return int(v) if v.as_tuple().exponent >= 0 else float(v)
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return {k: _plain(x) for k, x in v.items()} if isinstance(v, dict) else v


def encoded(v) -> str:
    """Text that is the same for two values that Python calls equal, and for no others."""
    if v is None:
        return "null"
    if isinstance(v, str):
        return "s" + json.dumps(v, ensure_ascii=False)
    if isinstance(v, list):
        return f"[{','.join(map(encoded, v))}]"
    if isinstance(v, dict):
        return f"{{{','.join(f'{json.dumps(k, ensure_ascii=False)}:{encoded(v[k])}' for k in sorted(v))}}}"
    return f"n{int(v)}" if isinstance(v, int) or v.is_integer() else f"n{v!r}"


def _in_batches(write):
    """A function of a variant column, from one of a Python value to text."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        with decimal.localcontext(prec=60):
            return values.map(lambda v: None if v is None else write(_plain(v.toPython())))

    return run


def _fast(v: Column) -> Column:
    """Whether a value is a string, a whole number or a boolean."""
    return F.schema_of_variant(v).isin("STRING", "BIGINT", "BOOLEAN")


def canonical(v: Column) -> Column:
    """Text that is equal for values that group together; integers stay apart from decimals (520, 520.0) at any depth.

    Decimals count by their value (1e-05 is 0.00001); keys of maps are in order.
    """
    write = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    return F.when(_fast(v), F.to_json(v)).otherwise(_in_batches(write)(F.when(~_fast(v), v)))


def typed(v: Column) -> Column:
    """Text that is the same for equal values and for no others: numbers and booleans by value, apart from strings; a missing value is null's."""
    schema = F.schema_of_variant(v)
    own = F.when(schema == "STRING", F.concat(F.lit("s"), F.to_json(v)))
    own = own.when(schema == "BIGINT", F.concat(F.lit("n"), F.to_json(v))).when(schema == "BOOLEAN", F.when(F.to_json(v) == "true", "n1").otherwise("n0"))
    return own.otherwise(F.coalesce(_in_batches(encoded)(F.when(~_fast(v), v)), F.lit("null")))


def shown(v: Column) -> Column:
    """A value as Python's ``str`` shows it: True, 1e-05, [1, 2]; strings bare, but quoted in lists and maps."""
    schema = F.schema_of_variant(v)
    own = F.when(schema == "STRING", F.try_variant_get(v, "$", "string")).when(schema == "BIGINT", F.to_json(v)).when(schema == "BOOLEAN", F.initcap(F.to_json(v)))
    return own.otherwise(_in_batches(str)(F.when(~_fast(v), v)))


def member(v: Column, literal) -> Column:
    """Whether a value equals the literal; a number or boolean also equals a list with it, or a list of lists with it."""
    if not isinstance(literal, (bool, int, float)):
        return equals(v, literal)
    inner = lambda x: F.exists(F.coalesce(_elements(x), F.array().cast("array<variant>")), lambda y: equals(y, literal))
    return equals(v, literal) | F.coalesce(F.exists(_elements(v), lambda x: equals(x, literal) | inner(x)), F.lit(False))


def at_key(v: Column, key: str) -> Column:
    """The value under a key of an object; keys that a path can't name go through a map."""
    if not set(key) & set("'\"[]\\"):
        return F.try_variant_get(v, f"$['{key}']", "variant")
    return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(key))


def filter_literal(s: str):
    """A value of a filter on the command line: whole number, number, else string."""
    for kind_ in (int, float):
        try:
            return kind_(s)
        except ValueError:
            pass
    return s


def example_literal(s: str):
    """A value of a query by example: a number with a point, a whole number, a boolean, else string."""
    try:
        return float(s) if "." in s else int(s)
    except ValueError:
        return {"true": True, "false": False}.get(s.lower(), s)


def edit_literal(s: str):
    """A value in a configuration's text: numbers (whole ones as integers), Fortran-style booleans, else string."""
    try:
        x = float(s)
        return int(x) if x.is_integer() else x
    except (ValueError, OverflowError):
        low = s.lower()
        return True if low in (".true.", "t", "true") else False if low in (".false.", "f", "false") else s


#: What Python reads as a number: digits may be parted by single underscores.
_DIGITS = r"[0-9]+(?:_[0-9]+)*"
NUMBER = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
NO_NUMBER = r"(?i)^[+-]?(?:inf|infinity|nan)$"


def edit_json(s: Column, plain: bool = False) -> Column:
    """JSON of a value in a configuration's text, by the rules of ``edit_literal``; ``plain``: true and false only.

    Infinity and NaN are written as Python's JSON writer does. Whole numbers beyond 64 bits keep 17 digits.
    """
    yes, no = (["true"], ["false"]) if plain else ([".true.", "t", "true"], [".false.", "f", "false"])
    x, low = F.when(s.rlike(NUMBER), F.replace(s, F.lit("_"), F.lit(""))).try_cast("double"), F.lower(s)
    quoted = F.to_json(F.struct(s.alias("v")))
    return (
        F.when((x == F.floor(x)) & (F.abs(x) < 9e18), x.cast("long").cast("string"))
        .when((F.abs(x) < 1e38), F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(float_text(x)))
        .when(x.isNotNull(), float_text(x))
        .when(s.rlike(NO_NUMBER), F.when(F.contains(low, F.lit("nan")), "NaN").when(F.startswith(low, F.lit("-")), "-Infinity").otherwise("Infinity"))
        .when(low.isin(*yes), "true")
        .when(low.isin(*no), "false")
        .otherwise(quoted.substr(F.lit(6), F.length(quoted) - 6))
    )


def parse_config_text(s: Column) -> Column:
    """Key to JSON text, from lines ``key = value``; ``;`` parts lines, ``#`` starts a comment.

    A line with more than one ``=``, in its comment too, makes the whole text unreadable: null. Lines that begin with
    ``#`` are comments as a whole.
    """
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    lines = F.transform(F.split(F.replace(s, F.lit(";"), F.lit("\n")), "\n"), trimmed)
    pairs = F.filter(lines, lambda x: F.contains(x, F.lit("=")) & ~F.startswith(x, F.lit("#")))
    value = lambda x: trimmed(F.regexp_replace(F.element_at(F.split(x, "="), 2), "(?s)#.*$", ""))
    entries = F.transform(pairs, lambda x: F.struct(trimmed(F.split(x, "=")[0]).alias("key"), edit_json(value(x)).alias("value")))
    broken = F.exists(pairs, lambda x: F.size(F.split(x, "=")) > 2)
    return F.when(~broken, F.map_from_entries(entries))


def edit_tokens(tokens: Column) -> Column:
    """Key to JSON text, from an array of ``key=value``; a token without ``=`` means true, and later ones win."""
    pairs = F.transform(
        tokens,
        lambda x: F.struct(
            F.split(x, "=")[0].alias("key"), F.when(F.contains(x, F.lit("=")), edit_json(F.element_at(F.split(x, "="), 2), plain=True)).otherwise("true").alias("value")
        ),
    )
    return F.map_from_entries(pairs)


def config_text(m: Column) -> Column:
    """Lines ``key = value`` of a map of strings."""
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(" = "), e["value"])), "\n")
