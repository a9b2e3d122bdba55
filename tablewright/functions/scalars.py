"""Column functions: lenient-free number parsing, naming styles, escaping, packing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_hex_int(c) -> Column:
    """``0x1F`` / ``#1F`` as base 16, anything else base 10; one leading ``*`` is dropped.

    Text that is not wholly a number gives NULL.
    """
    # Most cells are decimal or empty: they are told apart first.
    c = _col(c)
    text = F.regexp_replace(c, r"^\*", "")
    digits = F.regexp_extract(text, r"^(?:0[xX]|#)([0-9a-fA-F]+)$", 1)
    return (F.when(c == "", F.lit(None)).when(c.rlike(r"^[+-]?\d+$"), c.try_cast("bigint"))
            .when(digits != "", F.conv(digits, 16, 10).try_cast("bigint"))
            .when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")))


def parse_bool(c, layout: int = 2) -> Column:
    """Header layouts 2 and 3 accept 1/true/0/false only; layout 4 takes any text as true."""
    low = F.lower(_col(c))
    if layout == 4:
        return F.when(low.isin("", "0", "false"), False).when(low.isNotNull(), True)
    return F.when(low.isin("1", "true"), True).when(low.isin("", "0", "false"), False)


def parse_float(c) -> Column:
    c = _col(c)
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def camel_to_snake(c) -> Column:
    edges = "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[0-9])(?=[A-Za-z])"
    return F.lower(F.regexp_replace(_col(c), edges, "_"))


def screaming_snake(c) -> Column:
    edges = "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
    spaced = F.regexp_replace(F.regexp_replace(_col(c), edges, "_"), "_+", "_")
    return F.upper(F.regexp_replace(spaced, "^_|_$", ""))


def upper1(c) -> Column:
    c = _col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def lower1(c) -> Column:
    c = _col(c)
    return F.concat(F.lower(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def pascal(c) -> Column:
    return F.array_join(F.transform(F.split(_col(c), "_"), upper1), "")


def normalise_newlines(c) -> Column:
    return F.replace(_col(c), F.lit("\r\n"), F.lit("\n"))


def sql_escape(c) -> Column:
    doubled = F.replace(_col(c), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("'"), F.lit("''"))


def csv_escape(c) -> Column:
    c = _col(c)
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike('[,"\r\n]'), quoted).otherwise(F.coalesce(c, F.lit("")))


def shorten(c, n: int) -> Column:
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def is_default(c, dtype: T.DataType) -> Column:
    """Does the value equal its type's default?  Structs never do."""
    c = _col(c)
    if isinstance(dtype, T.BooleanType):
        return ~c
    if isinstance(dtype, T.NumericType):
        return c == 0
    if isinstance(dtype, T.StringType):
        return c == ""
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return F.size(c) == 0
    return F.lit(False)


def number_text(c) -> Column:
    """Shortest decimal text of a double, every digit kept: 1.0 -> 1, 1.2E7 -> 12000000, 1.5E-5 -> 0.000015.

    From 1e-6 to 1e21 the point of exponent notation is moved; beyond, the notation stays.
    """
    c = _col(c)
    text = c.cast("string")
    sign, digits = F.regexp_extract(text, "^-?", 0), F.regexp_extract(text, r"^-?(\d+)(?:\.0(?![0-9])|\.(\d+))?", 1)
    part = F.regexp_extract(text, r"^-?\d+\.(\d+?)0*(?:E|$)", 1)
    part = F.when(part == "0", "").otherwise(part)
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    every = F.concat(digits, part)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), every)
    point = F.length(digits) + power
    whole = F.rpad(F.substring(every, F.lit(1), point), point, "0")
    rest = F.substring(every, point + 1, F.length(every))
    large = F.when(rest == "", whole).otherwise(F.concat(whole, F.lit("."), rest))
    moved = F.concat(sign, F.when(power < 0, small).otherwise(large))
    usable = (F.abs(c) >= 1e-6) & (F.abs(c) < 1e21)
    # Numbers of this size are written without an exponent.
    plain = (F.abs(c) >= 1e-3) & (F.abs(c) < 1e7)
    short = F.when(text.endswith(".0"), F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)
    return F.when(c == 0, "0").when(plain, short).when(~usable, text).when(power.isNotNull(), moved).otherwise(short)


# White space as text readers know it, no-break and ideographic spaces and the byte order mark included.
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_space(c) -> Column:
    """Text without white space of any kind at both ends."""
    return F.btrim(_col(c), F.lit(SPACES))


def pack_value(c, dtype: T.DataType, nested: bool = False) -> Column:
    """One-cell text of a value: items joined by commas, inner composites in parentheses,
    a tagged struct as ``Impl(args)``."""
    c = _col(c)
    if isinstance(dtype, T.StructType):
        names = dtype.names
        if names[:1] == ["type"] and all(isinstance(f.dataType, T.StructType) for f in dtype.fields[1:]) and names[1:]:
            call = None
            for f in dtype.fields[1:]:
                args = pack_value(c[f.name], f.dataType)
                text = F.concat(F.lit(f.name), F.lit("("), args, F.lit(")"))
                call = F.when(c["type"] == f.name, text) if call is None else call.when(c["type"] == f.name, text)
            return call
        joined = F.concat_ws(",", *[F.coalesce(pack_value(c[f.name], f.dataType, True), F.lit(""))
                                    for f in dtype.fields])
        return F.concat(F.lit("("), joined, F.lit(")")) if nested else joined
    if isinstance(dtype, T.ArrayType):
        item = dtype.elementType
        if isinstance(item, T.StructType) and item.names == ["key", "value"]:
            # Map entries are flat pairs: k1,v1,k2,v2
            parts = F.transform(c, lambda e: F.concat_ws(
                ",", pack_value(e["key"], item["key"].dataType, True),
                pack_value(e["value"], item["value"].dataType, True)))
        else:
            parts = F.transform(c, lambda e: F.coalesce(pack_value(e, item, True), F.lit("")))
        joined = F.array_join(parts, ",")
        return F.concat(F.lit("("), joined, F.lit(")")) if nested else joined
    if isinstance(dtype, T.MapType):
        entry = T.ArrayType(T.StructType([T.StructField("key", dtype.keyType),
                                          T.StructField("value", dtype.valueType)]))
        return pack_value(F.map_entries(c), entry, nested)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return number_text(c)
    if isinstance(dtype, T.VariantType):
        return F.to_json(c)
    return c.cast("string")


def pack_id(schema: T.StructType, key) -> Column:
    """Record id: the packed key fields joined by ``;``."""
    return F.concat_ws(";", *[F.coalesce(pack_value(F.col(k), schema[k].dataType), F.lit("")) for k in key])


def pack_map_id(c, key_type: T.DataType, value_type: T.DataType) -> Column:
    """Identifier text of a map: ``k=>v;k=>v``."""
    return F.array_join(F.transform(F.map_entries(_col(c)), lambda e: F.concat(
        pack_value(e["key"], key_type), F.lit("=>"), pack_value(e["value"], value_type))), ";")


def split_sep(c, sep: str, trim_left: bool = False) -> Column:
    """Split on single-character separators, honouring ``"`` quoting with ``""`` escapes.

    ``sep`` may list several characters, each of them a separator.  Nothing after the
    last separator means no further field.
    """
    c = _col(c)
    any_sep = "[" + "".join(re.escape(s) for s in sep) + "]"
    not_sep = "[^" + any_sep[1:]
    raw = F.split(c, any_sep, -1)
    plain = (F.when(c == "", F.array().cast("array<string>"))
             .when(F.element_at(raw, -1) == "", F.slice(raw, 1, F.size(raw) - 1)).otherwise(raw))
    quoted = rf'"([^"]*+(?:""[^"]*+)*+)"?({not_sep}*)'
    token = rf'(?:{quoted}|{not_sep}*)(?:{any_sep}|$)'
    if trim_left:
        token = " *" + token
    tokens = F.regexp_extract_all(c, F.lit(token), F.lit(0))
    # The empty match at the end of the text is never a field.
    tokens = F.slice(tokens, 1, F.size(tokens) - 1)

    def clean(t: Column) -> Column:
        t = F.ltrim(t) if trim_left else t
        whole = rf"^{quoted}(?:{any_sep}|$)"
        inner = F.concat(F.replace(F.regexp_extract(t, whole, 1), F.lit('""'), F.lit('"')),
                         F.regexp_extract(t, whole, 2))
        return F.when(t.startswith('"'), inner).otherwise(F.regexp_replace(t, any_sep + "$", ""))

    if trim_left:
        plain = F.transform(plain, lambda p: F.ltrim(p))
    return F.when(F.instr(c, '"') == 0, plain).otherwise(F.transform(tokens, clean))
