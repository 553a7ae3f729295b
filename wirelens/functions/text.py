"""Names, labels, type words and typed cells as column expressions."""

from __future__ import annotations

from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.plans.model import NATURAL_LENGTH

# Words accepted for each field type (compared without case).
TYPE_WORDS = {
    "RawUnsignedBE": ("raw unsigned be", "rawunsignedbe", "raw"),
    "Bool": ("bool", "boolean"),
    "Uint8": ("uchar", "uint8", "unsigned char", "byte"),
    "Int8": ("char", "int8", "signed char"),
    "Uint16": ("ushort", "uint16", "unsigned short", "word"),
    "Int16": ("short", "int16", "signed short", "short int"),
    "Uint32": ("uint", "uint32", "unsigned int", "unsigned integer", "dword"),
    "Int32": ("int", "int32", "signed int", "signed integer"),
    "Uint64": ("ulong", "uint64", "unsigned long", "unsigned long int", "qword"),
    "Int64": ("long", "int64", "signed long", "long int"),
    "Float32": ("float", "float32", "real", "single"),
    "Float64": ("double", "float64"),
    "String": ("string", "str", "text"),
}
# Display label per type.
TYPE_LABEL = {
    "RawUnsignedBE": "Raw Unsigned BE",
    "Bool": "bool",
    "Uint8": "uchar",
    "Int8": "char",
    "Uint16": "ushort",
    "Int16": "short",
    "Uint32": "uint",
    "Int32": "int",
    "Uint64": "ulong",
    "Int64": "long",
    "Float32": "float",
    "Float64": "double",
    "String": "string",
}


def strip(text: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def type_from_alias(label: Column) -> Column:
    """Type of an exact type word, or NULL."""
    words = {w: t for t, ws in TYPE_WORDS.items() for w in ws}
    return F.try_element_at(_literal_map(words), F.lower(strip(label)))


def natural_length(kind: Column) -> Column:
    """Bytes a type occupies by itself; 0 when a length must be given."""
    return F.try_element_at(_literal_map(NATURAL_LENGTH), kind)


def type_label(kind: Column) -> Column:
    return F.try_element_at(_literal_map(TYPE_LABEL), kind)


def type_from_label(label: Column, size: Column) -> Column:
    """Type of a word or a wordy spelling; the size column fixes integer widths.

    Integers are unsigned unless the text says "signed"; a width that no type
    has gives raw unsigned; a text without any type word gives NULL.
    """
    s = F.lower(strip(label))

    def has(*words):
        return s.rlike("|".join(words))

    signed = has("signed") & ~has("unsigned")
    width = (
        F.when(size.isin(1, 2, 4, 8), size)
        .when(has("char", "byte"), 1)
        .when(has("dword"), 4)
        .when(has("qword"), 8)
        .when(has("short", "word"), 2)
        .when(has("long"), 8)
        .when(has("int"), 4)
        .otherwise(0)
    )
    prefix = F.when(signed, "Int").otherwise("Uint")
    integer = F.concat(prefix, (width * 8).cast("string"))
    wordy = (
        F.when(has("double"), "Float64")
        .when(has("float", "real", "single"), F.when(size == 8, "Float64").otherwise("Float32"))
        .when(has("bool"), "Bool")
        .when(has("string", "text", "ascii", "utf"), "String")
        .when(has("int", "char", "short", "long", "byte", "word"), integer)
    )
    return F.coalesce(type_from_alias(label), wordy)


def safe_name(text: Column) -> Column:
    """File-name form: forbidden characters and blanks to ``_``, trimmed of ``_``."""
    t = F.regexp_replace(strip(text), '[\\\\/:*?"<>|]', "_")
    t = F.regexp_replace(F.regexp_replace(t, "\\s+", "_"), "_+", "_")
    t = F.regexp_replace(t, "^_+|_+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("export"))


def column_label(text: Column) -> Column:
    """Column-label form; one underscore is cut from each end."""
    t = F.regexp_replace(F.regexp_replace(strip(text), "\\s+", "_"), "[^A-Za-z0-9_]", "_")
    t = F.regexp_replace(F.regexp_replace(t, "_+", "_"), "^_|_$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("BITFIELD"))


def typed_cell(text: Column) -> Column:
    """struct(number, text): plain decimal numbers become numeric, all else stays text.

    Integers of more than 15 digits would not survive a double and stay text.
    """
    t = strip(text)
    numeric = t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    long_plain = ~t.rlike("[eE]") & (F.length(F.regexp_replace(t, "[+\\-.]", "")) > 15)
    number = F.when(numeric & ~long_plain, t).try_cast("double")
    number = F.when(F.abs(number) < float("inf"), number)
    return F.struct(number.alias("number"), F.when(number.isNull(), text).alias("text"))


def byte_to_unit(offset: Column, unit: Column) -> Column:
    """1-based byte offset in the message's unit; a word is two bytes."""
    return F.when(F.upper(unit) == "WORDS", F.floor((offset - 1) / 2).cast("int") + 1).otherwise(offset)


def unit_to_byte(value: Column, unit: Column) -> Column:
    return F.when(F.upper(unit) == "WORDS", (value - 1) * 2 + 1).otherwise(value)


# ------------------------------------------------------ resolution expressions


def evaluate_expression(text: str | None) -> tuple[float | None, str | None]:
    """Value or error of an arithmetic text such as ``360/65536`` or ``2^-7``."""
    import ast
    import math
    import operator
    import re

    if text is None or not text.strip():
        return None, "empty"
    number = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    tokens = re.findall(rf"({number})|([^\W\d]\w*)|(\S)", text)
    parts = []
    for num, name, sign in tokens:
        if name and name.lower() not in ("pi", "e"):
            return None, f"unknown_name: {name.lower()}"
        if num and math.isinf(float(num)):
            return None, "number_too_large"
        if sign and sign not in "+-*/^()":
            return None, f"bad_character: {sign}"
        # Spaces keep "* *" from becoming a power and "2 3" from becoming a number.
        parts.append(f"({float(num)!r})" if num else name.lower() if name else {"^": "**"}.get(sign, sign))
    source = " ".join(parts)
    if source.count("(") > source.count(")"):
        return None, "unclosed_bracket"
    apply = {
        ast.Add: operator.add,
        ast.Sub: operator.sub,
        ast.Mult: operator.mul,
        ast.Div: operator.truediv,
        ast.Pow: operator.pow,
    }

    def value(node):
        if isinstance(node, ast.Constant) and isinstance(node.value, float):
            return node.value
        if isinstance(node, ast.Name):
            return {"pi": math.pi, "e": math.e}[node.id]
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            inner = value(node.operand)
            return -inner if isinstance(node.op, ast.USub) else inner
        if isinstance(node, ast.BinOp) and type(node.op) in apply:
            left, right = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow) and left == 0 and right < 0:
                raise OverflowError
            result = apply[type(node.op)](left, right)
            if isinstance(result, complex):
                raise OverflowError
            return result
        raise SyntaxError

    try:
        result = value(ast.parse(source, mode="eval").body)
    except ZeroDivisionError:
        return None, "division_by_zero"
    except OverflowError:
        return None, "undefined_power"
    except (SyntaxError, ValueError, RecursionError):
        return None, "malformed"
    if not math.isfinite(result):
        return None, "not_finite"
    return result, None


@F.pandas_udf(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("error", T.StringType())]))
def _solve(text: pd.Series) -> pd.DataFrame:
    solved = [evaluate_expression(t) for t in text]
    return pd.DataFrame(solved, columns=["value", "error"])


def solve_expression(text: Column) -> Column:
    return _solve(text)
