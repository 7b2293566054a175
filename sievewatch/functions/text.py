"""Text expressions whose details differ between Spark, Python and JavaScript."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# fixed values: the blanks that Python's str.strip and JavaScript's trim remove (Spark's trim takes
# ' ' only)
_COMMON = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)
PY_BLANKS = _COMMON + "\x1c\x1d\x1e\x1f\x85"
JS_BLANKS = _COMMON + "\ufeff"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(PY_BLANKS))


def js_trim(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(JS_BLANKS))


def first_truthy(*cols: Column | str) -> Column:
    """Python's ``a or b or c``: empty text counts as missing, the last branch is kept as is."""
    *head, last = [col(c) for c in cols]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in head], last)


def non_empty(c: Column | str) -> Column:
    """True for text that is neither null nor ''."""
    return F.coalesce(F.length(col(c)) > 0, F.lit(False))


def cut(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def one_line(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("\n"), F.lit(" "))


def join_or(arr: Column | str, empty: str, sep: str = ", ") -> Column:
    """Join a list; null or empty gives ``empty``."""
    a = col(arr)
    return F.when(F.coalesce(F.size(a), F.lit(0)) > 0, F.array_join(a, sep)).otherwise(F.lit(empty))


def _per_char(c: Column, boundary: str, lower_rest: bool) -> Column:
    """Upper-case every word character that follows a non-word character."""
    chars = F.split(c, "")

    def one(ch: Column, i: Column) -> Column:
        starts = (i == 0) | ~F.coalesce(F.get(chars, i - 1), F.lit("")).rlike(boundary)
        return F.when(starts, F.upper(ch)).otherwise(F.lower(ch) if lower_rest else ch)

    return F.array_join(F.transform(chars, one), "")


def title_case(c: Column | str) -> Column:
    """Python's ``str.title``: a letter after any non-letter is upper, all others lower.

    Plain words take the built-in function, which agrees there.
    """
    c = col(c)
    return F.when(c.rlike(r"^[A-Za-z ]*\z"), F.initcap(c)).otherwise(_per_char(c, r"^\p{L}$", True))


def capitalise_words(c: Column | str) -> Column:
    r"""JavaScript's ``replace(/\b\w/g, upper)``: the other letters keep their case."""
    return _per_char(col(c), r"^[A-Za-z0-9_]$", False)


def js_parse_int(c: Column | str) -> Column:
    """Leading integer of a text, null when there is none."""
    return F.regexp_extract(col(c).cast("string"), r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def iso_timestamp(c: Column | str) -> Column:
    """ISO text (``Z``, ``+00:00`` or ``+0000``) to timestamp; null when it does not parse."""
    text = F.regexp_replace(col(c), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return text.try_cast("timestamp")


def _json_string(c: Column) -> Column:
    """A JSON string literal with every non-ASCII character escaped, as Python writes it.

    Most texts need no escape at all; only the others go through the character-wise branch.
    """
    def unit(v: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(v)), 4, "0"))

    def escape(ch: Column) -> Column:
        cp = F.ascii(ch).cast("bigint")
        rest = cp - 0x10000
        pair = F.concat(
            unit(F.shiftright(rest, 10) + 0xD800), unit(rest.bitwiseAND(0x3FF) + 0xDC00)
        )
        out = F
        for char, short in zip('"\\\n\r\t\f\b', ['\\"', "\\\\", "\\n", "\\r", "\\t", "\\f", "\\b"]):
            out = out.when(ch == char, F.lit(short))
        return out.when(cp.between(0x20, 0x7E), ch).when(cp < 0x10000, unit(cp)).otherwise(pair)

    plain = c.rlike(r"^[\x20\x21\x23-\x5b\x5d-\x7e]*\z")
    escaped = F.array_join(F.transform(F.split(c, ""), escape), "")
    return F.concat(F.lit('"'), F.when(plain, c).otherwise(escaped), F.lit('"'))


def python_json(c: Column | str, dtype: T.DataType, indent: int = 2, level: int = 0) -> Column:
    """The text ``json.dumps(value, indent=2)`` gives for a value of this Spark type."""
    c = col(c)
    pad, end = " " * (indent * (level + 1)), " " * (indent * level)
    if isinstance(dtype, T.StructType):
        parts = [
            F.concat(
                F.lit(f'{pad}"{f.name}": '), python_json(c[f.name], f.dataType, indent, level + 1)
            )
            for f in dtype.fields
        ]
        body = F.concat(F.lit("{\n"), F.concat_ws(",\n", *parts), F.lit(f"\n{end}}}"))
    elif isinstance(dtype, T.ArrayType):
        items = F.transform(
            c,
            lambda x: F.concat(F.lit(pad), python_json(x, dtype.elementType, indent, level + 1)),
        )
        body = F.when(F.size(c) == 0, F.lit("[]")).otherwise(
            F.concat(F.lit("[\n"), F.array_join(items, ",\n"), F.lit(f"\n{end}]"))
        )
    elif isinstance(dtype, T.StringType):
        body = _json_string(c)
    else:
        body = c.cast("string")
    return F.when(c.isNull(), F.lit("null")).otherwise(body)


def _repr_string(c: Column) -> Column:
    """Python's repr of a text: double quotes only when it holds ' and no \"."""
    body = c
    for char, escaped in [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]:
        body = F.replace(body, F.lit(char), F.lit(escaped))
    double = c.contains("'") & ~c.contains('"')
    single = F.replace(body, F.lit("'"), F.lit("\\'"))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), single, F.lit("'"))
    )


def python_repr(c: Column | str, dtype: T.DataType) -> Column:
    """The text ``str(value)`` gives for a dict, list or scalar of this Spark type."""
    c = col(c)
    if isinstance(dtype, T.StructType):
        parts = [
            F.concat(F.lit(f"'{f.name}': "), python_repr(c[f.name], f.dataType))
            for f in dtype.fields
        ]
        body = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(dtype, T.ArrayType):
        items = F.transform(c, lambda x: python_repr(x, dtype.elementType))
        body = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(dtype, T.StringType):
        body = _repr_string(c)
    elif isinstance(dtype, T.BooleanType):
        body = F.when(c, F.lit("True")).otherwise(F.lit("False"))
    else:
        body = c.cast("string")
    return F.when(c.isNull(), F.lit("None")).otherwise(body)
