"""Column functions that turn loose text and numbers into typed values."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """Double value, or NULL where the text is not a number."""
    return _col(c).try_cast("double")


def safe_int(c: Column | str) -> Column:
    """Whole part of a number written as text ("1.0" gives 1); NULL if it is none."""
    return number(c).try_cast("int")


def coerce_zero(c: Column | str, kind: T.DataType | None = None) -> Column:
    """Double value with 0 for anything that is missing or not a number.

    A known integral ``kind`` needs no check beyond the one for NULL.
    """
    zero = F.lit(0.0)
    if isinstance(kind, T.IntegralType):
        return F.coalesce(_col(c).cast("double"), zero)
    return F.nanvl(F.coalesce(number(c), zero), zero)


def whole_or_zero(c: Column | str, out: str = "int", kind: T.DataType | None = None) -> Column:
    """Whole part of a number, 0 where there is none. A known integral ``kind`` is
    not taken through a double, which would round large ids."""
    value = _col(c) if isinstance(kind, T.IntegralType) else number(c)
    return F.coalesce(value.try_cast(out), F.lit(0).cast(out))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def has_float(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return has_float(kind.elementType)
    if isinstance(kind, T.MapType):
        return has_float(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(has_float(f.dataType) for f in kind.fields)
    return isinstance(kind, T.FloatType | T.DoubleType)


def nan_to_null_deep(c: Column, kind: T.DataType) -> Column:
    """``nan_to_null`` for every floating leaf below a nested column."""
    if not has_float(kind):
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: nan_to_null_deep(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: nan_to_null_deep(v, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = [nan_to_null_deep(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return nan_to_null(c)
