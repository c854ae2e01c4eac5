"""Functions over nested and JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT = T.DecimalType(38, 18)


def _has_floats(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_floats(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_floats(kind.keyType) or _has_floats(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_floats(field.dataType) for field in kind)
    return isinstance(kind, (T.DoubleType, T.FloatType))


def exact_decimals(value: Column, kind: T.DataType) -> Column:
    """Turn every float inside ``value``, at any depth, into the decimal of its shortest text.

    One whose text does not fit 20 digits before and 18 after the point is an error: no digit is lost.
    """
    if not _has_floats(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: exact_decimals(item, kind.elementType))
    if isinstance(kind, T.MapType):
        if _has_floats(kind.keyType):
            value = F.transform_keys(value, lambda k, _: exact_decimals(k, kind.keyType))
        return F.transform_values(value, lambda _, item: exact_decimals(item, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = [exact_decimals(value.getField(f.name), f.dataType).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields))
    exact = value.cast("string").try_cast(EXACT)
    lost = F.raise_error(F.concat(F.lit("no exact decimal for "), value.cast("string"))).cast(EXACT)
    return F.when(value.isNull() | (exact.cast(kind) == value), exact).otherwise(lost)


def json_type_names(document: Column, fields: list[str]) -> Column:
    """Type name of each listed field of a JSON text, in order, to detect records that drift from their schema.

    A text that is no JSON has no fields.
    """
    parsed = F.try_parse_json(document)

    def name(field: str) -> Column:
        kind = F.schema_of_variant(F.variant_get(parsed, f"$.{field}", "variant"))
        return (
            F.when(kind.isNull() | (kind == "VOID"), "NoneType")
            .when(kind == "STRING", "str")
            .when((kind == "BIGINT") | kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "int")
            .when(kind == "BOOLEAN", "bool")
            .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "float")
            .when(kind.startswith("ARRAY"), "list")
            .otherwise("dict")
        )

    return F.array(*[name(field) for field in fields])
