"""One spelling for nested values: JSON without blanks, keys in order at every depth, nulls kept, letters as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered(x: Column, kind: T.DataType) -> Column:
    """x with the fields of structs and the keys of maps in order, at every depth."""
    if isinstance(kind, T.StructType):
        fields = [ordered(x[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(x.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda y: ordered(y, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.transform(F.map_entries(x), lambda e: F.struct(e["key"].alias("key"), ordered(e["value"], kind.valueType).alias("value")))))
    return x


def canonical(x: Column, kind: T.DataType) -> Column:
    """The JSON of a struct, map or array of type kind."""
    return F.to_json(ordered(x, kind), {"ignoreNullFields": "false"})
