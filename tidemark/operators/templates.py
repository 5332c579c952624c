"""One typed layout for JSON records of many layouts: merged by an aggregate over VARIANT, then every record is put into it (W7)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, DoubleType, NullType, StructType, VariantType

from tidemark.operators.metadata import filled

#: A step of a path: a field's name, or into the elements of a list.
EACH = "[]"
Path = tuple[str, ...]


def records(payload: Column) -> Column:
    """A JSON text as VARIANT if it is an object; null for anything else."""
    v = F.try_parse_json(payload)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, NUMBER or another of VARIANT's types; null for a JSON null."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.when(name.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "NUMBER").when(name != "VOID", name)


def values_at(record: Column, path: Path) -> Column:
    """All values (array of VARIANT) that a record has at a path, in order."""
    found = F.filter(F.array(record), lambda v: v.isNotNull())
    for step in path:
        found = F.flatten(F.transform(found, _elements)) if step == EACH else F.filter(F.transform(found, _field(step)), lambda v: v.isNotNull())
    return found


def _elements(value: Column) -> Column:
    return F.coalesce(F.when(kind_of(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>")), F.array().cast("array<variant>"))


def _field(name: str):
    quote = '"' if "'" in name else "'"
    if quote in name:
        raise ValueError(f"a name with both quotes can't be looked up: {name}")
    return lambda v: F.try_variant_get(v, f"$[{quote}{name}{quote}]", "variant")


def _is(kind: str):
    return lambda v: kind_of(v) == kind


def _typed(schema: str) -> DataType:
    """VARIANT's own name of a schema as a type; a path of several kinds is VARIANT, one of nulls only is VOID."""
    return DataType.fromDDL(re.sub(r"(`(?:[^`]|``)*`)|\bOBJECT(?=<)", lambda m: m[1] or "STRUCT", schema))


def _mixed(kind: DataType, at: Path = ()) -> Iterator[Path]:
    if isinstance(kind, VariantType):
        yield at
    elif isinstance(kind, StructType):
        for f in kind:
            yield from _mixed(f.dataType, (*at, f.name))
    elif isinstance(kind, ArrayType):
        yield from _mixed(kind.elementType, (*at, EACH))


def _settled(kind: DataType, decided: dict[Path, DataType], at: Path = ()) -> DataType:
    if at in decided and isinstance(kind, VariantType):
        return _settled(decided[at], decided, at)
    if isinstance(kind, StructType):
        out = StructType()
        for f in kind:
            out = out.add(f.name, _settled(f.dataType, decided, (*at, f.name)))
        return out
    return ArrayType(_settled(kind.elementType, decided, (*at, EACH))) if isinstance(kind, ArrayType) else kind


def _final(kind: DataType) -> DataType:
    """Fractions as double; what never had a value stays VARIANT."""
    if isinstance(kind, StructType) and len(kind):
        out = StructType()
        for f in kind:
            out = out.add(f.name, _final(f.dataType))
        return out
    if isinstance(kind, ArrayType):
        return ArrayType(_final(kind.elementType))
    if isinstance(kind, (NullType, StructType)):
        return VariantType()
    return DoubleType() if isinstance(kind, DecimalType) and kind.scale else kind


def typed_template(df: DataFrame, payload: str, order: str, most: int = 10_000) -> tuple[StructType, dict[Path, str]]:
    """The layout that all records share, and the kinds of the paths whose values are of several kinds.

    One aggregate merges the records' schemas, with partial results in the tasks. Where a path has values of several kinds (a text here, a list there), the
    first value in the order of the column order decides, as read by two more aggregates for each depth at which kinds are mixed. Equal orders
    are told apart by kind. Null values say nothing; lists that are always empty and objects without fields stay VARIANT. Texts that are no JSON object are left out. Without any
    record the layout is empty. A layout of more than most paths is refused, as it is held by the driver: keys that are data belong into a map.
    """
    got = df.select(F.col(order).alias("k"), records(F.col(payload)).alias("v"))
    merged = got.agg(F.schema_of_variant_agg("v")).first()[0]
    layout = _typed(merged)
    if not isinstance(layout, StructType):
        return StructType(), {}
    kinds: dict[Path, str] = {}
    while open_ := list(_mixed(layout)):
        if len(open_) > most:
            raise ValueError(f"more than {most} paths of several kinds")
        firsts = [F.get(F.filter(F.transform(values_at(F.col("v"), p), kind_of), lambda x: x.isNotNull()), F.lit(0)) for p in open_]
        named = got.select("k", *[c.alias(f"f{i}") for i, c in enumerate(firsts)])
        first = named.agg(*[F.min_by(f"f{i}", F.when(F.col(f"f{i}").isNotNull(), F.struct("k", f"f{i}"))).alias(f"f{i}") for i in range(len(open_))]).first()
        chosen = {p: first[i] for i, p in enumerate(open_)}
        same = [F.to_variant_object(F.filter(values_at(F.col("v"), p), _is(kind))) for p, kind in chosen.items()]
        schemas = got.select(*[c.alias(f"s{i}") for i, c in enumerate(same)]).agg(*[F.schema_of_variant_agg(f"s{i}") for i in range(len(open_))]).first()
        layout = _settled(layout, {p: _typed(schemas[i]).elementType for i, p in enumerate(open_)})
        kinds |= chosen
    if (n := sum(1 for _ in _paths(layout))) > most:
        raise ValueError(f"{n} paths; a layout may have {most}")
    return _final(layout), kinds


def _ddl(kind: DataType) -> str:
    """A type's name with its fields' names quoted."""
    if isinstance(kind, StructType):
        return "struct<" + ",".join(f"`{f.name.replace('`', '``')}`:{_ddl(f.dataType)}" for f in kind) + ">"
    return f"array<{_ddl(kind.elementType)}>" if isinstance(kind, ArrayType) else kind.simpleString()


def _paths(kind: DataType) -> Iterator[DataType]:
    if isinstance(kind, StructType):
        for f in kind:
            yield f.dataType
            yield from _paths(f.dataType)
    elif isinstance(kind, ArrayType):
        yield from _paths(kind.elementType)


def conform(df: DataFrame, payload: str, template: tuple[StructType, dict[Path, str]], placeholders: bool = False) -> DataFrame:
    """df with record (a struct of the template's layout) and misfits (array of path, value) in place of nothing: every row stays, the payload too.

    Fields that a record lacks get '', 0, false, an empty list or a struct of these; with placeholders a list without elements gets one such
    element. A text column takes values of any kind as JSON. What a path's kind doesn't take is in misfits as JSON, under its dotted path; a payload that is no object
    is there whole, under the empty path, and its record has defaults only; a null payload has no misfits.
    """
    layout, kinds = template
    v = records(F.col(payload))

    def lost(p: Path, kind: str) -> Column:
        return F.transform(F.filter(values_at(v, p), lambda x: kind_of(x) != kind), lambda x: F.struct(F.lit(".".join(p)).alias("path"), F.to_json(x).alias("value")))

    whole = F.filter(F.array(F.struct(F.lit("").alias("path"), F.col(payload).alias("value"))), lambda x: v.isNull() & x["value"].isNotNull())
    record = filled(F.try_variant_get(v, "$", _ddl(layout)), layout, placeholders) if len(layout) else v
    return df.withColumns({"record": record, "misfits": F.concat(whole, *[lost(p, kind) for p, kind in kinds.items() if kind != "STRING"])})


def unify_folders(spark: SparkSession, folders: list[str], out: str, placeholders: bool = True) -> DataFrame:
    """Every JSON document of the folders in the layout that all of them share, written as JSON lines by folder; the rows (folder, n, n_misfits).

    A file is one document; by the order of their paths the first value decides where kinds are mixed. Folders are told apart by their
    last name, so two of the same name are refused. The rows come from what was written.
    """
    names = [f.rstrip("/").rsplit("/", 1)[-1] for f in folders]
    if len(set(names)) < len(names):
        raise ValueError("two folders of the same name")
    docs = spark.read.text([f"{f.rstrip('/')}/*.json" for f in folders], wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    done = conform(docs, "value", typed_template(docs, "value", "file"), placeholders)
    parts = F.split("file", "/")
    done.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("file"), "record", "misfits").write.partitionBy("folder").option("ignoreNullFields", False).json(out)
    return spark.read.json(out, schema="folder string, misfits array<struct<path:string,value:string>>").groupBy("folder").agg(F.count("*").alias("n"), F.sum(F.size("misfits")).alias("n_misfits"))
