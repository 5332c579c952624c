"""Catalog metadata: typed facets from nested JSON, ids, texts for embedding, null filling (W4, W7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from tidemark.functions.text import flexible_date, squeeze
from tidemark.functions.vectors import bound
from tidemark.operators.curation import fair_shares

#: Other names of metadata types.
ALIASES = {"timeseries": "indicator", "survey": "microdata"}
NAMED = "array<struct<name:string>>"
PERIODS = "array<struct<start:string,end:string>>"
#: By type, the JSON paths of idno, source, geographies, periods and abstract (fixed values).
PATHS = {
    "indicator": ("series_description.idno", "series_description.authoring_entity", "series_description.ref_country", "series_description.time_periods", "series_description.definition_long"),
    "microdata": ("study_description.title_statement.idno", "study_description.authoring_entity", "study_description.study_info.nation", "study_description.study_info.time_periods", "study_description.study_info.abstract"),
    "document": ("document_description.title_statement.idno", "document_description.authors", "document_description.ref_country", "document_description.time_periods", "document_description.abstract"),
    "geospatial": ("description.idno", "description.identificationInfo.citation.citedResponsibleParty", "description.identificationInfo.extent.geographicElement", "description.identificationInfo.citation.date", "description.identificationInfo.abstract"),
    "script": ("project_desc.title_statement.idno", "project_desc.authoring_entity", "project_desc.geographic_units", "project_desc.time_periods", "project_desc.abstract"),
}


def metadata_type(kind: Column) -> Column:
    lower = F.lower(F.trim(kind))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), lower), lower)


def path(payload: Column, dotted: str) -> Column:
    """The JSON text at a dotted path; null if it isn't there. A study's description may go by its short name."""
    found = F.get_json_object(payload, "$." + dotted)
    long, short = "study_description.", "study_desc."
    return F.coalesce(found, F.get_json_object(payload, "$." + short + dotted[len(long) :])) if dotted.startswith(long) else found


def sorted_set(values: Column) -> Column:
    """Distinct, ascending, without nulls and empty texts; an empty list as null."""
    found = F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))))
    return F.when(F.size(found) > 0, found)


def names(payload: Column, dotted: str, field: str = "name") -> Column:
    return F.transform(F.from_json(path(payload, dotted), NAMED.replace("name", field)), lambda x: x[field])


def coverage_dates(payload: Column, dotted: str) -> Column:
    """Of a list of dates and their types those of temporal coverage, as periods that only start."""
    dates = F.from_json(path(payload, dotted), "array<struct<date:string,type:string>>")
    return F.transform(F.filter(dates, lambda d: d["type"] == "temporal coverage"), lambda d: F.struct(d["date"].alias("start"), F.lit(None).cast("string").alias("end")))


def years(periods: Column) -> Column:
    """Distinct years of periods' starts and ends, ascending; dates that can't be read are left out."""
    text = F.flatten(F.transform(periods, lambda p: F.array(p["start"], p["end"])))
    return F.array_sort(F.array_distinct(F.filter(F.transform(text, lambda t: F.year(flexible_date(t))), lambda y: y.isNotNull())))


def facets(df: DataFrame, payload: str, kind: str) -> DataFrame:
    """Add idno, idno_uuid, source, geographies, years, year_start, year_end and abstract of each record by its type; unknown types raise.

    A geospatial record's sources are its responsible parties as listed, its years those of its dates of temporal coverage.
    """
    kind_of = metadata_type(F.col(kind))

    def by_type(make) -> Column:
        out = None
        for k, (name, paths) in enumerate(PATHS.items()):
            out = F.when(kind_of == name, make(name, paths)) if k == 0 else out.when(kind_of == name, make(name, paths))
        return out.otherwise(F.raise_error(F.concat(F.lit("unknown metadata type: "), F.coalesce(kind_of, F.lit("null")))))

    p = F.col(payload)

    def source(name: str, paths: tuple) -> Column:
        if name != "geospatial":
            return sorted_set(names(p, paths[1]))
        listed = F.filter(names(p, paths[1], "organisationName"), lambda v: v != "")
        return F.when(F.size(listed) > 0, listed)

    out = df.withColumns({
        "idno": by_type(lambda _, x: F.trim(path(p, x[0]))), "source": by_type(source),
        "geographies": by_type(lambda name, x: sorted_set(names(p, x[2], "geographicDescription" if name == "geospatial" else "name"))),
        "years": by_type(lambda name, x: years(coverage_dates(p, x[3]) if name == "geospatial" else F.from_json(path(p, x[3]), PERIODS))), "abstract": by_type(lambda _, x: path(p, x[4])),
    })
    uuid = F.regexp_replace(F.md5("idno"), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return out.withColumns({"idno_uuid": uuid, "year_start": F.get("years", F.lit(0)), "year_end": F.element_at("years", -1)})


def downloads(resources: Column) -> Column:
    """Resources that are downloads with an address."""
    return F.filter(resources, lambda r: (r["_links"]["type"] == "download") & (F.coalesce(r["_links"]["download"], F.lit("")) != ""))


def text_units(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row (key, field, text, uuid) for each field that isn't empty: the texts to embed."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), squeeze(F.col(f).cast("string")).alias("text")) for f in fields])
    units = df.select(F.col(key), F.explode(F.filter(each, lambda x: x["text"] != "")).alias("u")).select(key, "u.field", "u.text")
    return units.withColumn("uuid", F.md5(F.concat_ws("__", F.col(key).cast("string"), "field", "text")))


def segments(fields: list[tuple[str, str, int]]) -> Column:
    """Array of (label, text) of non-empty columns, each cut to its cap; fields: label, column, cap."""
    each = F.array(*[F.struct(F.lit(label).alias("label"), F.substring(squeeze(F.col(column).cast("string")), 1, cap).alias("text")) for label, column, cap in fields])
    return F.filter(each, lambda s: s["text"] != "")


def serialize(parts: Column, budget: int | None = None, seed: Column | None = None) -> Column:
    """'label: text' lines in order, or in the order of a hash of the seed and the label; cut at a word's end to the budget."""
    if seed is not None:
        keyed = F.array_sort(F.transform(parts, lambda s: F.struct(F.xxhash64(seed, s["label"]).alias("k"), s["label"].alias("label"), s["text"].alias("text"))))
        parts = F.transform(keyed, lambda s: F.struct(s["label"].alias("label"), s["text"].alias("text")))
    text = F.array_join(F.transform(parts, lambda s: F.concat(s["label"], F.lit(": "), s["text"])), "\n")
    if budget is None:
        return text
    return F.when(F.length(text) <= budget, text).otherwise(F.regexp_replace(F.substring(text, 1, budget), r"\s+\S*\z", ""))


def effective_cap(cap: int | None, elastic: bool) -> int:
    """The letters of a field that are read: its own cap, else 8000 of an elastic field and 300 of another (fixed values)."""
    return cap or (8000 if elastic else 300)


def elastic_segments(fields: list[tuple[str, Column, bool]]) -> Column:
    """Array of (label, text, elastic) of the fields that aren't null or empty; fields: label, text, whether it may be cut."""
    each = F.array(*[F.struct(F.lit(label).alias("label"), text.alias("text"), F.lit(elastic).alias("elastic")) for label, text, elastic in fields])
    return F.filter(each, lambda s: s["text"] != "")


def fit_budget(parts: Column, total: int | Column, separator: str = "\n") -> Column:
    """'label: text' lines of elastic_segments within total letters, labels and separators counted; only elastic fields are cut.

    What the other fields and all labels leave is shared max-min fairly: a short elastic field is kept whole and gives the rest of its share to the
    longer ones. A cut ends at a word where the cut text has a space. Fields that aren't elastic stay whole even where they alone exceed
    total; then elastic ones have a label only.
    """
    fixed = F.aggregate(parts, F.lit(0), lambda s, p: s + F.length(p["label"]) + 2 + F.when(p["elastic"], 0).otherwise(F.length(p["text"])))
    left = F.greatest(F.lit(0), F.lit(total).cast("int") - fixed - len(separator) * (F.size(parts) - 1))
    given = fair_shares(F.transform(F.filter(parts, lambda p: p["elastic"]), lambda p: F.length(p["text"])), left)

    def place(acc: Column, p: Column) -> Column:
        share = F.get(acc["given"], acc["at"])
        short = F.regexp_replace(F.regexp_replace(F.substr(p["text"], F.lit(1), share), r" [^ ]*\z", ""), r"[ \t\r\n]+\z", "")
        text = F.when(p["elastic"] & (share < F.length(p["text"])), short).otherwise(p["text"])
        return F.struct((acc["at"] + p["elastic"].cast("int")).alias("at"), acc["given"].alias("given"), F.concat(acc["out"], F.array(F.concat(p["label"], F.lit(": "), text))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), given.alias("given"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(parts, start, place, lambda acc: F.array_join(acc["out"], separator))


def picked_facets(evidence: dict[str, list[Column]], n: int, *seed: Column) -> Column:
    """n facets whose evidence is there, in the order of a hash of the seed (record, language) and the facet, again from the first if n is more.

    Where no facet has its evidence, keyword and natural are taken (fixed values).
    """
    def there(texts: list[Column]) -> Column:
        found = F.lit(True)
        for t in texts:
            found = found & (F.coalesce(t.cast("string"), F.lit("")) != "")
        return found

    known = F.filter(F.array(*[F.when(there(texts), F.lit(facet)) for facet, texts in evidence.items()]), lambda f: f.isNotNull())
    known = F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("keyword"), F.lit("natural")))
    mixed = F.array_sort(F.transform(known, lambda f: F.struct(F.md5(F.concat_ws("|", *[s.cast("string") for s in seed], f)).alias("h"), f.alias("f"))))
    return bound(mixed, lambda m: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(m, F.pmod(i, F.size(m)))["f"]))


def filled(column: Column, kind: DataType, placeholders: bool = False) -> Column:
    """A value of kind in which nothing is null: '' , 0, false, empty lists, and the same inside structs; with placeholders no list is empty but has one such element."""
    if isinstance(kind, StructType):
        return F.struct(*[filled(column[f.name], f.dataType, placeholders).alias(f.name) for f in kind])
    if isinstance(kind, ArrayType):
        found = F.coalesce(F.transform(column, lambda x: filled(x, kind.elementType, placeholders)), F.array().cast(kind))
        if not placeholders or kind.elementType.typeName() == "variant":
            return found
        return F.when(F.size(found) > 0, found).otherwise(F.array(filled(F.lit(None).cast(kind.elementType), kind.elementType, placeholders)))
    default = {"string": F.lit(""), "boolean": F.lit(False)}.get(kind.typeName(), F.lit(0).cast(kind) if kind.typeName() in ("integer", "long", "double", "float", "short", "byte", "decimal") else None)
    return column if default is None else F.coalesce(column, default)


def label_values(labels: Column) -> Column:
    """'[Label] value' texts as a map from label to the list of its values, in order."""
    pairs = F.filter(F.transform(labels, lambda t: F.struct(F.regexp_extract(t, r"^\[([^\]]+)\]\s*(.*)$", 1).alias("k"), F.regexp_extract(t, r"^\[([^\]]+)\]\s*(.*)$", 2).alias("v"))), lambda p: p["k"] != "")
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])))


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """By field how many rows have it, and which share."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), (F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) != "").cast("int").alias("has")) for f in fields])
    return df.select(F.explode(each).alias("x")).groupBy("x.field").agg(F.sum("x.has").alias("present"), F.round(F.avg("x.has"), 6).alias("share"))
