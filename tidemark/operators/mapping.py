"""Loosely built documents (JSON) as one schema: lists of terms with their vocabulary, ids, countries, languages, dates and the rest (W4).

A field may be a text, a list or an object of numbered entries, and an entry a text or an object with one field of interest; values() reads all of these.
Everything is an expression over VARIANT, so a document is parsed once and mapped in one select.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import squeeze

NO_TEXTS = "array<string>"


@dataclass(frozen=True)
class Terms:
    """A field as a source of terms: its name, the entries' field if they are objects, the mark that parts a text (none: a text is one term), its vocabulary."""

    name: str
    key: str = ""
    mark: str = ","
    vocabulary: str = ""


@dataclass(frozen=True)
class Layout:
    """Which fields of a document make up which part of a record; fields that no part uses go to additional."""

    idno: str
    title: str
    alternates: tuple[Terms, ...] = ()
    identifiers: dict[str, str] = field(default_factory=dict)
    authors: Terms | None = None
    dates: dict[str, tuple[str, ...]] = field(default_factory=dict)
    texts: dict[str, tuple[str, ...]] = field(default_factory=dict)
    themes: tuple[Terms, ...] = ()
    topics: tuple[Terms, ...] = ()
    keywords: tuple[Terms, ...] = ()
    languages: tuple[Terms, ...] = ()
    regions: tuple[Terms, ...] = ()
    country_names: str = ""
    country_code: str = ""
    relations: dict[str, str] = field(default_factory=dict)
    tags: dict[str, Terms] = field(default_factory=dict)

    def used(self) -> set[str]:
        lists = (*self.alternates, *self.themes, *self.topics, *self.keywords, *self.languages, *self.regions, *self.tags.values(), *([self.authors] if self.authors else ()))
        several = [f for group in (*self.dates.values(), *self.texts.values()) for f in group]
        return {self.idno, self.title, self.country_names, self.country_code, *self.identifiers, *self.relations, *several, *(t.name for t in lists)} - {""}


def text(doc: Column, name: str) -> Column:
    """A field as one text without surplus white space; '' for null and what isn't there."""
    return squeeze(F.coalesce(F.try_variant_get(doc, f"$['{name}']", "string"), F.lit("")))


def values(doc: Column, source: Terms) -> Column:
    """The texts of a field, cleaned, in order (numbered entries by their number), without empty ones."""
    at = f"$['{source.name}']"
    kind = F.coalesce(F.regexp_extract(F.schema_of_variant(F.try_variant_get(doc, at, "variant")), "^[A-Z]+", 0), F.lit("VOID"))
    listed = F.try_variant_get(doc, at, "array<variant>")
    numbered = F.array_sort(F.transform(F.map_entries(F.try_variant_get(doc, at, "map<string,string>")), lambda e: F.struct(F.coalesce(e["key"].try_cast("int"), F.lit(2**31 - 1)).alias("n"), e["key"].alias("k"), e["value"].alias("v"))))
    entries = F.when(kind == "ARRAY", F.transform(listed, lambda v: F.try_variant_get(v, "$", "string"))).when(kind == "OBJECT", F.transform(numbered, lambda e: e["v"])).otherwise(F.array().cast(NO_TEXTS))
    named = F.transform(entries, lambda e: F.when(F.trim(e).startswith("{") & F.try_parse_json(e).isNotNull(), _entry(F.try_parse_json(e), source.key)).otherwise(e))
    plain = F.try_variant_get(doc, at, "string")
    own = F.split(plain, f"[{source.mark}]") if source.mark else F.array(plain)
    every = F.when(kind.isin("ARRAY", "OBJECT"), named).when(kind == "VOID", F.array().cast(NO_TEXTS)).otherwise(own)
    return F.filter(F.transform(every, squeeze), lambda v: v != "")


def _entry(entry: Column, key: str) -> Column:
    """An entry's field, of a list its first value; null where it isn't there."""
    if not key:
        return F.lit(None).cast("string")
    return F.coalesce(F.try_variant_get(entry, f"$['{key}'][0]", "string"), F.try_variant_get(entry, f"$['{key}']", "string"))


def terms(doc: Column, sources: tuple[Terms, ...], once: bool = True) -> Column:
    """Array of (name, vocabulary) of the sources in order; once: a later source adds no name that is there already. The first source keeps its own repeats."""
    none = F.array().cast("array<struct<name:string,vocabulary:string,free:boolean>>")
    each = [_labelled(doc, s, k == 0 or not once) for k, s in enumerate(sources)]
    every = F.concat(none, *each)
    names = F.transform(every, lambda x: x["name"])
    kept = F.filter(every, lambda x, i: x["free"] | ~F.array_contains(F.slice(names, F.lit(1), i), x["name"]))
    return F.transform(kept, lambda x: F.struct(x["name"].alias("name"), x["vocabulary"].alias("vocabulary")))


def _labelled(doc: Column, source: Terms, free: bool) -> Column:
    return F.transform(values(doc, source), lambda v: F.struct(v.alias("name"), F.lit(source.vocabulary or source.name).alias("vocabulary"), F.lit(free).alias("free")))


def coded(names: Column, codes: dict[str, str]) -> Column:
    """Array of (name, code) of names that differ without regard to case, the first spelling kept; an unknown name has the code ''."""
    low = F.transform(names, F.lower)
    known = F.create_map(*[F.lit(x) for k, v in (codes or {"": ""}).items() for x in (k.lower(), v)])
    return F.transform(F.filter(names, lambda n, i: ~F.array_contains(F.slice(low, F.lit(1), i), F.lower(n))), lambda n: F.struct(n.alias("name"), F.coalesce(F.try_element_at(known, F.lower(n)), F.lit("")).alias("code")))


def _pairs(first: str, second: str, found: list[tuple[Column, Column]]) -> Column:
    """Array of pairs whose second part isn't empty."""
    none = F.array().cast(f"array<struct<{first}:string,{second}:string>>")
    return F.filter(F.concat(none, F.array(*[F.struct(a.alias(first), b.alias(second)) for a, b in found])), lambda p: p[second] != "") if found else none


def countries(doc: Column, layout: Layout, codes: dict[str, str]) -> Column:
    """Array of (name, code): one name with a code has that code's own, several are looked up by name, a code alone stands for its name."""
    names, code = values(doc, Terms(layout.country_names)), text(doc, layout.country_code)
    known = F.create_map(*[F.lit(x) for k, v in (codes or {"": ""}).items() for x in (k.lower(), v)])
    by = lambda x, other: F.coalesce(F.try_element_at(known, F.lower(x)), other)
    one = lambda n, c: F.struct(n.alias("name"), c.alias("code"))
    alone = F.when(code != "", F.array(one(code, by(code, code)))).otherwise(F.array().cast("array<struct<name:string,code:string>>"))
    return F.when(F.size(names) == 0, alone).when((F.size(names) == 1) & (code != ""), F.transform(names, lambda n: one(n, by(code, code)))).otherwise(F.transform(names, lambda n: one(n, by(n, F.lit("")))))


def mapped(df: DataFrame, payload: str, layout: Layout, codes: dict[str, str] | None = None, languages: dict[str, str] | None = None, once: bool = True) -> DataFrame:
    """df with record: its documents (JSON objects) in the layout's parts; codes: of countries by name or shorter code, languages: of languages by name.

    Dates are ISO days, '' where no field of theirs has one; an alternate title that equals the title is left out; regions are joined by ' ; '. additional holds every
    other field that isn't null or empty as it is written in JSON, with _ for dots in its name. A payload that is no object gives empty parts.
    """
    doc = F.try_parse_json(F.col(payload))
    first = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))
    day = lambda f: F.coalesce(F.date_format(F.to_date(F.regexp_extract(text(doc, f), r"^(\d{4}-\d{2}-\d{2})(?:[T ]|$)", 1).try_cast("date")), "yyyy-MM-dd"), F.lit(""))
    title = text(doc, layout.title)
    alternate = first(*[F.array_join(values(doc, s), " / ") for s in layout.alternates])
    spoken = F.flatten(F.array(*[values(doc, s) for s in layout.languages])) if layout.languages else F.array().cast(NO_TEXTS)
    regions = F.flatten(F.array(*[values(doc, s) for s in layout.regions])) if layout.regions else F.array().cast(NO_TEXTS)
    rest = F.map_filter(F.try_variant_get(doc, "$", "map<string,variant>"), lambda k, v: ~k.isin(*layout.used()) & ~F.to_json(v).isin("null", '""', "[]", "{}"))
    tags = [F.transform(values(doc, s), _tag(group)) for group, s in layout.tags.items()]
    parts = {
        "idno": text(doc, layout.idno), "title": title, "alternate_title": F.when(alternate != title, alternate).otherwise(F.lit("")),
        "identifiers": _pairs("type", "identifier", [(F.lit(kind), text(doc, f)) for f, kind in layout.identifiers.items()]),
        "authors": values(doc, layout.authors) if layout.authors else F.array().cast(NO_TEXTS),
        **{to: first(*map(day, fields)) for to, fields in layout.dates.items()}, **{to: first(*[text(doc, f) for f in fields]) for to, fields in layout.texts.items()},
        "countries": countries(doc, layout, codes or {}), "spatial_coverage": F.array_join(regions, " ; "), "languages": coded(spoken, languages or {}),
        "themes": terms(doc, layout.themes, once), "topics": terms(doc, layout.topics, once), "keywords": terms(doc, layout.keywords, once),
        "relations": _pairs("type", "name", [(F.lit(kind), text(doc, f)) for f, kind in layout.relations.items()]),
        "tags": F.concat(F.array().cast("array<struct<tag:string,tag_group:string>>"), *tags),
        "additional": F.map_from_entries(F.transform(F.map_entries(F.coalesce(rest, F.create_map().cast("map<string,variant>"))), lambda e: F.struct(F.replace(e["key"], F.lit("."), F.lit("_")).alias("key"), F.to_json(e["value"]).alias("value")))),
    }
    return df.withColumn("record", F.struct(*[c.alias(k) for k, c in parts.items()]))


def _tag(group: str):
    return lambda v: F.struct(v.alias("tag"), F.lit(group).alias("tag_group"))
