"""Catalogue studies and data dictionaries: header mapping, study rows, variables, identifiers, code look-ups (W1, W4, W6)."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import clean_text, make_vgid, squeeze
from tidemark.operators.curation import met_forms
from tidemark.operators.metadata import ALIASES, metadata_type, path

#: Header names, without punctuation, by the canonical column they stand for.
HEADERS = {
    "indicator_id": "indicator indicatorcode indicator_code ind indicatorid",
    "indicator_name": "indicatorname indicator_name indicatorlabel indicator_label",
    "geography_id": "countrycode country_code refarea ref_area geographyid geography_id geo_id iso iso3",
    "geography_name": "countryname country_name refarealabel ref_area_label geographyname geography_name",
    "period": "year period time date",
    "value": "value",
    "is_imputed": "imputed is_imputed isimputed",
    "anomaly_score": "abszscore abszscore_zscore abszscorezscore zscore anomalyscore anomaly_score score",
    "outlier_count": "outlierindicatortotal outlier_indicator_total outliercount outlier_count",
    "freq": "freq frequency",
}
VARIABLE = "struct<name:string,nvar:string,id:string,labl:string,label:string,qstn:struct<qstnlit:string>,txt:string,description:string,catgry:array<struct<catValu:string,code:string,labl:string,label:string>>>"
RESOURCE = "array<struct<dcformat:string,is_url:string,url:string,title:string>>"


def normal_header(name: Column) -> Column:
    """A header in lower case with single underscores for other signs."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def suggest_mappings(headers: DataFrame, table: str, place: str, header: str) -> DataFrame:
    """Rows (table, canonical, source): for each canonical column the first header of a table that is known to stand for it."""
    known = headers.sparkSession.createDataFrame([(a, c) for c, names in HEADERS.items() for a in names.split()], "_a string, canonical string")
    found = headers.withColumn("_a", normal_header(F.col(header))).join(F.broadcast(known), "_a")
    return found.groupBy(table, "canonical").agg(F.min_by(header, place).alias("source"))


def suggest_mapping(headers: list[str]) -> dict[str, str]:
    """The same for one list of headers."""
    known = {a: c for c, names in HEADERS.items() for a in names.split()}
    out: dict[str, str] = {}
    for h in headers:
        name = "_".join("".join(x if x.isascii() and x.isalnum() else " " for x in h.strip().lower()).split())
        if name in known:
            out.setdefault(known[name], h)
    return out


def valid_targets(mapping: dict, headers: list[str]) -> dict[str, str]:
    """Of a suggested mapping what maps a known canonical column to a header that exists."""
    return {k: v for k, v in mapping.items() if k in HEADERS and v in headers}


def variables(df: DataFrame, name: str, label: str, description: str, labels: str) -> DataFrame:
    """Dictionary variables from table rows: trimmed, value labels from JSON; rows without a name or label go."""
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    made = df.withColumns({"variable_name": text(name), "label": text(label), "description": text(description), "value_labels": F.from_json(labels, "map<string,string>")})
    return made.where("variable_name IS NOT NULL AND label IS NOT NULL")


def listed_variables(raw: Column) -> Column:
    """A dictionary variable from a catalogue's JSON: the first of its names and texts, value labels from its categories."""
    v = F.from_json(raw, VARIABLE)
    first = lambda *cs: F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])
    name = first(v["name"], v["nvar"], v["id"])
    codes = F.filter(F.transform(v["catgry"], lambda c: F.struct(F.coalesce(first(c["catValu"], c["code"]), F.lit("")).alias("k"), F.coalesce(first(c["labl"], c["label"]), F.lit("")).alias("v"))), lambda c: c["k"] != "")
    labels = F.when(F.size(codes) > 0, F.map_from_entries(F.array_distinct(codes)))
    return F.struct(name.alias("variable_name"), F.coalesce(first(v["labl"], v["label"]), name).alias("label"), first(v["qstn"]["qstnlit"], v["txt"], v["description"]).alias("description"), labels.alias("value_labels"))


def studies(payload: Column) -> Column:
    """The studies of an answer as JSON texts: a list, a single one, or the answer itself; a failed answer raises."""
    status = F.lower(F.coalesce(path(payload, "status"), F.lit("")))
    listed = F.from_json(path(payload, "studies"), "array<string>")
    itself = F.when(path(payload, "metadata").isNotNull() | path(payload, "filters").isNotNull(), F.array(payload)).otherwise(F.array().cast("array<string>"))
    found = F.coalesce(listed, F.when(path(payload, "study").isNotNull(), F.array(path(payload, "study"))), itself)
    failed = F.raise_error(F.concat(F.lit("answer says "), status, F.lit(": "), F.coalesce(path(payload, "message"), path(payload, "error"), status))).cast("array<string>")
    return F.when(status.isin("success", "ok", ""), found).otherwise(failed)


def _said(study: Column, *dotted: str) -> Column:
    """The first text at these paths that isn't empty, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(path(study, p)), F.lit("")) for p in dotted])


def study_row(study: Column) -> Column:
    """A study's id, idno and type: the metadata's own type before the filters'."""
    kind = _said(study, "metadata.type", "filters.dataset_type", "core_fields.type", "type")
    return F.struct(F.coalesce(path(study, "core_fields.id"), path(study, "id")).alias("id"), _said(study, "core_fields.idno", "idno").alias("idno"), metadata_type(kind).alias("type"))


def study_metadata(study: Column) -> Column:
    """A study (JSON) as a catalogue record (JSON): its metadata with its idno, type, filters (_extract_filters) and downloads (external_resources), those it has.

    A download is a resource whose link is one and has an address; a study whose metadata is no object raises, a null one gives null.
    """
    whole, row = F.try_parse_json(study), study_row(study)
    meta = F.try_variant_get(whole, "$.metadata", "map<string,variant>")
    raw = F.coalesce(F.try_variant_get(whole, "$.resources", "array<variant>"), F.array().cast("array<variant>"))
    text = lambda r, p: F.try_variant_get(r, p, "string")
    null = F.parse_json(F.lit("null"))

    def download(r: Column) -> Column:
        always = {"resource_id": F.coalesce(F.try_variant_get(r, "$.resource_id", "variant"), null), "url": text(r, "$._links.download").cast("variant"), "dcformat": F.coalesce(F.try_variant_get(r, "$.dcformat", "variant"), null), "is_url": F.coalesce(text(r, "$.is_url"), F.lit("0")).cast("variant")}
        more = {k: F.when(text(r, f"$.{k}").isNotNull(), F.try_variant_get(r, f"$.{k}", "variant")) for k in ("title", "dctype", "resource_type", "filename", "sort_order")}
        return F.to_variant_object(_there({**always, **more}))

    offered = F.transform(F.filter(raw, lambda r: (text(r, "$._links.type") == "download") & (text(r, "$._links.download") != "")), download)
    filters = F.try_variant_get(whole, "$.filters", "variant")
    added = {
        "idno": row["idno"].cast("variant"), "type": row["type"].cast("variant"), "_extract_filters": F.when(F.schema_of_variant(filters).startswith("OBJECT"), filters),
        "external_resources": F.when(F.size(offered) > 0, F.to_variant_object(offered)),
    }
    new = _there(added)
    merged = F.map_concat(F.map_filter(meta, lambda k, v: ~F.map_contains_key(new, k)), new)
    return F.when(study.isNotNull() & meta.isNull(), F.raise_error("study without metadata").cast("string")).otherwise(F.to_json(merged))


def _there(fields: dict[str, Column]) -> Column:
    """A map of those fields (VARIANT) that aren't null."""
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields.values())), lambda k, v: v.isNotNull())


def ids_type(row: Column) -> Column:
    """The id, idno and type of a row of a catalogue's search (JSON), the type by its usual name; a null row has nulls."""
    kind = path(row, "type")
    return F.struct(path(row, "id").alias("id"), path(row, "idno").alias("idno"), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), kind), kind).alias("type"))


def page_to_offset(params: dict) -> dict:
    """Catalogue paging (page, ps) as offset and limit; other known parameters stay, empty ones go."""
    size = int(params.get("ps", 100))
    kept = {k: params[k] for k in ("type", "source", "sk", "sort_by", "sort_order") if params.get(k) not in (None, "")}
    return {"limit": size, "offset": (int(params.get("page", 1)) - 1) * size, **kept}


def pdf_candidates(metadata: Column) -> Column:
    """A record's PDF resources that it hosts, else its own address; an is_url other than 0 and 1 raises."""
    listed = F.from_json(path(metadata, "external_resources"), RESOURCE)
    flag = lambda r: F.coalesce(r["is_url"], F.lit("1"))
    checked = F.transform(listed, lambda r: F.when(flag(r).isin("0", "1"), r).otherwise(F.raise_error(F.concat(F.lit("invalid is_url: "), flag(r))).cast("struct<dcformat:string,is_url:string,url:string,title:string>")))
    hosted = F.transform(F.filter(checked, lambda r: F.lower(F.trim(r["dcformat"])).isin("application/pdf", "pdf") & (flag(r) == "0") & (F.coalesce(r["url"], F.lit("")) != "")), lambda r: r["url"])
    own = F.filter(F.array(path(metadata, "document_description.url")), lambda u: F.coalesce(u, F.lit("")) != "")
    return F.when(F.size(F.coalesce(hosted, F.array().cast("array<string>"))) > 0, hosted).otherwise(own)


def doi(identifiers: Column) -> Column:
    """The first identifier (array of type and identifier) of type doi."""
    return F.get(F.filter(identifiers, lambda x: F.lower(F.trim(x["type"])) == "doi"), F.lit(0))["identifier"]


def dimensions_text(dimensions: Column, limit: int = 10) -> Column:
    """A line for each dimension (name, codes) of up to limit codes: its name and their labels."""
    few = F.filter(dimensions, lambda d: F.size(d["codes"]).between(1, limit))
    return F.array_join(F.transform(few, lambda d: F.concat(F.lit("- "), d["name"], F.lit(": "), F.array_join(d["codes"], ", "))), "\n")


def project_json(payload: Column, allowed: list[str]) -> Column:
    """A JSON record with only the allowed dotted paths and what encloses them."""
    tree: dict = {}
    for p in allowed:
        at = tree
        for k in p.split("."):
            at = at.setdefault(k, {})

    def build(node: dict, prefix: str) -> Column:
        return F.struct(*[(build(sub, f"{prefix}{k}.") if sub else path(payload, prefix + k)).alias(k) for k, sub in node.items()])

    return F.to_json(build(tree, ""))


def ratings(df: DataFrame, key: str, content: str, ids: list[str]) -> DataFrame:
    """One row a record with a column <id>_rating for each id of its JSON list of (id, analysis, rating)."""
    each = df.select(key, F.explode(F.from_json(content, "array<struct<id:string,analysis:string,rating:double>>")).alias("x"))
    return each.groupBy(key).agg(*[F.max(F.when(F.col("x.id") == i, F.col("x.rating"))).alias(f"{i}_rating") for i in ids])


def verticals(topics: Column, known: list[str]) -> Column:
    """The known topics in order, joined by ';'; 'N/A' for none."""
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(F.filter(topics, lambda t: t.isin(*known)))), ";"), F.lit("")), F.lit("N/A"))


def alt_titles(titles: Column) -> Column:
    return F.array_join(F.filter(F.transform(titles, lambda t: clean_text(t)), lambda t: t != ""), " / ")


def record_number(value: Column) -> Column:
    """The number in a record's address or the value itself if it is one; null otherwise."""
    v = F.trim(F.coalesce(value, F.lit("")))
    found = F.regexp_extract(v, r"(?i)guid=(\d+)|/(\d+)(?:[/?#]|$)", 1)
    other = F.regexp_extract(v, r"(?i)guid=(\d+)|/(\d+)(?:[/?#]|$)", 2)
    return F.coalesce(F.nullif(found, F.lit("")), F.nullif(other, F.lit("")), F.when(v.rlike(r"^\d+$"), v))


def looked_up(df: DataFrame, key: str, codes: DataFrame, code: str, name: str, to: str, special: dict[str, str] | None = None, missing: str | None = None) -> DataFrame:
    """df with the name of a code (or code of a name): special cases first, then a left join on codes, then missing, or the key itself."""
    table = codes.select(F.col(code).alias("_c"), F.col(name).alias("_n")).dropDuplicates(["_c"])
    joined = df.join(table, F.trim(F.col(key)) == F.col("_c"), "left")
    fixed = F.element_at(F.create_map(*[F.lit(x) for pair in (special or {"": ""}).items() for x in pair]), F.trim(F.coalesce(F.col(key), F.lit(""))))
    return joined.withColumn(to, F.coalesce(fixed, F.col("_n"), F.lit(missing) if missing is not None else F.col(key))).drop("_c", "_n")


def place_forms(countries: DataFrame, cities: DataFrame, aliases: DataFrame | None = None, least: int = 1_000_000) -> DataFrame:
    """Rows (code, form): country names, cities of at least so many people and given aliases, in lower case, once each."""
    each = countries.select("code", F.col("name").alias("form")).union(cities.where(F.col("population") >= least).select("code", "name"))
    each = each if aliases is None else each.union(aliases.select("code", "form"))
    return each.select("code", squeeze(F.lower("form")).alias("form")).where("form <> ''").distinct()


def strip_places(df: DataFrame, text: str, forms: DataFrame, to: str) -> DataFrame:
    """df with the text in lower case without any of forms (form), the longest first, where they begin and end at a word's edge; a null text gives an empty one.

    Each distinct text meets the forms whose first two words stand in it and is rid of those in one pass, so a gazetteer may have any size: only the few
    forms that a text may hold become its pattern.
    """
    runs = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))
    texts = df.select(F.md5(text).alias("_k"), F.lower(text).alias("_p")).where("_k IS NOT NULL").dropDuplicates(["_k"])
    named = forms.select(F.lower("form").alias("form")).where("form <> ''").distinct()
    met = met_forms(texts, runs(F.col("_p")), named, runs(F.col("form"))).groupBy("_k").agg(F.array_sort(F.collect_set(F.struct((-F.length("form")).alias("n"), "form"))).alias("_f"))
    quoted = F.array_join(F.transform("_f", lambda f: F.concat(F.lit("\\Q"), f["form"], F.lit("\\E"))), "|")
    joined = df.withColumn("_k", F.md5(text)).join(met.select("_k", F.concat(F.lit(r"(?U)\b("), quoted, F.lit(r")\b")).alias("_r")), "_k", "left")
    return joined.withColumn(to, squeeze(F.when(F.col("_r").isNull(), F.lower(text)).otherwise(F.regexp_replace(F.lower(text), F.col("_r"), F.lit(" "))))).drop("_k", "_r")


def camel_name(name: Column) -> Column:
    """Words with a capital, capitals as they are, single letters in capitals, small words low except at the beginning."""
    small = "of and in for on at with the".split()
    words = F.split(squeeze(name), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when((F.upper(w) == w) & (F.lower(w) != w), w).when(F.length(w) == 1, F.upper(w)).when(F.lower(w).isin(*small) & (i > 0), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))), " ")


def hierarchy_text(canonical: Column, aliases: Column, prototypes: Column) -> Column:
    """A family as a tree of lines: its canonical name, its aliases in quotes, its prototypes (array of names)."""
    quoted = F.array_join(F.transform(aliases, lambda a: F.concat(F.lit('"'), a, F.lit('"'))), ", ")
    lines = F.array(
        F.concat(canonical, F.lit("  <-- Canonical")), F.when(F.size(aliases) > 0, F.concat(F.lit("├─ Aliases: "), quoted)),
        F.when(F.size(prototypes) > 0, F.concat(F.lit("├─ Prototypes:\n"), F.array_join(F.transform(prototypes, lambda p: F.concat(F.lit("│   ├─ "), p)), "\n"))),
    )
    return F.array_join(F.array_compact(lines), "\n")


def variable_lines(listed: Column) -> Column:
    """Numbered lines of variables (array of name and label)."""
    return F.array_join(F.transform(listed, lambda v, i: F.concat((i + 1).cast("string"), F.lit(". "), v["name"], F.lit(": "), v["label"])), "\n")


def curated_group(answer: Column, candidates: Column, cluster: Column) -> Column:
    """A model's variable group (JSON: label, variables, definition) checked: names trimmed; none, a repeated or an unknown one raises."""
    g = F.from_json(answer, "struct<label:string,variables:array<string>,definition:string>")
    names = F.filter(F.transform(g["variables"], lambda v: F.trim(v)), lambda v: v != "")
    unknown = F.array_except(names, candidates)
    fault = F.when(F.coalesce(F.size(names), F.lit(0)) < 1, "no variables").when(F.size(F.array_distinct(names)) < F.size(names), "repeated variables").when(F.size(unknown) > 0, F.concat(F.lit("unknown variables: "), F.array_join(unknown, ", ")))
    kept = F.when(fault.isNotNull(), F.raise_error(fault).cast("array<string>")).otherwise(names)
    return F.struct(make_vgid(g["label"], cluster).alias("vgid"), F.array_join(kept, " ").alias("variables"), g["label"].alias("label"), g["definition"].alias("definition"))


def cluster_map(df: DataFrame, cluster: str, item: str, label: str) -> DataFrame:
    """Clusters with their items in order, their size and an estimate of their tokens (10 and the words of its label for each)."""
    words = F.size(F.filter(F.split(F.coalesce(F.col(label), F.lit("")), r"\s+"), lambda w: w != ""))
    return df.groupBy(cluster).agg(F.array_sort(F.collect_list(item)).alias("items"), F.count("*").alias("n"), F.sum(words + 10).alias("tokens"))


def leaf_paths(df: DataFrame, payload: str) -> DataFrame:
    """Rows (path, n): every dotted path to a value in the JSON records, lists passed through, and how many records have it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts: Counter = Counter()
            for record in frame[payload].dropna():
                todo, seen = [("", json.loads(record))], set()
                while todo:
                    at, node = todo.pop()
                    if isinstance(node, dict):
                        todo += [(f"{at}.{k}" if at else k, v) for k, v in node.items()]
                    elif isinstance(node, list):
                        todo += [(at, v) for v in node]
                    else:
                        seen.add(at)
                counts.update(seen)
            yield pd.DataFrame({"path": list(counts), "n": list(counts.values())})

    return df.select(payload).mapInPandas(run, "path string, n bigint").groupBy("path").agg(F.sum("n").alias("n"))


def missing_paths(df: DataFrame, payload: str, required: list[str]) -> DataFrame:
    """Rows (path, n_missing) of the required paths that not every record has."""
    wanted = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), path(F.col(payload), p).isNull().cast("long").alias("n_missing")) for p in required]))
    return df.select(wanted.alias("x")).select("x.*").groupBy("path").agg(F.sum("n_missing").alias("n_missing")).where("n_missing > 0")
