"""Explanations of anomalies: parsing model answers, ids, grouping by context, agreement, review items (W1)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVIDENCE = "array<struct<name:string,date_range:string,source_type:string,verifiability:string>>"
ANOMALY = f"struct<window:array<int>,is_anomaly:boolean,classification:string,confidence:double,explanation:string,evidence_strength:string,evidence_source:{EVIDENCE},source:string>"


def compact_id(*parts: Column) -> Column:
    """'a1' and 32 hex digits over the parts, joined by a zero byte."""
    return F.concat(F.lit("a1"), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 32))


def strip_fence(text: Column) -> Column:
    """Without a Markdown code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def parse_answers(df: DataFrame, answer: str = "response") -> DataFrame:
    """One row for each anomaly in a JSON answer: an object with anomalies, or an array of them, fenced or not."""
    body = strip_fence(F.col(answer))
    listed = F.from_json(body, f"struct<anomalies:array<{ANOMALY}>>").getField("anomalies")
    anomalies = F.when(body.startswith("["), F.from_json(body, f"array<{ANOMALY}>")).otherwise(listed)
    return df.withColumn("anomaly", F.explode(anomalies)).select("*", "anomaly.*").drop("anomaly")


def parse_legacy_id(custom_id: Column) -> Column:
    """nosearch-{hash}-{indicator}-{geography}-{md5}; the indicator may hold hyphens. Null if it is no such id."""
    pattern = r"^nosearch-([^-]*)-(.*)-([^-]+)-([0-9a-fA-F]{32})$"
    part = lambda k: F.regexp_extract(custom_id, pattern, k)
    return F.when(custom_id.rlike(pattern), F.struct(part(1).alias("prompt_hash"), part(2).alias("indicator_id"), part(3).alias("geography_id"), part(4).alias("context_md5")))


def resolve_ids(df: DataFrame, id_map: DataFrame, custom_id: str = "custom_id") -> DataFrame:
    """Series keys from the map, else from a legacy id; rows with neither go."""
    legacy = parse_legacy_id(F.col(custom_id))
    found = df.join(id_map.select(custom_id, F.col("indicator_id").alias("_i"), F.col("geography_id").alias("_g")), custom_id, "left")
    found = found.withColumns({"indicator_id": F.coalesce("_i", legacy["indicator_id"]), "geography_id": F.coalesce("_g", legacy["geography_id"])}).drop("_i", "_g")
    return found.where(F.col("indicator_id").isNotNull())


def outer_join(named: dict[str, DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join of explainers' rows by key; each value column gets its explainer's name as suffix."""
    frames = [df.select(*keys, *[F.col(v).alias(f"{v}_{name}") for v in values]) for name, df in named.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.join(frame, keys, "full_outer")
    return out


def by_context(named: dict[str, DataFrame], keys: list[str], value: str, order: str) -> DataFrame:
    """All explainers' values of a context as a list, in order; rows with a null key go, frames without the keys too."""
    usable = {n: df for n, df in named.items() if set(keys) <= set(df.columns)}
    union = None
    for name, df in usable.items():
        one = df.select(*keys, F.lit(name).alias("provider"), F.col(value).alias("value"), F.col(order).alias("ord"))
        union = one if union is None else union.unionByName(one)
    return union.na.drop(subset=keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "provider", "value"))).alias("explanations"))


def agreement(grouped: DataFrame) -> DataFrame:
    """single, agree or disagree, and the first explainer's value, for by_context() rows."""
    n = F.size("explanations")
    kinds = F.size(F.array_distinct(F.transform("explanations", lambda e: e["value"])))
    return grouped.withColumns({"n_explainers": n, "agreement": F.when(n == 1, "single").when(kinds == 1, "agree").otherwise("disagree"), "primary": F.element_at("explanations", 1)["value"]})


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of each pair of values, with totals marked 'All'; rows with a null go."""
    rows = df.na.drop(subset=[a, b]).select(F.col(a).cast("string").alias(a), F.col(b).cast("string").alias(b))
    total = lambda c: F.when(F.grouping(c) == 1, "All").otherwise(F.col(c))
    return rows.cube(a, b).agg(F.count("*").alias("n"), total(a).alias("_a"), total(b).alias("_b")).select(F.col("_a").alias(a), F.col("_b").alias(b), "n")


def parse_window(window: Column) -> Column:
    """'1999-2003' or '1999' as (start, end)."""
    at = lambda k: F.element_at(F.split(window, "-"), k).try_cast("int")
    return F.struct(at(1).alias("start"), at(-1).alias("end"))


def latest_feedback(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest entry of each key: what an upsert keeps."""
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])))
    return ranked.where("_k = 1").drop("_k")


def openai_request(custom_id: Column, model: str, prompt: Column) -> Column:
    """A batch request row as JSON text."""
    message = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/responses").alias("url"), F.struct(F.lit(model).alias("model"), message.alias("input")).alias("body")))


#: Formatters of batch requests and parsers of explainers' rows, by name; register_* adds to them.
FORMATTERS = {"openai": openai_request}
EXPLAINERS: dict = {}


def register_formatter(name: str, function) -> None:
    FORMATTERS[name] = function


def register_explainer(name: str, function) -> None:
    EXPLAINERS[name] = function


def generate_content_request(custom_id: Column, prompt: Column, system: str = "", schema: str = "{}", max_tokens: int = 8192) -> Column:
    """A request row in the layout of contents with parts, as JSON text. schema: the answer's JSON schema."""
    contents = F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.coalesce(prompt, F.lit("")).alias("text"))).alias("parts")))
    config = F.struct(F.lit(0).alias("temperature"), F.lit(1).alias("topP"), F.lit(max_tokens).alias("maxOutputTokens"), F.lit("application/json").alias("responseMimeType"), F.parse_json(F.lit(schema)).alias("responseJsonSchema"))
    fields = [contents.alias("contents"), config.alias("generation_config"), *([F.struct(F.array(F.struct(F.lit(system).alias("text"))).alias("parts")).alias("system_instruction")] if system else [])]
    return F.to_json(F.struct(custom_id.alias("key"), F.struct(*fields).alias("request")))


def message_request(custom_id: Column, model: str, prompt: Column, system: str = "", schema: str = "{}", max_tokens: int = 8192) -> Column:
    """A request row in the layout of messages with a system text, as JSON text; list bounds that the layout doesn't take are loosened."""
    output = F.struct(F.struct(F.lit("json_schema").alias("type"), F.parse_json(F.lit(json.dumps(loosened(json.loads(schema))))).alias("schema")).alias("format"))
    message = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    params = F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), F.lit(0).alias("temperature"), F.lit(system).alias("system"), message.alias("messages"), output.alias("output_config"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), params.alias("params")))


def loosened(schema):
    """A JSON schema whose lists ask for one item at most and have no upper bound."""
    if isinstance(schema, list):
        return [loosened(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    lists = schema.get("type") == "array"
    kept = {k: loosened(v) for k, v in schema.items() if not (lists and k == "maxItems")}
    if lists and isinstance(kept.get("minItems"), int):
        kept["minItems"] = min(1, kept["minItems"])
    return kept


def candidate_text(answer: Column) -> Column:
    """The text of the first part of the first candidate of an answer row."""
    return F.get_json_object(answer, "$.response.candidates[0].content.parts[0].text")


def message_text(answer: Column) -> Column:
    """The text blocks of a message answer that succeeded, one after another; null otherwise."""
    blocks = F.from_json(F.get_json_object(answer, "$.result.message.content"), "array<struct<type:string,text:string>>")
    text = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "")
    return F.when((F.get_json_object(answer, "$.result.type") == "succeeded") & (F.trim(text) != ""), text)


def window_text(window: Column) -> Column:
    """'a-b' for a window of two years or more, '' for anything else."""
    return F.when(F.size(window) >= 2, F.concat_ws("-", window[0].cast("string"), F.element_at(window, -1).cast("string"))).otherwise(F.lit(""))


def feedback_row(df: DataFrame, keys: list[str], maps: list[str]) -> DataFrame:
    """Feedback as flat rows: maps as JSON texts, the keys joined by '|' as item_key."""
    flat = df.withColumns({m: F.coalesce(F.to_json(m), F.lit("{}")) for m in maps})
    return flat.withColumn("item_key", F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Rows of an older layout with the columns that came later, and defaults for nulls."""
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in defaults.items()})


def arbiter_prompt(indicator: Column, geography: Column, window: Column, explanations: Column) -> Column:
    """The question that asks a judge to settle several explanations (an array) of one window."""
    return F.concat(F.lit("Indicator: "), indicator, F.lit("\nGeography: "), geography, F.lit("\nWindow: "), window, F.lit("\nExplanations:\n"), F.to_json(explanations))


def settled(grouped: DataFrame, verdict: Column) -> DataFrame:
    """by_context() rows with one value each: a single explanation as it is, else the judge's verdict, else the first explanation; and where it is from."""
    first, n = F.element_at("explanations", 1)["value"], F.size("explanations")
    source = F.when(n < 2, "single_explainer").when(verdict.isNotNull(), "arbiter").otherwise("fallback")
    return grouped.withColumns({"value": F.when(n < 2, first).otherwise(F.coalesce(verdict, first)), "source": source})


FORMATTERS |= {"gemini": generate_content_request, "anthropic": message_request}
EXPLAINERS |= {"gemini": candidate_text, "anthropic": message_text}
