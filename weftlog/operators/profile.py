"""Parameter profiles of APIs, in long tables: requests, parameters and parameter sets by site, path and method."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.functions.text import name_set, redact, value_type
from weftlog.functions.url import openapi_template

KEYS = ["site_id", "path", "method"]
LOCATIONS = ("path", "query", "header", "body")
MAX_EXAMPLES, TOP_SETS, SAMPLES_PER_METHOD, SAMPLES_PER_PATH = 8, 20, 40, 40


def methods(requests: DataFrame, keys: list[str] = KEYS, columns: dict[str, str] | None = None) -> DataFrame:
    """Requests of each method, and how many have parameters in each location."""
    columns = columns or {"query": "param_pairs", "body": "body_param_pairs"}
    return requests.groupBy(*keys).agg(F.count("*").alias("request_count"), *[F.count_if(F.size(c) > 0).alias(f"with_{loc}") for loc, c in columns.items()])


def parameters(requests: DataFrame, request: str, location: str, pairs: str, keys: list[str] = KEYS) -> DataFrame:
    """Per parameter: pairs, requests that have it, empty values, ratios, types by frequency, first distinct examples.

    ``request`` identifies and orders requests. A request's type of a repeated name is its last pair's.
    """
    total = requests.groupBy(*keys).agg(F.count("*").alias("request_count"))
    pair = requests.select(*keys, request, F.posexplode(pairs).alias("pos", "p")).select(*keys, request, "pos", F.col("p.name").alias("param"), F.col("p.value").alias("value"))
    by = [*keys, "param"]
    one = pair.groupBy(*by, request).agg(F.count("*").alias("pairs"), F.count_if(F.col("value") == "").alias("empty"), F.max(F.struct("pos", value_type(F.col("value")).alias("type"))).alias("last"))
    counts = one.groupBy(*by).agg(F.sum("pairs").alias("count"), F.count("*").alias("present_count"), F.sum("empty").alias("empty_count"))
    kinds = one.groupBy(*by, F.col("last.type").alias("type")).agg(F.count("*").alias("n"), F.min(request).alias("seen"))
    types = kinds.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "seen", "type"))), lambda x: x["type"]), ",").alias("types"))
    shown = pair.filter("value != ''").withColumn("value", redact(F.col("param"), F.col("value"))).groupBy(*by, "value").agg(F.min(F.struct(request, "pos")).alias("seen"))
    shown = shown.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("seen"))).filter(F.col("r") <= MAX_EXAMPLES)
    examples = shown.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]), " | ").alias("examples"))
    out = counts.join(types, by).join(examples, by, "left").join(total, keys)
    return out.withColumns({"location": F.lit(location), "required_ratio": F.round(F.col("present_count") / F.col("request_count"), 4), "empty_ratio": F.round(F.col("empty_count") / F.col("count"), 4)})


def parameter_sets(requests: DataFrame, request: str, pairs: str, keys: list[str] = KEYS, top: int = TOP_SETS) -> DataFrame:
    """The most frequent name sets of each method with their share; the empty set counts for the limit and is left out after."""
    sets = requests.select(*keys, request, name_set(F.col(pairs)).alias("params"))
    counts = sets.groupBy(*keys, "params").agg(F.count("*").alias("n"), F.min(request).alias("seen"))
    whole = F.sum("n").over(Window.partitionBy(*keys))
    ranked = counts.withColumns({"ratio": F.round(F.col("n") / whole, 4), "r": F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "seen"))})
    return ranked.filter((F.col("r") <= top) & (F.col("params") != "")).drop("r", "seen")


def samples(requests: DataFrame, request: str, site: str = "site_id", path: str = "path", method: str = "method") -> DataFrame:
    """The first requests of each method, and of each path at most ``SAMPLES_PER_PATH``, methods in order of first request."""
    by = [site, path, method]
    first = requests.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(request))).filter(F.col("r") <= SAMPLES_PER_METHOD)
    opening = first.groupBy(*by).agg(F.min(request).alias("opening"))
    order = Window.partitionBy(site, path).orderBy("opening", "r")
    return first.join(opening, by).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= SAMPLES_PER_PATH).drop("opening", "r")


def log_sample(url: Column, method: Column, query: Column, status: Column, content_type: Column, content_length: Column, body_pairs: Column | None = None, header_pairs: Column | None = None) -> Column:
    """A request as it is shown: request and response, values of body and headers redacted and cut.

    Of a name that repeats the last value counts. Nulls are empty, a method is GET and a status 0; bodies and headers
    without a pair are null, and so is left out of JSON.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))

    def shown(pairs: Column | None) -> Column:
        if pairs is None:
            return F.lit(None).cast("map<string,string>")
        last = F.filter(pairs, lambda p, i: F.size(F.filter(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["name"] == p["name"])) == 0)
        return F.when(F.size(pairs) > 0, F.map_from_entries(F.transform(last, lambda p: F.struct(p["name"], redact(p["name"], text(p["value"]))))))

    verb = F.upper(F.coalesce(F.nullif(method, F.lit("")), F.lit("GET")))
    request = F.struct(F.regexp_replace(text(url), r"^[A-Z]+ ", "").alias("url"), verb.alias("method"), text(query).alias("query"), shown(body_pairs).alias("body"), shown(header_pairs).alias("headers"))
    response = F.struct(F.coalesce(status.cast("int"), F.lit(0)).alias("status"), text(content_type).alias("content_type"), text(content_length).alias("content_length"))
    return F.struct(request.alias("request"), response.alias("response"))


def headers(requests: DataFrame, columns: tuple[str, ...] = ("headers", "request_headers", "header_params", "requestHeaders")) -> DataFrame:
    """``requests`` with ``header_pairs``: (name, value) of the first column that is a map, pairs or the text of a JSON object.

    Bad JSON, JSON of another kind, nulls and missing columns give no pairs.
    """
    def pairs(c: str):
        kind = requests.schema[c].dataType.typeName()
        if kind == "map":
            return F.transform(F.map_entries(c), lambda x: F.struct(x["key"].cast("string").alias("name"), x["value"].cast("string").alias("value")))
        if kind == "array":
            return F.transform(F.filter(c, lambda x: F.size(x) >= 2), lambda x: F.struct(x[0].cast("string").alias("name"), x[1].cast("string").alias("value")))
        found = F.map_entries(F.from_json(c, "map<string,string>"))
        return F.when(F.trim(c).startswith("{"), F.transform(found, lambda x: F.struct(x["key"].alias("name"), x["value"].alias("value"))))

    none = F.array().cast("array<struct<name:string,value:string>>")
    return requests.withColumn("header_pairs", F.coalesce(*[pairs(c) for c in columns if c in requests.columns], none))


def top_paths(method: DataFrame, most: int = 0) -> DataFrame:
    """site_id, path and request_count of each site's paths; with ``most`` those with the most requests, ties by path."""
    paths = method.groupBy("site_id", "path").agg(F.sum("request_count").alias("request_count"))
    order = Window.partitionBy("site_id").orderBy(F.desc("request_count"), "path")
    return paths.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most) if most else paths


def site_totals(method: DataFrame) -> DataFrame:
    return method.groupBy("site_id").agg(F.count_distinct("path").alias("path_count"), F.sum("request_count").alias("request_count"))


def openapi_paths(params: DataFrame) -> DataFrame:
    """One row per path template: its OpenAPI path item as JSON, built from the profile alone.

    Parameters present in every request are required; ties are ordered by count and name.
    """
    kind = F.substring_index("types", ",", 1)
    schema = F.when(kind == "INT", "integer").when(kind == "FLOAT", "number").when(kind == "BOOL", "boolean").when(kind.isin("ARRAY", "LIST"), "array").when(kind == "JSON", "object").otherwise("string")
    entry = F.struct((-F.col("required_ratio")).alias("o1"), (-F.col("count")).alias("o2"), F.col("param").alias("name"), F.col("location").alias("in"), (F.col("required_ratio") >= 1).alias("required"), F.struct(schema.alias("type")).alias("schema"))
    named = params.withColumn("template", openapi_template(F.col("path")))
    ops = named.groupBy("site_id", "template", "method").agg(F.array_sort(F.collect_list(entry)).alias("p"))
    op = F.struct(F.concat_ws(" ", "method", "template").alias("summary"), F.concat(F.lower("method"), F.regexp_replace("template", "[^A-Za-z0-9]+", "_")).alias("operationId"), F.transform("p", lambda x: F.struct(x["name"].alias("name"), x["in"].alias("in"), x["required"].alias("required"), x["schema"].alias("schema"))).alias("parameters"))
    return ops.select("site_id", "template", F.lower("method").alias("m"), op.alias("op")).groupBy("site_id", "template").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("m", "op"))))).alias("item"))
