"""Rules from reviewed scenarios: activities, order clauses, parameter scopes and formulas, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.operators import apidocs
from weftlog.operators.apidocs import METHOD, normal_api
from weftlog.operators.detection import BOUND
from weftlog.operators.graph import written
from weftlog.operators.openapi import OBJECT, SENSITIVE
from weftlog.operators.reviews import BINDING_DDL, DETAILS, OCCURRENCE_DDL, parameter_text, sequence_text

# Names of security types, and words that say there is no parameter risk.
SECURITY_NAMES = {"对象级越权": "BOLA", "横向越权": "BOLA", "功能级越权": "BFLA", "纵向越权": "BFLA", "对象属性级越权": "BOPLA", "属性越权": "BOPLA", "认证绕过": "AUTH_BYPASS", "资源消耗": "RESOURCE_CONSUMPTION", "其他": "OTHER"}
UNKNOWN_STEP = "无法确定"
NO_PARAMETERS = ("无", "none", "n/a", "na")
ADMIN = r"(?i)(admin|permission|role|config|workflow|scheme|manage|delete|project.?role)"
AUTH = r"(?i)(login|auth|session|cookie|token|xsrf|csrf|secure)"
FREQUENT = r"(?i)(search|upload|download|export|avatar|attachment|jql|cql|poll|notification|gadget|autocomplete)"
ATTACK = r"(?i)(attack|攻击|漏洞|枚举|篡改|绕过|越权|高危|直接调用)"
RISKY_PARTS = r"(leader|admin|delete|permission|config|token|search|export)"
PLAIN_TOKENS = ("get", "post", "put", "patch", "delete", "api", "jira", "rest")
TOKEN, HAN_TOKEN = r"[A-Za-z][A-Za-z0-9_/-]{2,}", r"[\u4e00-\u9fff]{2,}"
NO_ACTIVITY, LOGGED_IN = "A_risk", "authenticated_session"
NO_PARAMETER_RISK = ("无明显参数风险", "无参数风险", "无明显", "无", "none", "no obvious", "not applicable")
UPSTREAM_FORM = r"(?i)(前置|上下文|来源|继承|来自|绑定|跳过|缺失)"
BOUND_FORM = r"(?i)(绑定|所属|owner|project|issue|user|context|上下文|来源|来自)"
TOGETHER = (
    r"both|两者|同时|(参数|id|key|project|issue|user|object|对象).{0,20}(前置|上下文|来源|继承|来自|绑定|跳过|缺失)"
    r"|(前置|上下文|来源|继承|来自|绑定|跳过|缺失).{0,20}(参数|id|key|project|issue|user|object|对象)"
)
OCCURRENCES = (
    ("contexts", "context_source", "response_or_inferred", "参数可能来自上游上下文或响应结果，需要结合 OpenAPI 或原始请求确认。"),
    ("targets", "target_parameter", "unknown", "参数用于约束目标 API，但具体位置需要结合 OpenAPI 或原始请求确认。"),
)
BINDING_TEXT = " 应由上游上下文约束目标 API，避免中途替换或脱离上下文。"
CONCLUSIONS = {
    "both": ("RatedCombinedSequenceParameterRisk", "当顺序链被破坏，并且关键对象参数也存在来源不明、中途替换或上下文不一致时，产生组合风险评级。"),
    "sequence": ("RatedSequenceOrderRisk", "如果会话中出现跳步、越序、关键步骤缺失或敏感步骤过早出现，则产生序列顺序风险评级。"),
    "parameter": ("RatedParameterRisk", "如果目标 API 中出现关键参数，但该参数没有按正常业务上下文传递、绑定或保持一致，则产生参数一致性风险评级。"),
}
# End of fixed values.

def texts(a: Column) -> Column:
    """The non-blank entries of a list, trimmed; none for null."""
    return F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def security_name(x: Column) -> Column:
    names = F.create_map(*[F.lit(v) for kv in SECURITY_NAMES.items() for v in kv])
    t = F.trim(F.coalesce(x, F.lit("")))
    return F.coalesce(F.try_element_at(names, t), F.nullif(t, F.lit("")), F.lit("OTHER"))


def score_tokens(text: Column) -> Column:
    """Distinct words of a text to look for in an API: whole ones, their parts of three letters or more, and runs of Han characters."""
    whole = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda x: F.lower(F.regexp_replace(x, "^/+|/+$", "")))
    whole = F.filter(whole, lambda x: (x != "") & ~x.isin(*PLAIN_TOKENS))
    parts = F.filter(F.flatten(F.transform(whole, lambda x: F.split(x, "[/_-]+"))), lambda x: F.length(x) >= 3)
    return F.array_distinct(F.concat(whole, parts, F.regexp_extract_all(text, F.lit(HAN_TOKEN), F.lit(0))))


def risk_api(scenes: DataFrame, whole: bool = False) -> DataFrame:
    """``scenes`` (text, security_type, context) with ``api`` and ``score`` of the context's riskiest API, and with ``whole`` its entry as ``selected``.

    ``context`` is an array of (api, summary, operation_id, parameters, object_parameters, sensitive_fields).
    A word of the text in the API counts 1, one with a slash 3, and the security type has its bonus. Of equal
    scores the one with more parameters wins, then the first. An empty or null context has none.
    """
    size = lambda a: F.coalesce(F.size(a), F.lit(0))
    of = lambda kind, when, points: F.when((F.col("security_type") == kind) & when, points).otherwise(0)
    marked = scenes.withColumn("__tokens", score_tokens(F.coalesce("text", F.lit(""))))
    named = "operation_id" in scenes.schema["context"].dataType.elementType.names

    def scored(c: Column, i: Column) -> Column:
        words = F.concat_ws(" ", F.coalesce(c["api"], F.lit("")), F.coalesce(c["summary"], F.lit("")), F.coalesce(c["operation_id"], F.lit("")) if named else F.lit(""), F.array_join(F.coalesce(c["parameters"], F.array().cast("array<string>")), " "))
        low = F.lower(words)
        score = F.aggregate(F.filter("__tokens", lambda t: F.contains(low, F.lower(t))), F.lit(0), lambda n, t: n + F.when(F.contains(t, F.lit("/")), 3).otherwise(1))
        score = score + of("BOLA", size(c["object_parameters"]) > 0, 4) + of("BFLA", words.rlike(ADMIN), 5) + of("BOPLA", size(c["sensitive_fields"]) > 0, 5) + of("AUTH_BYPASS", words.rlike(AUTH), 5) + of("RESOURCE_CONSUMPTION", words.rlike(FREQUENT), 4)
        score = score + F.when(F.col("text").rlike(ATTACK) & low.rlike(RISKY_PARTS), 2).otherwise(0)
        return F.struct(score.alias("score"), size(c["parameters"]).alias("n"), (-i).alias("minus"), c["api"].alias("api"))

    best = F.array_max(F.transform("context", scored))
    found = marked.withColumn("__best", best).withColumns({"api": F.col("__best.api"), "score": F.col("__best.score")})
    return (found.withColumn("selected", F.get("context", -F.col("__best.minus"))) if whole else found).drop("__best", "__tokens")


def scenarios(reviews: DataFrame, include_low_trust: bool = False, by: list[str] | None = None) -> DataFrame:
    """One row per scenario of trusted reviews, with its position."""
    kept = reviews if include_low_trust else reviews.filter(F.coalesce("is_trustworthy", F.lit(False)))
    return kept.select(*(by or []), "cluster_index", "business_pattern_name", "trust_score", F.posexplode("possible_security_scenarios").alias("pos", "s"))


def text_of(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit("")))


def related_apis(s: Column) -> Column:
    """All APIs that a scenario names, methods in upper case, in order of code points; steps count if they are calls."""
    seq, par = s["sequence_order_risk"], s["parameter_consistency_risk"]
    told = F.flatten(F.transform(F.coalesce(s["scenario_angles"], F.array()), lambda a: texts(a["related_apis"])))
    steps = F.filter(F.transform(F.concat(*[texts(seq[c]) for c in ("normal_sequence_pattern", "possible_violation_sequence_pattern")]), normal_api), lambda x: x.rlike(METHOD))
    lists = F.concat(told, *[texts(c) for c in (seq["related_apis"], par["target_apis"], par["context_apis"], par["normal_parameter_sequence"])])
    return F.array_sort(F.array_distinct(F.concat(F.transform(lists, normal_api), steps)))


def records_text(a: Column, fields: str) -> Column:
    """Records as text, one a line, with the fields that are filled."""
    one = lambda r: F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f"'{f}': '"), r[f], F.lit("'")) for f in fields.split()]), F.lit("}"))
    return F.array_join(F.transform(a, one), "\n")


def blocks_text(s: Column) -> Column:
    par = s["parameter_consistency_risk"]
    return F.concat_ws("\n", sequence_text(s), parameter_text(s), F.array_join(texts(par["normal_parameter_sequence"]), "\n"), records_text(par["parameter_occurrences"], "parameter api location role evidence"), records_text(par["context_binding"], "source_api target_api parameter relation explanation"))


def scenario_text(s: Column) -> Column:
    """All that a scenario says."""
    angles = F.array_join(F.transform(s["scenario_angles"], lambda a: F.concat_ws("\n", a["angle"], a["reason"], F.array_join(a["related_apis"], "\n"), F.array_join(a["related_parameters_or_objects"], "\n"))), "\n")
    return F.concat_ws("\n", *[s[c] for c in ("scenario_title", "risk_level", "risk_type", "overall_reason", "security_type", *DETAILS, "later_check_hint")], blocks_text(s), angles)


def activities(d: DataFrame) -> DataFrame:
    """Steps as activities: blank ones get a name of their own; symbols A1, A2 ... by first occurrence, the normal order first."""
    seq = F.col("s.sequence_order_risk")
    steps = lambda c, name: F.transform(F.coalesce(seq[c], F.array().cast("array<string>")), lambda x, i: F.coalesce(F.nullif(text_of(x), F.lit("")), F.concat(F.lit(name), (i + 1).cast("string"))))
    d = d.withColumns({"normal": steps("normal_sequence_pattern", "normal_step_"), "risky": steps("possible_violation_sequence_pattern", "violation_step_"), "told": text_of(seq["missing_or_reordered_step"])})
    d = d.withColumn("labels", F.array_distinct(F.concat("normal", "risky")))
    named = F.get(F.filter("normal", lambda x: (F.col("told") != "") & (F.col("told") != UNKNOWN_STEP) & (F.contains(F.col("told"), x) | F.contains(F.col("told"), F.regexp_replace(x, r"^\S+\s+", "")))), F.lit(0))
    left_out = F.get(F.filter("normal", lambda x: ~F.array_contains("risky", x)), F.lit(0))
    d = d.withColumns({"named": named, "missing": F.coalesce(named, left_out)})
    last = lambda c: F.get(c, F.size(c) - 1)
    times = F.transform("labels", lambda x: F.struct((-F.size(F.filter("risky", lambda y: y == x))).alias("minus"), F.array_position("risky", x).alias("at"), x.alias("label")))
    d = d.withColumns({
        "missing_label": F.when(F.col("named").isNull() & F.col("missing").isNotNull(), F.col("missing")).otherwise(F.col("told")),
        "target": F.coalesce(F.when(F.col("missing").isNotNull(), F.get("risky", F.lit(0))), last("risky"), last("normal")),
        "most": F.get(F.array_sort(F.filter(times, lambda t: t["minus"] <= -2)), F.lit(0)), "chain": F.when(F.size("risky") > 0, F.col("risky")).otherwise(F.col("normal")),
    })
    sym = lambda label: F.concat(F.lit("A"), F.array_position("labels", label).cast("string"))
    fill = lambda pattern, *x: F.format_string(pattern, *x)
    required, target = sym(F.col("missing")), F.coalesce(sym(F.col("target")), F.lit(NO_ACTIVITY))
    before, after = sym(F.get("chain", F.size("chain") - 2)), sym(last("chain"))
    repeated, lacks = F.col("most").isNotNull(), F.col("missing").isNotNull()
    scope = F.struct(
        F.when(repeated, "repeated_call").when(lacks, "missing_or_reordered_step").otherwise("risky_order").alias("mode"),
        F.when(repeated, sym(F.col("most.label"))).alias("activity"), F.col("most.label").alias("activity_label"), (-F.col("most.minus")).cast("string").alias("threshold"),
        F.when(~repeated & lacks, required).alias("required_activity"), F.when(~repeated, F.col("missing")).alias("required_activity_label"),
        F.when(~repeated, target).alias("target_activity"), F.when(~repeated, F.coalesce("target", F.lit(""))).alias("target_activity_label"),
    )
    clause = (
        F.when(repeated, fill("CountInSession(s,%s) ≥ %s", sym(F.col("most.label")), (-F.col("most.minus")).cast("string")))
        .when(lacks, fill("Occurs(s,%2$s) ∧ RequiredBefore(%1$s,%2$s) ∧ ¬Before(s,%1$s,%2$s)", required, target))
        .when(F.size("chain") >= 2, fill("Occurs(s,%1$s) ∧ Occurs(s,%2$s) ∧ RiskyAdjacentOrder(s,%1$s,%2$s)", before, after))
        .otherwise(fill("Occurs(s,%1$s) ∧ SequenceOrderUncertain(s,%1$s)", target))
    )
    model = F.struct(
        F.transform("labels", lambda x: F.struct(sym(x).alias("symbol"), x.alias("label"))).alias("activities"), F.transform("normal", sym).alias("normal_chain"), F.transform("risky", sym).alias("risky_chain"),
        F.coalesce(required, F.lit("")).alias("missing_or_reordered_activity"), F.col("missing_label").alias("missing_or_reordered_label"), F.coalesce(seq["violated_order_constraint"], F.lit("")).alias("violated_order_constraint"), target.alias("risk_target_activity"),
        F.coalesce(seq["related_apis"], F.array().cast("array<string>")).alias("related_apis"),
    )
    return d.withColumns({"sequence_scope": scope, "sequence_formula": clause, "activity_abstraction": model})


def with_context(d: DataFrame, index: DataFrame | None, by: list[str], place: str | None) -> DataFrame:
    """``d`` (row, related) with ``context``: the documents of its APIs in turn, each once, or an entry of the API's own name."""
    if index is None:
        none = F.array().cast("array<string>")
        entry = lambda x: F.struct(x.alias("api"), F.lit("").alias("summary"), none.alias("parameters"), none.alias("object_parameters"), none.alias("sensitive_fields"), none.alias("auth_fields"))
        return d.withColumn("context", F.transform("related", entry))
    calls = d.select("row", *by, F.posexplode("related").alias("at", "api"))
    found = apidocs.context(calls, index, by, place)
    found = found.withColumnsRenamed({c: f"__{c}" for c in ("api", *by)})
    # a scenario names few APIs, each with up to two documents
    own = calls.join(found, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("api", *by)]).select("row", "at", "place", "entry")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "place", "entry"))), lambda x: x["entry"])
    listed = own.groupBy("row").agg(listed.alias("all")).select(F.col("row").alias("__row"), F.filter("all", lambda x, i: F.array_position(F.transform("all", lambda y: y["api"]), x["api"]) == i + 1).alias("context"))
    return d.join(listed, F.col("row") == F.col("__row"), "left").drop("__row").withColumn("context", F.coalesce("context", F.array()))


def constants(d: DataFrame) -> DataFrame:
    """``d`` (s, context, security_type) with ``bindings``: the riskiest API of the scenario and the names a formula is about, empty where there are none."""
    d = d.withColumn("text", scenario_text(F.col("s")))
    d = risk_api(d, whole=True)
    none = F.array().cast("array<string>")
    first = lambda names, pattern: F.coalesce(F.get(F.filter(names, lambda x: x.rlike(pattern)), F.lit(0)), F.get(names, F.lit(0)))
    of = lambda c: F.coalesce(F.col("selected")[c], none)
    said = F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce("s.scenario_angles", F.array()), lambda a: texts(a["related_parameters_or_objects"])))))
    like = lambda pattern: F.filter(said, lambda x: x.rlike(pattern))
    in_path = F.filter(F.transform(F.regexp_extract_all(F.coalesce("api", F.lit("")), F.lit(r"\{([^}/]+)\}"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    filled = lambda *c: F.trim(F.coalesce(*[F.nullif(F.col(f"s.{x}"), F.lit("")) for x in c], F.lit("")))
    own = F.struct(
        F.coalesce("api", F.lit("")).alias("api"), filled("target_asset", "scenario_title").alias("target_asset"),
        F.trim(F.coalesce(F.nullif("s.risk_level", F.lit("")), F.lit("medium"))).alias("risk_level"), F.trim(F.coalesce(F.nullif("s.risk_type", F.lit("")), F.lit("both"))).alias("risk_type"), filled("possible_attack_path", "overall_reason", "later_check_hint").alias("attack_path"),
        F.coalesce(first(F.concat(in_path, of("object_parameters")), OBJECT), F.get(like(OBJECT), F.lit(0)), F.lit("")).alias("object_field"),
        F.coalesce(first(of("sensitive_fields"), SENSITIVE), F.get(like(SENSITIVE), F.lit(0)), F.lit("")).alias("sensitive_field"),
        F.coalesce(first(of("auth_fields"), AUTH), F.when(F.col("text").rlike(AUTH), LOGGED_IN), F.lit("")).alias("auth_field"),
    )
    return d.withColumn("bindings", own)


def parameter_scope(d: DataFrame) -> DataFrame:
    """``d`` with ``p``: parameters, target and context APIs, where values should come from, and how they depend, defaults filled in.

    Without named targets, the context's APIs that are steps of the normal order are the target, else the last one; the
    steps before them are the context. A source is the normal order if there is one; a dependency is stable within the
    target unless named.
    """
    par, seq = F.col("s.parameter_consistency_risk"), F.col("s.sequence_order_risk")
    calls = lambda c: F.array_distinct(F.filter(c, lambda x: x.rlike(METHOD)))
    d = d.withColumn("labelled", calls(F.col("labels")))
    d = d.withColumns({
        "all_apis": F.when(F.size("context") > 0, F.array_distinct(F.transform("context", lambda c: F.trim(c["api"])))).otherwise(F.col("labelled")),
        "normal_apis": F.coalesce(F.nullif(calls(texts(seq["normal_sequence_pattern"])), F.array().cast("array<string>")), F.col("labelled")),
    })
    shared = F.filter("all_apis", lambda x: F.array_contains("normal_apis", x))
    d = d.withColumn("split", F.when(F.size("all_apis") == 0, F.array().cast("array<string>")).when(F.size(shared) > 0, shared).otherwise(F.slice("all_apis", -1, 1)))
    at = F.coalesce(F.array_min(F.filter(F.transform("split", lambda x: F.array_position("normal_apis", x)), lambda n: n > 0)) - 1, F.size("normal_apis"))
    but = lambda c: F.filter(c, lambda x: ~F.array_contains("split", x))
    before = but(F.slice("normal_apis", F.lit(1), at.cast("int")))
    around = F.when(F.size("all_apis") == 0, F.array().cast("array<string>")).when((F.size(before) == 0) & (F.size("normal_apis") > 1), but("normal_apis")).otherwise(before)
    or_else = lambda told, c: F.when(F.size(told) > 0, told).otherwise(c)
    d = d.withColumns({"targets": or_else(texts(par["target_apis"]), F.col("split")), "contexts": or_else(texts(par["context_apis"]), around), "form": F.coalesce(par["risky_parameter_form"], F.lit(""))})
    source, told = text_of(par["expected_parameter_source"]), F.coalesce(F.nullif(text_of(par["parameter_dependency_relation"]), F.lit("")), F.lit("stable_within_target_api"))
    source = F.coalesce(F.nullif(source, F.lit("")), F.when(F.coalesce(F.size(seq["normal_sequence_pattern"]), F.lit(0)) > 0, "normal_sequence_context"), F.when(F.col("form").rlike(UPSTREAM_FORM), "upstream_context"), F.lit("same_api_context"))
    relation = F.when((told == "unknown") & (F.size("contexts") > 0), "derived_from_context_api").when((told == "unknown") & F.col("form").rlike(BOUND_FORM), "bound_to_upstream_context").otherwise(told)
    d = d.withColumns({"params": texts(par["key_parameters_or_objects"]), "expected_source": source, "relation": relation})
    def occurrences(p: Column, c: str, role: str, where: str, evidence: str) -> Column:
        return F.transform(c, lambda a: F.struct(p.alias("parameter"), a.alias("api"), F.lit(where).alias("location"), F.lit(role).alias("role"), F.lit(evidence).alias("evidence")))

    each = F.flatten(F.transform("params", lambda p: F.concat(*[occurrences(p, *kind) for kind in OCCURRENCES])))
    bound = F.flatten(F.transform("params", lambda p: F.flatten(F.transform("contexts", lambda c: F.transform("targets", lambda t: F.struct(c.alias("source_api"), t.alias("target_api"), p.alias("parameter"), F.col("relation").alias("relation"), F.concat(p, F.lit(BINDING_TEXT)).alias("explanation")))))))
    told_or = lambda c, ddl, made: F.when(F.coalesce(F.size(par[c]), F.lit(0)) > 0, par[c]).otherwise(made.cast(f"array<{ddl}>")).alias(c)
    return d.withColumn("p", F.struct(
        F.col("params").alias("parameters"), or_else(F.col("targets"), F.col("all_apis")).alias("target_api_scope"), F.col("contexts").alias("context_api_scope"), F.col("relation").alias("dependency_relation"), "expected_source", F.col("form").alias("risk_form"),
        or_else(texts(par["normal_parameter_sequence"]), or_else(F.col("normal_apis"), F.col("all_apis"))).alias("normal_parameter_sequence"),
        told_or("parameter_occurrences", OCCURRENCE_DDL, each), told_or("context_binding", BINDING_DDL, bound),
    ))


def quoted(x: Column) -> Column:
    """A constant of a formula."""
    return F.concat(F.lit('"'), F.replace(F.replace(text_of(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def expressions(d: DataFrame) -> DataFrame:
    """``d`` with ``logic_expressions``: sequence, parameter or one of both, as the scenario's blocks and words support it."""
    par, p = F.col("s.parameter_consistency_risk"), F.col("p")
    symbols = lambda letter, c: F.transform(F.array_distinct(texts(p[c])), lambda x, i: F.struct(F.concat(F.lit(letter), (i + 1).cast("string")).alias("symbol"), x.alias("value")))
    d = d.withColumn("symbols", F.struct(symbols("C", "context_api_scope").alias("context_api_scope"), symbols("T", "target_api_scope").alias("target_api_scope"), symbols("P", "parameters").alias("parameters")))
    set_of = lambda c: F.concat(F.lit("{"), F.array_join(F.transform(F.col("symbols")[c], lambda x: x["symbol"]), ","), F.lit("}"))
    parameter_formula = F.format_string(
        "ParameterFlowContext(s,%1$s,%2$s,%3$s,%4$s) ∧ ParameterAppearsOrDerived(s,%2$s,%3$s) ∧ ¬ParameterConsistentWithContext(s,%1$s,%2$s,%3$s,%5$s)",
        set_of("context_api_scope"), set_of("target_api_scope"), set_of("parameters"), quoted(p["dependency_relation"]), quoted(p["expected_source"]),
    )
    named = lambda c: F.size(texts(par[c])) > 0
    told_type = F.lower(text_of(F.col("s.risk_type")))
    risk = F.when(told_type.isin("sequence_order", "parameter_consistency"), told_type).otherwise("both")
    form, keys = F.lower(F.trim("form")), texts(par["key_parameters_or_objects"])
    plain = F.lit(False)
    for words in NO_PARAMETER_RISK:
        plain = plain | F.contains(form, F.lit(words))
    real = ((F.size(keys) > 0) | (form != "")) & ~((F.size(keys) == 0) & plain) & ~((F.size(keys) > 0) & (F.size(F.filter(keys, lambda x: ~F.lower(x).isin(*NO_PARAMETERS))) == 0))
    block = F.coalesce(par.isNotNull() & (named("key_parameters_or_objects") | (form != "") | named("target_apis") | named("context_apis")), F.lit(False))
    unknown = lambda c: F.lower(F.trim(p[c])).isin("", "unknown")
    usable = (F.size(texts(p["parameters"])) > 0) & (F.size(texts(p["target_api_scope"])) > 0) & ~(unknown("dependency_relation") & unknown("expected_source")) & ~(F.lower(p["dependency_relation"]).isin(*BOUND) & (F.size(texts(p["context_api_scope"])) == 0))
    has_par = (risk != "sequence_order") & block & real & usable
    has_seq = (risk != "parameter_consistency") & (F.size("labels") > 0)
    coupled = F.lower(F.concat_ws("\n", "s.risk_type", "s.overall_reason", "s.later_check_hint", blocks_text(F.col("s"))))
    d = d.withColumns({"real": F.coalesce(real, F.lit(False)), "has_par": F.coalesce(has_par, F.lit(False)), "has_seq": has_seq, "parameter_formula": parameter_formula})
    d = d.withColumn("both", F.col("has_seq") & F.col("has_par") & coupled.rlike(TOGETHER))
    no_seq, no_par, no_sym = F.lit(None).cast(d.schema["sequence_scope"].dataType), F.lit(None).cast(d.schema["p"].dataType), F.lit(None).cast(d.schema["symbols"].dataType)

    def expression(dimension: str, conclusion: str, meaning: str, formula: Column, s: Column, scope: Column, names: Column) -> Column:
        whole = F.concat(F.lit("∀s ("), formula, F.lit(f" → {conclusion}(s,"), quoted(F.col("security_type")), F.lit(","), quoted(F.col("bindings.risk_level")), F.lit(","), quoted(F.col("s.scenario_title")), F.lit("))"))
        return F.struct(F.lit(dimension).alias("dimension"), whole.alias("formula"), F.struct(s.alias("sequence"), scope.alias("parameter")).alias("scope"), names.alias("symbol_bindings"), F.lit(meaning).alias("meaning"))

    seq, par_, names = F.col("sequence_scope"), F.col("p"), F.col("symbols")
    combined = F.concat(F.lit("("), "sequence_formula", F.lit(" ∧ "), "parameter_formula", F.lit(")"))
    return d.withColumn("logic_expressions", F.array_compact(F.array(
        F.when(F.col("both"), expression("sequence_order_and_parameter_consistency", *CONCLUSIONS["both"], combined, seq, par_, names)),
        F.when(F.col("has_seq") & ~F.col("both"), expression("sequence_order", *CONCLUSIONS["sequence"], F.col("sequence_formula"), seq, no_par, no_sym)),
        F.when(F.col("has_par") & ~F.col("both"), expression("parameter_consistency", *CONCLUSIONS["parameter"], F.col("parameter_formula"), no_seq, par_, names)),
    )))


def generate(reviews: DataFrame, index: DataFrame | None = None, include_low_trust: bool = False, by: list[str] | None = None, place: str | None = None) -> DataFrame:
    """One rule per scenario, in the shape that ``detection.expressions`` reads; ``status`` is generated or skipped.

    ``index`` is an OpenAPI index whose documents fill in what the scenario leaves open; ``by`` names columns that
    reviews and index share, such as the site, and ``place`` the documents' order. A scenario without an API, a title
    or a reason is skipped, and so is one of a sequence risk without steps; ``missing_requirements`` says why, and its
    lists of expressions are empty. A generated rule may have no expression, if its blocks support none. Null lists are
    empty, and repeated scenarios make a rule each.
    """
    by = by or []
    d = scenarios(reviews, include_low_trust, by).withColumn("related", related_apis(F.col("s")))
    d = written(d.withColumn("row", F.monotonically_increasing_id()))  # numbers stay as they are once written
    d = with_context(d, index, by, place).withColumns({
        "raw_type": F.coalesce(F.nullif("s.security_type", F.lit("")), F.lit("OTHER")), "security_type": security_name(F.col("s.security_type")),
        "scenario_id": F.coalesce(F.nullif("s.scenario_id", F.lit("")), F.concat(F.lit("C"), F.coalesce(F.col("cluster_index").cast("string"), F.lit("None")), F.lit("-S"), (F.col("pos") + 1).cast("string"))),
    })
    # few rows beside the logs, and long expressions: each part is written, not planned into the next
    d = expressions(written(parameter_scope(written(constants(written(activities(d), "activities")), "constants")), "scopes"))
    blank = lambda c: text_of(F.col(f"s.{c}")) == ""
    lacking = F.array_compact(F.array(F.when(F.size("related") == 0, "related_apis"), *[F.when(blank(c), c) for c in ("scenario_title", "overall_reason")]))
    unbound = F.array_compact(F.array(*[F.when(F.col(f"bindings.{c}") == "", c) for c in ("risk_level", "risk_type")], F.when(F.lower("bindings.risk_type").isin("sequence_order", "both") & (F.size("labels") == 0), "activity_abstraction")))
    d = d.withColumn("missing_requirements", F.when(F.size(lacking) > 0, lacking).otherwise(unbound))
    made = F.size("missing_requirements") == 0
    names = lambda c, n: F.slice(c, 1, n)
    documents = F.transform(F.slice("context", 1, 5), lambda c: F.struct(c["api"].alias("api"), names(c["parameters"], 12).alias("params"), names(c["object_parameters"], 8).alias("object_params"), names(c["sensitive_fields"], 8).alias("sensitive_fields")))
    seq = F.col("s.sequence_order_risk")
    summary = F.struct("security_type", "s.risk_level", "s.risk_score", "s.risk_type", seq["normal_sequence_pattern"].alias("normal_sequence"), seq["possible_violation_sequence_pattern"].alias("possible_violation_sequence"), seq["violated_order_constraint"].alias("violated_order_constraint"), "s.overall_reason", F.when(F.col("real"), F.col("p")).alias("parameter"))
    expressions_ = F.when(made, F.col("logic_expressions")).otherwise(F.array())
    return d.select(
        *by, F.concat(F.lit("FOL-"), "scenario_id").alias("fol_id"), F.when(made, "generated").otherwise("skipped").alias("status"), "missing_requirements",
        F.struct("cluster_index", "scenario_id", "business_pattern_name", F.col("s.scenario_title").alias("scenario_title"), "security_type", F.col("raw_type").alias("raw_security_type"), "trust_score").alias("source"),
        F.col("related").alias("related_apis"), "activity_abstraction", documents.alias("openapi_summary"), F.col("bindings").alias("formula_bindings"), F.when(made, summary).alias("scenario_summary"),
        F.size(expressions_).alias("logic_expression_count"), expressions_.alias("logic_expressions"), F.struct(F.lit(False).alias("disabled")).alias("refinement"),
    )


def markdown(rules: DataFrame) -> DataFrame:
    """One line of text per rule expression, in order, for a report."""
    e = rules.filter("status = 'generated'").select("fol_id", "source.scenario_title", F.posexplode("logic_expressions").alias("i", "e"))
    return e.orderBy("fol_id", "i").select(F.concat(F.lit("- **"), "fol_id", F.lit("** "), F.coalesce("scenario_title", F.lit("")), F.lit(": `"), "e.formula", F.lit("`")).alias("value"))
