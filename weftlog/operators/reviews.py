"""Cluster reviews: what a reviewer gets, and what is made of its answer. All columns, no driver loop.

The reviewer itself is outside: ``review_with`` takes any function from rows to answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftlog.functions.text import is_object

MIN_LENGTH, MAX_STEPS, HEAD, TAIL = 5, 40, 18, 12

# Words by which answers are sorted.
NO_RISK = r"(?i)(无明显|无参数风险|无顺序风险|无法确定|无法推断|依据不足|none|not applicable|n/a)"
SEQUENCE_SIGNAL = r"(?i)(跳过|越序|提前|缺失|重复|先.*后|直接调用|绕过|order|sequence|repeat|missing|skip)"
PARAMETER_SIGNAL = r"(?i)(参数|对象|标识|id|key|token|上下文|来源|绑定|中途替换|不一致|跨对象|parameter|context|binding)"
SEQUENCE_TITLE = r"(顺序|跳过|越序|重复调用|资源消耗)"
FOREIGN_TITLE = r"(重复调用|资源消耗|顺序|跳过|越序)"
PARAMETER_NAME = r"\b([A-Za-z][A-Za-z0-9_]*(?:Id|ID|Key|Name|Token|Role|Permission|Status|Type|Level|Number))\b"
TRIGGER = r"(?i)/trigger/[^/\s]+"
PARAMETER_TITLES = {"BOLA": " 上下文不一致导致的对象级访问风险", "BOPLA": " 属性参数越权修改风险", "AUTH_BYPASS": " 认证上下文不一致风险", "": " 参数上下文一致性风险"}
SEQUENCE_TITLES = {"RESOURCE_CONSUMPTION": " 重复调用资源消耗风险", "BFLA": " 高权限操作顺序绕过风险", "": " 业务顺序约束绕过风险"}
BOTH_TITLE, NO_TITLE, ANY_OBJECT, ANY_API = " 上下文参数与业务顺序共同绕过风险", "安全场景依据不足", "对象参数", "接口"
COUPLED = r"(?is)(同时|共同|两者|both|组合|顺序.{0,30}参数|参数.{0,30}顺序|上下文.{0,30}跳过|跳过.{0,30}上下文)"
OBJECTS = r"(?i)(id|key|object|issue|project|user|avatar|trigger|content|page|space|对象|标识)"
PROPERTIES = r"(?i)(reporter|assignee|status|securityLevel|visibility|属性|字段|状态|负责人)"
LOGIN = r"(?i)(login|auth|session|token|xsrf|csrf|认证|会话)"
VOLUME = r"(?i)(频繁|批量|资源|枚举|遍历|frequency|resource|enumerat)"
REPEAT = r"(?i)(重复|repeat)"
PRIVILEGE = r"(?i)(admin|permission|role|group|config|delete|manage|权限|角色|管理|删除)"
TYPES = ("BOLA", "BFLA", "BOPLA", "AUTH_BYPASS", "RESOURCE_CONSUMPTION", "OTHER")
API = r"(?i)^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+"
# End of fixed values.

SEQUENCE_DDL = "struct<normal_sequence_pattern:array<string>,possible_violation_sequence_pattern:array<string>,violated_order_constraint:string,missing_or_reordered_step:string,why_this_order_is_risky:string,related_apis:array<string>>"
OCCURRENCE_DDL = "struct<parameter:string,api:string,location:string,role:string,evidence:string>"
BINDING_DDL = "struct<source_api:string,target_api:string,parameter:string,relation:string,explanation:string>"
PARAMETER_DDL = f"struct<key_parameters_or_objects:array<string>,target_apis:array<string>,context_apis:array<string>,parameter_dependency_relation:string,expected_parameter_source:string,risky_parameter_form:string,normal_parameter_sequence:array<string>,parameter_occurrences:array<{OCCURRENCE_DDL}>,context_binding:array<{BINDING_DDL}>>"
ANGLE_DDL = "struct<angle:string,reason:string,related_apis:array<string>,related_parameters_or_objects:array<string>>"
DETAILS = ("target_asset", "business_security_boundary", "risk_direction", "why_reasonable_in_this_cluster", "possible_attack_path", "later_rule_generation_hint")
SCENARIO_DDL = (
    f"struct<scenario_id:string,scenario_title:string,security_type:string,risk_level:string,risk_type:string,sequence_order_risk:{SEQUENCE_DDL},parameter_consistency_risk:{PARAMETER_DDL},overall_reason:string,later_check_hint:string,"
    f"risk_score:double,{','.join(f'{c}:string' for c in DETAILS)},scenario_angles:array<{ANGLE_DDL}>>"
)
REVIEW_DDL = f"cluster_index int, is_trustworthy boolean, trust_score double, business_pattern_name string, mixed_member_session_ids array<string>, possible_security_scenarios array<{SCENARIO_DDL}>"


def trim_trace(trace: Column, most: int = MAX_STEPS, head: int = HEAD, tail: int = TAIL) -> Column:
    """Head and tail of a long trace with a mark for what is left out."""
    h = max(1, min(head, most))
    t = max(0, min(tail, most - h))
    n = F.size(trace)
    mark = F.array(F.concat(F.lit("... omitted_steps="), (n - h - t).cast("string"), F.lit(", total_steps="), n.cast("string")))
    end = F.slice(trace, n - t + 1, F.lit(t)) if t else F.array().cast("array<string>")
    return F.when(n <= most, trace).otherwise(F.concat(F.slice(trace, 1, h), F.when(n > h + t, mark).otherwise(F.array().cast("array<string>")), end))


def reviewable(clusters: DataFrame, length: str = "representative_length", least: int = MIN_LENGTH) -> tuple[DataFrame, DataFrame]:
    """Clusters whose representative is long enough, and the others."""
    fits = F.coalesce(F.col(length), F.lit(0)) >= max(1, least)
    return clusters.filter(fits), clusters.filter(~fits)


def review_with(clusters: DataFrame, reviewer: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType = REVIEW_DDL) -> DataFrame:
    """Answers of an outside reviewer, asked from the executors batch by batch."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield reviewer(batch)

    return clusters.mapInPandas(ask, schema)


def parse_answers(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Reviews from answer texts: what stands between the first and the last brace, if it is one object; other answers are dropped."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return answers.filter(is_object(found)).select(F.from_json(found, REVIEW_DDL).alias("r")).select("r.*")


def words(block: Column, fields: tuple[str, ...], lists: tuple[str, ...]) -> Column:
    return F.concat_ws("\n", *[F.array_join(F.coalesce(block[c], F.array().cast("array<string>")), "\n") for c in lists], *[block[c] for c in fields])


def sequence_text(s: Column) -> Column:
    return words(s["sequence_order_risk"], ("violated_order_constraint", "missing_or_reordered_step", "why_this_order_is_risky"), ("normal_sequence_pattern", "possible_violation_sequence_pattern", "related_apis"))


def parameter_text(s: Column) -> Column:
    return words(s["parameter_consistency_risk"], ("parameter_dependency_relation", "expected_parameter_source", "risky_parameter_form"), ("key_parameters_or_objects", "target_apis", "context_apis"))


def risk_type(s: Column) -> Column:
    """sequence_order, parameter_consistency, both or none, by what the two blocks support."""
    seq, par = s["sequence_order_risk"], s["parameter_consistency_risk"]
    size = lambda a: F.coalesce(F.size(F.filter(a, lambda x: F.trim(x) != "")), F.lit(0))
    has_seq = F.coalesce((size(seq["possible_violation_sequence_pattern"]) > 0) & ~sequence_text(s).rlike(NO_RISK) & (size(seq["normal_sequence_pattern"]) >= 2) & sequence_text(s).rlike(SEQUENCE_SIGNAL), F.lit(False))
    params = size(par["key_parameters_or_objects"]) > 0
    form = F.trim(F.coalesce(par["risky_parameter_form"], F.lit("")))
    has_par = F.coalesce(params | ((form != "") & ~parameter_text(s).rlike(NO_RISK) & form.rlike(PARAMETER_SIGNAL)), F.lit(False))
    told = F.lower(F.trim(F.coalesce(s["risk_type"], F.lit(""))))
    coupled = F.concat_ws("\n", s["scenario_title"], s["security_type"], s["risk_type"], s["overall_reason"], s["later_check_hint"], sequence_text(s), parameter_text(s)).rlike(COUPLED)
    return (
        F.when((told == "sequence_order") & has_seq, "sequence_order").when((told == "parameter_consistency") & has_par, "parameter_consistency")
        .when(has_seq & has_par & coupled, "both").when(has_par, "parameter_consistency").when(has_seq, "sequence_order").otherwise("none")
    )


def security_type(s: Column, risk: Column) -> Column:
    """The first category whose words fit the main block, title and reason."""
    par = risk == "parameter_consistency"
    text = F.concat_ws("\n", s["scenario_title"], F.when(par, parameter_text(s)).otherwise(sequence_text(s)), s["overall_reason"])
    told = F.upper(F.trim(F.coalesce(s["security_type"], F.lit(""))))
    return (
        F.when(par & text.rlike(OBJECTS), "BOLA").when(par & text.rlike(PROPERTIES), "BOPLA").when(par & text.rlike(LOGIN), "AUTH_BYPASS")
        .when(text.rlike(VOLUME) | ((risk == "sequence_order") & text.rlike(REPEAT)), "RESOURCE_CONSUMPTION").when(text.rlike(LOGIN), "AUTH_BYPASS")
        .when(text.rlike(PRIVILEGE), "BFLA").when(text.rlike(PROPERTIES), "BOPLA").when(text.rlike(OBJECTS), "BOLA").when(told.isin(*TYPES), told).otherwise("OTHER")
    )


def listed(a: Column) -> Column:
    """The non-blank entries of a list, trimmed; none for null."""
    return F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def aligned_title(s: Column, risk: Column, security: Column) -> Column:
    """The scenario's title if it speaks of its own risk, else one made of its first parameter or last call."""
    title = F.coalesce(s["scenario_title"], F.lit(""))
    par, seq = title.rlike(PARAMETER_SIGNAL), title.rlike(SEQUENCE_SIGNAL)
    fits = F.when(risk == "parameter_consistency", par & ~title.rlike(FOREIGN_TITLE)).when(risk == "sequence_order", seq | title.rlike(SEQUENCE_TITLE)).when(risk == "both", par & seq).otherwise(F.lit(False))
    calls = F.filter(listed(s["sequence_order_risk"]["normal_sequence_pattern"]), lambda x: x.rlike(API))
    name = F.coalesce(F.get(listed(s["parameter_consistency_risk"]["key_parameters_or_objects"]), F.lit(0)), F.lit(ANY_OBJECT))
    call = F.coalesce(F.regexp_extract(F.get(calls, F.size(calls) - 1), r"([^/]*)$", 1), F.lit(ANY_API))

    def ending(titles: dict[str, str]) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in titles.items() for v in kv]), security), F.lit(titles[""]))

    made = F.when(risk == "parameter_consistency", F.concat(name, ending(PARAMETER_TITLES))).when(risk == "sequence_order", F.concat(call, ending(SEQUENCE_TITLES))).when(risk == "both", F.concat(name, F.lit(BOTH_TITLE)))
    return F.when(fits, title).otherwise(F.coalesce(made, F.nullif(title, F.lit("")), F.lit(NO_TITLE)))


def parameter_blocks(reviews: DataFrame, trace: str | None = None) -> DataFrame:
    """One row per scenario with its parameters and APIs filled in: cluster_index, pos, parameters, target_apis, context_apis, dependency, expected_source, risky_form.

    Parameters are those named and those that read like one anywhere in the scenario. Without target APIs the
    last known API is the target, without context APIs all others are the context; ``trace`` names a column
    with the representative's calls. Null lists are empty, and a scenario without any API has neither.
    """
    cluster = listed(F.col(trace)) if trace else F.array().cast("array<string>")
    d = reviews.select("cluster_index", cluster.alias("cluster"), F.posexplode("possible_security_scenarios").alias("pos", "s"))
    s, par, seq = F.col("s"), F.col("s.parameter_consistency_risk"), F.col("s.sequence_order_risk")
    text = F.concat_ws("\n", s["scenario_title"], s["security_type"], s["risk_type"], s["overall_reason"], s["later_check_hint"], sequence_text(s), parameter_text(s))
    calls = lambda a: F.filter(listed(a), lambda x: x.rlike(API))
    trigger = F.when(text.rlike(TRIGGER), F.array(F.lit("triggerId"))).otherwise(F.array().cast("array<string>"))
    d = d.withColumns({
        "parameters": F.array_distinct(F.concat(listed(par["key_parameters_or_objects"]), F.regexp_extract_all(text, F.lit(PARAMETER_NAME), F.lit(1)), trigger)),
        "apis": F.array_distinct(F.concat(calls(seq["normal_sequence_pattern"]), calls(seq["related_apis"]), calls(F.col("cluster")))),
    })
    told = calls(par["target_apis"])
    d = d.withColumn("target_apis", F.when((F.size(told) > 0) | (F.size("apis") == 0), told).otherwise(F.slice("apis", -1, 1)))
    told = calls(par["context_apis"])
    d = d.withColumn("context_apis", F.when(F.size(told) > 0, told).otherwise(F.array_except("apis", "target_apis")))
    known = lambda x: F.when(~F.lower(F.trim(x)).isin("", "unknown"), F.trim(x))
    bound = F.size("context_apis") > 0
    return d.select(
        "cluster_index", "pos", "parameters", "target_apis", "context_apis",
        F.coalesce(known(par["parameter_dependency_relation"]), F.when(bound, "bound_to_upstream_context").otherwise("stable_within_target_api")).alias("dependency"),
        F.coalesce(known(par["expected_parameter_source"]), F.when(bound, "upstream_context_api").otherwise("same_request_or_business_context")).alias("expected_source"),
        F.trim(F.coalesce(par["risky_parameter_form"], F.lit(""))).alias("risky_form"),
    )


def parameter_occurrences(blocks: DataFrame) -> DataFrame:
    """Where each parameter is looked for: one row per parameter and API, context APIs as its source, target APIs as its use."""
    row = blocks.select("cluster_index", "pos", F.explode("parameters").alias("parameter"), "context_apis", "target_apis")
    source = row.select("cluster_index", "pos", "parameter", F.explode("context_apis").alias("api"), F.lit("response_or_business_context").alias("location"), F.lit("context_source").alias("role"))
    return source.union(row.select("cluster_index", "pos", "parameter", F.explode("target_apis").alias("api"), F.lit("path_query_body_or_header").alias("location"), F.lit("target_parameter").alias("role")))


def context_bindings(blocks: DataFrame) -> DataFrame:
    """One row per parameter, source API and target API, with their relation."""
    row = blocks.select("cluster_index", "pos", F.explode("parameters").alias("parameter"), "context_apis", "target_apis", F.col("dependency").alias("relation"))
    row = row.withColumn("source_api", F.explode("context_apis")).withColumn("target_api", F.explode("target_apis"))
    return row.select("cluster_index", "pos", "parameter", "source_api", "target_api", "relation")


def normalise(reviews: DataFrame) -> DataFrame:
    """Reviews with their scenarios' risk and security types set, unsupported scenarios and foreign blocks removed, and ``warnings``."""
    def scenario(s: Column) -> Column:
        risk = risk_type(s)
        return s.withField("scenario_title", aligned_title(s, risk, security_type(s, risk))).withField("security_type", security_type(s, risk)).withField("risk_type", risk).withField("sequence_order_risk", F.when(risk != "parameter_consistency", s["sequence_order_risk"])).withField("parameter_consistency_risk", F.when(risk != "sequence_order", s["parameter_consistency_risk"]))

    kept = F.filter(F.transform(F.coalesce("possible_security_scenarios", F.array().cast(f"array<{SCENARIO_DDL}>")), scenario), lambda s: s["risk_type"] != "none")
    score = F.coalesce("trust_score", F.lit(0.0))
    warn = F.array_compact(F.array(F.when(~F.coalesce("is_trustworthy", F.lit(False)), "not_trustworthy"), F.when(score < 0.7, "low_trust_score"), F.when(F.size("mixed_member_session_ids") > 0, "mixed_cluster")))
    return reviews.withColumns({"trust_score": score, "possible_security_scenarios": kept, "warnings": warn})


def mark_duplicates(reviews: DataFrame) -> DataFrame:
    """``name_count``: reviews that share a business pattern name."""
    return reviews.withColumn("name_count", F.count("*").over(Window.partitionBy("business_pattern_name")))


def summary(reviews: DataFrame) -> DataFrame:
    trusted, score = F.coalesce("is_trustworthy", F.lit(False)), F.coalesce("trust_score", F.lit(0.0))
    return reviews.agg(
        F.count("*").alias("reviewed_clusters"), F.count_if(trusted).alias("trustworthy_clusters"), F.count_if(~trusted).alias("untrustworthy_clusters"), F.coalesce(F.round(F.avg(score), 4), F.lit(0.0)).alias("avg_trust_score"),
        F.coalesce(F.sum(F.when(trusted, F.size("possible_security_scenarios")).otherwise(0)), F.lit(0)).alias("possible_security_scenario_count"), F.array_sort(F.collect_list(F.when(score < 0.6, F.col("cluster_index")))).alias("low_trust_cluster_indexes"),
    )
