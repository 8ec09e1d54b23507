"""Rules over sessions: order of steps and consistency of parameters, as joins and windows over long tables.

``steps`` has session_id, step, api; ``values`` has session_id, step, api, name, value. Rules come as one row
per expression (see ``expressions``). The rule side is joined by API, so a session meets only the rules that
name one of its APIs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.functions.params import DETECTION, body_pairs
from weftlog.functions.url import query_pairs, raw_query, request_api, request_target
from weftlog.operators.graph import written

# Front-end requests, and words of rules.
NOISE = r"(?i)\.(?:js|css|png|jpg|jpeg|gif|svg|ico|woff2?|ttf|map)(?:$|\?)|/s/|/download/resources/|/download/batch/|/images/|/static/|/assets/|/rest/wrm/|/webResources/|/useravatar|/avatar|/favicon"
BOUND = ("derived_from_context_api", "bound_to_upstream_context")
UPSTREAM = ("upstream_context_api", "normal_sequence_context", "upstream_context")
NO_VALUES = ("", "null", "undefined")
# End of fixed values.

VALUES_SHOWN = 20


def business_steps(steps: DataFrame, keep_noise: bool = False) -> DataFrame:
    """Steps without front-end noise, numbered anew, with ``dropped`` per session."""
    noisy = F.col("api").rlike(NOISE)
    dropped = F.count_if(noisy).over(Window.partitionBy("session_id"))
    kept = steps.withColumn("dropped", F.lit(0) if keep_noise else dropped)
    kept = kept if keep_noise else kept.filter(~noisy)
    return kept.withColumn("step", F.row_number().over(Window.partitionBy("session_id").orderBy("step")))


def request_values(requests: DataFrame, token: str = "token") -> DataFrame:
    """``values`` of requests (session_id, step, token ``METHOD target [BODY body]``): one row per query or body parameter.

    Path and header parameters are no values here. A token of another shape has none.
    """
    body = F.regexp_extract(token, r"(?is)^\s*[A-Za-z]+\s+\S+\s+BODY\s+(.*)$", 1)
    pairs = F.concat(query_pairs(raw_query(request_target(F.col(token)))), body_pairs(body, DETECTION))
    return requests.select("session_id", "step", request_api(F.col(token)).alias("api"), F.explode(pairs).alias("p")).select("session_id", "step", "api", "p.name", "p.value")


def active(rules: DataFrame) -> DataFrame:
    return rules.filter((F.col("status") == "generated") & ~F.coalesce("refinement.disabled", F.lit(False)))


def expressions(rules: DataFrame) -> DataFrame:
    """One row per rule expression, with the activities' symbols replaced by their APIs."""
    names = F.map_from_entries(F.transform("activity_abstraction.activities", lambda a: F.struct(a["symbol"], a["label"])))
    e = rules.select("fol_id", "source", names.alias("apis"), F.posexplode("logic_expressions").alias("pos", "e")).withColumn("expr", F.col("pos") + 1)
    api = lambda c: F.try_element_at("apis", F.col(c))
    e = e.withColumns({"s": F.col("e.scope.sequence"), "p": F.col("e.scope.parameter")})
    return e.select(
        "fol_id", "expr", F.col("e.dimension").alias("dimension"), F.col("s.mode").alias("mode"), api("s.activity").alias("activity_api"), F.coalesce(F.col("s.threshold").try_cast("int"), F.lit(2)).alias("threshold"),
        api("s.required_activity").alias("required_api"), api("s.target_activity").alias("target_api"), F.col("p.parameters").alias("parameters"), F.col("p.target_api_scope").alias("target_apis"),
        F.coalesce("p.context_api_scope", F.array().cast("array<string>")).alias("context_apis"), F.lower(F.coalesce("p.dependency_relation", F.lit(""))).alias("dependency"), F.lower(F.coalesce("p.expected_source", F.lit(""))).alias("expected_source"),
    )


KEY = ["session_id", "fol_id", "expr"]


def repeated_calls(steps: DataFrame, exprs: DataFrame) -> DataFrame:
    """An API called at least ``threshold`` times."""
    rule = exprs.filter("mode = 'repeated_call'").select("fol_id", "expr", F.col("activity_api").alias("api"), "threshold")
    counts = steps.groupBy("session_id", "api").agg(F.count("*").alias("n"), F.min("step").alias("step"))
    return counts.join(rule, "api").filter("n >= threshold").select(*KEY, F.lit("repeated_call").alias("reason"), "step", F.lit("").alias("parameter"), F.col("n").cast("string").alias("detail"))


def missing_before(steps: DataFrame, exprs: DataFrame) -> DataFrame:
    """Each target call with no required call before it; if the rule's required step is unknown, each target call.

    The latest required step before a target is a running maximum over the session's rows that matter.
    """
    rule = exprs.filter("mode = 'missing_or_reordered_step'").select("fol_id", "expr", "required_api", "target_api")
    sides = rule.select("fol_id", "expr", F.col("target_api").alias("api"), F.lit(1).alias("side")).union(rule.filter("required_api is not null").select("fol_id", "expr", F.col("required_api").alias("api"), F.lit(0).alias("side")))
    rows = steps.join(sides, "api")
    w = Window.partitionBy(*KEY).orderBy("step").rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("before", F.max(F.when(F.col("side") == 0, F.col("step"))).over(w))
    return found.filter("side = 1 and before is null").select(*KEY, F.lit("required_before_missing").alias("reason"), "step", F.lit("").alias("parameter"), F.lit("").alias("detail"))


def risky_order(steps: DataFrame, exprs: DataFrame, adjacent: bool = False) -> DataFrame:
    """Each target call of the other sequence rules; with ``adjacent`` only those right after the activity."""
    rule = exprs.filter("dimension like 'sequence_order%' and coalesce(mode, '') not in ('repeated_call', 'missing_or_reordered_step')").select("fol_id", "expr", F.col("target_api").alias("api"), "activity_api")
    rows = steps.withColumn("prev", F.lag("api").over(Window.partitionBy("session_id").orderBy("step"))).join(rule, "api")
    rows = rows.filter("prev = activity_api") if adjacent else rows
    return rows.select(*KEY, F.lit("sequence_order_uncertain").alias("reason"), "step", F.lit("").alias("parameter"), F.lit("").alias("detail"))


def name_matches(observed: Column, wanted: Column) -> Column:
    o, w = F.lower(observed), F.lower(wanted)
    return (o == w) | F.endswith(o, F.concat(F.lit("."), w)) | F.endswith(o, F.concat(F.lit("]"), w))


def parameter_hits(values: DataFrame, exprs: DataFrame) -> DataFrame:
    """Values that switch within the target APIs, lack a context, or do not come from it."""
    rule = exprs.filter("dimension like '%parameter_consistency' and size(target_apis) > 0 and size(parameters) > 0")
    bound = (F.size("context_apis") > 0) & (F.col("dependency").isin(*BOUND) | F.col("expected_source").isin(*UPSTREAM))
    rule = rule.select("fol_id", "expr", "parameters", "target_apis", "context_apis", bound.alias("bound"))
    sides = rule.select("fol_id", "expr", "bound", "parameters", F.explode("target_apis").alias("api"), F.lit(True).alias("target")).union(rule.select("fol_id", "expr", "bound", "parameters", F.explode("context_apis").alias("api"), F.lit(False).alias("target")))
    sides = sides.withColumn("wanted", F.explode("parameters")).drop("parameters").distinct()
    real = values.filter(~F.coalesce("value", F.lit("")).isin(*NO_VALUES))
    found = real.join(sides, "api").filter(name_matches(F.col("name"), F.col("wanted")))
    one = found.groupBy(*KEY, "bound", F.col("wanted").alias("parameter"), "value").agg(F.bool_or("target").alias("t"), F.bool_or(~F.col("target")).alias("c"), F.min(F.when(F.col("target"), F.col("step"))).alias("step"))
    per = one.groupBy(*KEY, "bound", "parameter").agg(
        F.count_if("t").alias("targets"), F.count_if("c").alias("contexts"), F.count_if(F.col("t") & ~F.col("c")).alias("foreign"), F.min("step").alias("step"),
        F.array_sort(F.collect_list(F.when(F.col("t"), F.col("value")))).alias("tv"), F.array_sort(F.collect_list(F.when(F.col("t") & ~F.col("c"), F.col("value")))).alias("fv"),
    )
    shown = lambda c: F.array_join(F.slice(c, 1, VALUES_SHOWN), ",")
    hit = lambda when, reason, c: F.when(when, F.struct(F.lit(reason).alias("reason"), shown(F.col(c)).alias("detail")))
    hits = F.array_compact(F.array(
        hit(F.col("targets") >= 2, "parameter_value_switch", "tv"), hit(F.col("bound") & (F.col("targets") > 0) & (F.col("contexts") == 0), "parameter_context_missing", "tv"),
        hit(F.col("bound") & (F.col("contexts") > 0) & (F.col("foreign") > 0), "parameter_not_from_context", "fv"),
    ))
    return per.withColumn("h", F.explode(hits)).select(*KEY, "h.reason", "step", "parameter", "h.detail")


def sequence_hits(steps: DataFrame, exprs: DataFrame) -> DataFrame:
    return repeated_calls(steps, exprs).unionByName(missing_before(steps, exprs)).unionByName(risky_order(steps, exprs))


def combined_hits(found: DataFrame) -> DataFrame:
    """One hit per session and expression for which ``found`` has hits of both kinds, ``sequence`` and ``parameter``."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    both = found.groupBy(*KEY).agg(n("sequence").alias("ns"), n("parameter").alias("np"), F.min(F.when(F.col("kind") == "sequence", F.col("step"))).alias("step")).filter("ns > 0 and np > 0")
    return both.select(*KEY, F.lit("combined_sequence_parameter_risk").alias("reason"), "step", F.lit("").alias("parameter"), F.concat_ws("+", "ns", "np").alias("detail"))


def detect(steps: DataFrame, values: DataFrame, exprs: DataFrame) -> DataFrame:
    """All hits: session_id, fol_id, expr, reason, step, parameter, detail.

    Steps and values are searched once for expressions of one kind and of both; the hits, few beside the steps, are
    written before those of both kinds are put together.
    """
    sequence = sequence_hits(steps, exprs.filter("dimension like 'sequence_order%'")).withColumn("kind", F.lit("sequence"))
    parameter = parameter_hits(values, exprs.filter("dimension like '%parameter_consistency'")).withColumn("kind", F.lit("parameter"))
    found = written(sequence.unionByName(parameter).join(exprs.select("fol_id", "expr", "dimension"), ["fol_id", "expr"]), "hits")
    combined = F.col("dimension") == "sequence_order_and_parameter_consistency"
    columns = [*KEY, "reason", "step", "parameter", "detail"]
    return found.filter(~combined).select(*columns).unionByName(combined_hits(found.filter(combined)).select(*columns))


def findings_by_rule(hits: DataFrame) -> DataFrame:
    """Per rule: findings (one per session hit), hits, sessions, the first and last; rules without an id are left out.

    A rule may hit a good part of all sessions, so their ids and hits stay rows (``session_findings``).
    """
    per = hits.filter("coalesce(fol_id, '') != ''").groupBy("fol_id", "session_id").agg(F.count("*").alias("n"))
    return per.groupBy("fol_id").agg(F.count("*").alias("hit_count"), F.sum("n").alias("expression_hit_count"), F.count_if(F.col("session_id") != "").alias("hit_session_count"), F.min("session_id").alias("first_session"), F.max("session_id").alias("last_session"))


def capped_evidence(hits: DataFrame, most: int) -> DataFrame:
    """The first ``most`` sessions' hits of each rule, in order of session; 0 keeps all."""
    if not most:
        return hits
    rank = F.row_number().over(Window.partitionBy("fol_id").orderBy("session_id"))  # limited in each task before the shuffle
    first = hits.select("fol_id", "session_id").distinct().withColumn("r", rank).filter(F.col("r") <= most).drop("r")
    return hits.join(first, ["fol_id", "session_id"], "left_semi")


#: What a finding tells of its rule: the field, and where generated rules have it, the first that is there.
TOLD = {
    "scenario_id": ("source",), "scenario_title": ("source",), "security_type": ("scenario_summary", "source"), "risk_level": ("scenario_summary",),
    "business_pattern_name": ("source",), "overall_reason": ("scenario_summary",),
}


def told(rules: DataFrame) -> DataFrame:
    """fol_id, source and the fields of ``TOLD``; those that the rules lack are empty."""
    held = {c: getattr(rules.schema[c].dataType, "names", []) for c in ("source", "scenario_summary") if c in rules.columns}
    of = lambda name, where: [F.col(f"{c}.{name}").cast("string") for c in where if name in held.get(c, [])]
    return rules.select("fol_id", "source", *[F.coalesce(*of(name, where), F.lit("")).alias(name) for name, where in TOLD.items()])


def session_findings(hits: DataFrame, steps: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per rule and session hit: what the rule says (``TOLD``), the hits by expression and step, and the session's context.

    ``steps`` may have ``dropped``, the front-end requests that were left out of the session, ``token``, the requests as
    sent, which make ``raw_sequence``, and ``source_ip``. Without them these are 0, empty and empty.
    """
    own = hits.groupBy("fol_id", "session_id").agg(F.array_sort(F.collect_list(F.struct("expr", "step", "reason", "parameter", "detail"))).alias("expression_hits"))
    has = set(steps.columns)
    dropped = F.max("dropped") if "dropped" in has else F.max(F.lit(0))
    sequence = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("step", c))), lambda x: x[c])
    raw = sequence("token") if "token" in has else F.array().cast("array<string>")
    source = F.coalesce(F.max("source_ip"), F.lit("")) if "source_ip" in has else F.lit("")
    context = steps.join(own.select("session_id").distinct(), "session_id", "left_semi").groupBy("session_id").agg(sequence("api").alias("api_sequence"), raw.alias("raw_sequence"), source.alias("source_ip"), dropped.alias("filtered_noise_count"))
    return own.join(context, "session_id", "left").join(told(rules), "fol_id")


def run_summary(hits: DataFrame, steps: DataFrame, rules: DataFrame, most: int = 0) -> DataFrame:
    """One row per rule with its hit and emitted sessions, under the counts of the whole run; rules without a hit have 0.

    A finding is a session that a rule hits; beyond ``most`` of a rule (0: no limit) it is counted, not emitted.
    """
    per = hits.select("fol_id", "session_id").distinct().groupBy("fol_id").agg(F.count("*").alias("rule_hit_count"))
    each = rules.select("fol_id").join(per, "fol_id", "left").withColumn("rule_hit_count", F.coalesce("rule_hit_count", F.lit(0)))
    each = each.withColumn("emitted_count", F.least("rule_hit_count", F.lit(most)) if most else F.col("rule_hit_count"))
    dropped = F.max("dropped") if "dropped" in steps.columns else F.max(F.lit(0))
    sessions = steps.groupBy("session_id").agg(dropped.alias("d")).agg(F.count("*").alias("session_count"), F.coalesce(F.sum("d"), F.lit(0)).alias("filtered_noise_count"))
    hit = capped_evidence(hits, most).agg(F.count_distinct("session_id").alias("hit_session_count"))
    whole = each.agg(F.count("*").alias("rule_count"), F.sum("emitted_count").alias("finding_count"))
    return each.crossJoin(F.broadcast(sessions)).crossJoin(F.broadcast(hit)).crossJoin(F.broadcast(whole))  # one row each


def noise_overlap(hit_sessions: DataFrame, noise: DataFrame) -> DataFrame:
    """Sessions hit by a rule, noise sessions, those in both, and both shares."""
    h, z = hit_sessions.select("session_id").distinct().withColumn("h", F.lit(1)), noise.select("session_id").distinct().withColumn("z", F.lit(1))
    both = h.join(z, "session_id", "full")
    out = both.agg(F.count("h").alias("hit_sessions"), F.count("z").alias("noise_sessions"), F.count_if(F.col("h").isNotNull() & F.col("z").isNotNull()).alias("overlap"))
    return out.withColumns({"share_of_hits": F.round(F.try_divide("overlap", "hit_sessions"), 6), "share_of_noise": F.round(F.try_divide("overlap", "noise_sessions"), 6)})
