"""Which objects belong together and who reaches them, from objects named in requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.functions.params import BOUNDARY, body_pairs
from weftlog.functions.text import strip
from weftlog.functions.url import query_pairs, raw_query, request_api, request_target, target_path

# What counts as an object's field, segment or value.
OBJECT_FIELD = r"(?i)(issue|project|space|content|page|comment|worklog|attachment|board|sprint|filter|dashboard|avatar|user|group|role|permission|account|tenant).*(id|key|name)?$|^(id|key)$"
NON_OBJECT_FIELD = r"(?i)(pageSize|pageNum|pageNumber|startAt|maxResults|limit|offset|size|sort|order|expand|fields|userScope|scope|filterType|jql|cql|query|search|issueNavId)$"
NON_OBJECT_VALUE = r"(?i)^(all|none|null|true|false|undefined|sidebar|search|default|primary|latest)$"
OBJECT_TYPES = ("issue", "project", "space", "content", "page", "comment", "worklog", "attachment", "board", "sprint", "filter", "dashboard", "avatar", "user", "group", "role", "permission", "account", "tenant")
SEGMENT_TYPES = {
    "issue": "issue", "issues": "issue", "project": "project", "projects": "project", "space": "space", "spaces": "space", "content": "content", "page": "page", "pages": "page",
    "comment": "comment", "comments": "comment", "worklog": "worklog", "worklogs": "worklog", "attachment": "attachment", "attachments": "attachment", "board": "board", "boards": "board",
    "sprint": "sprint", "sprints": "sprint", "filter": "filter", "filters": "filter", "dashboard": "dashboard", "dashboards": "dashboard", "avatar": "avatar", "avatars": "avatar",
    "user": "user", "users": "user", "group": "group", "groups": "group", "role": "role", "roles": "role", "permission": "permission", "permissions": "permission",
}
ACTOR_FIELD = r"(?i)(user|username|account|owner|author|reporter|creator|assignee|session|token|cookie)"
STATIC = r"(?i)\.(?:js|css|png|jpg|jpeg|gif|svg|ico|woff2?|ttf|map)(?:$|\?)|/s/|/download/resources/|/images/|/static/"
ID_VALUE = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,80}$"
PROJECT_KEY = r"^[A-Z][A-Z0-9_]{1,15}$"
ISSUE_KEY = r"^([A-Z][A-Z0-9_]+)-\d+$"
# End of fixed values.

WINDOW, MIN_SUPPORT = 6, 3


def object_like(value: Column) -> Column:
    v = strip(value)
    return (v != "") & (F.length(v) <= 100) & ~v.rlike(NON_OBJECT_VALUE) & v.rlike(ID_VALUE)


def object_field(name: Column, value: Column) -> Column:
    return ~name.rlike(NON_OBJECT_FIELD) & ~((F.lower(name) == "id") & value.rlike("[:/]")) & name.rlike(OBJECT_FIELD) & object_like(value)


def path_identifier(value: Column) -> Column:
    v = strip(value)
    shaped = v.rlike(r"\d") | v.rlike(PROJECT_KEY) | v.rlike(r"^([A-Fa-f0-9]{16,}|[A-Fa-f0-9-]{24,})$")
    return object_like(v) & ~v.rlike(r"^\d+(?:\.\d+)+$") & shaped


def object_type(name: Column) -> Column:
    low, found = F.lower(name), F.lit("object")
    for kind in reversed(OBJECT_TYPES):
        found = F.when(low.contains(kind), kind).otherwise(found)
    return found


def segment_type(segment: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in SEGMENT_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(named, F.lower(segment)), F.lit(""))


def path_objects(path: Column) -> Column:
    """(type, field, value) of identifier-like segments whose segment before, or the one before that, names a type."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    at = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    kind = lambda i: F.when(segment_type(at(i - 1)) != "", segment_type(at(i - 1))).otherwise(segment_type(at(i - 2)))
    named = F.transform(parts, lambda p, i: F.struct(F.lit("path").alias("part"), F.when(path_identifier(p), kind(i)).otherwise("").alias("type"), F.concat(kind(i), F.lit("Id")).alias("field"), p.alias("value")))
    return F.filter(named, lambda o: o["type"] != "")


def pair_objects(pairs: Column, part: str) -> Column:
    kept = F.filter(pairs, lambda p: object_field(p["name"], p["value"]))
    return F.transform(kept, lambda p: F.struct(F.lit(part).alias("part"), object_type(p["name"]).alias("type"), p["name"].alias("field"), p["value"].alias("value")))


def event_objects(steps: DataFrame, token: str = "token") -> DataFrame:
    """``steps`` with ``api``, ``objects`` (distinct, in order) and ``hints`` (values of actor-like fields)."""
    t = F.col(token)
    body = F.regexp_extract(t, r"(?is)\s+BODY\s+(.*)$", 1)
    df = steps.withColumns({"api": request_api(t), "__query": query_pairs(raw_query(request_target(t))), "__body": body_pairs(body, BOUNDARY), "__path": target_path(request_target(t))})
    pairs = F.filter(F.concat("__query", "__body"), lambda p: p["name"].rlike(ACTOR_FIELD) & object_like(p["value"]))
    objects = F.array_distinct(F.concat(path_objects(F.col("__path")), pair_objects(F.col("__query"), "query"), pair_objects(F.col("__body"), "body")))
    return df.withColumns({"objects": objects, "hints": F.array_distinct(F.transform(pairs, lambda p: p["value"]))}).drop("__query", "__body", "__path")


def project_ref(kind: Column, field: Column, value: Column) -> Column:
    keyed = F.lower(field).contains("key") | value.rlike(PROJECT_KEY)
    return F.when(kind == "project", F.concat(F.when(keyed, "projectKey:").otherwise("projectId:"), value))


def issue_ref(kind: Column, field: Column, value: Column) -> Column:
    keyed = F.lower(field).contains("key") | value.rlike(ISSUE_KEY)
    return F.when(kind == "issue", F.concat(F.when(keyed, "issueKey:").otherwise("issueId:"), value))


def refs(events: DataFrame) -> DataFrame:
    """``events`` with ``projects`` and ``issues`` named in each request."""
    pick = lambda f: F.filter(F.transform("objects", lambda o: f(o["type"], o["field"], o["value"])), lambda r: r.isNotNull())
    return events.withColumns({"projects": pick(project_ref), "issues": pick(issue_ref)})


def with_upstream(events: DataFrame, session: str = "session_id", window: int = WINDOW, static: bool = False) -> DataFrame:
    """The last ``window`` references of the ``window`` events before, static requests left out.

    A window of rows, not a self-join: it holds a few small arrays at a time.
    """
    kept = events if static else events.filter(~F.col("api").rlike(STATIC))
    before = Window.partitionBy(session).orderBy("step").rowsBetween(-window, -1)
    tail = lambda c: F.slice(F.reverse(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("step", c)).over(before)), lambda x: x[c]))), 1, window)
    return kept.withColumns({"upstream_projects": tail("projects"), "upstream_issues": tail("issues")})


def project_issues(events: DataFrame) -> DataFrame:
    """(project, issue, n): in one request, an issue upstream of a project, a project upstream of an issue, or by the issue key's prefix."""
    pair = lambda projects, issues: F.flatten(F.transform(projects, lambda p: F.transform(issues, lambda i: F.struct(p.alias("project"), i.alias("issue")))))
    key = lambda i: F.regexp_extract(F.regexp_replace(i, "^[^:]*:", ""), ISSUE_KEY, 1)
    prefix = F.filter(F.transform("issues", lambda i: F.struct(F.concat(F.lit("projectKey:"), key(i)).alias("project"), i.alias("issue"))), lambda x: x["project"] != "projectKey:")
    found = F.concat(pair(F.col("projects"), F.concat("issues", "upstream_issues")), pair(F.col("upstream_projects"), F.col("issues")), prefix)
    every = events.select(F.explode(found).alias("r")).select("r.*")
    return every.groupBy("project", "issue").agg(F.count("*").alias("n"))


def actors(events: DataFrame, session: str = "session_id", user: str = "user_hint", client: str = "source_ip") -> DataFrame:
    """Each session's actor: its user, else client, else the hint seen at least twice most often, else itself."""
    hint = events.select(session, "step", F.explode("hints").alias("hint")).groupBy(session, "hint").agg(F.count("*").alias("n"), F.min("step").alias("seen"))
    best = hint.groupBy(session).agg(F.min(F.struct((-F.col("n")).alias("minus"), "seen", "hint")).alias("b")).filter("b.minus <= -2").select(session, F.col("b.hint").alias("hint"))
    named = events.groupBy(session).agg(F.max(user).alias("u"), F.max(client).alias("c")).join(best, session, "left")
    of = lambda name, c: F.concat(F.lit(f"{name}:"), F.nullif(c.cast("string"), F.lit("")))
    return named.select(session, F.coalesce(of("user", F.col("u")), of("client", F.col("c")), of("hint", F.col("hint")), of("session", F.col(session))).alias("actor"))


def actor_projects(events: DataFrame, relations: DataFrame, actor: DataFrame, session: str = "session_id", top: int = 3) -> DataFrame:
    """(actor, project, n): projects named, and the ``top`` projects of each issue named."""
    rank = F.row_number().over(Window.partitionBy("issue").orderBy(F.desc("n"), "project"))
    likely = relations.withColumn("r", rank).filter(F.col("r") <= top).select("issue", "project")
    direct = events.select(session, F.explode("projects").alias("project"))
    inferred = events.select(session, F.explode("issues").alias("issue")).join(likely, "issue").select(session, "project")
    return direct.union(inferred).join(actor, session).groupBy("actor", "project").agg(F.count("*").alias("n"))


def supported(relations: DataFrame, left: str, right: str, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Per ``left``: support and distinct ``right``, where support reaches the minimum; widest first."""
    out = relations.groupBy(left).agg(F.sum("n").alias("support"), F.count("*").alias(f"{right}_count"))
    return out.filter(F.col("support") >= min_support).orderBy(F.desc(f"{right}_count"), F.desc("support"), left)


def widest(relations: DataFrame, left: str, right: str, min_support: int = MIN_SUPPORT, top_items: int = 20, limit: int = 20) -> DataFrame:
    """The first ``limit`` rows of ``supported``, each with its ``top_items`` most frequent ``right`` as (value, count); 0 means all.

    Of items as frequent as each other, and of rows as wide and as well supported, the first by name count. Both limits
    apply within tasks before anything is shuffled for them.
    """
    rows = supported(relations, left, right, min_support)
    rows = rows.limit(limit) if limit else rows
    items = relations.join(F.broadcast(rows.select(left)) if limit else rows.select(left), left, "left_semi")
    if top_items:
        rank = F.row_number().over(Window.partitionBy(left).orderBy(F.desc("n"), right))
        items = items.withColumn("__r", rank).filter(F.col("__r") <= top_items)
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), F.col(right).alias("value")))), lambda x: F.struct(x["value"].alias("value"), (-x["minus"]).alias("count")))
    return rows.join(items.groupBy(left).agg(listed.alias(f"{right}s")), left)
