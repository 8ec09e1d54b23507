"""The queries in SQL, for DuckDB on the same tables."""

from __future__ import annotations

from weftlog.operators.mining import Weights
from weftlog.plans.queries import CAP_EVENTS, CAP_SECONDS, IDLE

W = Weights()


def sessions(idle: int) -> str:
    return f"""
ev as (
  select event_id, user_id, event_type, value, epoch_us(ts) as us, epoch_us(ts) / 1e6 as sec, cast(json_extract_string(props, '$.k') as int) as k from events
), gap as (
  select *, case when sec - lag(sec) over (partition by user_id order by sec, event_id) > {idle} then 1 else 0 end as new from ev
), seg as (
  select *, sum(new) over (partition by user_id order by sec, event_id rows unbounded preceding)::bigint as segment from gap
), steps as (
  select *, user_id || '_' || segment as session_id, event_type as api, row_number() over (partition by user_id, segment order by sec, event_id) as step from seg
)"""


S = sessions(IDLE)
NAME_SET = "array_to_string(list_sort(list_distinct(list_transform(pairs, lambda p: p.name))), ',')"
LABEL = "case when bool_or(event_type = 'error') then 'abnormal' else 'normal' end as session_label"
BY_SESSION = f"select user_id, segment, min(us) as start_us, max(us) as end_us, count(*) as session_length, {LABEL} from seg group by user_id, segment"

CAPPED = f"""
with recursive {S.strip()}, walk as (
  select user_id, segment, step, us, event_type, sec as first, 1 as n, 0::bigint as part from steps where step = 1
  union all
  select s.user_id, s.segment, s.step, s.us, s.event_type, case when s.sec - w.first > {CAP_SECONDS} or w.n >= {CAP_EVENTS} then s.sec else w.first end,
    case when s.sec - w.first > {CAP_SECONDS} or w.n >= {CAP_EVENTS} then 1 else w.n + 1 end, case when s.sec - w.first > {CAP_SECONDS} or w.n >= {CAP_EVENTS} then w.part + 1 else w.part end
  from walk w join steps s on s.user_id = w.user_id and s.segment = w.segment and s.step = w.step + 1
)
select user_id, segment, part, min(us) as start_ts, max(us) as end_ts, count(*) as session_length, {LABEL} from walk group by user_id, segment, part
"""

PAGE = r"""
page as (
  select page_id, url as raw_url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as site_id,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '^//[^/]*', ''), ';[^/]*$', '') as full_path,
    regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1) as query, 'GET' as method
  from pages
), shaped as (
  select *, '/' || array_to_string(list_transform(list_filter(string_split(full_path, '/'), lambda p: p <> ''), lambda p: case
    when regexp_full_match(p, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}') then '{uuid}' when regexp_full_match(p, '-?[0-9]+') then '{int}'
    when regexp_full_match(p, '[A-Za-z][A-Za-z0-9]+-[0-9]+') then '{issue_key}' when regexp_full_match(p, '[0-9a-fA-F]{8,}') then '{hex}' when regexp_full_match(p, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then '{date}'
    when regexp_full_match(p, '[A-Za-z0-9_-]{24,}') then '{token}' when regexp_full_match(p, '[0-9a-fA-F]{8,}\.[^.]*') then '{file_hash}.' || lower(regexp_extract(p, '\.([^.]*)$', 1)) else lower(p) end), '/') as path,
    list_transform(list_filter(string_split(query, '&'), lambda q: q <> ''), lambda q: struct_pack(name := replace(string_split(q, '=')[1], '+', ' '), value := case when contains(q, '=') then replace(regexp_replace(q, '^[^=]*=', ''), '+', ' ') else '' end)) as pairs
  from page
)"""


def kind(x: str) -> str:
    """The value lattice as a CASE over an SQL expression."""
    return rf"""case when {x} = '' then 'EMPTY' when regexp_full_match({x}, '-?[0-9]+') then 'INT' when regexp_full_match({x}, '-?[0-9]+\.[0-9]+') then 'FLOAT'
    when regexp_full_match({x}, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}') then 'UUID' when lower({x}) in ('true', 'false') then 'BOOL' when starts_with({x}, '{{') and ends_with({x}, '}}') then 'JSON'
    when starts_with({x}, '[') and ends_with({x}, ']') then 'ARRAY' when starts_with({x}, 'http://') or starts_with({x}, 'https://') then 'URL' when contains({x}, '@') and contains({x}, '.') then 'EMAIL'
    when length({x}) >= 24 and regexp_full_match({x}, '[A-Za-z0-9._~+/=-]+') then 'TOKEN' when contains({x}, ',') then 'LIST' else 'STR' end"""


TYPE_PATTERN = f"array_to_string(list_transform(pairs, lambda p: p.name || '=<' || {kind('p.value')} || '>'), '&')"
STATIC = r"'\.(jpg|jpeg|png|gif|css|js|txt|xml|ico|svg|woff|woff2|ttf|map|bmp|webp|mp4)$'"
HEALTH = "(full_path in ('', '/', '/health', '/healthz') or starts_with(full_path, '/health/') or starts_with(full_path, '/healthz/'))"
STRIPPED = r"regexp_replace(w, '^\s+|\s+$', '', 'g')"

PAIR = f"""
pair as (
  select path, method, page_id, i as pos, pairs[i].name as param, pairs[i].value as value from (select *, unnest(range(1, len(pairs) + 1)) as i from shaped)
), one as (
  select path, method, param, page_id, count(*) as pairs, count_if(value = '') as empty, arg_max({kind('value')}, pos) as type from pair group by all
), kinds as (
  select path, method, param, type, count(*) as n, min(page_id) as seen from one group by all
), shown as (
  select *, row_number() over (partition by path, method, param order by page_id, pos) as r from (select path, method, param, value, min(page_id) as page_id, arg_min(pos, page_id) as pos from pair where value <> '' group by all)
)"""

OR = """
o as (select o_orderkey, o_orderstatus, o_orderkey as id from orders),
r as (select l_orderkey as id, l_linenumber, l_partkey, l_suppkey, l_linestatus || '-' || l_linenumber as kind, l_extendedprice from lineitem where l_returnflag = 'R')"""
LABELLED = f"""
with {OR}, first as (
  select id as matched_id, kind from (select *, row_number() over (partition by id order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, kind) as n from r) where n = 1
), labelled as (
  select o_orderkey, o_orderstatus, case when matched_id is null then 0 else 1 end::int as label, coalesce(kind, 'none') as security_event_type, coalesce(matched_id::varchar, '') as matched_id from o left join first on o.id = matched_id
)"""

BOUND_VALUES = """
vals as (select session_id, step, api, k::varchar as value from steps),
purchases as (select session_id, value, min(step) as step from vals where api = 'purchase' group by all),
context as (select distinct session_id, value from vals where api in ('view', 'click'))"""
HITS = f"""
with {S.strip()}, {BOUND_VALUES.strip()}, missing as (
  select session_id, step from (select *, max(case when api = 'view' then step end) over (partition by session_id order by step rows between unbounded preceding and 1 preceding) as before from steps) where api = 'purchase' and before is null
), per as (
  select p.session_id, count(*) as targets, min(p.step) as step, string_agg(p.value, ',' order by p.value) as tv, count_if(c.value is null) as foreign_values, string_agg(case when c.value is null then p.value end, ',' order by p.value) as fv
  from purchases p left join context c on p.session_id = c.session_id and p.value = c.value group by p.session_id
), bound as (
  select p.*, exists (select 1 from context c where c.session_id = p.session_id) as has_context from per p
), params as (
  select session_id, 'parameter_value_switch' as reason, step, tv as detail, false as bound from bound where targets >= 2
  union all select session_id, 'parameter_context_missing', step, tv, true from bound where not has_context
  union all select session_id, 'parameter_not_from_context', step, fv, true from bound where has_context and foreign_values > 0
), hits as (
  select session_id, 'R1' as fol_id, 'repeated_call' as reason, min(step) as step, '' as parameter, count(*)::varchar as detail from steps where api = 'error' group by session_id having count(*) >= 2
  union all select session_id, 'R2', 'required_before_missing', step, '', '' from missing
  union all select session_id, 'R3', 'sequence_order_uncertain', step, '', '' from steps where api = 'click'
  union all select session_id, 'R4', reason, step, 'k', detail from params where not bound
  union all select session_id, 'R5', reason, step, 'k', detail from params
  union all select m.session_id, 'R6', 'combined_sequence_parameter_risk', m.step, '', m.n || '+' || p.n
    from (select session_id, min(step) as step, count(*) as n from missing group by 1) m join (select session_id, count(*) as n from params group by 1) p on m.session_id = p.session_id
)"""

OBJECTS = f"""
with {S.strip()}, obj as (
  select session_id, step, 'client:c' || (user_id % 40) as actor,
    case when event_type = 'purchase' then 'projectKey:P' || (k % 10) end as project, case when event_type <> 'purchase' then 'issueKey:PRJ' || (k % 7) || '-' || k end as issue
  from steps
), near as (
  select a.session_id, a.step, a.project as p, a.issue as i, b.project as up, b.issue as ui from obj a join obj b on a.session_id = b.session_id and b.step between a.step - 6 and a.step - 1
), relations as (
  select project, issue, count(*) as n from (
    select p as project, ui as issue from near where p is not null and ui is not null
    union all select up, i from near where up is not null and i is not null
    union all select 'projectKey:' || regexp_extract(issue, '^issueKey:([A-Z][A-Z0-9_]+)-', 1), issue from obj where issue is not null
  ) group by all
)"""

VECTORS_OF = f"""
with recursive {S.strip()}, lists as (
  select session_id, list(api order by step) as apis from steps group by session_id
), dist as (
  select array_to_string(apis, '>') as trace, any_value(apis) as apis, count(*) as n, min(session_id) as head, len(any_value(apis)) as length from lists group by 1
), st as (
  select trace, apis, unnest(range(1, len(apis) + 1)) as i from dist
), cnt as (
  select trace, apis[i] as api, count(*) as c from st group by all
), ahead as (
  select trace, apis[i] as a, d, apis[i + d] as b from st, range(1, 6) t(d) where i + d <= len(apis)
), vec as (
  select trace, 'seen:' || api as feature, {W.presence}::double as v from cnt
  union all select trace, 'freq:' || api, {W.frequency} * ln(least(c, {W.cap}) + 1.0) from cnt
  union all select trace, 'direct:' || a || '>' || b, {W.direct} * count(*) from ahead where d = 1 group by trace, a, b
  union all select trace, 'skip:' || a || '>' || b, {W.skip} * sum(1.0::double / d) from ahead where d > 1 group by trace, a, b
  union all select trace, 'start:' || apis[1], {W.endpoint} from dist
  union all select trace, 'end:' || apis[-1], {W.endpoint} from dist
), norm as (
  select d.trace, any_value(d.n) as n, any_value({W.length} * ln(d.length + 1.0) / ln((select max(length) from dist) + 1.0)) as len, sqrt(sum(v * v) + any_value({W.length} * ln(d.length + 1.0) / ln((select max(length) from dist) + 1.0)) ^ 2) as norm
  from dist d join vec on d.trace = vec.trace group by d.trace
), pairs as (
  select x.trace as a, y.trace as b, greatest(0, least(1, 1 - (any_value(p.dot) + any_value(x.len * y.len)) / any_value(x.norm * y.norm))) as dist
  from (select l.trace as a, r.trace as b, sum(l.v * r.v) as dot from vec l join vec r on l.feature = r.feature and l.trace < r.trace group by 1, 2) p
  join norm x on x.trace = p.a join norm y on y.trace = p.b group by 1, 2
)<kth>, near as (
  select a, b, dist from pairs where dist <= <eps> union all select b, a, dist from pairs where dist <= <eps>
), core as (
  select d.trace, d.head from dist d left join (select a, sum(d.n) as others from near join dist d on d.trace = b group by a) o on o.a = d.trace where d.n + coalesce(others, 0) >= 3
), edge as (
  select a, b from near where a in (select trace from core) and b in (select trace from core)
), reach as (
  select trace, trace as other from core union select r.trace, e.b from reach r join edge e on e.a = r.other
), comp as (
  select r.trace, min(c.head) as head from reach r join core c on c.trace = r.other group by r.trace
), numbered as (
  select trace, dense_rank() over (order by head) - 1 as cluster from comp
), labels as (
  select trace, cluster from numbered
  union all select a, min(cluster) from near join numbered on numbered.trace = b where a not in (select trace from core) group by a
)"""
#: Distance of every two sequences; those without a shared feature have their lengths only.
APART = "case when x.trace = y.trace then 0 else coalesce(p.dist, greatest(0, least(1, 1 - x.len * y.len / (x.norm * y.norm)))) end"
KTH = f"""
, steps_k as (
  select a, dist, sum(m) over (partition by a order by dist range between unbounded preceding and current row) as reach from (
    select x.trace as a, case when x.trace = y.trace then y.n - 1 else y.n end as m, {APART} as dist
    from norm x cross join norm y left join pairs p on p.a = least(x.trace, y.trace) and p.b = greatest(x.trace, y.trace)
  )
), kd as (
  select a as trace, min(dist) as k from steps_k where reach >= 2 group by a
), runs as (
  select k, sum(n) as n from kd join norm using (trace) group by k
), placed as (
  select k, n, coalesce(sum(n) over (order by k desc rows between unbounded preceding and 1 preceding), 0) as x0, sum(n) over () - 1 as last, max(k) over () as high, min(k) over () as low from runs
), ends as (
  select *, unnest([x0, x0 + n - 1]) as x from placed
), chosen as (
  select k as raw_eps, least(0.6, greatest(0.15, k)) as eps from ends
  order by round(abs((low - high) * x - last * k + last * high) / sqrt((low - high) ^ 2 + last::double ^ 2), 12) desc, x limit 1
)"""
VECTORS = VECTORS_OF.replace("<kth>", "").replace("<eps>", "0.3")
AUTO = VECTORS_OF.replace("<kth>", KTH).replace("<eps>", "(select eps + 1e-9 from chosen)")
MEDOID = f"""
, member as (
  select l.trace, cluster, d.n, d.head, d.length from labels l join dist d on d.trace = l.trace
), within as (
  select m.cluster, x.trace, o.trace as other, o.n, m.head, {APART} as dist
  from member m join member o on m.cluster = o.cluster join norm x on x.trace = m.trace join norm y on y.trace = o.trace left join pairs p on p.a = least(m.trace, o.trace) and p.b = greatest(m.trace, o.trace)
), medoid as (
  select * from (select *, row_number() over (partition by cluster order by round(total, 9), head) as r from (select cluster, trace, head, sum(n * dist) as total from within group by all)) where r = 1
), away as (
  select w.cluster, s.session_id, round(w.dist, 6) as distance, len(s.apis)::int as length, w.other as trace
  from within w join medoid d on d.cluster = w.cluster and d.trace = w.trace join lists s on array_to_string(s.apis, '>') = w.other where s.session_id <> d.head
)"""
SUMMARY = MEDOID + """
select m.cluster::int as cluster, sum(m.n)::bigint as cluster_size, min(m.length)::int as min_length, max(m.length)::int as max_length, round(sum(m.n * m.length) / sum(m.n), 3) as avg_length, any_value(d.head) as representative, any_value(d.trace) as representative_trace
from member m join medoid d on d.cluster = m.cluster group by m.cluster having sum(m.n) >= 3
"""
NOISE = "select s.session_id, len(s.apis)::int as length, array_to_string(s.apis, '>') as trace from lists s left join labels l on l.trace = array_to_string(s.apis, '>') where l.trace is null"
ONE_HIT = f"{HITS}, one_hit as (select *, row_number() over (partition by fol_id order by session_id) as r from (select distinct fol_id, session_id from hits))"
GATEWAY = f"""
with {PAGE.strip()}, lines as (
  select *, page_id % 2 = 1 as odd, {TYPE_PATTERN} as types, {NAME_SET} as names, case when query <> '' then full_path || '?' || query else full_path end as sent,
    case when regexp_matches(lower(full_path), {STATIC}) then 'static_resource' when {HEALTH} then 'health_check' else 'dynamic_request' end as url_type,
    case when page_id % 2 = 1 then 'POST ' else 'GET ' end as verb
  from shaped
), tokens as (
  select *, verb || path || case when types <> '' then '?' || types else '' end as pattern from lines
)"""

BLOCKS = """
with b as (
  select p_partkey, p_size, 'GET /type/' || (p_size % 5) as first, case when p_size % 2 = 0 then 'POST /pay' else 'POST /buy' end as target,
    list_filter([case when p_size % 2 = 0 then 'orderId' end, case when p_size % 3 = 0 then 'brandKey' end], lambda x: x is not null) as params, case when p_size % 2 = 0 then ['GET /type/' || (p_size % 5), 'POST /buy'] else ['GET /type/' || (p_size % 5)] end as sources
  from part
)"""

PART = """d as (select *, p_type as site_id, ['get', 'put', 'post'][p_size % 3 + 1] as key, '/parts/' || replace(p_brand, '#', '-') || '/' as base from part)"""

# What names of objects, of sensitive fields and of fields of a login have in them.
OBJECT_NAMES = "(?i)(issue|project|space|content|page|comment|worklog|attachment|board|sprint|filter|dashboard|avatar|user|group|id|key)"
SENSITIVE_NAMES = "(?i)(reporter|creator|author|assignee|owner|status|resolution|security|visibility|role|permission|sprint|version|duedate|project|issuetype|transition)"
LOGIN_NAMES = "(?i)(login|auth|session|cookie|token|xsrf|csrf|secure)"
# End of fixed values.

SQL = {
    "openapi_index": f"""with {PART}, n as (select *, split_part(p_name, ' ', 1) as a, ['partId', 'token', split_part(p_name, ' ', 1), split_part(p_name, ' ', 1) || '.role', split_part(p_name, ' ', 2)] as names from d)
      select site_id, upper(key) || ' ' || base || p_partkey || '/{{partId}}' as api, p_name as summary, array_to_string(names, ',') as parameters, 'partId:path:integer,' || a || ':body:object' as required,
        {", ".join(f"array_to_string(list_filter(names, lambda x: regexp_matches(x, '{pattern}')), ',') as {name}" for name, pattern in (("object_parameters", OBJECT_NAMES), ("sensitive_fields", SENSITIVE_NAMES), ("auth_fields", LOGIN_NAMES)))} from n""",
    "openapi_merge": f"""with {PART}, e as (select site_id, base || p_size || '/{{partId}}' as path, key, p_partkey % 4 as r from d), old as (select * from e where r % 2 = 1),
      new as (select * from e where r = 0 or (r = 2 and not exists (select 1 from old where old.site_id = e.site_id and lower(old.path) = lower(e.path))))
      select site_id, path, key, min(m) as n_parameters, max(t) as body_token from (select *, 2::int as m, '' as t from old union all select *, 1::int, 'string' from new) group by all""",
    "review_summary": """select count(*) as reviewed_clusters, count_if(p_size % 3 > 0)::bigint as trustworthy_clusters, count_if(p_size % 3 = 0)::bigint as untrustworthy_clusters, round(avg(p_size / 50.0), 4) as avg_trust_score,
      coalesce(sum(case when p_size % 3 > 0 and p_size % 2 = 0 then 1 else 0 end), 0)::bigint as possible_security_scenario_count, coalesce(string_agg(case when p_size / 50.0 < 0.6 then p_partkey::varchar end, ',' order by p_partkey), '') as low_trust_cluster_indexes from part""",
    "context_bindings": f"{BLOCKS}, s as (select target, sources, unnest(params) as parameter from b) select parameter, source_api, target as target_api, 'bound_to_upstream_context' as relation, count(*) as n from (select *, unnest(sources) as source_api from s) group by all",
    "parameter_occurrences": f"""{BLOCKS}, s as (select target, sources, unnest(params) as parameter from b)
      select parameter, api, location, role, count(*) as n from (select parameter, unnest(sources) as api, 'response_or_business_context' as location, 'context_source' as role from s union all select parameter, target, 'path_query_body_or_header', 'target_parameter' from s) group by all""",
    "api_risk": rf"""with {PAGE.strip()}, c as (select site_id, path, min(page_id) as opening from shaped group by all),
      s as (select site_id, 'attack on ' || arg_min(path, opening) || ' search' as text, ['BOLA', 'BFLA', 'RESOURCE_CONSUMPTION'][length(site_id) % 3 + 1] as security_type from c group by site_id),
      w as (select *, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_/-]{{2,}}'), lambda x: lower(regexp_replace(x, '^/+|/+$', '', 'g'))), lambda x: x not in ('', 'get', 'post', 'put', 'patch', 'delete', 'api', 'jira', 'rest')) as whole from s),
      t as (select *, list_distinct(list_concat(whole, list_filter(flatten(list_transform(whole, lambda x: regexp_split_to_array(x, '[/_-]+'))), lambda x: length(x) >= 3))) as tokens from w),
      r as (select t.site_id, security_type, 'GET ' || path as api, opening, coalesce(list_sum(list_transform(list_filter(tokens, lambda x: contains(lower('GET ' || path), x)), lambda x: case when contains(x, '/') then 3 else 1 end)), 0)
          + case when security_type = 'BOLA' and contains(path, '{{int}}') then 4 when security_type = 'BFLA' and regexp_matches(lower(path), '(admin|permission|role|config|workflow|scheme|manage|delete|project.?role)') then 5
            when security_type = 'RESOURCE_CONSUMPTION' and regexp_matches(lower(path), '(search|upload|download|export|avatar|attachment|jql|cql|poll|notification|gadget|autocomplete)') then 4 else 0 end
          + case when regexp_matches(lower(path), '(leader|admin|delete|permission|config|token|search|export)') then 2 else 0 end as score from t join c on c.site_id = t.site_id)
      select site_id, security_type, api, score::int as score from (select *, row_number() over (partition by site_id order by score desc, opening) as n from r) where n = 1""",
    "session_gap": f"with {S.strip()} {BY_SESSION.replace('start_us', 'start_ts').replace('end_us', 'end_ts')}",
    "session_gap_default": f"with {sessions(600).strip()} {BY_SESSION.replace('start_us', 'start_ts').replace('end_us', 'end_ts')}",
    "session_capped": CAPPED,
    "session_length_hist": f"with {S.strip()}, s as ({BY_SESSION}) select session_length, case when session_length <= 2 then 'short_1_2' when session_length <= 50 then 'main_3_50' else 'long_51_plus' end as bucket, count(*) as n_sessions, count_if(session_label = 'abnormal')::bigint as n_abnormal from s group by all",
    "session_stream": f"with {S.strip()}, s as ({BY_SESSION}) select user_id, start_us, end_us, session_length, session_label from s",
    "dfg_edges": f"with {S.strip()}, p as (select api as source, lead(api) over (partition by session_id order by step) as target from steps) select source, target, count(*) as n from p where target is not null group by all",
    "skip_edges": f"with {S.strip()} select a.api as source, b.api as target, count(*) as n, round(sum(1.0::double / (b.step - a.step)), 4) as weight from steps a join steps b on a.session_id = b.session_id and b.step - a.step between 2 and 5 group by all",
    "role_edges": "with p as (select role as source, lead(role) over (partition by conv_id order by turn) as target from conversations) select source, target, count(*) as n from p where target is not null group by all",
    "trace_summary": f"""with {S.strip()}, c as (select user_id, segment, api, count(*) as n, min(step) as seen from steps group by all),
      r as (select *, row_number() over (partition by user_id, segment order by n desc, seen) as r from c),
      t as (select user_id, segment, string_agg(api || ':' || n, ',' order by r) as top_activities, max(r) as d from r where r <= 8 group by all)
      select s.user_id, s.segment, count(*) as length, arg_min(api, step) as first_activity, arg_max(api, step) as last_activity, any_value(t.d) as distinct_activities, any_value(t.top_activities) as top_activities
      from steps s join t on t.user_id = s.user_id and t.segment = s.segment group by s.user_id, s.segment""",
    "url_template": rf"""with {PAGE.strip()} select page_id, site_id, full_path as path, path as path_pattern, query,
      case when regexp_matches(lower(full_path), '\.(jpg|jpeg|png|gif|css|js|txt|xml|ico|svg|woff|woff2|ttf|map|bmp|webp|mp4)$') then 'static_resource'
        when full_path in ('', '/', '/health', '/healthz') or starts_with(full_path, '/health/') or starts_with(full_path, '/healthz/') then 'health_check' else 'dynamic_request' end as url_type,
      array_to_string(list_sort(list_distinct(list_transform(pairs, lambda p: p.name))), ',') as param_name_set,
      array_to_string(list_transform(pairs, lambda p: p.name || '=<' || {kind('p.value')} || '>'), '&') as param_type_pattern, regexp_replace(lower(path), '\{{[^}}]*\}}', '{{}}', 'g') as fingerprint from shaped""",
    "method_profile": f"with {PAGE.strip()} select path, method, count(*) as request_count, count_if(len(pairs) > 0)::bigint as with_query from shaped group by all",
    "parameter_profile": f"""with {PAGE.strip()}, {PAIR.strip()}, total as (select path, method, count(*) as request_count from shaped group by all),
      counts as (select path, method, param, sum(pairs)::bigint as count, count(*) as present_count, sum(empty)::bigint as empty_count from one group by all),
      ty as (select path, method, param, string_agg(type, ',' order by n desc, seen, type) as types from kinds group by all),
      ex as (select path, method, param, string_agg(value, ' | ' order by r) as examples from shown where r <= 8 group by all)
      select c.path, c.method, 'query' as location, c.param, request_count, count, present_count, empty_count, round(present_count / request_count, 4) as required_ratio, round(empty_count / count, 4) as empty_ratio, types, examples
      from counts c join total t on t.path = c.path and t.method = c.method join ty on ty.path = c.path and ty.method = c.method and ty.param = c.param left join ex on ex.path = c.path and ex.method = c.method and ex.param = c.param""",
    "parameter_sets": f"""with {PAGE.strip()}, sets as (select path, method, array_to_string(list_sort(list_distinct(list_transform(pairs, lambda p: p.name))), ',') as params, page_id from shaped),
      c as (select path, method, params, count(*) as n, min(page_id) as seen from sets group by all),
      r as (select *, round(n / sum(n) over (partition by path, method), 4) as ratio, row_number() over (partition by path, method order by n desc, seen) as r from c)
      select path, method, params, n, ratio from r where r <= 20 and params <> ''""",
    "request_samples": f"""with {PAGE.strip()}, f as (select *, row_number() over (partition by site_id, path, method order by page_id) as r, min(page_id) over (partition by site_id, path, method) as opening from shaped),
      g as (select *, row_number() over (partition by site_id, path order by opening, r) as sample_no from f where r <= 40) select site_id, path, method, page_id, sample_no from g where sample_no <= 40""",
    "value_typing": f"with w as (select unnest(string_split(text, ' ')) as w from documents), s as (select {STRIPPED} as x from w) select {kind('x')} as kind, count(*) as n from s group by 1",
    "label_left_join": f"{LABELLED} select * from labelled",
    "label_counts": f"{LABELLED} select count(*) as n_access, count_if(label = 1)::bigint as n_labelled, count_if(label = 1 and security_event_type = 'none')::bigint as n_without_kind from labelled",
    "label_semi": f"with {OR} select id, l_linenumber, l_partkey, l_suppkey, kind from r where id in (select id from o where o_orderstatus = 'F')",
    "label_anti": f"with {OR} select id, l_linenumber, l_partkey, l_suppkey, kind from r where id not in (select id from o where o_orderstatus = 'F')",
    "time_window": "select event_type, count(*) as n, round(sum(value), 2) as total from events where ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-06 00:00:00' group by event_type",
    "rule_hits": f"{HITS} select session_id, fol_id, 1 as expr, reason, step, parameter, detail from hits",
    "findings_by_rule": f"{HITS}, found as (select fol_id, session_id, count(*) as n from hits group by all) select fol_id, count(*) as hit_count, sum(n)::bigint as expression_hit_count, count(distinct session_id) as hit_session_count, min(session_id) as first_session, max(session_id) as last_session from found group by fol_id",
    "rule_evidence": f"""{ONE_HIT}, t as (select session_id, string_agg(api, '>' order by step) as trace from steps group by session_id)
      select h.fol_id, h.session_id, h.fol_id as scenario_id, string_agg(reason || '@' || step, ',' order by step, reason, parameter, detail) as hits, any_value(trace) as trace, 0::bigint as filtered_noise_count
      from hits h join one_hit o on o.fol_id = h.fol_id and o.session_id = h.session_id and o.r <= 50 join t on t.session_id = h.session_id group by h.fol_id, h.session_id""",
    "rule_run_summary": f"""{ONE_HIT}, c as (select fol_id, count(*) as n from one_hit group by fol_id), e as (select rule as fol_id, coalesce(n, 0) as n from (values ('R1'), ('R2'), ('R3'), ('R4'), ('R5'), ('R6')) v(rule) left join c on fol_id = rule)
      select fol_id, n as rule_hit_count, least(n, 50) as emitted_count, (select count(distinct session_id) from steps) as session_count, 0::bigint as filtered_noise_count, (select count(distinct session_id) from one_hit where r <= 50) as hit_session_count,
        6::bigint as rule_count, (select sum(least(n, 50))::bigint from e) as finding_count from e""",
    "request_values": f"""with {PAGE.strip()}, r as (select *, row_number() over (partition by site_id order by page_id)::int as step from shaped),
      v as (select site_id, step, full_path, unnest(list_concat(pairs, case when page_id % 2 = 0 then [struct_pack(name := 'page', value := page_id::varchar), struct_pack(name := 'kind', value := 'even page')] else [] end)) as p from r)
      select site_id as session_id, step, 'GET ' || full_path as api, p.name as name, p.value as value from v""",
    "business_focus": f"""with {PAGE.strip()}, r as (select *, 'GET ' || case when page_id % 3 = 0 then '/static/app.js' when page_id % 5 = 0 then '/logo.PNG?v=2' else path end as api from shaped),
      n as (select *, page_id % 3 = 0 or page_id % 5 = 0 as noisy from r), d as (select *, count_if(noisy) over (partition by site_id)::bigint as dropped from n)
      select site_id as session_id, row_number() over (partition by site_id order by page_id)::int as step, api, dropped from d where not noisy""",
    "noise_overlap": f"""{VECTORS}, missing as (
        select session_id from (select *, max(case when api = 'view' then step end) over (partition by session_id order by step rows between unbounded preceding and 1 preceding) as before from steps) where api = 'purchase' and before is null
      ), h as (select distinct session_id from missing), z as (select session_id from ({NOISE}))
      select (select count(*) from h) as hit_sessions, (select count(*) from z) as noise_sessions, count(*) as overlap, round(count(*) / (select nullif(count(*), 0) from h), 6) as share_of_hits, round(count(*) / (select nullif(count(*), 0) from z), 6) as share_of_noise from h join z using (session_id)""",
    "boundary_relations": f"{OBJECTS} select project, issue, n from relations",
    "project_support": f"{OBJECTS} select project, sum(n)::bigint as support, count(*) as issue_count from relations group by project having sum(n) >= 3",
    "actor_access": f"""{OBJECTS}, likely as (select issue, project from (select *, row_number() over (partition by issue order by n desc, project) as r from relations) where r <= 3)
      select actor, project, count(*) as n from (select actor, project from obj where project is not null union all select o.actor, l.project from obj o join likely l on l.issue = o.issue) group by all""",
    "upstream_window": f"""{OBJECTS}, w as (select o.session_id, o.step, count(n.up) as projects_before, count(n.ui) as issues_before from obj o left join near n on n.session_id = o.session_id and n.step = o.step group by all)
      select projects_before::int as projects_before, issues_before::int as issues_before, count(*) as n from w group by all""",
    "sequence_norms": f"{VECTORS} select trace, n as n_sessions, round(norm, 6) as norm, round(len, 6) as scaled_length from norm",
    "close_sequences": f"{VECTORS} select a as left_trace, b as right_trace, round(dist, 6) as dist from pairs where dist <= 0.3",
    "dbscan_labels": f"{VECTORS} select s.session_id, coalesce(l.cluster, -1)::int as cluster from lists s left join labels l on l.trace = array_to_string(s.apis, '>')",
    "cluster_summary": VECTORS + SUMMARY,
    "cluster_members": f"{VECTORS}{MEDOID} select cluster::int as cluster, session_id, distance, length, trace from away",
    "nearest_members": f"{VECTORS}{MEDOID} select cluster::int as cluster, session_id, distance, length, trace from (select *, row_number() over (partition by cluster order by distance, session_id) as r from away) where r <= 5",
    "noise_sessions": f"{VECTORS} {NOISE}",
    "auto_eps": f"""{AUTO}, s as (select min(k) as low, max(k) as high, sum(k * n) / sum(n) as mean from runs)
      select round(eps, 6)::double as eps, round(raw_eps, 6) as raw_eps, round(low, 6) as k_distance_min, round(high, 6) as k_distance_max, round(mean, 6) as k_distance_avg, 'auto_k_distance_elbow' as mode,
        (select count(*) from labels) as clustered_sequences, (select count(*) from ({NOISE})) as noise_sessions from chosen, s""",
    "first_sessions": f"with {S.strip()} select 's1' as site_id, session_id, count(*) as session_length from seg, lateral (select user_id || '_' || segment as session_id) where user_id % 3 = 1 group by session_id order by session_id limit 100",
    "top_paths": f"with {PAGE.strip()}, c as (select site_id, path, count(*) as request_count from shaped group by all) select site_id, path, request_count, rank::int as rank from (select *, row_number() over (partition by site_id order by request_count desc, path) as rank from c) where rank <= 3",
    "site_totals": f"with {PAGE.strip()} select site_id, count(distinct path) as path_count, count(*) as request_count from shaped group by site_id",
    "header_profile": f"""with {PAGE.strip()}, h as (select site_id, page_id, unnest(['Host', 'X-Page']) as param, unnest([site_id, page_id::varchar]) as value from page where page_id % 7 <> 0),
      t as (select site_id, count(*) as request_count from page group by site_id), x as (select site_id, param, string_agg(value, ' | ' order by r) as examples from (select *, row_number() over (partition by site_id, param order by seen) as r from (select site_id, param, value, min(page_id) as seen from h group by all)) where r <= 8 group by site_id, param)
      select h.site_id, 'header' as location, h.param, any_value(request_count) as request_count, count(*) as count, count(*) as present_count, any_value(case when h.param = 'Host' then {kind('h.site_id')} else 'INT' end) as types, any_value(examples) as examples
      from h join t on t.site_id = h.site_id join x on x.site_id = h.site_id and x.param = h.param group by h.site_id, h.param""",
    "path_parameters": f"""with {PAGE.strip()}, z as (select page_id, unnest(list_zip(list_filter(string_split(path, '/'), lambda p: p <> ''), list_filter(string_split(full_path, '/'), lambda p: p <> ''))) as p from shaped)
      select page_id, regexp_extract(p[1], '^\\{{(.*)\\}}$', 1) as name, p[2] as value from z where regexp_full_match(p[1], '\\{{.*\\}}')""",
    "gateway_events": rf"""{GATEWAY} select 'r' || page_id as request_id, site_id, case when page_id % 5 = 0 then 'waf_log_websec' else 'waf_log_webaccess' end as tag, '2026-06-16 08:00:00' as timestamp, '192.0.2.' || (page_id % 250) as source_ip, trim(verb) as method,
      (200 + page_id % 3)::int as status_code, full_path as path, path as path_pattern, query, url_type, case when page_id % 5 = 0 then 'abnormal' else 'normal' end as event_label, 'none' as event_type, case when full_path = '' then 'missing_url' else 'ok' end as reason,
      names as param_name_set, types as param_type_pattern, len(pairs)::int as param_count, case when odd then 'kind,page' else '' end as body_param_name_set, case when odd then 'page=<INT>&kind=<STR>' else '' end as body_param_type_pattern, case when odd then 2 else 0 end::int as body_param_count,
      verb || sent as api_request, pattern as api_request_pattern, verb || path || case when names <> '' then '?' || names else '' end as api_request_param_names,
      pattern || case when odd then ' BODY page=<INT>&kind=<STR>' else '' end as token, verb || sent || case when odd then ' BODY page=' || page_id || '&kind=odd' else '' end as full_request from tokens""",
    "gateway_counts": f"""{GATEWAY}, k as (select *, full_path <> '' and url_type = 'dynamic_request' as kept from lines)
      select count_if(full_path <> '')::bigint as ok, count_if(full_path = '')::bigint as missing_url, count_if(full_path <> '' and url_type = 'static_resource')::bigint as static_resource, count_if(full_path <> '' and url_type = 'health_check')::bigint as health_check,
        count_if(kept and query <> '')::bigint as with_query, count_if(kept and odd)::bigint as with_body_params from k""",
}
