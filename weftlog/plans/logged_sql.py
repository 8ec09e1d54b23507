"""SQL of the queries over written logs."""

from __future__ import annotations

from weftlog.plans.queries import IDLE
from weftlog.plans.sql import OBJECTS, ONE_HIT, PAGE, sessions
from weftlog.plans.sql import SQL as BASE

STEPS = f"""with {sessions(IDLE).strip()}, spread as (
  select *, (user_id % 3)::varchar as site, case when bool_or(event_type = 'error') over (partition by session_id) then 'abnormal' else 'normal' end as label, count(*) over (partition by session_id) as n,
    'GET /' || event_type || '/' || coalesce(k::varchar, 'none') || '?k=1' as token from steps
)"""

ALL_STEPS = f"""{STEPS}
select 't' as site_id, 'Session_' || session_id || '_Label:' || label || '_Length:' || n as session_id, label as session_label, '' as source_ip, step::int as step, token from spread where user_id % 2 = 0
union all
select case when user_id % 5 = 0 then 'unknown_site' else site end, session_id, label, 'c' || user_id, step::int,
  case when user_id % 5 < 4 or step % 3 <> 2 then token else 'GET /other' end from spread where user_id % 2 = 1
"""

REASONS = """
with e as (
  select event_id, event_id % 12 as way, date_trunc('second', ts::timestamp) as moment from events
), spelt as (
  select *, date_trunc('day', moment) as day, case way
    when 4 then strftime(moment, '%Y-%m-%dT%H:%M:%SZ') when 5 then strftime(moment, '%Y-%m-%dT%H:%M:%S') || '+02:00' when 6 then strftime(moment, '%Y-%m-%dT%H:%M:%S') when 7 then strftime(moment, '%Y-%m-%d %H:%M:%S') when 8 then strftime(moment, '%Y-%m-%d') || 'T24:00:00Z'
    when 9 then strftime(moment, '%Y-%m-%d') || 'T:' || strftime(moment, '%M:%S') when 10 then strftime(moment, '%Y-%m-%dT%H:%M:%S') || '.250000Z' when 11 then strftime(moment, '%Y-%m-%d %H:%M:%S') || '|late' end as shown from e
)
select case way when 0 then '{"event_id": ' || event_id when 1 then '[' || event_id || ']' when 2 then '{"timestamp": "soon", "event_id": ' || event_id || '}' when 3 then '{"event_id": ' || event_id || '}' else '{"timestamp": "' || shown || '", "event_id": ' || event_id || '}' end as line,
  case when way < 2 then 'bad_json' when way < 4 then 'bad_time' else 'ok' end as reason, case when way >= 2 then event_id else -1 end as event_id,
  case when way >= 4 then epoch_ms(case way when 5 then moment - interval 2 hour when 8 then day + interval 1 day when 9 then day + to_minutes(minute(moment)) + to_seconds(second(moment)) - interval 8 hour when 10 then moment + interval 250 millisecond when 4 then moment else moment - interval 8 hour end) else -1 end as at_ms
from spelt
"""

ROUTED = """
with l as (
  select page_id, case when page_id % 5 = 0 then 'tag:waf_log_websec' when page_id % 5 < 4 then 'tag:waf_log_webaccess' else 'tag:other' end as tag, ['none', '', 'sqli'][page_id % 3 + 1] as kind,
    ['2026-06-15T24:00:00+08:00', '2026-06-16T07:59:59', '2026-06-16T00:00:00Z', '2026-06-16T23:00:00+08:00', '2026-06-15T23:59:59+08:00', 'today'][page_id % 6 + 1] as moment, page_id % 6 < 4 as within from pages
), r as (
  select *, case when kind = 'sqli' then 1 else 0 end as label, '{"timestamp":"' || moment || '","msg":"' || tag || ';request_id:r' || page_id || ';event_type:' || case when kind = 'sqli' then 'attack' else 'none' end || ';url:/p/' || page_id || '"}' as body from l where within
)
select case when page_id % 5 = 0 then 'security' when page_id % 5 < 4 then 'access' else 'unknown' end as route, 'r' || page_id as request_id, kind as event_type,
  case when page_id % 7 = 0 then '{"raw_line":' || to_json(body || ' tail')::varchar || ',"label":' || label || ',"matched_request_id":"r' || page_id || '"}' else left(body, length(body) - 1) || ',"label":' || label || ',"matched_request_id":"r' || page_id || '"}' end as line from r
"""

BODIES = rf"""with {PAGE.strip()}, l as (
  select page_id, page_id % 6 as way, full_path, regexp_replace(raw_url, '^[a-z]+://[^/?#]*', '') as target, case when page_id % 4 = 0 then 'unknown_ip' else '192.0.2.' || (page_id % 200) end as ip from page
)
select 'ok' as reason, 'r' || page_id as request_id, case way when 0 then 'PUT' when 1 then 'GET' else 'DELETE' end as method, case when way = 1 then '/' || full_path else full_path end as path, ip as source_ip,
  case when way = 0 then 'id,user.name,user.tags[],user.tags[],user.tags[],ok' else '' end as body_names, case when way = 0 then 'id=<INT>&user.name=<STR>&user.tags[]=<STR>&user.tags[]=<BOOL>&user.tags[]=<EMPTY>&ok=<BOOL>' else '' end as body_param_type_pattern
from l where way in (0, 1, 5)
union all select 'missing_url', 'r' || page_id, '', '', '', '', '' from l where way = 2
"""

CLIENTS = """
with e as (
  select event_id, epoch_us(ts) / 1e6 as sec, user_id % 2 as site, case user_id % 4 when 0 then 'r' || user_id when 1 then 's' || user_id when 2 then 's' || user_id else 'unknown_ip' end as client from events
), gap as (
  select *, case when sec - lag(sec) over w > 600 then 1 else 0 end as fresh from e window w as (partition by site, client order by sec, event_id)
), seg as (
  select *, sum(fresh) over (partition by site, client order by sec, event_id rows unbounded preceding)::bigint as segment from gap
)
select 'sess_' || site || '_' || client || '_' || floor(min(sec))::bigint || '_' || segment as session_id, client as client_key, count(*) as session_length from seg group by site, client, segment
"""

LEAVES = """
with recursive o as (
  select ('{"status":"' || o_orderstatus || '","items":' || to_json(range(0, (o_orderkey % 3 + 21)::bigint))::varchar || ',"more":{"flag":' || case when o_orderkey % 2 = 0 then 'true' else 'false' end || ',"none":null,"empty":[],"list":[{"a":' || (o_custkey % 4) || '},[1,"x"]]},"n":-' || (o_orderkey % 5) || '}')::json as doc from orders
), bodies as (select doc, count(*) as n from o group by doc),
walk as (
  select n, doc as v, d as dialect, '' as name from bodies, unnest(['event', 'profile', 'boundary', 'detection']) as u(d)
  union all
  select n, k.v, dialect, k.name from (
    select w.n, w.dialect, unnest(case when json_type(w.v) = 'OBJECT'
      then list_transform(json_keys(w.v), lambda x: struct_pack(name := case when w.name = '' then x else w.name || '.' || x end, v := json_extract(w.v, '$."' || x || '"')))
      else list_transform(range(0, (case when w.dialect = 'boundary' then least(20, json_array_length(w.v)) else json_array_length(w.v) end)::bigint), lambda i: struct_pack(name := w.name || case when w.dialect in ('boundary', 'detection') or w.name = '' then '[' || i || ']' else '[]' end, v := json_extract(w.v, '$[' || i || ']'))) end) as k
    from walk w where json_type(w.v) in ('OBJECT', 'ARRAY')
  )
), leaves as (
  select n, dialect, name, json_type(v) as kind, case when json_type(v) = 'VARCHAR' then v->>'$' when json_type(v) = 'BOOLEAN' then upper(left(v::varchar, 1)) || substr(v::varchar, 2) when json_type(v) = 'NULL' then case dialect when 'detection' then 'None' else '' end else v::varchar end as value
  from walk where json_type(v) <> 'OBJECT' and (json_type(v) <> 'ARRAY' or (dialect = 'profile' and json_array_length(v) = 0)) and not (dialect = 'boundary' and json_type(v) = 'NULL')
)
select dialect, name, value, sum(n)::bigint as n from leaves group by all
"""

TITLES = """
with b as (select *, p_size % 2 = 0 as even from part)
select p_partkey::int as cluster_index, array_to_string(list_filter([case when p_size % 3 = 0 then 'not_trustworthy' end, case when p_size / 50.0 < 0.7 then 'low_trust_score' end], lambda x: x is not null), ',') as warnings, count(*) over (partition by p_brand) as name_count,
  case when not even then '' when regexp_matches(p_name, '(id|key|token|parameter|context|binding)') then p_name else 'orderId 上下文不一致导致的对象级访问风险' end as scenario_title,
  case when even then 'BOLA' else '' end as security_type, case when even then 'parameter_consistency' else '' end as risk_type
from b
"""

ANSWERS = "select p_partkey::int as cluster_index, p_partkey % 2 = 0 as is_trustworthy, 'a {' || p_brand || '}' as business_pattern_name from part where p_partkey % 5 < 2"

BRIEFS = """
with s as (select user_id, list(event_type order by epoch_us(ts), event_id) as trace from events group by user_id)
select user_id, case when len(trace) >= 10 then 'review' else 'short' end as kind, array_to_string(case when len(trace) <= 14 then trace
  else list_concat(trace[1:9], ['... omitted_steps=' || (len(trace) - 13) || ', total_steps=' || len(trace)], trace[len(trace) - 3:len(trace)]) end, '>') as trace from s
"""

ONE_CLIENT = """
with e as (select epoch_us(ts) as us, epoch_us(ts) / 1e6 as sec, event_id from events), g as (
  select *, case when sec - lag(sec) over (order by sec, event_id) > 30 then 1 else 0 end as fresh from e
), s as (
  select *, sum(fresh) over (order by sec, event_id rows unbounded preceding)::bigint as segment from g
)
select 'proxy' as client, segment, count(*) as session_length, min(us) as start_us, max(us) as end_us from s group by segment
"""

PROJECTS = f"""{OBJECTS}, per as (select project, sum(n)::bigint as support, count(*) as issue_count from relations group by project having sum(n) >= 3 order by issue_count desc, support desc, project limit 10),
  r as (select *, row_number() over (partition by project order by n desc, issue) as r from relations)
select p.project, support, issue_count, string_agg(issue || '*' || n, ',' order by r) as issues from per p join r on r.project = p.project and r.r <= 5 group by all
"""

ACTORS = f"""{OBJECTS}, likely as (select issue, project from (select *, row_number() over (partition by issue order by n desc, project) as r from relations) where r <= 3),
  access as (select actor, project, count(*) as n from (select actor, project from obj where project is not null union all select o.actor, l.project from obj o join likely l on l.issue = o.issue) group by all),
  per as (select actor, sum(n)::bigint as support, count(*) as project_count from access group by actor having sum(n) >= 3 order by project_count desc, support desc, actor limit 25),
  r as (select *, row_number() over (partition by actor order by n desc, project) as r from access)
select p.actor, support, project_count, string_agg(project || '*' || n, ',' order by r) as projects from per p join r on r.actor = p.actor and r.r <= 3 group by all
"""

FINDINGS = f"""{ONE_HIT}, t as (select session_id, any_value(user_id) as user_id, string_agg(api, '>' order by step) as trace, string_agg('GET /' || api || '?k=' || coalesce(k::varchar, ''), ' ' order by step) as requests from steps group by session_id)
select h.fol_id, h.session_id, h.fol_id as scenario_id, 'title of ' || h.fol_id as scenario_title, case when h.fol_id = 'R2' then 'BFLA' else 'BOLA' end as security_type, case when h.fol_id <> 'R3' then 'high' else '' end as risk_level,
  'shop' as business_pattern_name, 'reason of ' || h.fol_id as overall_reason, '192.0.2.' || (any_value(t.user_id) % 250) as source_ip, any_value(requests) as requests, any_value(trace) as trace,
  string_agg(reason || '@' || step, ',' order by step, reason, parameter, detail) as hits, (any_value(t.user_id) % 3)::bigint as filtered_noise_count
from hits h join one_hit o on o.fol_id = h.fol_id and o.session_id = h.session_id and o.r <= 50 join t on t.session_id = h.session_id group by h.fol_id, h.session_id
"""

REFRESHED = """
select 'all' as way, o_orderstatus, count(*) as n, round(sum(case when o_orderstatus = 'P' then 0.0::double else o_totalprice end), 2) as total from orders group by all
union all select 'new', o_orderstatus, count(*), round(sum(case when o_orderstatus = 'F' then o_totalprice else -o_totalprice end), 2) from orders group by all
"""

SAMPLES = f"""with {PAGE.strip()}, f as (
  select *, row_number() over (partition by site_id, path, method order by page_id) as r, min(page_id) over (partition by site_id, path, method) as opening from shaped
), g as (
  select *, row_number() over (partition by site_id, path order by opening, r) as sample_no from f where r <= 40
)
select site_id, path, page_id, sample_no, '{{"request":{{"url":' || to_json(full_path)::varchar || ',"method":"GET","query":' || to_json(query)::varchar
  || case when page_id % 2 = 1 then ',"body":{{"password":"<redacted>","page":"' || page_id || '","note":"' || repeat('n', 253) || '..."}}' else '' end
  || '}},"response":{{"status":' || case when page_id % 4 > 0 then 200 + page_id % 4 else 0 end || ',"content_type":"text/html","content_length":""}}}}' as sample from g where sample_no <= 40
"""

REPORT = f"""
with e as (select *, epoch_us(ts) / 1e6 as sec from events), g as (
  select *, case when sec - lag(sec) over (partition by user_id order by sec, event_id) > {IDLE} then 1 else 0 end as fresh from e where event_id % 40 > 1
), seg as (
  select *, sum(fresh) over (partition by user_id order by sec, event_id rows unbounded preceding) as segment from g
), s as (
  select count(*) as n, case when bool_or(event_type = 'error') then 'abnormal' else 'normal' end as label from seg group by user_id, segment
)
select 'events' as counter, sum(n)::bigint as n from s union all select 'sessions', count(*) from s union all select 'label_' || label, count(*) from s group by label union all select 'length_' || n, count(*) from s group by n
union all select case event_id % 40 when 0 then 'bad_json' else 'bad_time' end, count(*) from events where event_id % 40 < 2 group by 1
"""

LATER = f"with {sessions(IDLE).strip()} select user_id, segment, count(*) as session_length, floor(min(us) / 1e6 * 1000)::bigint as start_ms from seg where segment > 0 group by user_id, segment"

SQL = {
    "later_sessions": LATER, "log_samples": SAMPLES, "session_report": REPORT, "top_clusters": f"select * from ({BASE['cluster_summary']}) order by cluster_size desc, cluster limit 2", "session_gap_wide": BASE["session_gap"], "session_gap_one_client": ONE_CLIENT, "project_tops": PROJECTS, "actor_tops": ACTORS, "rule_findings": FINDINGS, "refreshed_orders": REFRESHED,
    "all_session_steps": ALL_STEPS, "line_reasons": REASONS, "routed_lines": ROUTED, "gateway_bodies": BODIES, "client_sessions": CLIENTS, "json_leaves": LEAVES, "scenario_titles": TITLES, "answer_reviews": ANSWERS, "cluster_briefs": BRIEFS,
}
