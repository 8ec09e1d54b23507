"""SQL of the queries over documented APIs and rules."""

from __future__ import annotations

from weftlog.plans.sql import PAGE, kind

TEMPLATE = """'/' || array_to_string(list_transform(shaped, lambda p, i: case when regexp_full_match(p, '\\{{.*\\}}') and len(list_filter(shaped[1:i], lambda q: q = p)) > 1
  then regexp_replace(p, '\\}}$', '') || '_' || len(list_filter(shaped[1:i], lambda q: q = p)) || '}}' else p end), '/')"""

DOCUMENTED = rf"""with {PAGE.strip()}, parts as (
  select page_id, full_path, list_transform(list_filter(string_split(full_path, '/'), lambda p: p <> ''), lambda p: case
    when regexp_full_match(p, '\{{.*\}}') then p when regexp_full_match(p, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}') then '{{uuid}}' when regexp_full_match(p, '-?[0-9]+') then '{{int}}'
    when regexp_full_match(p, '[A-Za-z][A-Za-z0-9]+-[0-9]+') then '{{issue_key}}' when regexp_full_match(p, '[0-9a-fA-F]{{8,}}') then '{{hex}}' when regexp_full_match(p, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then '{{date}}'
    when regexp_full_match(p, '[A-Za-z0-9_-]{{24,}}') then '{{token}}' else lower(p) end) as shaped from page
), named as (
  select page_id, full_path, {TEMPLATE.format()} as template from parts
), docs as (
  select case when page_id % 3 = 0 then 'POST' else 'GET' end as m, template, min(page_id) as place from named group by all
), calls as (
  select distinct case page_id % 6 when 0 then 'get ' || full_path || '/' when 1 then ' POST ' || full_path when 2 then full_path when 3 then 'GET ' || regexp_replace(full_path, '^/[^/]*', '') when 4 then 'GET /v2' || template else 'PUT ' || full_path end as api from named
), cut as (
  select api, case when contains(trim(api), ' ') then upper(split_part(trim(api), ' ', 1)) else '' end as m,
    regexp_replace(case when contains(trim(api), ' ') then split_part(trim(api), ' ', 2) else trim(api) end, '/+$', '') as path from calls
), other as (
  select m, m || ' ' || template as doc_api, regexp_replace(template, '/+$', '') as path, place from docs
), met as (
  select c.api, o.doc_api, o.place from cut c join other o on (c.m = '' or c.m = o.m) and trim(c.api) <> '' and
    (c.path = o.path or regexp_replace(c.path, '/[0-9]+|/[A-Fa-f0-9-]{{8,}}', '/{{}}', 'g') = regexp_replace(o.path, '\{{[^/]+\}}', '{{}}', 'g') or ends_with(c.path, o.path) or ends_with(o.path, c.path))
), first as (
  select * from (select *, row_number() over (partition by api order by place, doc_api) as n from met) where n <= 2
)
select c.api, coalesce(f.doc_api, '') as doc_api, coalesce(f.place, -1) as place from cut c left join first f on c.api = f.api
"""

STEP = "regexp_matches(x, '^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS) ', 'i')"
OBJECT = "(issue|project|space|content|page|comment|worklog|attachment|board|sprint|filter|dashboard|avatar|user|group|id|key)"
SENSITIVE = "(reporter|creator|author|assignee|owner|status|resolution|security|visibility|role|permission|sprint|version|duedate|project|issuetype|transition)"
CLEAN = "list_transform(list_filter({0}, lambda x: trim(x) <> ''), lambda x: trim(x))"
QUOTED = "'\"' || replace(replace(trim({0}), '\\', '\\\\'), '\"', '\\\"') || '\"'"

RULES = f"""with base as (
  select p_partkey as k, p_size as z, p_name as name, p_brand, split_part(p_name, ' ', 1) as w0, split_part(p_name, ' ', 2) as w1 from part where p_size % 13 > 0
), docs as (
  select 'POST /' || split_part(p_name, ' ', 1) || '/{{partId}}/' || split_part(p_name, ' ', 2) as doc, split_part(p_name, ' ', 1) as w0, split_part(p_name, ' ', 2) as w1 from part group by all
), told as (
  select *, 'post /' || w0 || '/' || k || '/' || w1 as call, 'POST /' || w0 || '/' || k || '/' || w1 as up_call, 'GET /list/' || (z % 5) as listing,
    case when k % 23 = 0 then '' else name || case when k % 17 = 0 then ' "x\\y"' else '' end end as title, case when k % 29 = 0 then '' else 'order of ' || name end as reason,
    coalesce(case k % 5 when 0 then 'BOLA' when 1 then 'BFLA' when 3 then 'BOPLA' when 4 then 'AUTH_BYPASS' end, 'OTHER') as kind, case k % 5 when 1 then '功能级越权' when 2 then '' when 0 then 'BOLA' when 3 then 'BOPLA' else 'AUTH_BYPASS' end as raw_kind,
    case k % 2 when 0 then 'high' else 'medium' end as level, case k % 4 when 0 then 'sequence_order' when 1 then 'parameter_consistency' when 2 then 'both' end as told_risk,
    case when z % 5 = 0 then 'skips GET /list/0' when z % 5 = 1 then '无法确定' else '' end as told_step,
    case when z % 2 = 0 then ['orderId', w1 || 'Key'] when z % 7 = 0 then ['none'] else []::varchar[] end as params, case when z % 6 = 0 then ['POST /pay'] else []::varchar[] end as own_targets, case when z % 10 = 0 then ['GET /cart'] else []::varchar[] end as own_contexts,
    case when z % 8 = 0 then 'unknown' when z % 8 = 1 then 'derived_from_context_api' else 'stable_within_target_api' end as told_relation, case when z % 9 = 0 then 'unknown' else '' end as told_source,
    case when z % 11 = 0 then 'orderId 来源 不明' when z % 3 = 1 then 'none' else '' end as form from base
), steps as (
  select *, case z % 4 when 0 then []::varchar[] when 1 then [listing, call] when 2 then ['GET /list', 'normal_step_2', call] else [call] end as normal,
    case z % 3 when 0 then [call, 'GET /list', call] when 1 then [call] else []::varchar[] end as risky from told
), labelled as (
  select *, list_filter(list_concat(normal, risky), lambda x, i: list_position(list_concat(normal, risky), x) = i) as labels,
    list_filter(normal, lambda x: told_step <> '' and told_step <> '无法确定' and (contains(told_step, x) or contains(told_step, regexp_replace(x, '^[^ ]+ +', ''))))[1] as named from steps
), chosen as (
  select *, coalesce(named, list_filter(normal, lambda x: not list_contains(risky, x))[1]) as missing,
    list_sort(list_distinct(list_concat(list_transform(list_filter(list_concat(list_filter(normal, lambda x: x not like 'normal_step%'), risky), lambda x: {STEP}), lambda x: upper(split_part(x, ' ', 1)) || ' ' || split_part(x, ' ', 2)), own_targets, own_contexts, case when z % 3 = 0 then [up_call] else []::varchar[] end))) as related,
    list_distinct(list_filter(normal, lambda x: {STEP})) as dummy from labelled
), targeted as (
  select *, coalesce(case when missing is not null then risky[1] end, risky[len(risky)], normal[len(normal)]) as target, case when len(list_filter(risky, lambda x: x = call)) >= 2 then 'A' || list_position(labels, call) end as most,
    case when len(risky) > 0 then risky else normal end as chain, case when named is null and missing is not null then missing else told_step end as missing_label,
    list_transform(related, lambda x: case when x = up_call then 'POST /' || w0 || '/{{partId}}/' || w1 else x end) as documents from chosen
), worded as (
  select *, 'A' || list_position(labels, missing) as ms, coalesce('A' || list_position(labels, target), 'A_risk') as ts, list_filter(chain, lambda x, i: i >= len(chain) - 1) as lasts,
    concat_ws(chr(10), title, case when k % 2 = 0 then 'high' end, told_risk, nullif(reason, ''), nullif(raw_kind, ''), 'login area', array_to_string(list_transform(normal, lambda x: case when x = 'normal_step_2' then '' else x end), chr(10)), array_to_string(risky, chr(10)), 'listed first', nullif(told_step, ''),
      array_to_string(params, chr(10)), array_to_string(own_targets, chr(10)), array_to_string(own_contexts, chr(10)), case when z % 8 < 2 then told_relation end, nullif(told_source, ''), nullif(form, ''), case when z % 3 = 0 then concat_ws(chr(10), 'angle', call, 'ownerRole', 'itemId') end) as said from targeted
), tokens as (
  select *, list_filter(list_transform(regexp_extract_all(said, '[A-Za-z][A-Za-z0-9_/-]{{2,}}'), lambda x: lower(regexp_replace(x, '^/+|/+$', '', 'g'))), lambda x: x not in ('', 'get', 'post', 'put', 'patch', 'delete', 'api', 'jira', 'rest')) as whole from worded
), all_tokens as (
  select *, list_distinct(list_concat(whole, list_filter(flatten(list_transform(whole, lambda x: regexp_split_to_array(x, '[/_-]+'))), lambda x: length(x) >= 3), regexp_extract_all(said, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'))) as toks from tokens
), options as (
  select k, unnest(documents) as doc, generate_subscripts(documents, 1) as nth, toks, kind, said, w0, w1 from all_tokens
), texts as (
  select *, case when contains(doc, '{{partId}}') then doc || ' ' || w0 || ' ' || w1 || '  partId ' || w0 || 'Status token' else doc || '   ' end as body, contains(doc, '{{partId}}') as documented from options
), scored as (
  select *, coalesce(list_sum(list_transform(list_filter(toks, lambda x: contains(lower(body), lower(x))), lambda x: case when contains(x, '/') then 3 else 1 end)), 0)
    + case when kind = 'BOLA' and documented then 4 when kind = 'BFLA' and regexp_matches(body, '(admin|permission|role|config|workflow|scheme|manage|delete|project.?role)', 'i') then 5 when kind = 'BOPLA' and documented then 5
      when kind = 'AUTH_BYPASS' and regexp_matches(body, '(login|auth|session|cookie|token|xsrf|csrf|secure)', 'i') then 5 else 0 end
    + case when regexp_matches(said, '(attack|攻击|漏洞|枚举|篡改|绕过|越权|高危|直接调用)', 'i') and regexp_matches(lower(body), '(leader|admin|delete|permission|config|token|search|export)') then 2 else 0 end as score from texts
), selected as (
  select k, doc as api, documented from (select *, row_number() over (partition by k order by score desc, case when documented then 3 else 0 end desc, nth) as n from scored) where n = 1
), scoped as (
  select t.*, s.api, coalesce(s.documented, false) as documented, case when len(t.documents) > 0 then t.documents else list_filter(t.labels, lambda x: {STEP}) end as all_apis,
    case when len(list_filter(t.normal, lambda x: {STEP})) > 0 then list_filter(t.normal, lambda x, i: {STEP} and list_position(t.normal, x) = i) else list_filter(t.labels, lambda x: {STEP}) end as normal_apis from all_tokens t left join selected s on s.k = t.k
), split as (
  select *, case when len(all_apis) = 0 then []::varchar[] when len(list_filter(all_apis, lambda x: list_contains(normal_apis, x))) > 0 then list_filter(all_apis, lambda x: list_contains(normal_apis, x)) else all_apis[len(all_apis):len(all_apis)] end as ta from scoped
), around as (
  select *, list_filter(normal_apis[1:coalesce(list_min(list_filter(list_transform(ta, lambda x: list_position(normal_apis, x)), lambda n: n > 0)) - 1, len(normal_apis))], lambda x: not list_contains(ta, x)) as before from split
), filled as (
  select *, case when len(own_targets) > 0 then own_targets else ta end as targets, case when len(own_contexts) > 0 then own_contexts when len(all_apis) = 0 then []::varchar[] when len(before) = 0 and len(normal_apis) > 1 then list_filter(normal_apis, lambda x: not list_contains(ta, x)) else before end as contexts from around
), related_ as (
  select *, case when told_source <> '' then told_source when len(normal) > 0 then 'normal_sequence_context' when regexp_matches(form, '来源') then 'upstream_context' else 'same_api_context' end as source,
    case when told_relation <> 'unknown' then told_relation when len(contexts) > 0 then 'derived_from_context_api' when regexp_matches(form, '来源') then 'bound_to_upstream_context' else 'unknown' end as relation, case when len(targets) > 0 then targets else all_apis end as scope from filled
), judged as (
  select *, coalesce(told_risk, 'both') <> 'parameter_consistency' and len(labels) > 0 as has_seq,
    coalesce(told_risk, 'both') <> 'sequence_order' and (len(params) > 0 or form <> '' or len(own_targets) > 0 or len(own_contexts) > 0) and (len(params) > 0 or form not in ('', 'none')) and params <> ['none']
      and len(params) > 0 and len(scope) > 0 and not (relation = 'unknown' and source = 'unknown') and not (relation in ('derived_from_context_api', 'bound_to_upstream_context') and len(contexts) = 0) as has_par,
    lower(concat_ws(chr(10), told_risk, nullif(reason, ''), array_to_string(list_transform(normal, lambda x: case when x = 'normal_step_2' then '' else x end), chr(10)), array_to_string(risky, chr(10)), 'listed first', told_step, array_to_string(params, chr(10)), array_to_string(own_targets, chr(10)), array_to_string(own_contexts, chr(10)), case when z % 8 < 2 then told_relation end, told_source, form)) as coupled from related_
), clauses as (
  select *, has_seq and has_par and regexp_matches(coupled, 'both|两者|同时|(参数|id|key|project|issue|user|object|对象).{{0,20}}(前置|上下文|来源|继承|来自|绑定|跳过|缺失)|(前置|上下文|来源|继承|来自|绑定|跳过|缺失).{{0,20}}(参数|id|key|project|issue|user|object|对象)') as together,
    case when most is not null then 'CountInSession(s,' || most || ') ≥ 2' when missing is not null then 'Occurs(s,' || ts || ') ∧ RequiredBefore(' || ms || ',' || ts || ') ∧ ¬Before(s,' || ms || ',' || ts || ')'
      when len(chain) >= 2 then 'Occurs(s,A' || list_position(labels, lasts[1]) || ') ∧ Occurs(s,A' || list_position(labels, lasts[2]) || ') ∧ RiskyAdjacentOrder(s,A' || list_position(labels, lasts[1]) || ',A' || list_position(labels, lasts[2]) || ')'
      else 'Occurs(s,' || ts || ') ∧ SequenceOrderUncertain(s,' || ts || ')' end as sc,
    '{{' || array_to_string(list_transform(contexts, lambda x, i: 'C' || i), ',') || '}}' as cs, '{{' || array_to_string(list_transform(scope, lambda x, i: 'T' || i), ',') || '}}' as tset, '{{' || array_to_string(list_transform(params, lambda x, i: 'P' || i), ',') || '}}' as ps from judged
), formulas as (
  select *, 'ParameterFlowContext(s,' || cs || ',' || tset || ',' || ps || ',"' || relation || '") ∧ ParameterAppearsOrDerived(s,' || tset || ',' || ps || ') ∧ ¬ParameterConsistentWithContext(s,' || cs || ',' || tset || ',' || ps || ',"' || source || '")' as pc,
    '(s,"' || kind || '","' || level || '",' || {QUOTED.format('title')} || '))' as rated,
    list_filter([case when len(related) = 0 then 'related_apis' end, case when title = '' then 'scenario_title' end, case when reason = '' then 'overall_reason' end], lambda x: x is not null) as lacking from clauses
), ready as (
  select *, case when len(lacking) > 0 then lacking when coalesce(told_risk, 'both') <> 'parameter_consistency' and len(labels) = 0 then ['activity_abstraction'] else []::varchar[] end as missing_list from formulas
)
select 'FOL-' || case when k % 19 = 0 then 'own-' || k else 'C' || k || '-S1' end as fol_id, case when len(missing_list) = 0 then 'generated' else 'skipped' end as status, array_to_string(missing_list, ',') as missing, array_to_string(related, ',') as related,
  array_to_string(documents[1:5], ',') as documents, kind as security_type, coalesce(api, '') as api, 'login area' as target_asset, level as risk_level, coalesce(told_risk, 'both') as risk_type,
  case when documented then 'partId' when z % 3 = 0 then 'itemId' else '' end as object_field, case when documented then w0 || 'Status' when z % 3 = 0 then 'ownerRole' else '' end as sensitive_field, case when documented and length(w1) % 2 = 0 then 'token' else 'authenticated_session' end as auth_field,
  array_to_string(list_transform(labels, lambda x, i: 'A' || i || '=' || x), ',') as activities, missing_label,
  case when len(missing_list) > 0 then '' else array_to_string(list_filter([
    case when together then '∀s ((' || sc || ' ∧ ' || pc || ') → RatedCombinedSequenceParameterRisk' || rated end, case when has_seq and not together then '∀s (' || sc || ' → RatedSequenceOrderRisk' || rated end,
    case when has_par and not together then '∀s (' || pc || ' → RatedParameterRisk' || rated end], lambda x: x is not null), ' | ') end as formulas,
  case when has_par and len(missing_list) = 0 then array_to_string(scope, ',') else '' end as targets, case when has_par and len(missing_list) = 0 then array_to_string(contexts, ',') else '' end as contexts, case when has_par and len(missing_list) = 0 then relation else '' end as relation, case when has_par and len(missing_list) = 0 then source else '' end as expected_source,
  case when has_par and len(missing_list) = 0 then array_to_string(case when len(normal_apis) > 0 then normal_apis else all_apis end, ',') else '' end as normal_order,
  case when has_par and len(missing_list) = 0 then array_to_string(flatten(list_transform(params, lambda p: list_concat(list_transform(contexts, lambda a: p || '@' || a || '@context_source'), list_transform(targets, lambda a: p || '@' || a || '@target_parameter')))), ',') else '' end as occurrences,
  case when has_par and len(missing_list) = 0 then array_to_string(flatten(list_transform(params, lambda p: flatten(list_transform(contexts, lambda c: list_transform(targets, lambda t: c || '>' || t || '>' || p))))), ',') else '' end as bindings
from ready
"""

OPENAPI = f"""with {PAGE.strip()}, named as (
  select *, {TEMPLATE.format().replace("shaped", "segments")} as template from (select *, list_filter(string_split(path, '/'), lambda p: p <> '') as segments from shaped)
), pair as (
  select site_id, path, template, page_id, pairs[i].name as param, pairs[i].value as value, i from (select *, unnest(range(1, len(pairs) + 1)) as i from named)
), one as (
  select site_id, path, template, param, page_id, count(*) as pairs, arg_max({kind('value')}, i) as type from pair group by all
), kinds as (
  select *, row_number() over (partition by site_id, path, param order by n desc, seen, type) as nth from (select site_id, path, param, type, count(*) as n, min(page_id) as seen from one group by all)
), total as (
  select site_id, path, count(*) as requests from named group by all
), entry as (
  select o.site_id, o.path, any_value(template) as template, o.param, sum(pairs) as n, round(count(*) / any_value(requests), 4) as ratio, any_value(k.type) as type
  from one o join total t on t.site_id = o.site_id and t.path = o.path join kinds k on k.site_id = o.site_id and k.path = o.path and k.param = o.param and k.nth = 1 group by o.site_id, o.path, o.param
), shown as (
  select *, '{{"name":' || to_json(param)::varchar || ',"in":"query","required":' || case when ratio >= 1 then 'true' else 'false' end || ',"schema":{{"type":"' ||
    case type when 'INT' then 'integer' when 'FLOAT' then 'number' when 'BOOL' then 'boolean' when 'ARRAY' then 'array' when 'LIST' then 'array' when 'JSON' then 'object' else 'string' end || '"}}}}' as shape from entry
)
select site_id, template, '{{"get":{{"summary":"GET ' || template || '","operationId":"get' || regexp_replace(template, '[^A-Za-z0-9]+', '_', 'g') || '","parameters":[' || string_agg(shape, ',' order by ratio desc, n desc, param) || ']}}}}' as item
from shown group by site_id, template
"""

SHAPES = f"""
with recursive made as (
  select 's' || (c_custkey % 5) as site_id, c_custkey as k, '{{"type":"object","required":["user","n' || c_custkey || '"],"properties":{{"user":{{"type":"object","required":["ownerId"],"properties":{{"ownerId":{{"type":"string"}},"role":{{"properties":{{"level":{{"type":"integer"}}}}}}}}}},"n' || c_custkey || '":{{"type":"number"}},"plain":{{}}}}}}' as nested from customer
), ops as (
  select *, case k % 6
    when 0 then '{{"summary":"s' || k || '","operationId":"o' || k || '","parameters":[{{"name":"id' || k || '","in":"path","required":true,"schema":{{"type":"integer"}}}},{{"in":"query"}},{{"name":"token","in":"header"}}]}}'
    when 1 then '{{"parameters":[],"requestBody":{{"content":{{"application/json":{{"schema":' || nested || '}},"text/x-form":{{"schema":{{"properties":{{"status":{{"type":"string"}}}}}}}},"a/b":{{}}}}}}}}'
    when 2 then '{{"requestBody":{{"required":true,"content":{{"application/json":{{"schema":' || nested || '}}}}}}}}' when 3 then '{{"summary":"none"}}' when 4 then '{{"parameters":{{"name":"x"}},"requestBody":{{"content":[1]}}}}' else '"no object"' end as op from made
), docs as (
  select site_id, k, ('{{"paths":{{"/c/' || k || '/{{id}}":{{"' || ['get', 'POST', 'x-note', 'delete'][k % 4 + 1] || '":' || op || ',"parameters":[]}},"/odd":[1]}}}}')::json as doc from ops where k % 11 <> 0
), paths as (
  select site_id, k, p, json_extract(doc, '$.paths."' || p || '"') as item from (select *, unnest(json_keys(doc, '$.paths')) as p from docs)
), entries as (
  select site_id, k, p, m, json_extract(item, '$."' || m || '"') as op from (select *, unnest(json_keys(item)) as m from paths where json_type(item) = 'OBJECT')
), operations as (
  select row_number() over () as id, site_id, upper(m) || ' ' || p as api, op from entries where lower(m) in ('get', 'put', 'post', 'delete', 'patch', 'head', 'options') and json_type(op) = 'OBJECT'
), listed as (
  select id, [0, i] as place, x->>'name' as name, coalesce(x->>'in', '') as kind, coalesce((x->>'required')::boolean, false) as required, coalesce(x->'schema'->>'type', 'unknown') as type
  from (select id, unnest(range(0, json_array_length(op, '$.parameters')::bigint)) as i, op from operations where json_type(op, '$.parameters') = 'ARRAY'), lateral (select json_extract(op, '$.parameters[' || i || ']') as x)
), media as (
  select id, i, json_extract(op, '$.requestBody.content."' || json_keys(op, '$.requestBody.content')[i] || '".schema') as body from (select *, unnest(range(1, len(json_keys(op, '$.requestBody.content')) + 1)) as i from operations where json_type(op, '$.requestBody.content') = 'OBJECT')
), walk as (
  select id, [1, i] as place, '' as name, body, false as required from media where json_type(body) = 'OBJECT'
  union all
  select id, list_append(place, i), case when name = '' then keys[i] else name || '.' || keys[i] end, json_extract(body, '$.properties."' || keys[i] || '"'), list_contains(coalesce(from_json(json_extract(body, '$.required'), '["varchar"]'), []::varchar[]), keys[i])
  from (select *, json_keys(body, '$.properties') as keys, unnest(range(1, len(json_keys(body, '$.properties')) + 1)) as i from walk where json_type(body, '$.properties') = 'OBJECT')
), fields as (
  select id, place, name, kind, required, type from listed where name <> ''
  union all select id, place, name, 'body', required, coalesce(body->>'type', 'unknown') from walk where name <> ''
), grouped as (
  select id, list(name order by place) as names, string_agg(name || ':' || kind || ':' || required || ':' || type, ',' order by place) as parameters from fields group by id
)
select site_id, api, coalesce(op->>'summary', '') as summary, coalesce(op->>'operationId', '') as operation_id, coalesce(parameters, '') as parameters,
  {", ".join(f"coalesce(array_to_string(list_filter(names, lambda x: regexp_matches(x, '{pattern}', 'i')), ','), '') as {name}" for name, pattern in (("object_parameters", OBJECT), ("sensitive_fields", SENSITIVE), ("auth_fields", "(login|auth|session|cookie|token|xsrf|csrf|secure)")))}
from operations o left join grouped g on g.id = o.id
"""

LINES = f"""select '- **' || fol_id || '** ' || p_name || case when p_partkey % 17 = 0 then ' "x\y"' else '' end || ': `' || formula || '`' as value
from (select *, unnest(string_split(formulas, ' | ')) as formula from ({RULES}) where formulas <> '') r join part on p_partkey = regexp_extract(fol_id, '[0-9]+')::bigint
"""

SQL = {"rule_lines": LINES, "openapi_shapes": SHAPES, "documented_calls": DOCUMENTED, "review_rules": RULES, "openapi_paths": OPENAPI}
