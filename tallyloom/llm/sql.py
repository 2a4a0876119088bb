"""DuckDB SQL with the results of the subpackage's queries, where SQL can express them."""

from __future__ import annotations

from tallyloom.llm.conversations import INBOUND, OUTBOUND
from tallyloom.llm.survivor import FILLERS


def _list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_GROUPS = """
WITH RECURSIVE e AS (
  SELECT lead_id AS a, owner_lead_id AS b FROM lead_identity_conflicts WHERE lead_id <> owner_lead_id
  UNION SELECT owner_lead_id, lead_id FROM lead_identity_conflicts WHERE lead_id <> owner_lead_id
), r AS (
  SELECT a AS n, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n
), g AS (SELECT n AS lead_id, min(m) AS group_id FROM r GROUP BY n)
"""

_MESSAGES = rf"""
c AS (
  SELECT conversation_id, coalesce(provider_message_id, 'row:' || id) AS mid, fetched_at, id,
         CASE WHEN lower(regexp_replace(direction, '^\s+|\s+$', '', 'g')) IN ({_list(OUTBOUND)}) THEN 'operator'
              WHEN lower(regexp_replace(direction, '^\s+|\s+$', '', 'g')) IN ({_list(INBOUND)}) THEN 'lead' END AS role,
         CASE WHEN year(sent_at) > 1970 THEN sent_at END AS sent,
         CASE WHEN regexp_matches(body, '[^\s\p{{Z}}\p{{Cc}}\p{{Cf}}]') THEN body END AS body
  FROM lead_messages WHERE conversation_id IS NOT NULL
), m AS (
  SELECT conversation_id, mid,
         (list(role ORDER BY fetched_at, id) FILTER (role IS NOT NULL))[1] AS role,
         (list(sent ORDER BY fetched_at, id) FILTER (sent IS NOT NULL))[1] AS sent,
         (list(body ORDER BY fetched_at, id) FILTER (body IS NOT NULL))[1] AS body
  FROM c GROUP BY ALL
), o AS (
  SELECT *, lag(sent) OVER w AS prev, row_number() OVER w AS n, (epoch_us(sent) - epoch_us(lag(sent) OVER w)) / 1e6 AS gap
  FROM m WHERE body IS NOT NULL WINDOW w AS (PARTITION BY conversation_id ORDER BY sent IS NOT NULL, sent, mid)
), h AS (
  SELECT CAST(floor(log2(gap) * 2) AS BIGINT) AS b, count(*) AS n FROM o WHERE gap > 0 GROUP BY 1
), s AS (
  SELECT b, sum(n) OVER (ORDER BY b) AS w, sum(b * n) OVER (ORDER BY b) AS m, sum(n) OVER () AS total, sum(b * n) OVER () AS mass FROM h
), l AS (
  SELECT coalesce((SELECT greatest(3600, pow(2, (b + 1) / 2.0)) FROM s WHERE w < total ORDER BY pow(mass * w / CAST(total AS DOUBLE) - m, 2) / (w * CAST(total - w AS DOUBLE)) DESC, b LIMIT 1), 'infinity'::DOUBLE) AS most
), t AS (
  SELECT *, last_value(CASE WHEN o.n = 1 OR prev IS NULL OR gap > most THEN sent END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY sent IS NOT NULL, sent, mid ROWS UNBOUNDED PRECEDING) AS session_at
  FROM o CROSS JOIN l
), z AS (
  SELECT conversation_id, session_at, count(*) AS n_messages, count(*) FILTER (role = 'operator') AS by_operator, count(*) FILTER (role = 'lead') AS by_lead, count(*) FILTER (role IS NULL) AS n_no_role,
         max(sent) AS last_at, (list(role ORDER BY sent DESC NULLS LAST, mid DESC))[1] AS last_role
  FROM t GROUP BY ALL
)"""

SQL = {
    "p5_sessions": f"WITH {_MESSAGES} SELECT *, session_at IS NOT NULL AND n_no_role = 0 AND by_operator > 0 AND by_lead > 0 AS reciprocal FROM z",
    "p5_conversations": f"""WITH {_MESSAGES}, k AS (
  SELECT conversation_id FROM z GROUP BY 1 HAVING sum(n_no_role) = 0 AND bool_and(session_at IS NOT NULL) AND sum(by_operator) > 0 AND sum(by_lead) > 0 AND arg_max(last_role, session_at) <> 'lead')
SELECT conversation_id, session_at, sent AS at, mid AS message_id, role, body FROM t WHERE conversation_id IN (SELECT conversation_id FROM k)""",
    "p3_found": _GROUPS + "SELECT lead_id, group_id FROM g",
    "p3_group_sizes": _GROUPS + "SELECT group_id, count(*) AS n_leads FROM g GROUP BY group_id",
    "p4_found": rf"""
WITH RECURSIVE t AS (
  SELECT id, id AS root FROM leads WHERE merged_into IS NULL
  UNION SELECT l.id, t.root FROM leads l JOIN t ON l.merged_into = t.id
), m AS (
  SELECT t.root, l.* FROM t JOIN leads l USING (id) WHERE t.root IN (SELECT root FROM t WHERE id <> root)
), v AS (
  SELECT root, 'current_title' AS field_name, id, updated_at, created_at, current_title AS v FROM m
  UNION ALL SELECT root, 'current_company', id, updated_at, created_at, current_company FROM m
  UNION ALL SELECT root, 'linkedin_url', id, updated_at, created_at, linkedin_url FROM m
), k AS (
  SELECT *, lower(regexp_replace(v, '^\s+|\s+$', '', 'g')) AS c FROM v WHERE v IS NOT NULL
), ok AS (
  SELECT *, row_number() OVER (PARTITION BY root, field_name ORDER BY updated_at DESC, created_at DESC, id DESC) AS n FROM k
  WHERE CASE WHEN field_name = 'linkedin_url'
             THEN regexp_matches(trim(v), '(?i)^(?:https?://)?(?:[a-z0-9-]+\.)*linkedin\.[a-z.]+/(?:in|pub)/[^/?#\s]+')
             ELSE regexp_matches(c, '[\p{{L}}\p{{N}}]') AND c NOT IN ({_list(FILLERS)}) END
)
SELECT root AS keeper_id, field_name, id AS lead_id FROM ok WHERE n = 1""",
    "p5_found": rf"""
WITH c AS (
  SELECT conversation_id, coalesce(provider_message_id, 'row:' || id) AS mid, fetched_at, id,
         CASE WHEN lower(regexp_replace(direction, '^\s+|\s+$', '', 'g')) IN ({_list(OUTBOUND)}) THEN 'operator'
              WHEN lower(regexp_replace(direction, '^\s+|\s+$', '', 'g')) IN ({_list(INBOUND)}) THEN 'lead' END AS role,
         CASE WHEN year(sent_at) > 1970 THEN sent_at END AS sent,
         CASE WHEN regexp_matches(body, '[^\s\p{{Z}}\p{{Cc}}\p{{Cf}}]') THEN body END AS body
  FROM lead_messages WHERE conversation_id IS NOT NULL
), m AS (
  SELECT conversation_id, mid,
         (list(role ORDER BY fetched_at, id) FILTER (role IS NOT NULL))[1] AS role,
         (list(sent ORDER BY fetched_at, id) FILTER (sent IS NOT NULL))[1] AS sent,
         (list(body ORDER BY fetched_at, id) FILTER (body IS NOT NULL))[1] AS body
  FROM c GROUP BY ALL
), v AS (
  SELECT conversation_id, count(*) FILTER (body IS NOT NULL) AS n,
         count(*) FILTER (body IS NOT NULL AND (role IS NULL OR sent IS NULL)) AS bad,
         count(DISTINCT role) FILTER (body IS NOT NULL) AS sides,
         (list(role ORDER BY sent DESC, mid DESC) FILTER (body IS NOT NULL))[1] AS last_role
  FROM m GROUP BY conversation_id
)
SELECT conversation_id FROM v WHERE n = 0 OR bad > 0 OR sides < 2 OR last_role = 'lead'""",
}
