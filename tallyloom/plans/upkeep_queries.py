"""Queries over the upkeep pipelines, each with SQL written from its definition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import urls as U
from tallyloom.operators import identity
from tallyloom.operators.components import shared_key_groups
from tallyloom.plans import upkeep, views
from tallyloom.plans.domain import SQL as DOMAIN_SQL
from tallyloom.plans.roles import Roles, with_roles

AS_OF = "2026-01-01 00:00:00"
CUT = "2025-06-01 00:00:00"
_HANDLE = r"lower(nullif(regexp_extract(linkedin_url, '/in/([A-Za-z0-9_\-]+)', 1), ''))"


def filtered_by_text(r: Roles) -> DataFrame:
    return upkeep.where_text(r["leads"], "score > 5000 AND persona IN ('BUILDING', 'MACHINERY')").select("id", "persona", "score")


def held_members_by_status(r: Roles) -> DataFrame:
    return upkeep.count_where_exists(r["campaign_members"], ["status"], "lead_id", r["star_tags"].where("tag = 'error'"), "held")


def repaired_names(r: Roles) -> DataFrame:
    """The stored answers are what rows folded into another lead say."""
    leads = r.raw("leads")
    calls = leads.where("merged_into is not null").select("id", F.col("merged_into").alias("lead_id"), F.coalesce("linkedin_url", F.lit("")).alias("params"), F.to_json(F.struct(F.struct(F.col("name").alias("full_name")).alias("data"))).alias("response"), F.col("name").isNotNull().alias("success"), F.col("updated_at").alias("fetched_at"))
    return upkeep.repaired_names(leads.where("merged_into is null"), calls)


def size_targets(r: Roles) -> DataFrame:
    return upkeep.size_targets(r.raw("leads"), r.raw("lead_tags"), r.raw("companies").withColumnRenamed("created_at", "size_fetched_at"), AS_OF, 365)


def refresh_list(r: Roles) -> DataFrame:
    t = r["star_tags"]
    return upkeep.refresh_list(t, "click", r["signals"], "view", r["signals"].where("enricher_name = 'error' AND value > 80")).select("lead_id", "id", "value", "payload")


def member_index(r: Roles) -> DataFrame:
    leads = r.raw("leads")
    own = leads.where("linkedin_urn is not null").select(F.lit("linkedin_urn").alias("kind"), F.col("linkedin_urn").alias("value"), F.col("id").alias("lead_id"))
    return upkeep.member_index(own, leads)


def _identity_rows(r: Roles) -> DataFrame:
    """Each lead's tokens as identities: the search form under its own kind, the member's own marked as primary."""
    leads = r.raw("leads")
    each = F.array(F.struct(F.col("linkedin_urn").alias("value"), F.lit(False).alias("is_primary")), F.struct(F.col("member_urn").alias("value"), F.lit(True).alias("is_primary")))
    i = leads.select(F.coalesce("merged_into", "id").alias("lead_id"), "created_at", F.explode(each).alias("e")).select("lead_id", "created_at", "e.*").where("value is not null")
    return i.withColumn("kind", F.when(F.col("value").startswith("ACwAA"), "linkedin_urn_search").otherwise("linkedin_urn"))


def member_ids_by_lead(r: Roles) -> DataFrame:
    return identity.member_ids(_identity_rows(r), ["linkedin_urn", "linkedin_urn_search"])


def post_touches(r: Roles) -> DataFrame:
    """A poster's own posts as touches; the time is the post's, else the one in its key."""
    leads, posts = r.raw("leads"), r.raw("posts")
    index = leads.select(F.col("id").alias("value"), F.col("id").alias("lead_id"))
    e = posts.where("poster_lead_id is not null").select(F.col("poster_lead_id").alias("member_id"), F.lit(None).cast("timestamp_ntz").alias("at"), F.col("post_urn").alias("post_key"), F.lit("outbound").alias("direction"), F.lit("post").alias("kind"), F.lit("walk").alias("source"), F.col("post_urn").alias("external_id"))
    out = upkeep.touches(e, posts.select(F.col("post_urn").alias("post_key"), "posted_at"), index)
    return out.select("lead_id", "external_id", F.date_format("touched_at", "yyyy-MM-dd HH:mm:ss").alias("touched"))


def short_committees(r: Roles) -> DataFrame:
    m = r["leads"].select(F.col("company_id").alias("company"), F.col("id").alias("lead_id"), F.col("persona").alias("seed"))
    return upkeep.short_committees(m, r["star_tags"].where("tag = 'error'"), 40)


def curated_posters(r: Roles) -> DataFrame:
    leads = r["leads"]
    return upkeep.curated_posters(leads, r["companies"].where("country < 12"), leads.where("score > 9000").select(F.col("id").alias("lead_id"), "company_id"), r["star_tags"].where("tag = 'click'"))


def event_report(r: Roles) -> DataFrame:
    m = r["memberships"].withColumn("last_seen_at", F.col("id"))
    return upkeep.event_report(r["collectives"].where("kind = 'event'").select("id", "name"), m, "host")


_GUEST_WORDS = {"f": "approved", "o": "pending"}


def _guest_rows(r: Roles) -> tuple[DataFrame, DataFrame]:
    s = r["lead_sources"].select("id", "lead_id", F.col("source_type").alias("event_id"), F.col("source_label").alias("status"), (F.col("source_label") == "F").alias("attended"), "recorded_at")
    l = r["leads"].withColumn("merged_into", F.when(F.col("id") % 9 == 0, F.col("id") + 1))
    i = l.where("id % 4 <> 0").select(F.col("id").alias("lead_id"), F.lit("linkedin_url").alias("kind"), F.col("linkedin_url").alias("value"))
    return upkeep.guest_memberships(s, l, i, _GUEST_WORDS)


def guest_memberships(r: Roles) -> DataFrame:
    return _guest_rows(r)[0].select("collective_id", "lead_id", "member_value", "application", "attended", "source_status")


def unknown_guest_words(r: Roles) -> DataFrame:
    return _guest_rows(r)[1]


def join_requests(r: Roles) -> DataFrame:
    s = r.raw("customer").join(r.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("lead_id"), F.col("n_name").alias("group_name"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("030 555-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))).alias("phone"), F.col("c_acctbal").alias("requested_at"))
    l = r["leads"].withColumn("merged_into", F.when(F.col("id") % 9 == 0, F.col("id") + 1))
    return upkeep.join_requests(s, l, r["collectives"])


def tag_memberships(r: Roles) -> DataFrame:
    l = r["leads"].withColumn("merged_into", F.when(F.col("id") % 9 == 0, F.col("id") + 1))
    i = l.where("id % 4 <> 0").select(F.col("id").alias("lead_id"), F.lit("linkedin_url").alias("kind"), F.col("linkedin_url").alias("value"))
    m = r["memberships"].select(F.col("collective_id").cast("string").alias("collective_id"), F.col("id").alias("lead_id"), "member_kind", "member_value")
    return upkeep.tag_memberships(r["star_tags"], "click", l, i, "7", m).select("collective_id", "lead_id", "member_kind", "member_value")


def deal_company_links(r: Roles) -> DataFrame:
    """Deals known by a page (those of leads) or by a domain (one for each company's site)."""
    a = r.raw("leads").select(F.concat(F.lit("l:"), "id").alias("deal_id"), F.col("current_company_url").alias("page"), F.lit(None).cast("string").alias("domain"))
    b = r.raw("companies").select(F.concat(F.lit("c:"), "id").alias("deal_id"), F.lit(None).cast("string").alias("page"), F.col("website").alias("domain"))
    return upkeep.deal_companies(a.unionAll(b), r.raw("companies")).select("deal_id", "match_slug", "match_domain", "company_id")


def reply_tags(r: Roles) -> DataFrame:
    m = r.raw("lead_messages").select(F.col("conversation_id").alias("lead_id"), "provider_message_id", "sent_at", "fetched_at", F.when(F.lower(F.trim("direction")) == "inbound", "lead").alias("role"))
    cut = F.to_timestamp_ntz(F.lit(CUT))
    tags = m.where("false").select("lead_id", F.lit("x").alias("tag"))
    members = m.where("false").select("lead_id", F.lit("x").alias("status"), F.col("sent_at").alias("last_status_at"))
    return upkeep.message_effects(m.where(F.col("fetched_at") >= cut), m.where(F.col("fetched_at") < cut), tags, members)[0]


def findings_once(r: Roles) -> DataFrame:
    c = r.raw("lead_identity_conflicts")
    keys = ["lead_id", "owner_lead_id", "kind", "value"]
    old = c.where("resolved_by_merge is not null").select(*keys).distinct()
    return upkeep.recorded_once(old, c.where("resolved_by_merge is null"), keys, keys)


def token_backfill(r: Roles) -> DataFrame:
    leads = r.raw("leads")
    return upkeep.token_backfill(leads.select(F.col("id").alias("lead_id"), F.col("linkedin_urn").alias("token")), leads)[0]


def token_duplicates(r: Roles) -> DataFrame:
    leads = r.raw("leads")
    return upkeep.token_backfill(leads.select(F.col("id").alias("lead_id"), F.col("linkedin_urn").alias("token")), leads)[1]


def conflicts_backfilled(r: Roles) -> DataFrame:
    leads = r.raw("leads")
    return upkeep.conflicts_backfilled(leads, leads.where("member_urn is not null").select(F.lit("linkedin_urn").alias("kind"), F.col("member_urn").alias("value"), F.col("id").alias("lead_id")))


def rewritten_urls(r: Roles) -> DataFrame:
    return upkeep.rewritten(r.raw("leads").select("id", "linkedin_url"), {"linkedin_url": U.profile_url(F.col("linkedin_url"))}).select("id", "old", "new")


def related_companies(r: Roles) -> DataFrame:
    rel = r["companies"].select(F.col("id").alias("company_id"), F.when(F.col("id") % 3 == 0, "competitor").otherwise("partner").alias("relationship"), F.concat(F.lit("scope-"), F.col("country")).alias("scope"), F.col("country").alias("recorded_at"))
    return views.related_companies(r["companies"], rel, "competitor").select("id", "name", "linkedin_slug", "linkedin_url", "scope", "recorded_at")


def usage_costs(r: Roles) -> DataFrame:
    c = r["enrichment_calls"]
    usage = c.groupBy("api").agg(F.count("*").alias("calls"), F.count_if("success").alias("successes"))
    return upkeep.usage_costs(usage, c.where("success").select("api", F.col("cost").alias("price"), F.col("fetched_at").alias("seen_at"), "id"), ["api"]).withColumn("est_cost", F.round("est_cost", 2))


def backfill_state(r: Roles) -> DataFrame:
    """Events of small value as what was read before, the others as what came now."""
    e = r.raw("events")
    state = lambda df: df.groupBy("user_id").agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest"), F.bool_or(F.col("event_type") == "purchase").alias("complete"))
    early = F.col("value") < 50
    return upkeep.backfill_state(state(e.where(early)), state(e.where(~early)), "user_id")


def token_groups(r: Roles) -> DataFrame:
    """Leads under one member token or one e-mail address, directly or through others."""
    return shared_key_groups(r.raw("leads"), "id", ["linkedin_urn", "email"])


QUERIES = {f.__name__: f for f in (
    filtered_by_text, held_members_by_status, repaired_names, size_targets, refresh_list, member_index, member_ids_by_lead, post_touches, short_committees, curated_posters, event_report, guest_memberships, unknown_guest_words, join_requests, tag_memberships,
    deal_company_links, reply_tags, findings_once, token_backfill, token_duplicates, conflicts_backfilled, rewritten_urls, related_companies, token_groups, usage_costs, backfill_state,
)}

_URL_KEY = "regexp_replace(lower({0}), '/+$', '')"
_SLUG = r"coalesce(lower(nullif(regexp_extract({0}, '(?i)/company/([A-Za-z0-9_\-]+)', 1), '')), '')"
_GUESTS = """s AS (SELECT s.id, lead_id, source_type AS event_id, lower(trim(source_label)) AS word, CASE lower(trim(source_label)) WHEN 'f' THEN 'approved' WHEN 'o' THEN 'pending' END AS application, source_label = 'F' AS attended, recorded_at FROM r_lead_sources s JOIN r_leads l ON l.id = s.lead_id WHERE l.id % 9 <> 0)"""
_SITE = r"regexp_replace(lower(coalesce(website, '')), '^https?://(www\.)?', '')"

SQL = {k: with_roles(v) for k, v in {
    "filtered_by_text": "SELECT id, persona, score FROM r_leads WHERE score > 5000 AND persona IN ('BUILDING', 'MACHINERY')",
    "held_members_by_status": "SELECT status, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM r_star_tags t WHERE t.tag = 'error' AND t.lead_id = m.lead_id)) AS held FROM r_campaign_members m GROUP BY status",
    "repaired_names": rf"""WITH c AS (SELECT id AS call_id, merged_into AS lead_id, {_HANDLE} AS handle, trim(name) AS found_name, updated_at AS fetched_at FROM leads WHERE merged_into IS NOT NULL AND trim(name) <> '' AND NOT regexp_matches(name, '(^|\s)None(\s|$)')),
        l AS (SELECT id AS lead_id, {_HANDLE} AS handle FROM leads WHERE merged_into IS NULL),
        m AS (SELECT l.lead_id, call_id, found_name, fetched_at FROM c JOIN l ON c.lead_id = l.lead_id UNION ALL SELECT l.lead_id, call_id, found_name, fetched_at FROM c JOIN l ON c.handle = l.handle)
        SELECT lead_id, found_name, call_id FROM m QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY fetched_at DESC, call_id DESC) = 1""",
    "size_targets": f"SELECT DISTINCT current_company_url FROM leads WHERE current_company_url <> '' AND id IN (SELECT lead_id FROM lead_tags) AND {_SLUG.format('current_company_url')} NOT IN (SELECT {_SLUG.format('linkedin_url')} FROM companies WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AND {_SLUG.format('linkedin_url')} <> '')",
    "refresh_list": "SELECT lead_id, id, value, payload FROM r_signals WHERE enricher_name = 'view' AND lead_id IN (SELECT lead_id FROM r_star_tags WHERE tag = 'click') AND lead_id NOT IN (SELECT lead_id FROM r_signals WHERE enricher_name = 'error' AND value > 80 AND lead_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY enriched_at DESC, id DESC) = 1",
    "member_index": "WITH a AS (SELECT linkedin_urn AS value, coalesce(merged_into, id) AS lead_id, 0 AS rank FROM leads WHERE linkedin_urn IS NOT NULL UNION ALL SELECT member_urn, id, 1 FROM leads WHERE member_urn IS NOT NULL AND merged_into IS NULL) SELECT value, lead_id FROM a QUALIFY row_number() OVER (PARTITION BY value ORDER BY rank, lead_id) = 1",
    "member_ids_by_lead": "WITH i AS (SELECT coalesce(merged_into, id) AS lead_id, created_at, linkedin_urn AS value, false AS is_primary FROM leads WHERE linkedin_urn IS NOT NULL UNION ALL SELECT coalesce(merged_into, id), created_at, member_urn, true FROM leads WHERE member_urn IS NOT NULL) SELECT lead_id, value FROM i QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY value LIKE 'ACoAA%' DESC, value NOT LIKE 'ACwAA%' DESC, is_primary DESC, created_at, value) = 1",
    "post_touches": r"""WITH t AS (SELECT p.poster_lead_id AS lead_id, p.post_urn AS external_id, coalesce(min(q.posted_at), make_timestamp((CAST(nullif(regexp_extract(p.post_urn, '([0-9]{18,19})\D*$', 1), '') AS BIGINT) >> 22) * 1000)) AS made
        FROM posts p JOIN posts q ON q.post_urn = p.post_urn WHERE p.poster_lead_id IN (SELECT id FROM leads) GROUP BY p.id, 1, 2)
        SELECT lead_id, external_id, strftime(made, '%Y-%m-%d %H:%M:%S') AS touched FROM t QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY made IS NULL, made, lead_id) = 1""",
    "short_committees": "SELECT company_id AS company, count(*) FILTER (NOT held) AS live, count(*) AS total FROM (SELECT *, id IN (SELECT lead_id FROM r_star_tags WHERE tag = 'error') AS held FROM r_leads) GROUP BY 1 HAVING count(*) FILTER (NOT held) BETWEEN 1 AND 39",
    "curated_posters": f"SELECT l.id AS lead_id, c.id AS company_id FROM r_leads l JOIN r_companies c ON c.id = l.company_id WHERE c.country < 12 AND l.score > 9000 UNION SELECT l.id, c.id FROM r_leads l JOIN r_companies c ON {_URL_KEY.format('l.current_company_url')} = {_URL_KEY.format('c.linkedin_url')} WHERE c.country < 12 AND l.id IN (SELECT lead_id FROM r_star_tags WHERE tag = 'click')",
    "event_report": "SELECT c.id, c.name, count(m.id) AS people, count(m.id) FILTER (m.role = 'host') AS in_role, max(m.id) AS last_seen_at FROM r_collectives c LEFT JOIN r_memberships m ON m.collective_id = c.id WHERE c.kind = 'event' GROUP BY ALL",
    "guest_memberships": f"WITH {_GUESTS}, w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY event_id, lead_id ORDER BY recorded_at DESC, id DESC) = 1) SELECT event_id AS collective_id, lead_id, linkedin_url AS member_value, application, CASE WHEN attended THEN true END AS attended, word AS source_status FROM w JOIN r_leads l ON l.id = w.lead_id WHERE l.id % 4 <> 0",
    "unknown_guest_words": f"WITH {_GUESTS} SELECT word, count(*) AS n FROM s WHERE application IS NULL GROUP BY word",
    "join_requests": "SELECT g.id AS collective_id, c_custkey AS lead_id, '+030555' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS member_value, c_acctbal AS first_seen_at FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN r_collectives g ON g.name = n_name WHERE g.kind = 'group' AND c_custkey % 3 <> 0 AND c_custkey % 9 <> 0",
    "tag_memberships": "SELECT '7' AS collective_id, t.lead_id, coalesce(m.member_kind, 'linkedin_url') AS member_kind, coalesce(m.member_value, l.linkedin_url) AS member_value FROM r_star_tags t JOIN r_leads l ON l.id = t.lead_id LEFT JOIN r_memberships m ON m.collective_id = 7 AND m.id = l.id WHERE t.tag = 'click' AND l.id % 9 <> 0 AND l.id % 4 <> 0",
    "deal_company_links": rf"""WITH d AS (SELECT 'l:' || id AS deal_id, lower(nullif(regexp_extract(current_company_url, '(?i)linkedin\.[a-z.]+/company/([^/?#]+)', 1), '')) AS match_slug, NULL AS match_domain FROM leads
        UNION ALL SELECT 'c:' || id, NULL, nullif(split_part(regexp_replace(regexp_replace(lower(website), '^https?://', ''), '^www\.', ''), '/', 1), '') FROM companies)
        SELECT deal_id, match_slug, match_domain, coalesce((SELECT min(id) FROM companies c WHERE lower(c.linkedin_slug) = d.match_slug), (SELECT min(id) FROM companies c WHERE starts_with({_SITE}, d.match_domain))) AS company_id FROM d""",
    "reply_tags": f"SELECT conversation_id AS lead_id, 'they:replied' AS tag, min(sent_at) AS tagged_at FROM lead_messages WHERE fetched_at >= TIMESTAMP '{CUT}' AND lower(trim(direction)) = 'inbound' AND conversation_id IS NOT NULL AND provider_message_id NOT IN (SELECT provider_message_id FROM lead_messages WHERE fetched_at < TIMESTAMP '{CUT}' AND provider_message_id IS NOT NULL) GROUP BY 1",
    "findings_once": "SELECT DISTINCT lead_id, owner_lead_id, kind, value FROM lead_identity_conflicts",
    "token_backfill": "SELECT min(id) AS lead_id, linkedin_urn AS member_urn FROM leads WHERE member_urn IS NULL AND trim(linkedin_urn) <> '' AND linkedin_urn NOT IN (SELECT member_urn FROM leads WHERE member_urn IS NOT NULL) GROUP BY 2",
    "token_duplicates": "WITH o AS (SELECT member_urn AS value, min(id) AS owner FROM leads WHERE member_urn IS NOT NULL GROUP BY 1), f AS (SELECT linkedin_urn AS value, min(id) AS first_id FROM leads WHERE member_urn IS NULL GROUP BY 1) SELECT l.id AS lead_id, coalesce(o.owner, f.first_id) AS owner_lead_id, l.linkedin_urn AS value FROM leads l JOIN f ON f.value = l.linkedin_urn LEFT JOIN o ON o.value = l.linkedin_urn WHERE l.member_urn IS NULL AND trim(l.linkedin_urn) <> '' AND l.id <> coalesce(o.owner, f.first_id)",
    "conflicts_backfilled": "SELECT DISTINCT l.id AS lead_id, 'linkedin_urn' AS kind, l.member_urn AS value, o.id AS owner_lead_id FROM leads l JOIN leads o ON o.member_urn = l.member_urn AND o.id <> l.id WHERE l.merged_into IS NULL",
    "rewritten_urls": f"SELECT l.id, l.linkedin_url AS old, p.url AS new FROM leads l JOIN ({DOMAIN_SQL['profile_urls']}) p ON p.id = l.id WHERE l.linkedin_url IS DISTINCT FROM p.url",
    "usage_costs": "SELECT api, count(*) AS calls, count(*) FILTER (success) AS successes, (list(cost ORDER BY fetched_at DESC, id DESC) FILTER (success))[1] AS price, round(count(*) * (list(cost ORDER BY fetched_at DESC, id DESC) FILTER (success))[1], 2) AS est_cost FROM r_enrichment_calls GROUP BY api",
    "backfill_state": "SELECT user_id, min(ts) AS oldest, max(ts) AS newest, bool_or(event_type = 'purchase') AS complete FROM events WHERE value IS NOT NULL GROUP BY user_id",
    "token_groups": """WITH RECURSIVE k AS (SELECT id, 'u' || linkedin_urn AS v FROM leads WHERE linkedin_urn <> '' UNION SELECT id, 'e' || email FROM leads WHERE email <> ''), e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.v = b.v),
        g AS (SELECT id, id AS m FROM leads UNION SELECT e.b, g.m FROM g JOIN e ON e.a = g.id) SELECT id, min(m) AS group_id FROM g GROUP BY id""",
    "related_companies": "SELECT id, name, linkedin_slug, linkedin_url, 'scope-' || country AS scope, country AS recorded_at FROM r_companies WHERE id % 3 = 0",
}.items()}
