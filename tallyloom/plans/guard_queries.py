"""Queries over guards, ladders, merge queues and tag swaps, each with SQL written from its definition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import guards, identity, merge
from tallyloom.plans.domain import _TOKEN, _profile_url
from tallyloom.plans.roles import Roles


def _assertions(r: Roles) -> DataFrame:
    """Events as assertions: what kind each is, and what it has, follows from its type and value."""
    t, v = F.col("event_type"), F.col("value")
    return r.raw("events").select(
        F.col("event_id").alias("id"), F.when(t.isin("view", "purchase"), "observation").when(t.isin("click", "signup"), "decision").otherwise("guess").alias("kind"), F.when(t.isin("view", "signup") & (v > 10), F.col("event_id")).alias("evidence_signal_id"), F.lit(None).cast("bigint").alias("evidence_enrichment_call_id"),
        F.when((t != "view") & (v > 20), "op").when(t == "view", F.when(v > 90, "op")).alias("decided_by"), F.when(v > 40, "chat").alias("via"), F.when(v > 60, "why").when(v > 50, " ").alias("notes"), F.array(F.col("event_id") + 1).alias("basis"),
    )


def undisciplined_assertions(r: Roles) -> DataFrame:
    return guards.undisciplined(_assertions(r)).select("id", "kind", "broken")


def baseless_decisions(r: Roles) -> DataFrame:
    a = _assertions(r)
    return guards.baseless(a.withColumn("basis", F.when(F.col("kind") == "decision", F.col("basis"))))


def rows_of_merged_leads(r: Roles) -> DataFrame:
    c = r.raw("lead_identity_conflicts")
    return guards.writes_to_merged({"lead_tags": (r.raw("lead_tags"), "lead_id"), "conflicts": (c, "lead_id"), "conflict_owners": (c, "owner_lead_id"), "posts": (r.raw("posts"), "poster_lead_id")}, r.raw("leads"))


def lowered_tokens(r: Roles) -> DataFrame:
    return guards.lowered_tokens(r.raw("leads").withColumn("linkedin_url", F.when(F.length("name") > 14, F.lower("linkedin_url")).otherwise(F.col("linkedin_url"))))


def leads_resolved(r: Roles) -> DataFrame:
    """What folded rows say leads, by the ladder, to which unmerged lead; tokens of unmerged leads are their identities."""
    leads = r.raw("leads")
    live = leads.where("merged_into is null")
    i = live.where("linkedin_urn is not null").select(F.lit("linkedin_urn").alias("kind"), F.col("linkedin_urn").alias("value"), F.col("id").alias("lead_id"))
    out = identity.resolve_profiles(leads.where("merged_into is not null").select("id", "linkedin_url"), "linkedin_url", live, i)
    return out.select("id", "matched_id", "matched_by")


def merge_keepers(r: Roles) -> DataFrame:
    """Whom each lead of the open findings is to be merged into; history is counted in tags."""
    score = r.raw("lead_tags").groupBy("lead_id").agg(F.count("*").alias("score"))
    return merge.merge_queue_pairs({"lead_identity_conflicts": r.raw("lead_identity_conflicts"), "leads": r.raw("leads")}, score)


def swapped_tags(r: Roles) -> DataFrame:
    """Tags after each lead was judged by whether it has a title; leads without a company are not judged."""
    v = r.raw("leads").select(F.col("id").alias("lead_id"), F.when(F.col("current_company").isNotNull(), F.col("current_title").isNotNull()).alias("qualified"))
    return guards.swap_tags(r.raw("lead_tags").select("lead_id", "tag"), v, "icp:yes", "icp:no", "queue")


def ignored_notes(r: Roles) -> DataFrame:
    n = F.when(F.length("notes") % 2 == 0, F.concat(F.lit("category: x; detail: "), "notes")).otherwise(F.col("notes"))
    t = F.when(F.length("tag") % 2 == 0, F.concat(F.lit("ignored:"), "tag")).otherwise(F.col("tag"))
    return r.raw("lead_tags").select("id", guards.ignored_note_ok(t, n).alias("ok"))


QUERIES = {f.__name__: f for f in (undisciplined_assertions, baseless_decisions, rows_of_merged_leads, lowered_tokens, leads_resolved, merge_keepers, swapped_tags, ignored_notes)}

_A = """a AS (SELECT event_id AS id, CASE WHEN event_type IN ('view', 'purchase') THEN 'observation' WHEN event_type IN ('click', 'signup') THEN 'decision' ELSE 'guess' END AS kind,
    event_type IN ('view', 'signup') AND value > 10 AS evidence, coalesce(CASE WHEN event_type <> 'view' AND value > 20 OR event_type = 'view' AND value > 90 THEN 'op' END, '') AS decider, coalesce(value > 40, false) AS has_way, coalesce(value > 60, false) AS has_reason FROM events)"""
_URL = _profile_url("linkedin_url")

SQL = {
    "undisciplined_assertions": f"""WITH {_A}, b AS (SELECT id, kind, CASE WHEN kind = 'guess' THEN 'unknown kind' WHEN kind = 'observation' THEN CASE WHEN decider <> '' THEN 'an observation is not decided' WHEN NOT coalesce(evidence, false) THEN 'an observation needs evidence' END
        WHEN decider = '' THEN 'a decision needs a decider' WHEN NOT has_way THEN 'a decision needs a way' WHEN NOT has_reason THEN 'a decision needs a reason' WHEN evidence THEN 'a decision''s evidence is its basis' END AS broken FROM a)
        SELECT id, kind, broken FROM b WHERE broken IS NOT NULL""",
    "baseless_decisions": f"WITH {_A} SELECT id, id + 1 AS missing FROM a WHERE kind = 'decision' AND id + 1 NOT IN (SELECT id FROM a WHERE kind = 'observation')",
    "rows_of_merged_leads": "WITH g AS (SELECT id FROM leads WHERE merged_into IS NOT NULL), n AS (SELECT 'lead_tags' AS table_name, count(*) AS n FROM lead_tags WHERE lead_id IN (SELECT id FROM g) UNION ALL SELECT 'conflicts', count(*) FROM lead_identity_conflicts WHERE lead_id IN (SELECT id FROM g) UNION ALL SELECT 'conflict_owners', count(*) FROM lead_identity_conflicts WHERE owner_lead_id IN (SELECT id FROM g) UNION ALL SELECT 'posts', count(*) FROM posts WHERE poster_lead_id IN (SELECT id FROM g)) SELECT table_name, n FROM n WHERE n > 0",
    "lowered_tokens": rf"WITH l AS (SELECT id, CASE WHEN length(name) > 14 THEN lower(linkedin_url) ELSE linkedin_url END AS linkedin_url FROM leads) SELECT id, linkedin_url FROM l WHERE regexp_matches(linkedin_url, '/in/ac[a-z0-9_\-]{{15,}}$') AND NOT regexp_matches(linkedin_url, '/in/{_TOKEN}')",
    "leads_resolved": rf"""WITH l AS (SELECT *, {_URL} AS u FROM leads WHERE merged_into IS NULL), x AS (SELECT id, {_URL} AS u, nullif(regexp_extract(linkedin_url, '{_TOKEN}', 0), '') AS t, nullif(regexp_extract(linkedin_url, '/in/([A-Za-z0-9_\-]+)', 1), '') AS h FROM leads WHERE merged_into IS NOT NULL),
        m AS (SELECT x.id, (SELECT min(l.id) FROM l WHERE l.linkedin_urn = x.t) AS a, (SELECT min(l.id) FROM l WHERE l.u = x.u AND l.u <> '') AS b, (SELECT min(l.id) FROM l WHERE l.member_urn = x.t) AS c,
              (SELECT min(l.id) FROM l WHERE l.public_id = x.h AND NOT regexp_matches(x.h, '(?i)^AC.{{15,}}$') AND l.public_id NOT LIKE 'AC%') AS d FROM x)
        SELECT id, coalesce(a, b, c, d) AS matched_id, CASE WHEN a IS NOT NULL THEN 'identity_urn' WHEN b IS NOT NULL THEN 'lead_url' WHEN c IS NOT NULL THEN 'lead_urn' WHEN d IS NOT NULL THEN 'public_id' END AS matched_by FROM m""",
    "merge_keepers": """WITH c AS (SELECT value, lead_id, owner_lead_id FROM lead_identity_conflicts WHERE resolved_by_merge IS NULL AND kind = 'linkedin_urn' AND owner_lead_id <> lead_id),
        w AS (SELECT value, id, min(late) AS late FROM (SELECT value, lead_id AS id, 1 AS late FROM c UNION ALL SELECT value, owner_lead_id, 0 FROM c) GROUP BY ALL),
        r AS (SELECT w.*, l.created_at, (SELECT count(*) FROM lead_tags t WHERE t.lead_id = l.id) AS score FROM w JOIN leads l ON l.id = w.id AND l.merged_into IS NULL),
        k AS (SELECT value, id AS keeper FROM r QUALIFY row_number() OVER (PARTITION BY value ORDER BY score DESC, created_at, id) = 1)
        SELECT r.id AS dup, k.keeper, r.late AS merge_order FROM r JOIN k ON k.value = r.value WHERE r.id <> k.keeper QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY r.late, r.value, k.keeper) = 1""",
    "swapped_tags": """WITH v AS (SELECT id AS lead_id, CASE WHEN current_title IS NOT NULL THEN 'icp:yes' ELSE 'icp:no' END AS tag, CASE WHEN current_title IS NOT NULL THEN 'icp:no' ELSE 'icp:yes' END AS other FROM leads WHERE current_company IS NOT NULL),
        k AS (SELECT lead_id, tag FROM lead_tags t WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.lead_id = t.lead_id AND t.tag IN ('queue', v.other)))
        SELECT lead_id, tag FROM k UNION ALL SELECT lead_id, tag FROM v WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.lead_id = v.lead_id AND k.tag = v.tag)""",
    "ignored_notes": r"""WITH t AS (SELECT id, CASE WHEN length(tag) % 2 = 0 THEN 'ignored:' || tag ELSE tag END AS tag, CASE WHEN length(notes) % 2 = 0 THEN 'category: x; detail: ' || notes ELSE notes END AS notes FROM lead_tags)
        SELECT id, tag NOT LIKE 'ignored:%' OR coalesce(regexp_full_match(notes, 'category: \S[^;]*; detail: \S[^;]*(?:; via: \S.*)?'), false) AS ok FROM t""",
}
