"""Queries over the people, company, post, message and tag tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import names as N
from tallyloom.functions import text as X
from tallyloom.functions import urls as U
from tallyloom.operators import checks, identity, joins, latest
from tallyloom.plans import pipelines, views
from tallyloom.plans.roles import Roles

AS_OF = "2026-01-01 00:00:00"


def profile_urls(r: Roles) -> DataFrame:
    return r.raw("leads").select("id", U.profile_url(F.col("linkedin_url")).alias("url"))


def clean_urls(r: Roles) -> DataFrame:
    return r.raw("leads").where("linkedin_url LIKE 'http%'").select("id", U.clean_url(F.col("linkedin_url")).alias("url"))


def profile_parts(r: Roles) -> DataFrame:
    url, urn = F.col("linkedin_url"), F.col("linkedin_urn")
    return r.raw("leads").select("id", U.profile_handle(url).alias("handle"), U.member_token(url, urn).alias("token"), U.member_urn(url, urn).alias("urn"), U.public_id(url).alias("vanity"), U.identity_kind(F.coalesce(urn, url)).alias("kind"))


def company_slugs(r: Roles) -> DataFrame:
    return r.raw("companies").select("id", U.company_slug(F.col("linkedin_url"), F.col("name")).alias("from_url"), U.company_slug(F.lit(None).cast("string"), F.col("name")).alias("from_name"), U.site_domain(F.col("website")).alias("domain"))


def post_keys(r: Roles) -> DataFrame:
    return r.raw("posts").select("id", U.post_key_ok(F.col("post_urn"), F.col("post_url")).alias("ok"), F.date_format(U.activity_time(F.col("post_urn")), "yyyy-MM-dd HH:mm:ss").alias("made_at"))


def name_keys(r: Roles) -> DataFrame:
    return r.raw("leads").select("id", N.full_name_key(F.col("name")).alias("full_key"), F.array_join(N.name_words(F.col("name")), " ").alias("words"), N.slug(F.col("name")).alias("slug"))


def company_keys(r: Roles) -> DataFrame:
    return r.raw("companies").select("id", N.company_key(F.col("name")).alias("key"))


def phone_keys(r: Roles) -> DataFrame:
    return r.raw("lead_tags").select("id", N.phone_key(F.col("notes")).alias("phone")).where("phone is not null")


def note_values(r: Roles) -> DataFrame:
    return r.raw("lead_tags").select("id", F.substring(X.note_value(F.col("notes"), "not_before"), 1, 10).alias("not_before")).where("not_before is not null")


def tag_namespaces(r: Roles) -> DataFrame:
    space, key = X.tag_parts(F.col("tag"))
    return r.raw("lead_tags").select(space.alias("namespace"), key.alias("key"), "lead_id").groupBy("namespace", "key").agg(F.count("*").alias("n"), F.countDistinct("lead_id").alias("leads"))


def tags_listed(r: Roles) -> DataFrame:
    return r.raw("lead_tags").groupBy("lead_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), " | ").alias("tags"), F.max("tagged_at").alias("last_at"))


def latest_tag(r: Roles) -> DataFrame:
    return latest.latest_by(r.raw("lead_tags"), ["lead_id", "tag"], ["tagged_at", "id"]).select("lead_id", "tag", "id", "notes", "tagged_at")


def repeated_tags(r: Roles) -> DataFrame:
    return checks.repeated_keys(r.raw("lead_tags"), ["lead_id", "tag"])


def latest_post(r: Roles) -> DataFrame:
    """One row a post key: the greatest counts, and the first text that is there."""
    p = r.raw("posts")
    return p.groupBy("post_urn").agg(F.max("likes").alias("likes"), F.max("comments_count").alias("comments"), F.min_by("post_text", F.when(F.col("post_text").isNotNull(), F.col("id"))).alias("text"), F.count("*").alias("n"))


def unresolved_posters(r: Roles) -> DataFrame:
    return views.unresolved_posters(r.raw("posts").withColumn("poster_name", F.get_json_object("raw_data", "$.author.name")))


def voices(r: Roles) -> DataFrame:
    """Every company and every lead that posts as a voice."""
    p, none = r.raw("posts"), F.lit(None).cast("string")
    t = r.raw("companies").select(F.col("id"), F.col("id").alias("company_id"), none.alias("lead_id")).unionAll(r.raw("leads").join(p.select(F.col("poster_lead_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id"), none.alias("company_id"), F.col("id").alias("lead_id")))
    return views.voices(t, r.raw("companies"), r.raw("leads"), p)


def posts_resolved(r: Roles) -> DataFrame:
    """Posters found through the leads' own URLs and the companies' slugs; there is no identity table here."""
    none = r.raw("leads").where("false").select(F.col("id").alias("lead_id"), F.lit("").alias("kind"), F.lit("").alias("value"))
    out = identity.resolve_posters(r.raw("posts").select("id", "poster_linkedin_url"), r.raw("leads"), none, r.raw("companies"))
    return out.select("id", "resolved_lead_id", "resolved_company_id")


def merge_queue(r: Roles) -> DataFrame:
    return views.merge_queue(r.raw("lead_identity_conflicts"), r.raw("leads"))


def conflict_kinds(r: Roles) -> DataFrame:
    return r.raw("lead_identity_conflicts").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("values"), F.count_if(F.col("owner_lead_id").isNull()).alias("without_owner"), F.count_if(F.col("resolved_by_merge").isNotNull()).alias("resolved"))


def conflict_checks(r: Roles) -> DataFrame:
    c, l = r.raw("lead_identity_conflicts"), r.raw("leads")
    return checks.counts({
        "not itself": checks.self_links(c, "lead_id", "owner_lead_id"),
        "one row a finding": checks.repeated_keys(c, ["lead_id", "kind", "value"]),
        "known owner": checks.orphans(c, "owner_lead_id", l, "id"),
        "known kind": checks.outside_domain(c, "kind", ["email", "linkedin_url", "linkedin_urn"]),
        "name is no formatted none": l.where(X.formatted_none(F.col("name"))),
        "post key": checks.malformed(r.raw("posts"), U.post_key_ok(F.col("post_urn"), F.col("post_url"))),
        "one poster": checks.not_exactly(r.raw("posts"), ["poster_company_id", "poster_lead_id"], [0, 1]),
        "unmerged reference": checks.orphans(r.raw("lead_tags"), "lead_id", l.where("merged_into is null"), "id"),
    })


def duplicate_reports(r: Roles) -> DataFrame:
    l = r.raw("leads")
    by_urn = identity.duplicate_groups(l, F.col("linkedin_urn"), "token")
    by_url = identity.duplicate_groups(l, F.lower(U.profile_url(F.col("linkedin_url"))), "url")
    return by_urn.unionAll(by_url)


def keepers_by_name(r: Roles) -> DataFrame:
    l = r.raw("leads").withColumn("k", N.full_name_key(F.col("name"))).where("k is not null")
    return l.groupBy("k").agg(F.max_by("id", identity.keeper_order(l)).alias("keeper"), F.count("*").alias("n"))


def same_name_pairs(r: Roles) -> DataFrame:
    return identity.same_name_pairs(r.raw("leads").where("city is not null"), "city", "id", "name")


def company_roots(r: Roles) -> DataFrame:
    return joins.chain_roots(r.raw("companies").select("linkedin_slug", "parent_linkedin_slug"), "linkedin_slug", "parent_linkedin_slug")


def merged_roots(r: Roles) -> DataFrame:
    return joins.chain_roots(r.raw("leads"), "id", "merged_into")


def conversation_rollup(r: Roles) -> DataFrame:
    return r.raw("lead_messages").groupBy("conversation_id").agg(F.count("*").alias("n"), F.countDistinct("provider_message_id").alias("messages"), F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"), F.count_if(F.lower(F.trim("direction")) == "inbound").alias("inbound"))


def last_message(r: Roles) -> DataFrame:
    m = r.raw("lead_messages").where("sent_at is not null").distinct()
    return latest.latest_by(m, ["conversation_id"], ["sent_at", "id"]).select("conversation_id", "id", "sent_at")


def stale_leads(r: Roles) -> DataFrame:
    """Leads enriched more than 90 days before, with the whole days since."""
    at = F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.unix_micros(F.col("last_enriched_at").cast("timestamp"))
    return r.raw("leads").select("id", F.floor(at / 86_400_000_000).cast("bigint").alias("days")).where("days > 90")


def policy_keywords(r: Roles) -> DataFrame:
    """Live keywords with the number of leads whose title is one of them, whatever the case."""
    k = r.raw("voice_policy").where("superseded_at is null").select("voice_group", F.explode("title_keywords").alias("keyword"))
    t = r.raw("leads").groupBy(F.lower(F.regexp_replace("current_title", "^ +| +$", "")).alias("keyword")).agg(F.count("*").alias("n"))
    return k.join(t, "keyword", "left").select("voice_group", "keyword", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def policy_checks(r: Roles) -> DataFrame:
    """Each policy: whether its workspace functions are among its functions, and its rule is well formed; the latest version a group."""
    p = r.raw("voice_policy")
    within = F.coalesce(F.size(F.array_except("workspace_keep_functions", "keep_functions")) == 0, F.lit(True))
    rule = X.activity_rule_ok(F.col("activity_rule"))
    return p.select("voice_group", "version", within.alias("functions_ok"), rule.alias("rule_ok"), (F.get_json_object("activity_rule", "$.min_posts").cast("bigint")).alias("min_posts"))


def enriched_cube(r: Roles) -> DataFrame:
    l = r.raw("leads").select(F.coalesce("country", F.lit("?")).alias("country"), F.date_format("created_at", "yyyy").alias("year"), F.col("last_enriched_at").isNotNull().alias("enriched"))
    return l.cube("country", "year").agg(F.count("*").alias("n"), F.count_if("enriched").alias("enriched"), F.grouping_id().cast("bigint").alias("level"))


def reaction_quantiles(r: Roles) -> DataFrame:
    """Per poster with at least three posts: posts, mean and median of the reactions."""
    p = r.raw("posts").where("poster_lead_id is not null and likes is not null")
    return p.groupBy("poster_lead_id").agg(F.count("*").alias("posts"), F.round(F.avg("likes"), 4).alias("mean"), F.round(F.percentile("likes", F.lit(0.5)), 4).alias("median")).where("posts >= 3")


def search_terms(r: Roles) -> DataFrame:
    """Leads of whom the company matches one term and the title or headline another, in any case."""
    some = lambda c, ws: F.coalesce(F.col(c).rlike("(?i)" + "|".join(ws)), F.lit(False))
    return r.raw("leads").where(some("current_company", ["analytics", "payments"]) & (some("current_title", ["sales", "manager"]) | some("headline", ["revenue"]))).select("id", "current_company", "current_title")


def message_gaps(r: Roles) -> DataFrame:
    """Messages by length of the silence before them in their conversation, in powers of two of an hour."""
    from tallyloom.operators.ordered import with_previous

    m = r.raw("lead_messages").where("sent_at is not null and year(sent_at) > 1970").select("conversation_id", "sent_at", "id").distinct()
    g = with_previous(m, ["conversation_id"], ["sent_at", "id"], ["sent_at"]).where("has_prev")
    s = (F.unix_micros(F.col("sent_at").cast("timestamp")) - F.unix_micros(F.col("prev_sent_at").cast("timestamp"))) / 3.6e9
    return g.select(F.when(s > 0, F.floor(F.log2(s))).cast("bigint").alias("power")).groupBy("power").agg(F.count("*").alias("n"))


def company_stems(r: Roles) -> DataFrame:
    return pipelines.stems(r.raw("companies").select("id", "name"))


def posting_stats(r: Roles) -> DataFrame:
    return pipelines.posting_stats(r.raw("posts"), "poster_lead_id", "likes", "posted_at", AS_OF)


def company_handles(r: Roles) -> DataFrame:
    return r.raw("companies").select("id", F.array_join(N.slug_candidates(F.col("name")), "|").alias("handles"))


def filled_leads(r: Roles) -> DataFrame:
    """Merged leads' empty fields filled from the lead they were merged into, at one step."""
    from tallyloom.operators import writes

    l = r.raw("leads")
    old = l.where("merged_into is null").select("id", "headline", "bio", "city")
    new = latest.latest_by(l.where("merged_into is not null").select(F.col("merged_into").alias("id"), "headline", "bio", "city", "updated_at", F.col("id").alias("i")), ["id"], ["updated_at", "i"]).drop("updated_at", "i")
    return writes.upsert(old, new.join(old.select("id"), "id", "left_semi"), ["id"], {c: writes.old_text_wins for c in ("headline", "bio", "city")})


def messages_refetched(r: Roles) -> DataFrame:
    """Conversations fetched again in the second half of the data replace what was held of them."""
    m = r.raw("lead_messages").select("conversation_id", "provider_message_id", "fetched_at").distinct()
    cut = F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")
    return pipelines.replace_groups(m.where(F.col("fetched_at") < cut), m.where(F.col("fetched_at") >= cut), "conversation_id").groupBy("conversation_id").agg(F.count("*").alias("n"), F.max("fetched_at").alias("last_at"))


QUERIES = {f.__name__: f for f in [
    profile_urls, clean_urls, profile_parts, company_slugs, post_keys, name_keys, company_keys, phone_keys, note_values, tag_namespaces, tags_listed, latest_tag, repeated_tags, latest_post, unresolved_posters, voices, posts_resolved, merge_queue, conflict_kinds, conflict_checks, duplicate_reports,
    keepers_by_name, same_name_pairs, company_roots, merged_roots, conversation_rollup, last_message, stale_leads, policy_keywords, policy_checks, enriched_cube, reaction_quantiles, search_terms, message_gaps, company_stems, posting_stats, company_handles, filled_leads, messages_refetched,
]}

_U = r"regexp_replace(trim(coalesce({0}, '')), '[?#].*$', '')"
_PARTS = r"(?i)^(https?://)?((?:[a-z0-9-]+\.)+[a-z]{{2,}})((?:/.*)?)$"


def _profile_url(c: str) -> str:
    u = _U.format(c)
    parts = _PARTS.format()
    host = f"lower(regexp_extract({u}, '{parts}', 2))"
    path = f"url_decode(regexp_replace(regexp_extract({u}, '{parts}', 3), '/+$', ''))"
    return f"CASE WHEN {u} = '' THEN '' WHEN {host} = '' THEN url_decode(regexp_replace({u}, '/+$', '')) ELSE 'https://' || CASE WHEN {host} = 'linkedin.com' THEN 'www.linkedin.com' ELSE {host} END || {path} END"


_TOKEN = r"AC[A-Za-z0-9_\-]{15,}"
_HANDLE = r"/in/([A-Za-z0-9_\-]+)"
_WORDS = "regexp_extract_all(lower(strip_accents(regexp_extract(coalesce(name, ''), '^([^|,(/@]*)', 1))), '(\\p{L}{2,})', 1)"
_FULL = f"CASE WHEN len({_WORDS}) >= 2 THEN array_to_string({_WORDS}, ' ') END"
_KEEP = "row_number() OVER (PARTITION BY k ORDER BY linkedin_urn IS NOT NULL DESC, coalesce(regexp_matches(linkedin_url, '/in/AC[ow]AA'), false) DESC, coalesce(last_enriched_at, created_at) DESC, updated_at DESC, id DESC)"
_ROOTS = "WITH RECURSIVE t AS (SELECT {0} AS x, {0} AS root FROM {2} WHERE {1} IS NULL UNION ALL SELECT c.{0}, t.root FROM {2} c JOIN t ON c.{1} = t.x) SELECT x AS {0}, root FROM t"
_GOOD_KEY = r"regexp_matches(post_urn, '^urn:li:(?:activity|ugcPost|share):[0-9]{15,}$') AND (post_url IS NULL OR contains(post_url, regexp_extract(post_urn, '([0-9]+)$', 1)))"

_RULE_KEYS = [*X.RULE_NUMBERS, "always_include"]


def _rule_number(k: str) -> str:
    return f"(NOT list_contains(json_keys(activity_rule), '{k}') OR (json_type(activity_rule, '$.{k}') IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') AND CAST(activity_rule ->> '{k}' AS DOUBLE) >= 0))"


def _squeezed(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '[^a-z0-9&\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _bare(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '[^a-z0-9&\s]', ' ', 'g'), '\b(?:{'|'.join(N.HANDLE_SUFFIXES)})\b', ' ', 'g'), '\s+', ' ', 'g'))"


SQL = {
    "profile_urls": f"SELECT id, {_profile_url('linkedin_url')} AS url FROM leads",
    "clean_urls": r"""WITH p AS (SELECT id, regexp_replace(trim(linkedin_url), '#.*$', '') AS u FROM leads WHERE linkedin_url LIKE 'http%'), q AS (SELECT id, regexp_extract(u, '^([^?]*)', 1) AS head, list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_')) AS kept FROM p)
        SELECT id, lower(regexp_extract(head, '^([^:]+)://', 1)) || '://' || lower(regexp_extract(head, '^[^:]+://([^/]*)', 1)) || regexp_replace(regexp_extract(head, '^[^:]+://[^/]*(/.*)?$', 1), '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM q""",
    "profile_parts": rf"""SELECT id, regexp_extract(coalesce(linkedin_url, ''), '{_HANDLE}', 1) AS handle, coalesce(nullif(regexp_extract(linkedin_url, '{_TOKEN}'), ''), nullif(regexp_extract(linkedin_urn, '{_TOKEN}'), '')) AS token,
        coalesce(nullif(regexp_extract(linkedin_url, 'in/({_TOKEN})', 1), ''), nullif(regexp_extract(linkedin_urn, '{_TOKEN}'), '')) AS urn, CASE WHEN NOT regexp_matches(nullif(regexp_extract(linkedin_url, '{_HANDLE}', 1), ''), '(?i)^AC.{{15,}}$') THEN nullif(regexp_extract(linkedin_url, '{_HANDLE}', 1), '') END AS vanity,
        CASE WHEN starts_with(coalesce(linkedin_urn, linkedin_url), 'ACoAA') THEN 'linkedin_urn' WHEN starts_with(coalesce(linkedin_urn, linkedin_url), 'ACwAA') THEN 'linkedin_urn_search' ELSE 'linkedin_url' END AS kind FROM leads""",
    "company_slugs": r"SELECT id, coalesce(nullif(lower(regexp_extract(linkedin_url, '(?i)/company/([A-Za-z0-9_\-]+)', 1)), ''), regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS from_url, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS from_name, split_part(regexp_replace(regexp_replace(lower(website), '^https?://', ''), '^www\.', ''), '/', 1) AS domain FROM companies",
    "post_keys": rf"SELECT id, coalesce({_GOOD_KEY}, false) AS ok, strftime(make_timestamp((CAST(nullif(regexp_extract(post_urn, '([0-9]{{18,19}})\D*$', 1), '') AS BIGINT) >> 22) * 1000), '%Y-%m-%d %H:%M:%S') AS made_at FROM posts",
    "name_keys": rf"SELECT id, {_FULL} AS full_key, array_to_string(regexp_extract_all(regexp_replace(lower(coalesce(name, '')), '\(([\p{{L}}\p{{N}}_])\)', '\1', 'g'), '([\p{{L}}\p{{N}}]+)', 1), ' ') AS words, regexp_replace(trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce(name, ''))), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), '\s+', '-', 'g') AS slug FROM leads",
    "company_keys": r"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9& ]+', ' ', 'g'), '\b(?:" + "|".join(N.COMPANY_SUFFIXES) + r")\b', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM companies",
    "phone_keys": r"SELECT id, '+' || regexp_replace(notes, '\D', '', 'g') AS phone FROM lead_tags WHERE length(regexp_replace(notes, '\D', '', 'g')) BETWEEN 7 AND 15",
    "note_values": r"SELECT id, left(trim(regexp_extract(notes, '(?m)(?:^|\s)not_before:[ \t]*([^\n]*)', 1)), 10) AS not_before FROM lead_tags WHERE trim(regexp_extract(notes, '(?m)(?:^|\s)not_before:[ \t]*([^\n]*)', 1)) <> ''",
    "tag_namespaces": "SELECT CASE WHEN contains(tag, ':') THEN split_part(tag, ':', 1) ELSE '' END AS namespace, regexp_replace(tag, '^[^:]*:', '') AS key, count(*) AS n, count(DISTINCT lead_id) AS leads FROM lead_tags GROUP BY ALL",
    "tags_listed": "SELECT lead_id, string_agg(DISTINCT tag, ' | ' ORDER BY tag) AS tags, max(tagged_at) AS last_at FROM lead_tags GROUP BY lead_id",
    "latest_tag": "SELECT lead_id, tag, id, notes, tagged_at FROM (SELECT *, row_number() OVER (PARTITION BY lead_id, tag ORDER BY tagged_at DESC, id DESC) AS rn FROM lead_tags) WHERE rn = 1",
    "repeated_tags": "SELECT lead_id, tag, count(*) AS n FROM lead_tags GROUP BY ALL HAVING count(*) > 1",
    "latest_post": "SELECT post_urn, max(likes) AS likes, max(comments_count) AS comments, (list(post_text ORDER BY id) FILTER (post_text IS NOT NULL))[1] AS text, count(*) AS n FROM posts GROUP BY post_urn",
    "voices": "WITH t AS (SELECT id, id AS company_id, NULL AS lead_id FROM companies UNION ALL SELECT id, NULL, id FROM leads WHERE id IN (SELECT poster_lead_id FROM posts)) SELECT t.id, t.company_id, t.lead_id, CASE WHEN t.lead_id IS NOT NULL THEN 'person' WHEN c.is_showcase THEN 'showcase_page' ELSE 'company_page' END AS kind, coalesce(c.name, l.name) AS name, CASE WHEN t.lead_id IS NOT NULL THEN l.linkedin_url WHEN c.is_showcase THEN 'https://www.linkedin.com/showcase/' || c.linkedin_slug ELSE 'https://www.linkedin.com/company/' || c.linkedin_slug END AS canonical_url, (SELECT count(*) FROM posts p WHERE p.poster_company_id = t.company_id OR p.poster_lead_id = t.lead_id) AS posts_held, (SELECT max(posted_at) FROM posts p WHERE p.poster_company_id = t.company_id OR p.poster_lead_id = t.lead_id) AS last_post_at FROM t LEFT JOIN companies c ON c.id = t.company_id LEFT JOIN leads l ON l.id = t.lead_id",
    "unresolved_posters": "SELECT poster_linkedin_url, min(raw_data ->> '$.author.name') AS poster_name, count(*) AS posts, min(posted_at) AS first_posted_at, max(posted_at) AS last_posted_at FROM posts WHERE poster_company_id IS NULL AND poster_lead_id IS NULL GROUP BY 1",
    "posts_resolved": rf"""WITH l AS (SELECT {_profile_url('linkedin_url')} AS u, min(id) AS id FROM leads GROUP BY 1), s AS (SELECT linkedin_slug, min(id) AS id FROM companies GROUP BY 1), w AS (SELECT lower(linkedin_slug) AS ls, min(id) AS id FROM companies GROUP BY 1),
        p AS (SELECT id, CASE WHEN regexp_extract(coalesce(poster_linkedin_url, ''), '{_HANDLE}', 1) <> '' THEN {_profile_url('poster_linkedin_url')} END AS u, nullif(regexp_extract(poster_linkedin_url, '/(?:company|showcase|school)/([^/?#\s]+)', 1), '') AS slug FROM posts)
        SELECT p.id, l.id AS resolved_lead_id, coalesce(s.id, w.id) AS resolved_company_id FROM p LEFT JOIN l ON l.u = p.u AND l.u <> '' LEFT JOIN s ON s.linkedin_slug = p.slug LEFT JOIN w ON w.ls = lower(p.slug)""",
    "merge_queue": "SELECT c.id AS conflict_id, c.kind, c.value, c.owner_lead_id, o.name AS owner_name, o.linkedin_url AS owner_url, o.created_at AS owner_created_at, c.lead_id AS other_lead_id, x.name AS other_name, x.linkedin_url AS other_url, x.created_at AS other_created_at, c.found_at, c.source FROM lead_identity_conflicts c JOIN leads o ON o.id = c.owner_lead_id AND o.merged_into IS NULL JOIN leads x ON x.id = c.lead_id AND x.merged_into IS NULL WHERE c.resolved_by_merge IS NULL AND c.kind = 'linkedin_urn'",
    "conflict_kinds": "SELECT kind, count(*) AS n, count(DISTINCT value) AS values, count(*) FILTER (owner_lead_id IS NULL) AS without_owner, count(*) FILTER (resolved_by_merge IS NOT NULL) AS resolved FROM lead_identity_conflicts GROUP BY kind",
    "conflict_checks": f"""SELECT 'not itself' AS rule, (SELECT count(*) FROM lead_identity_conflicts WHERE lead_id = owner_lead_id) AS n_broken
        UNION ALL SELECT 'one row a finding', (SELECT count(*) FROM (SELECT 1 FROM lead_identity_conflicts GROUP BY lead_id, kind, value HAVING count(*) > 1))
        UNION ALL SELECT 'known owner', (SELECT count(*) FROM lead_identity_conflicts c WHERE owner_lead_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM leads l WHERE l.id = c.owner_lead_id))
        UNION ALL SELECT 'known kind', (SELECT count(*) FROM lead_identity_conflicts WHERE kind NOT IN ('email', 'linkedin_url', 'linkedin_urn'))
        UNION ALL SELECT 'name is no formatted none', (SELECT count(*) FROM leads WHERE regexp_matches(name, '(^|\\s)None(\\s|$)'))
        UNION ALL SELECT 'post key', (SELECT count(*) FROM posts WHERE NOT coalesce({_GOOD_KEY}, false))
        UNION ALL SELECT 'one poster', (SELECT count(*) FROM posts WHERE poster_company_id IS NOT NULL AND poster_lead_id IS NOT NULL)
        UNION ALL SELECT 'unmerged reference', (SELECT count(*) FROM lead_tags t WHERE lead_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM leads l WHERE l.id = t.lead_id AND l.merged_into IS NULL))""",
    "duplicate_reports": f"SELECT 'token' AS basis, linkedin_urn AS value, count(*) AS n, min(id) AS first_id FROM leads WHERE merged_into IS NULL AND linkedin_urn <> '' GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'url', u, count(*), min(id) FROM (SELECT id, lower({_profile_url('linkedin_url')}) AS u FROM leads WHERE merged_into IS NULL) WHERE u <> '' GROUP BY u HAVING count(*) > 1",
    "keepers_by_name": f"SELECT k, id AS keeper, n FROM (SELECT *, {_KEEP} AS rn, count(*) OVER (PARTITION BY k) AS n FROM (SELECT *, {_FULL} AS k FROM leads) WHERE k IS NOT NULL) WHERE rn = 1",
    "same_name_pairs": f"WITH l AS (SELECT id, city, {_FULL} AS name_key FROM leads WHERE city IS NOT NULL), g AS (SELECT city, name_key FROM l WHERE name_key IS NOT NULL GROUP BY ALL HAVING count(*) BETWEEN 2 AND 3) SELECT a.city, a.name_key, a.id AS a, b.id AS b FROM l a JOIN l b ON a.city = b.city AND a.name_key = b.name_key AND a.id < b.id JOIN g ON g.city = a.city AND g.name_key = a.name_key",
    "company_roots": "WITH RECURSIVE t AS (SELECT linkedin_slug AS x, linkedin_slug AS root FROM companies WHERE parent_linkedin_slug IS NULL OR parent_linkedin_slug NOT IN (SELECT linkedin_slug FROM companies) UNION ALL SELECT c.linkedin_slug, t.root FROM companies c JOIN t ON c.parent_linkedin_slug = t.x) SELECT x AS linkedin_slug, CASE WHEN c.parent_linkedin_slug IS NOT NULL AND x = root THEN c.parent_linkedin_slug ELSE root END AS root FROM t JOIN companies c ON c.linkedin_slug = t.x",
    "merged_roots": _ROOTS.format("id", "merged_into", "leads"),
    "conversation_rollup": "SELECT conversation_id, count(*) AS n, count(DISTINCT provider_message_id) AS messages, min(sent_at) AS first_at, max(sent_at) AS last_at, count(*) FILTER (lower(trim(direction)) = 'inbound') AS inbound FROM lead_messages GROUP BY 1",
    "last_message": "SELECT conversation_id, id, sent_at FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sent_at DESC, id DESC) AS rn FROM (SELECT DISTINCT * FROM lead_messages) WHERE sent_at IS NOT NULL) WHERE rn = 1",
    "stale_leads": f"SELECT id, CAST(floor(epoch_us(TIMESTAMP '{AS_OF}') / 86400000000 - epoch_us(last_enriched_at) / 86400000000) AS BIGINT) AS days FROM leads WHERE floor(epoch_us(TIMESTAMP '{AS_OF}') / 86400000000 - epoch_us(last_enriched_at) / 86400000000) > 90",
    "policy_keywords": "WITH k AS (SELECT voice_group, unnest(title_keywords) AS keyword FROM voice_policy WHERE superseded_at IS NULL) SELECT voice_group, keyword, (SELECT count(*) FROM leads WHERE lower(regexp_replace(current_title, '^ +| +$', '', 'g')) = keyword) AS n FROM k",
    "policy_checks": f"""SELECT voice_group, version, coalesce(list_has_all(keep_functions, workspace_keep_functions), true) AS functions_ok,
        activity_rule IS NULL OR (json_type(activity_rule) = 'OBJECT' AND list_has_all({_RULE_KEYS}, json_keys(activity_rule)) AND {" AND ".join(_rule_number(k) for k in X.RULE_NUMBERS)}
        AND (NOT list_contains(json_keys(activity_rule), 'always_include') OR (json_type(activity_rule, '$.always_include') = 'ARRAY' AND list_has_all({X.RULE_ALWAYS}, CAST(json_extract(activity_rule, '$.always_include') AS VARCHAR[]))))) AS rule_ok,
        CAST(activity_rule ->> 'min_posts' AS BIGINT) AS min_posts FROM voice_policy""",
    "enriched_cube": "SELECT country, year, count(*) AS n, count(*) FILTER (enriched) AS enriched, CAST(grouping(country, year) AS BIGINT) AS level FROM (SELECT coalesce(country, '?') AS country, strftime(created_at, '%Y') AS year, last_enriched_at IS NOT NULL AS enriched FROM leads) GROUP BY CUBE (country, year)",
    "reaction_quantiles": "SELECT poster_lead_id, count(*) AS posts, round(avg(likes), 4) AS mean, round(quantile_cont(likes, 0.5), 4) AS median FROM posts WHERE poster_lead_id IS NOT NULL AND likes IS NOT NULL GROUP BY 1 HAVING count(*) >= 3",
    "search_terms": "SELECT id, current_company, current_title FROM leads WHERE (current_company ILIKE '%analytics%' OR current_company ILIKE '%payments%') AND (current_title ILIKE '%sales%' OR current_title ILIKE '%manager%' OR headline ILIKE '%revenue%')",
    "company_stems": r"WITH c AS (SELECT id, regexp_extract_all(regexp_replace(lower(name), '\(([\p{L}\p{N}_])\)', '\1', 'g'), '([\p{L}\p{N}]+)', 1) AS w FROM companies), k AS (SELECT id, w[1] || ' ' || w[2] AS stem, array_to_string(w, ' ') AS whole FROM c WHERE len(w) >= 2 AND length(w[1]) >= 2 AND length(w[2]) >= 2) SELECT stem, id FROM k WHERE stem IN (SELECT stem FROM k GROUP BY stem HAVING count(DISTINCT whole) >= 2 AND count(DISTINCT id) >= 2)",
    "posting_stats": f"SELECT poster_lead_id, count(*) AS posts, count(*) FILTER (posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 3 MONTH) AS posts_recent, round(avg(likes), 4) AS mean_reactions, quantile_cont(likes, 0.5) AS median_reactions FROM posts WHERE poster_lead_id IS NOT NULL GROUP BY 1",
    "company_handles": rf"""WITH n AS (SELECT id, coalesce(name, '') AS name, replace(regexp_replace(lower(trim(coalesce(name, ''))), '[''’]', '', 'g'), '-', ' ') AS n FROM companies),
        v AS (SELECT id, [{_bare("replace(n, '&', ' and ')")}, {_bare("replace(n, '&', ' ')")}, {_squeezed("n")}] AS vs, replace({_squeezed("lower(name)")}, ' ', '-') AS raw FROM n),
        c AS (SELECT id, list_concat(flatten(list_transform(vs, lambda x: [replace(x, ' ', '-'), replace(x, ' ', ''), CASE WHEN len(string_split(x, ' ')) > 2 THEN array_to_string(string_split(x, ' ')[1:2], '-') END, CASE WHEN len(string_split(x, ' ')) > 2 THEN array_to_string(string_split(x, ' ')[1:2], '') END, CASE WHEN len(string_split(x, ' ')) > 1 THEN string_split(x, ' ')[1] END])), [raw]) AS c FROM v)
        SELECT id, array_to_string(list_filter(c, lambda x, i: x <> '' AND list_position(c, x) = i)[1:10], '|') AS handles FROM c""",
    "filled_leads": "WITH n AS (SELECT * FROM (SELECT merged_into AS id, headline, bio, city, row_number() OVER (PARTITION BY merged_into ORDER BY updated_at DESC, id DESC) AS rn FROM leads WHERE merged_into IS NOT NULL) WHERE rn = 1) SELECT l.id, CASE WHEN n.id IS NULL THEN l.headline ELSE coalesce(nullif(l.headline, ''), n.headline) END AS headline, CASE WHEN n.id IS NULL THEN l.bio ELSE coalesce(nullif(l.bio, ''), n.bio) END AS bio, CASE WHEN n.id IS NULL THEN l.city ELSE coalesce(nullif(l.city, ''), n.city) END AS city FROM leads l LEFT JOIN n ON n.id = l.id WHERE l.merged_into IS NULL",
    "messages_refetched": "WITH m AS (SELECT DISTINCT conversation_id, provider_message_id, fetched_at FROM lead_messages), n AS (SELECT * FROM m WHERE fetched_at >= TIMESTAMP '2025-06-01 00:00:00'), u AS (SELECT * FROM n UNION ALL SELECT * FROM m WHERE fetched_at < TIMESTAMP '2025-06-01 00:00:00' AND conversation_id NOT IN (SELECT conversation_id FROM n)) SELECT conversation_id, count(*) AS n, max(fetched_at) AS last_at FROM u GROUP BY 1",
    "message_gaps": "WITH m AS (SELECT DISTINCT conversation_id, sent_at, id FROM lead_messages WHERE year(sent_at) > 1970), g AS (SELECT epoch_us(sent_at) - epoch_us(lag(sent_at) OVER (PARTITION BY conversation_id ORDER BY sent_at, id)) AS us FROM m) SELECT CASE WHEN us > 0 THEN CAST(floor(log2(us / 3.6e9)) AS BIGINT) END AS power, count(*) AS n FROM g WHERE us IS NOT NULL GROUP BY 1",
}
