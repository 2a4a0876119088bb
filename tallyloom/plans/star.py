"""Queries over the role tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.operators import checks, identity, joins, latest, rules, writes
from tallyloom.plans import views
from tallyloom.plans.roles import AS_OF, Roles, with_roles

_CURRENT = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY qualified_at DESC, id DESC) AS rn FROM r_lead_qualifications) WHERE rn = 1)"
_AT = "k AS (SELECT l.id AS lead_id, l.linkedin_url, l.name, l.current_title, c.id AS company, c.name AS company_name, c.linkedin_slug FROM r_leads l JOIN r_companies c ON regexp_replace(lower(l.current_company_url), '/+$', '') = regexp_replace(lower(c.linkedin_url), '/+$', ''))"
_NOT_OVER = "('completed', 'removed_blocked', 'removed_other')"
_ROLLUP = "string_agg(DISTINCT coalesce({0}, '~'), ',' ORDER BY coalesce({0}, '~'))"


def current_qualification(r: Roles) -> DataFrame:
    return views.current_qualification(r["lead_qualifications"])


def current_per_qualifier(r: Roles) -> DataFrame:
    return views.current_per(r["lead_qualifications"], ["lead_id", "qualifier_name"], ["qualified_at", "id"]).select("lead_id", "qualifier_name", "qualified", "qualified_at", "id")


def in_campaign(r: Roles) -> DataFrame:
    return views.in_campaign(r["campaign_members"], r["leads"], r["campaigns"])


def staged_for_upload(r: Roles) -> DataFrame:
    return views.staged(r["campaign_members"], r["leads"], r["campaigns"])


def replied(r: Roles) -> DataFrame:
    return views.replied(r["campaign_members"], r["leads"], r["campaigns"])


def qualified_no_campaign(r: Roles) -> DataFrame:
    """Qualified leads without an upload in flight; every lead has some membership."""
    return views.qualified_no_campaign(r["lead_qualifications"], r["leads"], r["campaign_members"].where("status = 'uploaded'"))


def provenance(r: Roles) -> DataFrame:
    return views.provenance(r["leads"], r["lead_sources"]).withColumns({c: views.as_text(c) for c in ("source_types", "source_labels")})


def campaign_funnel(r: Roles) -> DataFrame:
    return views.campaign_funnel(r["campaigns"], r["campaign_members"])


def leads_at_companies(r: Roles) -> DataFrame:
    return views.leads_at_companies(r["leads"], r["companies"])


def pipeline_state(r: Roles) -> DataFrame:
    out = views.pipeline_state(r["leads"], r["lead_sources"], r["lead_qualifications"], r["star_tags"], r["campaign_members"], r["campaigns"])
    return out.withColumns({c: views.as_text(c) for c in ("source_types", "source_labels", "tags", "active_campaigns")})


def engager_report(r: Roles) -> DataFrame:
    return views.engager_report(r["posts"], r["post_engagements"], r["leads"])


def pending_removals(r: Roles) -> DataFrame:
    return views.pending_removals(r["campaign_members"], r["lead_qualifications"], r["leads"], r["campaigns"])


def upcoming_meeting(r: Roles) -> DataFrame:
    o = r.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("lead_id"), F.col("o_orderdate").alias("scheduled_at"))
    return views.upcoming(o, "lead_id", "scheduled_at", AS_OF)


def deal_leads(r: Roles) -> DataFrame:
    return views.deal_leads(r["leads"], r["companies"], r["company_deals"]).withColumns({c: views.as_text(c) for c in ("deal_ids", "deal_companies")})


def active_deal_companies(r: Roles) -> DataFrame:
    return views.active_deal_companies(r["company_deals"]).withColumn("deal_ids", views.as_text("deal_ids"))


def deleted_deals(r: Roles) -> DataFrame:
    return views.deleted_deals(r["company_deals"])


def held_by_policy(r: Roles) -> DataFrame:
    return views.held_by_policy(r["lead_qualifications"], r["leads"], "policy", "active_deal_dq_v1.0")


def _related(r: Roles) -> DataFrame:
    return r["companies"].select(F.col("id").alias("company_id"), F.when(F.col("id") % 3 == 0, "competitor").otherwise("partner").alias("relationship"), F.concat(F.lit("scope-"), F.col("country")).alias("scope"), F.lit("list").alias("source"), F.lit(None).cast("string").alias("notes"))


def leads_at_competitors(r: Roles) -> DataFrame:
    return views.leads_at_related(r["leads"], r["companies"], _related(r), "competitor")


def vendor_customers(r: Roles) -> DataFrame:
    l = r.raw("lineitem").select(F.col("l_suppkey").alias("vendor"), (F.col("l_partkey") % 10).alias("customer")).groupBy("vendor", "customer").agg(F.count("*").alias("n"))
    return views.vendor_customers(l, r["companies"], _related(r))


def latest_signal_null_equal(r: Roles) -> DataFrame:
    return views.latest_signal(r["signals"], ["lead_id", "enricher_name"])


def monitoring_conflicts(r: Roles) -> DataFrame:
    src = r["lead_sources"].select("lead_id", F.concat(F.lit("SUPPLIER#"), F.lpad((F.col("lead_id") % 7).cast("string"), 9, "0"), F.lit(" staff")).alias("label"))
    c = r["companies"].withColumn("name", F.upper("name"))
    decided = r["lead_qualifications"].select(F.col("lead_id").alias("company_id"), F.col("qualifier_name").alias("value"), "reason", F.lit("op").alias("decided_by"), F.col("qualified_at").alias("decided_at"), "id")
    return views.monitoring_conflicts(c, src, "label", F.col("id") % 2 == 0, decided).drop("country", "linkedin_slug", "linkedin_url", "wanted")


def target_posts(r: Roles) -> DataFrame:
    targets = r["leads"].select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("lead_id"), F.when(F.col("id") % 2 == 1, F.col("id")).alias("company_id"))
    posts = r["posts"].select("id", F.when(F.col("id") % 3 != 0, F.col("poster_lead_id")).alias("poster_lead_id"), F.when(F.col("id") % 3 == 0, F.col("poster_lead_id")).alias("poster_company_id"), F.timestamp_seconds(F.col("id") * 1000).cast("timestamp_ntz").alias("posted_at"))
    return views.target_posts(targets, posts)


def collective_members(r: Roles) -> DataFrame:
    """Guests have an identity on file, hosts have none."""
    ids = r["memberships"].where("role = 'guest'").select(F.col("member_kind").alias("kind"), F.col("member_value").alias("value"), F.col("id").alias("lead_id"))
    return views.collective_members(r["memberships"], r["collectives"], ids)


def small_group_ties(r: Roles) -> DataFrame:
    return views.small_group_ties(collective_members(r), 60)


def match_states(r: Roles) -> DataFrame:
    m = r["leads"].select(F.lit("a").alias("a_kind"), F.col("id").alias("a_value"), F.lit("b").alias("b_kind"), (F.col("id") % 50).alias("b_value"), F.when(F.col("id") % 9 == 0, F.lit("x")).alias("rejected_at"))
    i = r["leads"].select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"), F.col("id").alias("value"), (F.col("id") % 10).alias("lead_id"))
    return views.match_states(m, i)


def hierarchy_root(r: Roles) -> DataFrame:
    """Nations hang below their region's first nation, those below nation 0."""
    n = r["collectives"].select("id", F.when(F.col("id") > 4, F.col("parent_id")).when(F.col("id") > 0, F.lit(0)).alias("up"))
    return joins.chain_roots(n, "id", "up")


def any_key_matches(r: Roles) -> DataFrame:
    """Leads meet companies by URL, else by name; the first that holds says how."""
    return joins.any_key_join(r["leads"].withColumnRenamed("id", "lead_id"), r["companies"].withColumnRenamed("id", "company"), ["lead_id"], ["company"], [
        ("url", F.regexp_replace(F.lower("current_company_url"), "/+$", ""), F.regexp_replace(F.lower("linkedin_url"), "/+$", "")),
        ("number", F.regexp_extract("name", r"(\d+)", 1), F.regexp_extract("name", r"(\d+)", 1)),
    ])


def prefix_matches(r: Roles) -> DataFrame:
    words = r.raw("part").select(F.col("p_type").alias("prefix"), F.length("p_type").alias("n")).groupBy("prefix").agg(F.count("*").alias("n_parts"))
    return joins.prefix_join(r.raw("part").select(F.col("p_partkey").alias("id"), F.concat("p_type", F.lit(" "), "p_brand").alias("text")), "text", words, "prefix").select("id", "prefix", "n_parts")


def overlapping_periods(r: Roles) -> DataFrame:
    """Engagement hours of one user that overlap a purchase's two hours."""
    e = r.raw("events").where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("v0"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("v1"))
    p = r.raw("events").where("event_type = 'purchase'").select(F.col("event_id").alias("buy_id"), "user_id", F.col("ts").alias("b0"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("b1"))
    return joins.overlap_join(e, "v0", "v1", p, "b0", "b1", ["user_id"], 7200).select("user_id", "view_id", "buy_id")


def no_verdict_not_in(r: Roles) -> DataFrame:
    tagged = r["star_tags"].where("tag = 'error'")
    return joins.not_in(r["leads"].select("id", "name"), "id", tagged, "lead_id")


def semi_and_anti(r: Roles) -> DataFrame:
    have = r["leads"].select("id", "name").join(r["star_tags"].where("tag = 'purchase'").select(F.col("lead_id").alias("id")), "id", "left_semi")
    return have.join(r["campaign_members"].select(F.col("lead_id").alias("id")), "id", "left_anti").select("id", "name")


def missing_engagement(r: Roles) -> DataFrame:
    """Posts with more likes than engagements held, the widest gap first."""
    n = r["post_engagements"].where("engagement_type = 'click'").groupBy(F.col("post_id").alias("id")).agg(F.count("*").alias("held"))
    p = r["posts"].join(n, "id", "left").select("id", F.coalesce("likes", F.lit(0)).cast("bigint").alias("likes"), F.coalesce("held", F.lit(0).cast("bigint")).alias("held"))
    return p.withColumn("gap", F.col("likes") - F.col("held")).where("gap >= 10").orderBy(F.desc("gap"), "id")


def tag_pivot(r: Roles) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    return r["star_tags"].groupBy("lead_id").agg(*[F.bool_or(F.col("tag") == k).alias(f"has_{k}") for k in kinds], F.count("*").alias("n_tags"))


def first_known_values(r: Roles) -> DataFrame:
    q = r["lead_qualifications"].select("lead_id", "id", "qualified_at", F.when(F.col("id") % 3 == 0, F.col("persona")).alias("persona"), F.when(F.col("id") % 5 == 0, F.col("amount")).alias("amount"))
    return latest.first_known(q, ["lead_id"], ["qualified_at", "id"], ["persona", "amount"])


def most_common_source(r: Roles) -> DataFrame:
    return latest.most_common(r["lead_sources"], ["lead_id"], "source_type")


def first_by_order(r: Roles) -> DataFrame:
    return r["lead_sources"].groupBy("lead_id").agg(F.min_by("source_label", F.struct("recorded_at", "id")).alias("first_label"))


def top_per_company(r: Roles) -> DataFrame:
    return latest.split_top(r["leads"].select("id", "company_id", "score"), ["company_id"], [F.desc("score"), F.asc("id")], 3, ["id"])


def first_by_list_order(r: Roles) -> DataFrame:
    order = ["purchase", "signup", "click"]
    t = r["star_tags"].withColumn("place", latest.in_list_order(F.col("tag"), order))
    return latest.ranked_first(t, ["lead_id"], [F.asc("place"), F.asc("tag")]).select("lead_id", "tag", F.col("place").cast("bigint").alias("place"))


def group_hold(r: Roles) -> DataFrame:
    """Companies one of whose leads was tagged `error`, with the members the hold passes on to."""
    held = r["leads"].join(r["star_tags"].where("tag = 'error'").select(F.col("lead_id").alias("id"), F.lit(True).alias("own")), "id", "left")
    g = held.groupBy("company_id").agg(F.bool_or("own").alias("hold"))
    return held.join(g.where("hold"), "company_id").select("id", "company_id", F.coalesce("own", F.lit(False)).alias("own"))


def having_gap(r: Roles) -> DataFrame:
    return r["lead_sources"].groupBy("lead_id").agg(F.countDistinct("source_type").alias("kinds"), F.count("*").alias("n")).where("n - kinds >= 5")


def relationship_score(r: Roles) -> DataFrame:
    return identity.relationship_score([(r["lead_sources"], "lead_id"), (r["post_engagements"], "lead_id"), (r["campaign_members"], "lead_id"), (r["star_tags"].where("tag <> 'error'"), "lead_id")])


def cache_latest_success(r: Roles) -> DataFrame:
    c = r["enrichment_calls"].where("success").withColumn("params", X.canonical_json(F.col("params")))
    return latest.latest_by(c, ["api", "params"], ["fetched_at", "id"])


def usage_by_day(r: Roles) -> DataFrame:
    return r["enrichment_calls"].groupBy(F.date_format("fetched_at", "yyyy-MM-dd").alias("day"), "api").agg(F.count("*").alias("calls"), F.count_if("success").alias("successes"), F.round(F.sum("cost"), 2).alias("cost"))


def json_key_exists(r: Roles) -> DataFrame:
    return r.raw("events").where(X.json_has_key(F.col("props"), "k")).groupBy("event_type").agg(F.count("*").alias("n"), F.max(F.get_json_object("props", "$.k").cast("bigint")).alias("greatest"))


def set_operations(r: Roles) -> DataFrame:
    """(sources united with engagements) without campaign members, and what all three share."""
    a, b, c = r["lead_sources"].select("lead_id"), r["post_engagements"].select("lead_id"), r["campaign_members"].select("lead_id")
    return a.union(b).distinct().exceptAll(c.distinct()).select("lead_id", F.lit("only").alias("part")).unionAll(a.intersect(b).intersect(c).select("lead_id", F.lit("all").alias("part")))


def upsert_fill(r: Roles) -> DataFrame:
    old = r["leads"].where("id % 3 <> 0").select("id", F.when(F.col("id") % 2 == 0, F.col("name")).alias("name"), F.col("score"))
    new = r["leads"].where("id % 5 <> 0").select("id", F.concat(F.lit("new "), "name").alias("name"), F.when(F.col("id") % 4 != 0, F.col("score") + 1).alias("score"))
    return writes.upsert(old, new, ["id"], {"name": writes.old_wins, "score": writes.new_wins}, action="action")


def upsert_counts(r: Roles) -> DataFrame:
    old = r["posts"].where("id % 2 = 0").select("id", "likes", F.lit(True).alias("seen"))
    new = r["posts"].where("id % 3 = 0").select("id", (F.col("likes") - 5 + F.col("id") % 10).alias("likes"), F.lit(False).alias("seen"))
    return writes.upsert(old, new, ["id"], {"likes": writes.greatest, "seen": writes.either})


def append_if_absent(r: Roles) -> DataFrame:
    old = r["lead_sources"].where("id % 2 = 0").select("lead_id", "source_type").distinct()
    new = r["lead_sources"].where("id % 2 = 1").select("lead_id", "source_type").distinct()
    return writes.append_absent(old, new, ["lead_id", "source_type"])


def reconcile_deleted(r: Roles) -> DataFrame:
    d = r["company_deals"].select("deal_id", "company_id", "is_deleted", "deleted_at")
    live = d.where("deal_id % 3 <> 0").select("deal_id").distinct()
    return writes.mark_missing(d, live, "deal_id", "is_deleted", "deleted_at", F.lit(AS_OF).cast("timestamp_ntz"))


def status_history(r: Roles) -> DataFrame:
    """Statuses with news for every third lead, the history given as text."""
    m = r["campaign_members"].groupBy("lead_id").agg(F.max("status").alias("status"), F.max("last_status_at").alias("at"))
    m = m.withColumn("history", F.array(F.struct(F.col("status").alias("value"), F.col("at"))))
    news = m.where("lead_id % 3 = 0").select("lead_id", F.lit("completed").alias("status"), F.lit(AS_OF).cast("timestamp_ntz").alias("at"))
    out = writes.append_history(m, news, "lead_id", "status", "at", "history")
    return out.select("lead_id", "status", F.array_join(F.transform("history", lambda h: h["value"]), ">").alias("path"), F.size("history").cast("bigint").alias("n"))


def membership_change_log(r: Roles) -> DataFrame:
    old = r["memberships"].where("id % 4 <> 0").select("id", "role", "member_state")
    new = r["memberships"].select("id", F.when(F.col("id") % 6 == 0, F.lit("speaker")).otherwise(F.col("role")).alias("role"), F.when(F.col("id") % 10 != 0, F.col("member_state")).alias("member_state"))
    return writes.change_log(old, new, ["id"], ["role", "member_state"])


def tag_removals(r: Roles) -> DataFrame:
    old = r["star_tags"]
    return writes.removals(old, old.where("lead_id % 3 <> 1"), ["lead_id", "tag"], F.lit("sweep"), F.lit("stale"), F.lit(AS_OF).cast("timestamp_ntz"))


def departures(r: Roles) -> DataFrame:
    listed = r["memberships"].where("id % 3 <> 0").select("collective_id", F.col("id").alias("member"), F.when(F.col("id") % 2 == 0, F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")).alias("left_at"))
    now = r["memberships"].where("id % 5 <> 0").select("collective_id", F.col("id").alias("member"))
    return writes.departures(listed, now, ["collective_id", "member"], "left_at", F.lit(AS_OF).cast("timestamp_ntz"))


def array_union_upsert(r: Roles) -> DataFrame:
    lists = lambda df: df.groupBy("lead_id").agg(F.collect_set("source_type").alias("kinds"))
    s = r["lead_sources"]
    u = writes.upsert(lists(s.where("id % 2 = 0")), lists(s.where("id % 2 = 1")), ["lead_id"], {"kinds": writes.union_of})
    return u.select("lead_id", F.array_join(F.array_sort("kinds"), ",").alias("kinds"))


def rules_classifier(r: Roles) -> DataFrame:
    spec = [
        {"if": "lead['score'] < 0 and 'BUILD' in lead['persona']", "qualified": False, "reason": "in debt"},
        {"if": "any(k in lead.get('persona', '').lower() for k in ['auto', 'furni']) and lead['score'] >= 1000", "qualified": True, "reason": "='seg ' + lead['persona'].lower()"},
        {"if": "lead['country'] in [1, 2, 3] or not lead['name']", "qualified": True, "reason": "near"},
    ]
    return rules.classify(r["leads"], spec, ["qualified", "reason"]).select("id", "qualified", "reason")


def sql_classifier(r: Roles) -> DataFrame:
    targets = r["leads"].select(F.col("id").alias("lead_id"))
    q = "SELECT t.lead_id, count(q.id) > 5 AS qualified, count(q.id) AS n FROM target_leads t LEFT JOIN verdicts q ON q.lead_id = t.lead_id AND q.qualified GROUP BY t.lead_id"
    return rules.classify_by_sql(r.spark, targets, q, {"verdicts": r["lead_qualifications"]})


def unclassified_leads(r: Roles) -> DataFrame:
    return rules.unclassified(r["leads"].select(F.col("id").alias("lead_id"), "name"), r["lead_qualifications"], "1-URGENT", "v1")


def constraint_violations(r: Roles) -> DataFrame:
    li, o = r.raw("lineitem"), r.raw("orders")
    return checks.counts({
        "unique line": checks.repeated_keys(li, ["l_orderkey", "l_linenumber"]),
        "order of a known lead": checks.orphans(o, "o_custkey", r["leads"].where("score >= 0"), "id"),
        "known status": checks.outside_domain(o, "o_orderstatus", ["F", "O"]),
        "priced": checks.not_positive(li.withColumn("x", F.col("l_quantity") - 3), "x"),
        "returned is finished": checks.not_implied(li, F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"),
        "exactly one subject": checks.not_exactly(r["company_deals"], ["company_id", "match_slug"], [1]),
        "ordered pair": checks.unordered_pairs(li, ["l_suppkey", "l_linenumber"], ["l_partkey", "l_orderkey"]),
        "not itself": checks.self_links(li, "l_suppkey", "l_partkey"),
        "formed name": checks.malformed(r["companies"], F.col("linkedin_slug").rlike("^supplier-[0-9]+[02468]$")),
    })


def claims_settled(r: Roles) -> DataFrame:
    """Every signal claims its payload for its lead, in order of its id; a few payloads have an owner."""
    s = r["signals"].where("lead_id is not null")
    claims = s.select("lead_id", F.col("enricher_name").alias("kind"), F.when(F.col("id") % 13 != 0, F.col("payload")).alias("value"), F.col("id").alias("seq"))
    owned = s.where("id % 40 = 0").groupBy(F.col("enricher_name").alias("kind"), F.col("payload").alias("value")).agg(F.min("lead_id").alias("lead_id"))
    return identity.settle_claims(owned, claims).select("lead_id", "kind", "value", "seq", "owner", "outcome")


def keeper_choice(r: Roles) -> DataFrame:
    """In each company the lead with the longest history stays, the smallest id of several."""
    j = r["leads"].select("id", "company_id").join(relationship_score(r).withColumnRenamed("lead_id", "id"), "id", "left")
    return j.groupBy("company_id").agg(F.max_by("id", F.struct(F.coalesce("score", F.lit(0)), (-F.col("id")).alias("n"))).alias("keeper"), F.count("*").alias("n_leads"))


def frequent_engagers(r: Roles) -> DataFrame:
    """Per poster, people with at least three engagements, counted by persona in one pass."""
    e = r["post_engagements"].join(r["posts"].select(F.col("id").alias("post_id"), "poster_lead_id"), "post_id").groupBy("poster_lead_id", "lead_id").agg(F.count("*").alias("n")).where("n >= 3")
    j = e.join(r["leads"].select(F.col("id").alias("lead_id"), "persona"), "lead_id")
    return j.groupBy("poster_lead_id").agg(F.count("*").alias("people"), F.count_if(F.col("persona") == "BUILDING").alias("building"), F.count_if(F.col("persona") == "MACHINERY").alias("machinery"), F.sum("n").alias("engagements"))


def distinct_two_sided(r: Roles) -> DataFrame:
    """Per collective: members, hosts and the parents' other collectives, distinct over two joins."""
    m = r["memberships"].groupBy("collective_id").agg(F.count("*").alias("members"), F.count_if(F.col("role") == "host").alias("hosts"))
    sib = r["collectives"].select("parent_id", F.col("id").alias("other"))
    s = r["collectives"].join(sib, "parent_id").where("other <> id").groupBy("id").agg(F.countDistinct("other").alias("siblings"))
    return r["collectives"].select("id", "name").join(m, F.col("id") == F.col("collective_id"), "left").join(s, "id", "left").select("id", "name", "members", "hosts", "siblings")


QUERIES = {f.__name__: f for f in [
    current_qualification, current_per_qualifier, in_campaign, staged_for_upload, replied, qualified_no_campaign, provenance, campaign_funnel, leads_at_companies, pipeline_state, engager_report, pending_removals, upcoming_meeting, deal_leads, active_deal_companies,
    deleted_deals, held_by_policy, vendor_customers, latest_signal_null_equal, monitoring_conflicts, target_posts, collective_members, small_group_ties, match_states, hierarchy_root, any_key_matches, prefix_matches, overlapping_periods, no_verdict_not_in, semi_and_anti,
    missing_engagement, tag_pivot, first_known_values, most_common_source, first_by_order, top_per_company, first_by_list_order, group_hold, having_gap, relationship_score, cache_latest_success, usage_by_day, json_key_exists, set_operations, upsert_fill, upsert_counts,
    append_if_absent, reconcile_deleted, status_history, membership_change_log, tag_removals, departures, array_union_upsert, rules_classifier, sql_classifier, unclassified_leads, constraint_violations, claims_settled, keeper_choice, frequent_engagers, distinct_two_sided,
    leads_at_competitors,
]}

_MEMBER = "m AS (SELECT m.*, l.name, l.current_title, l.current_company, l.country, l.linkedin_url, c.name AS campaign, c.channel FROM r_campaign_members m JOIN r_leads l ON l.id = m.lead_id JOIN r_campaigns c ON c.id = m.campaign_id)"
_SCORE = "s AS (SELECT lead_id, CAST(count(*) AS BIGINT) AS score FROM (SELECT lead_id FROM r_lead_sources UNION ALL SELECT lead_id FROM r_post_engagements UNION ALL SELECT lead_id FROM r_campaign_members UNION ALL SELECT lead_id FROM r_star_tags WHERE tag <> 'error') WHERE lead_id IS NOT NULL GROUP BY lead_id)"
_CM = "cm AS (SELECT m.id AS membership_id, m.collective_id, c.kind, c.name AS collective_name, c.parent_id, c.operator_id, c.provider, CASE WHEN m.role = 'guest' THEN m.id END AS lead_id, m.member_kind, m.member_value, m.role, m.member_state FROM r_memberships m JOIN r_collectives c ON c.id = m.collective_id)"
_SQL = {
    "current_qualification": f"WITH {_CURRENT} SELECT * EXCLUDE (rn) FROM cur",
    "current_per_qualifier": "SELECT lead_id, qualifier_name, qualified, qualified_at, id FROM (SELECT *, row_number() OVER (PARTITION BY lead_id, qualifier_name ORDER BY qualified_at DESC, id DESC) AS rn FROM r_lead_qualifications) WHERE rn = 1",
    "in_campaign": f"WITH {_MEMBER} SELECT lead_id, name, current_title, current_company, country, campaign, channel, status AS campaign_status, last_status_at, uploaded_at, staged_at FROM m WHERE status NOT IN {_NOT_OVER}",
    "staged_for_upload": f"WITH {_MEMBER} SELECT lead_id, name, current_title, current_company, linkedin_url, country, campaign, channel, staged_at FROM m WHERE status = 'staged'",
    "replied": f"WITH {_MEMBER} SELECT lead_id, name, current_title, current_company, linkedin_url, campaign, last_status_at AS replied_at FROM m WHERE status IN ('replied', 'meeting_booked')",
    "qualified_no_campaign": f"WITH {_CURRENT} SELECT cur.lead_id, l.name, l.current_title, l.current_company, l.country, cur.persona, cur.seniority, qualifier_version, qualified_at FROM cur JOIN r_leads l ON l.id = cur.lead_id WHERE qualified AND NOT EXISTS (SELECT 1 FROM r_campaign_members m WHERE m.lead_id = cur.lead_id AND m.status = 'uploaded')",
    "provenance": f"SELECT l.id AS lead_id, l.name, l.linkedin_url, {_ROLLUP.format('source_type')} AS source_types, {_ROLLUP.format('source_label')} AS source_labels, min(recorded_at) AS first_seen_at, max(recorded_at) AS last_seen_at, count(*) AS source_count FROM r_leads l LEFT JOIN r_lead_sources s ON s.lead_id = l.id GROUP BY ALL",
    "campaign_funnel": "SELECT c.name AS campaign, c.channel, m.status, count(*) AS n FROM r_campaigns c LEFT JOIN r_campaign_members m ON m.campaign_id = c.id GROUP BY ALL",
    "leads_at_companies": f"WITH {_AT} SELECT lead_id, linkedin_url AS lead_linkedin_url, name AS lead_name, current_title, company, company_name, linkedin_slug AS company_slug FROM k",
    "pipeline_state": f"""WITH {_CURRENT} SELECT l.id AS lead_id, l.name, l.linkedin_url, l.current_title, l.current_company, l.country,
        (SELECT {_ROLLUP.format('source_type')} FROM r_lead_sources s WHERE s.lead_id = l.id) AS source_types, (SELECT {_ROLLUP.format('source_label')} FROM r_lead_sources s WHERE s.lead_id = l.id) AS source_labels,
        (SELECT min(recorded_at) FROM r_lead_sources s WHERE s.lead_id = l.id) AS first_seen_at, (SELECT {_ROLLUP.format('tag')} FROM r_star_tags t WHERE t.lead_id = l.id) AS tags,
        cur.qualifier_name, cur.qualifier_version, cur.qualified, cur.persona AS verdict_persona, cur.qualified_at,
        (SELECT {_ROLLUP.format('c.name')} FROM r_campaign_members m JOIN r_campaigns c ON c.id = m.campaign_id WHERE m.lead_id = l.id AND m.status NOT IN {_NOT_OVER}) AS active_campaigns
        FROM r_leads l LEFT JOIN cur ON cur.lead_id = l.id""",
    "engager_report": "SELECT p.poster_lead_id, t.name AS poster_name, t.linkedin_url AS poster_linkedin_url, coalesce(e.persona, '(unqualified)') AS engager_persona, count(DISTINCT pe.lead_id) AS engager_count, count(DISTINCT p.id) AS posts_engaged FROM r_posts p JOIN r_leads t ON t.id = p.poster_lead_id JOIN r_post_engagements pe ON pe.post_id = p.id JOIN r_leads e ON e.id = pe.lead_id WHERE pe.lead_id <> p.poster_lead_id GROUP BY p.poster_lead_id, t.name, t.linkedin_url, e.persona",
    "pending_removals": f"WITH {_CURRENT} SELECT m.id AS campaign_member_id, m.lead_id, m.campaign_id, m.status, m.uploaded_at, m.last_status_at, l.linkedin_url, l.name AS lead_name, c.name AS campaign_name, cur.qualified, cur.persona, cur.disqualified_reason, cur.qualifier_name, cur.qualifier_version, cur.qualified_at, CASE WHEN m.status = 'pending_removal' THEN 'manual' ELSE 'auto' END AS removal_source FROM r_campaign_members m JOIN r_leads l ON l.id = m.lead_id JOIN r_campaigns c ON c.id = m.campaign_id LEFT JOIN cur ON cur.lead_id = m.lead_id WHERE m.status = 'pending_removal' OR (m.status IN ('staged', 'uploaded', 'connection_sent', 'connected', 'message_sent') AND cur.qualified IS FALSE)",
    "upcoming_meeting": f"SELECT o_custkey AS lead_id, o_orderkey AS id, o_orderdate AS scheduled_at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey DESC) AS rn FROM orders WHERE o_orderdate >= TIMESTAMP '{AS_OF}') WHERE rn = 1",
    "deal_leads": f"""WITH {_AT}, d AS (SELECT * FROM r_company_deals WHERE is_open OR is_won), h AS (
        SELECT k.lead_id, k.linkedin_url, k.name, k.current_title, d.company_name, d.deal_id, d.is_won, d.is_open, d.is_deleted, d.stage_name FROM k JOIN d ON d.company_id = k.company
        UNION SELECT k.lead_id, k.linkedin_url, k.name, k.current_title, d.company_name, d.deal_id, d.is_won, d.is_open, d.is_deleted, d.stage_name FROM k JOIN d ON d.match_slug = k.linkedin_slug)
        SELECT lead_id, linkedin_url, name, current_title, bool_or(is_won) AS is_customer, bool_or(is_open) AS has_open_deal, bool_or(is_deleted) AS has_deleted_deal, max(stage_name) FILTER (WHERE is_open) AS open_stage, string_agg(DISTINCT deal_id, ',' ORDER BY deal_id) AS deal_ids, string_agg(DISTINCT company_name, ',' ORDER BY company_name) AS deal_companies FROM h GROUP BY ALL""",
    "active_deal_companies": "SELECT company_id, match_slug, max(company_name) AS company_name, bool_or(is_won) AS is_customer, bool_or(is_open) AS has_open_deal, bool_or(is_deleted) AS has_deleted_deal, max(stage_name) FILTER (WHERE is_open) AS open_stage, string_agg(DISTINCT deal_id, ',' ORDER BY deal_id) AS deal_ids, max(synced_at) AS last_synced_at FROM r_company_deals WHERE is_open OR is_won GROUP BY company_id, match_slug",
    "deleted_deals": "SELECT deal_id, company_id, company_name, match_slug, match_domain, stage_name, is_open, is_won, amount, deleted_at, synced_at FROM r_company_deals WHERE is_deleted AND (is_open OR is_won)",
    "held_by_policy": f"WITH {_CURRENT}, real AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY qualified_at DESC, id DESC) AS rn FROM r_lead_qualifications WHERE qualifier_name <> 'policy') WHERE rn = 1 AND qualified) SELECT cur.lead_id, l.linkedin_url, l.name, l.current_title, l.current_company, cur.reason AS deal_reason, CAST(cur.full_result -> '$.deal_companies' AS VARCHAR) AS deal_companies, cur.full_result ->> '$.open_stage' AS open_stage, cur.qualified_at AS held_since, real.persona AS would_be_persona, real.qualifier_name AS real_qualifier, real.qualifier_version AS real_qualifier_version FROM cur JOIN real USING (lead_id) JOIN r_leads l ON l.id = cur.lead_id WHERE cur.qualifier_name = 'policy' AND cur.qualifier_version = 'active_deal_dq_v1.0' AND NOT cur.qualified",
    "leads_at_competitors": f"WITH {_AT} SELECT k.lead_id, k.linkedin_url AS lead_linkedin_url, k.name AS lead_name, k.current_title, k.company AS company_id, k.company_name, k.linkedin_slug AS company_slug, 'scope-' || c.country AS related_scope, 'list' AS tag_source, CAST(NULL AS VARCHAR) AS related_notes FROM k JOIN r_companies c ON c.id = k.company WHERE c.id % 3 = 0",
    "vendor_customers": "SELECT v.vendor, v.customer, v.n, c.name AS customer_name, c.linkedin_url AS customer_linkedin_url, w.name AS vendor_name, CASE WHEN w.id % 3 = 0 THEN 'scope-' || w.country END AS vendor_scope FROM (SELECT l_suppkey AS vendor, l_partkey % 10 AS customer, count(*) AS n FROM lineitem GROUP BY ALL) v JOIN r_companies c ON c.id = v.customer JOIN r_companies w ON w.id = v.vendor",
    "latest_signal_null_equal": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY lead_id, enricher_name ORDER BY enriched_at DESC, id DESC) AS rn FROM r_signals) WHERE rn = 1",
    "monitoring_conflicts": "WITH c AS (SELECT id, upper(name) AS name FROM r_companies), d AS (SELECT * FROM r_lead_qualifications QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY qualified_at DESC, id DESC) = 1), s AS (SELECT lead_id, 'SUPPLIER#' || lpad(CAST(lead_id % 7 AS VARCHAR), 9, '0') || ' staff' AS label FROM r_lead_sources), h AS (SELECT c.id, c.name, (SELECT count(DISTINCT lead_id) FROM s WHERE s.label LIKE c.name || '%') AS reps_held FROM c) SELECT h.id, h.name, reps_held, CASE WHEN h.id % 2 = 0 AND reps_held = 0 THEN 'wanted_but_empty' WHEN h.id % 2 <> 0 AND reps_held > 0 THEN 'held_but_unwanted' END AS conflict, d.qualifier_name AS monitoring_decision, d.reason AS monitoring_reason, CASE WHEN d.lead_id IS NOT NULL THEN 'op' END AS monitoring_decided_by, d.qualified_at AS monitoring_decided_at FROM h LEFT JOIN d ON d.lead_id = h.id",
    "target_posts": "WITH t AS (SELECT id, CASE WHEN id % 2 = 0 THEN id END AS lead_id, CASE WHEN id % 2 = 1 THEN id END AS company_id FROM r_leads), p AS (SELECT id, CASE WHEN id % 3 <> 0 THEN poster_lead_id END AS poster_lead_id, CASE WHEN id % 3 = 0 THEN poster_lead_id END AS poster_company_id, make_timestamp(id * 1000000000) AS posted_at FROM r_posts) SELECT t.*, (SELECT count(*) FROM p WHERE p.poster_lead_id = t.lead_id OR p.poster_company_id = t.company_id) AS posts_held, (SELECT max(posted_at) FROM p WHERE p.poster_lead_id = t.lead_id OR p.poster_company_id = t.company_id) AS last_post_at FROM t",
    "collective_members": f"WITH {_CM} SELECT * FROM cm",
    "small_group_ties": f"WITH {_CM} SELECT cm.lead_id, cm.operator_id, cm.collective_id, cm.collective_name AS group_name, g.group_size FROM cm JOIN (SELECT collective_id, count(*) + 1 AS group_size FROM cm WHERE member_state = 'member' AND kind = 'group' GROUP BY collective_id HAVING count(*) + 1 < 60) g USING (collective_id) WHERE cm.member_state = 'member' AND cm.kind = 'group' AND cm.lead_id IS NOT NULL",
    "match_states": "WITH m AS (SELECT 'a' AS a_kind, id AS a_value, 'b' AS b_kind, id % 50 AS b_value, CASE WHEN id % 9 = 0 THEN 'x' END AS rejected_at FROM r_leads), i AS (SELECT CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS kind, id AS value, id % 10 AS lead_id FROM r_leads) SELECT m.*, x.lead_id AS a_lead_id, y.lead_id AS b_lead_id, CASE WHEN rejected_at IS NOT NULL THEN 'rejected' WHEN x.lead_id = y.lead_id THEN 'proven' ELSE 'open' END AS state FROM m LEFT JOIN i x ON x.kind = a_kind AND x.value = a_value LEFT JOIN i y ON y.kind = b_kind AND y.value = b_value",
    "hierarchy_root": "WITH RECURSIVE n AS (SELECT id, CASE WHEN id > 4 THEN parent_id WHEN id > 0 THEN 0 END AS up FROM r_collectives), t AS (SELECT id, id AS root FROM n WHERE up IS NULL UNION ALL SELECT n.id, t.root FROM n JOIN t ON n.up = t.id) SELECT id, root FROM t",
    "any_key_matches": "SELECT l.id AS lead_id, c.id AS company, CASE WHEN regexp_replace(lower(l.current_company_url), '/+$', '') = regexp_replace(lower(c.linkedin_url), '/+$', '') THEN 'url' ELSE 'number' END AS matched_by FROM r_leads l JOIN r_companies c ON regexp_replace(lower(l.current_company_url), '/+$', '') = regexp_replace(lower(c.linkedin_url), '/+$', '') OR regexp_extract(l.name, '(\\d+)', 1) = regexp_extract(c.name, '(\\d+)', 1)",
    "prefix_matches": "SELECT p.p_partkey AS id, t.p_type AS prefix, t.n_parts FROM part p JOIN (SELECT p_type, count(*) AS n_parts FROM part GROUP BY ALL) t ON starts_with(p.p_type || ' ' || p.p_brand, t.p_type)",
    "overlapping_periods": "SELECT v.user_id, v.event_id AS view_id, b.event_id AS buy_id FROM events v JOIN events b ON v.user_id = b.user_id AND v.ts < b.ts + INTERVAL 2 HOUR AND b.ts < v.ts + INTERVAL 1 HOUR WHERE v.event_type = 'view' AND b.event_type = 'purchase'",
    "no_verdict_not_in": "SELECT id, name FROM r_leads WHERE id NOT IN (SELECT lead_id FROM r_star_tags WHERE tag = 'error')",
    "semi_and_anti": "SELECT id, name FROM r_leads l WHERE EXISTS (SELECT 1 FROM r_star_tags t WHERE t.lead_id = l.id AND tag = 'purchase') AND NOT EXISTS (SELECT 1 FROM r_campaign_members m WHERE m.lead_id = l.id)",
    "missing_engagement": "SELECT p.id, CAST(coalesce(p.likes, 0) AS BIGINT) AS likes, count(e.id) AS held, CAST(coalesce(p.likes, 0) AS BIGINT) - count(e.id) AS gap FROM r_posts p LEFT JOIN r_post_engagements e ON e.post_id = p.id AND e.engagement_type = 'click' GROUP BY p.id, p.likes HAVING coalesce(p.likes, 0) - count(e.id) >= 10",
    "tag_pivot": "SELECT lead_id, " + ", ".join(f"bool_or(tag = '{k}') AS has_{k}" for k in ["click", "error", "purchase", "signup", "view"]) + ", count(*) AS n_tags FROM r_star_tags GROUP BY lead_id",
    "first_known_values": "SELECT lead_id, (list(persona ORDER BY qualified_at DESC, id DESC) FILTER (id % 3 = 0))[1] AS persona, (list(amount ORDER BY qualified_at DESC, id DESC) FILTER (id % 5 = 0))[1] AS amount FROM r_lead_qualifications GROUP BY lead_id",
    "most_common_source": "SELECT lead_id, source_type, n FROM (SELECT lead_id, source_type, count(*) AS n, row_number() OVER (PARTITION BY lead_id ORDER BY count(*) DESC, source_type) AS rn FROM r_lead_sources GROUP BY lead_id, source_type) WHERE rn = 1",
    "first_by_order": "SELECT lead_id, (list(source_label ORDER BY recorded_at, id))[1] AS first_label FROM r_lead_sources GROUP BY lead_id",
    "top_per_company": "SELECT id, company_id, score, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, id) <= 3 AS is_top FROM r_leads",
    "first_by_list_order": "WITH t AS (SELECT *, coalesce(list_position(['purchase', 'signup', 'click'], tag), 4) AS place FROM r_star_tags) SELECT lead_id, tag, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY place, tag) AS rn FROM t) WHERE rn = 1",
    "group_hold": "WITH h AS (SELECT l.id, l.company_id, t.lead_id IS NOT NULL AS own FROM r_leads l LEFT JOIN r_star_tags t ON t.lead_id = l.id AND t.tag = 'error') SELECT id, company_id, own FROM h WHERE company_id IN (SELECT company_id FROM h GROUP BY company_id HAVING bool_or(own))",
    "having_gap": "SELECT lead_id, count(DISTINCT source_type) AS kinds, count(*) AS n FROM r_lead_sources GROUP BY lead_id HAVING count(*) - count(DISTINCT source_type) >= 5",
    "relationship_score": f"WITH {_SCORE} SELECT * FROM s",
    "cache_latest_success": "SELECT id, api, '{\"k\":\"' || (params ->> 'k') || '\"}' AS params, success, cost, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY api, params ->> 'k' ORDER BY fetched_at DESC, id DESC) AS rn FROM r_enrichment_calls WHERE success) WHERE rn = 1",
    "usage_by_day": "SELECT strftime(fetched_at, '%Y-%m-%d') AS day, api, count(*) AS calls, count(*) FILTER (success) AS successes, round(sum(cost), 2) AS cost FROM r_enrichment_calls GROUP BY ALL",
    "json_key_exists": "SELECT event_type, count(*) AS n, max(CAST(props ->> 'k' AS BIGINT)) AS greatest FROM events WHERE json_exists(props, '$.k') GROUP BY event_type",
    "set_operations": "SELECT lead_id, 'only' AS part FROM (SELECT lead_id FROM r_lead_sources UNION SELECT lead_id FROM r_post_engagements EXCEPT SELECT lead_id FROM r_campaign_members) UNION ALL SELECT lead_id, 'all' FROM (SELECT lead_id FROM r_lead_sources INTERSECT SELECT lead_id FROM r_post_engagements INTERSECT SELECT lead_id FROM r_campaign_members)",
    "upsert_fill": "WITH o AS (SELECT id, CASE WHEN id % 2 = 0 THEN name END AS name, score, 1 AS h FROM r_leads WHERE id % 3 <> 0), n AS (SELECT id, 'new ' || name AS name, CASE WHEN id % 4 <> 0 THEN score + 1 END AS score, 1 AS h FROM r_leads WHERE id % 5 <> 0) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.h = 1 AND n.h = 1 THEN coalesce(o.name, n.name) WHEN o.h = 1 THEN o.name ELSE n.name END AS name, CASE WHEN o.h = 1 AND n.h = 1 THEN coalesce(n.score, o.score) WHEN o.h = 1 THEN o.score ELSE n.score END AS score, CASE WHEN o.h IS NULL THEN 'insert' WHEN n.h IS NULL THEN 'none' ELSE 'update' END AS action FROM o FULL JOIN n ON o.id = n.id",
    "upsert_counts": "WITH o AS (SELECT id, likes, true AS seen FROM r_posts WHERE id % 2 = 0), n AS (SELECT id, likes - 5 + id % 10 AS likes, false AS seen FROM r_posts WHERE id % 3 = 0) SELECT coalesce(o.id, n.id) AS id, greatest(o.likes, n.likes) AS likes, coalesce(o.seen, false) OR coalesce(n.seen, false) AS seen FROM o FULL JOIN n ON o.id = n.id",
    "append_if_absent": "SELECT DISTINCT lead_id, source_type FROM r_lead_sources",
    "reconcile_deleted": f"SELECT deal_id, company_id, CASE WHEN NOT is_deleted AND deal_id % 3 = 0 THEN true ELSE is_deleted END AS is_deleted, CASE WHEN NOT is_deleted AND deal_id % 3 = 0 THEN TIMESTAMP '{AS_OF}' ELSE deleted_at END AS deleted_at FROM r_company_deals",
    "status_history": "WITH m AS (SELECT lead_id, max(status) AS s FROM r_campaign_members GROUP BY lead_id) SELECT lead_id, CASE WHEN lead_id % 3 = 0 THEN 'completed' ELSE s END AS status, CASE WHEN lead_id % 3 = 0 AND s IS DISTINCT FROM 'completed' THEN s || '>completed' ELSE s END AS path, CASE WHEN lead_id % 3 = 0 AND s IS DISTINCT FROM 'completed' THEN 2 ELSE 1 END::BIGINT AS n FROM m",
    "membership_change_log": "WITH n AS (SELECT id, CASE WHEN id % 6 = 0 THEN 'speaker' ELSE role END AS role, CASE WHEN id % 10 <> 0 THEN member_state END AS member_state FROM r_memberships), o AS (SELECT id, role, member_state FROM r_memberships WHERE id % 4 <> 0), u AS (SELECT n.id, 'role' AS field, o.role AS old_value, n.role AS new_value FROM n LEFT JOIN o ON o.id = n.id UNION ALL SELECT n.id, 'member_state', o.member_state, n.member_state FROM n LEFT JOIN o ON o.id = n.id) SELECT * FROM u WHERE old_value IS DISTINCT FROM new_value",
    "tag_removals": f"SELECT *, 'sweep' AS removed_by, 'stale' AS removed_reason, TIMESTAMP '{AS_OF}' AS removed_at FROM r_star_tags WHERE lead_id % 3 = 1",
    "departures": f"WITH l AS (SELECT collective_id, id AS member, CASE WHEN id % 2 = 0 THEN TIMESTAMP '1997-01-01 00:00:00' END AS left_at FROM r_memberships WHERE id % 3 <> 0), n AS (SELECT collective_id, id AS member FROM r_memberships WHERE id % 5 <> 0) SELECT coalesce(l.collective_id, n.collective_id) AS collective_id, coalesce(l.member, n.member) AS member, CASE WHEN n.member IS NOT NULL THEN NULL ELSE coalesce(l.left_at, TIMESTAMP '{AS_OF}') END AS left_at FROM l FULL JOIN n ON l.member = n.member AND l.collective_id = n.collective_id",
    "array_union_upsert": f"SELECT lead_id, {_ROLLUP.format('source_type')} AS kinds FROM r_lead_sources GROUP BY lead_id",
    "rules_classifier": "SELECT id, CASE WHEN score < 0 AND contains(persona, 'BUILD') THEN false WHEN (contains(lower(persona), 'auto') OR contains(lower(persona), 'furni')) AND score >= 1000 THEN true WHEN country IN (1, 2, 3) OR coalesce(name, '') = '' THEN true ELSE false END AS qualified, CASE WHEN score < 0 AND contains(persona, 'BUILD') THEN 'in debt' WHEN (contains(lower(persona), 'auto') OR contains(lower(persona), 'furni')) AND score >= 1000 THEN 'seg ' || lower(persona) WHEN country IN (1, 2, 3) OR coalesce(name, '') = '' THEN 'near' ELSE 'no rule matched' END AS reason FROM r_leads",
    "sql_classifier": "SELECT l.id AS lead_id, count(q.id) > 5 AS qualified, count(q.id) AS n FROM r_leads l LEFT JOIN r_lead_qualifications q ON q.lead_id = l.id AND q.qualified GROUP BY l.id",
    "unclassified_leads": "SELECT id AS lead_id, name FROM r_leads l WHERE NOT EXISTS (SELECT 1 FROM r_lead_qualifications q WHERE q.lead_id = l.id AND qualifier_name = '1-URGENT' AND qualifier_version = 'v1')",
    "constraint_violations": """SELECT 'unique line' AS rule, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS n_broken
        UNION ALL SELECT 'order of a known lead', (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM r_leads l WHERE l.id = o_custkey AND l.score >= 0))
        UNION ALL SELECT 'known status', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))
        UNION ALL SELECT 'priced', (SELECT count(*) FROM lineitem WHERE l_quantity - 3 <= 0)
        UNION ALL SELECT 'returned is finished', (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'F')
        UNION ALL SELECT 'exactly one subject', (SELECT count(*) FROM r_company_deals WHERE (company_id IS NOT NULL)::INT + (match_slug IS NOT NULL)::INT <> 1)
        UNION ALL SELECT 'ordered pair', (SELECT count(*) FROM lineitem WHERE NOT (l_suppkey < l_partkey OR (l_suppkey = l_partkey AND l_linenumber < l_orderkey)))
        UNION ALL SELECT 'not itself', (SELECT count(*) FROM lineitem WHERE l_suppkey = l_partkey)
        UNION ALL SELECT 'formed name', (SELECT count(*) FROM r_companies WHERE NOT regexp_matches(linkedin_slug, '^supplier-[0-9]+[02468]$'))""",
    "claims_settled": """WITH s AS (SELECT * FROM r_signals WHERE lead_id IS NOT NULL), c AS (SELECT lead_id, enricher_name AS kind, CASE WHEN id % 13 <> 0 THEN payload END AS value, id AS seq FROM s),
        o AS (SELECT enricher_name AS kind, payload AS value, min(lead_id) AS h FROM s WHERE id % 40 = 0 GROUP BY ALL), f AS (SELECT kind, value, min(seq) AS at, arg_min(lead_id, seq) AS h FROM c WHERE value IS NOT NULL GROUP BY ALL)
        SELECT c.*, CASE WHEN c.value IS NOT NULL THEN coalesce(o.h, f.h) END AS owner, CASE WHEN c.value IS NULL THEN 'empty' WHEN o.h IS NULL AND c.seq = f.at THEN 'inserted' WHEN c.lead_id = coalesce(o.h, f.h) THEN 'ours' ELSE 'duplicate' END AS outcome
        FROM c LEFT JOIN o USING (kind, value) LEFT JOIN f USING (kind, value)""",
    "keeper_choice": f"WITH {_SCORE} SELECT company_id, id AS keeper, n_leads FROM (SELECT l.company_id, l.id, count(*) OVER (PARTITION BY company_id) AS n_leads, row_number() OVER (PARTITION BY company_id ORDER BY coalesce(s.score, 0) DESC, l.id) AS rn FROM r_leads l LEFT JOIN s ON s.lead_id = l.id) WHERE rn = 1",
    "frequent_engagers": "WITH e AS (SELECT p.poster_lead_id, x.lead_id, count(*) AS n FROM r_post_engagements x JOIN r_posts p ON p.id = x.post_id GROUP BY ALL HAVING count(*) >= 3) SELECT poster_lead_id, count(*) AS people, count(*) FILTER (persona = 'BUILDING') AS building, count(*) FILTER (persona = 'MACHINERY') AS machinery, CAST(sum(n) AS BIGINT) AS engagements FROM e JOIN r_leads l ON l.id = e.lead_id GROUP BY poster_lead_id",
    "distinct_two_sided": "SELECT c.id, c.name, (SELECT nullif(count(*), 0) FROM r_memberships m WHERE m.collective_id = c.id) AS members, (SELECT CASE WHEN count(*) > 0 THEN count(*) FILTER (role = 'host') END FROM r_memberships m WHERE m.collective_id = c.id) AS hosts, (SELECT nullif(count(DISTINCT o.id), 0) FROM r_collectives o WHERE o.parent_id = c.parent_id AND o.id <> c.id) AS siblings FROM r_collectives c",
}
SQL = {k: with_roles(v) for k, v in _SQL.items()}
