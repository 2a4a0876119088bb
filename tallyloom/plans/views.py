"""The model's views over its role tables.

Each takes the DataFrames it reads and gives the view's rows. What one row a key means is always an
aggregate (combined before the shuffle), child tables are summed up once before they are joined, and
joins are equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import urls as U
from tallyloom.operators.joins import prefix_join
from tallyloom.operators.latest import latest_by

OVER = ["completed", "removed_blocked", "removed_other"]
REMOVED = ["removed_blocked", "removed_other"]
IN_FLIGHT = ["staged", "uploaded", "connection_sent", "connected", "message_sent"]


def sorted_set(c: str) -> Column:
    """The distinct values in order, a null among them as the last."""
    known = F.array_sort(F.collect_set(c))
    return F.when(F.bool_or(F.col(c).isNull()), F.concat(known, F.array(F.lit(None).cast("string")))).otherwise(known)


def as_text(c: str) -> Column:
    """An array as text, for comparison: its members joined by commas, a null as `~`; null for no array."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "~").alias(c)


def current_qualification(q: DataFrame) -> DataFrame:
    return latest_by(q, ["lead_id"], ["qualified_at", "id"])


def current_per(q: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    return latest_by(q, keys, newest)


PERSON = ["name", "current_title", "current_company", "linkedin_url", "country"]


def member_rows(members: DataFrame, leads: DataFrame, campaigns: DataFrame) -> DataFrame:
    m = members.join(campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("campaign"), "channel"), "campaign_id")
    return m.join(leads.select(F.col("id").alias("lead_id"), *PERSON), "lead_id")


def in_campaign(members: DataFrame, leads: DataFrame, campaigns: DataFrame) -> DataFrame:
    return member_rows(members.where(~F.col("status").isin(OVER)), leads, campaigns).select("lead_id", "name", "current_title", "current_company", "country", "campaign", "channel", F.col("status").alias("campaign_status"), "last_status_at", "uploaded_at", "staged_at")


def staged(members: DataFrame, leads: DataFrame, campaigns: DataFrame) -> DataFrame:
    return member_rows(members.where("status = 'staged'"), leads, campaigns).select("lead_id", *PERSON, "campaign", "channel", "staged_at")


def replied(members: DataFrame, leads: DataFrame, campaigns: DataFrame) -> DataFrame:
    return member_rows(members.where(F.col("status").isin("replied", "meeting_booked")), leads, campaigns).select("lead_id", "name", "current_title", "current_company", "linkedin_url", "campaign", F.col("last_status_at").alias("replied_at"))


def qualified_no_campaign(q: DataFrame, leads: DataFrame, members: DataFrame) -> DataFrame:
    now = current_qualification(q).where("qualified")
    busy = members.where(~F.col("status").isin(REMOVED)).select("lead_id").distinct()
    out = now.join(busy, "lead_id", "left_anti").join(leads.select(F.col("id").alias("lead_id"), "name", "current_title", "current_company", "country"), "lead_id")
    return out.select("lead_id", "name", "current_title", "current_company", "country", "persona", "seniority", "qualifier_version", "qualified_at")


def provenance(leads: DataFrame, sources: DataFrame) -> DataFrame:
    """A lead without a source has lists of one null and a source_count of 1, as a left join counts it."""
    s = sources.groupBy("lead_id").agg(sorted_set("source_type").alias("source_types"), sorted_set("source_label").alias("source_labels"), F.min("recorded_at").alias("first_seen_at"), F.max("recorded_at").alias("last_seen_at"), F.count("*").alias("n"))
    j = leads.select(F.col("id").alias("lead_id"), "name", "linkedin_url").join(s, "lead_id", "left")
    nothing = F.array(F.lit(None).cast("string"))
    return j.select("lead_id", "name", "linkedin_url", F.coalesce("source_types", nothing).alias("source_types"), F.coalesce("source_labels", nothing).alias("source_labels"), "first_seen_at", "last_seen_at", F.coalesce("n", F.lit(1)).cast("bigint").alias("source_count"))


def campaign_funnel(campaigns: DataFrame, members: DataFrame) -> DataFrame:
    """An empty campaign has one row with a null status and 1."""
    n = members.groupBy("campaign_id", "status").agg(F.count("*").alias("n"))
    j = campaigns.join(n, campaigns["id"] == n["campaign_id"], "left")
    return j.select(F.col("name").alias("campaign"), "channel", "status", F.coalesce("n", F.lit(1)).cast("bigint").alias("n"))


def leads_at_companies(leads: DataFrame, companies: DataFrame) -> DataFrame:
    """Leads whose company URL is a company's, in lower case and without the last slash."""
    c = companies.select(U.company_url_key(F.col("linkedin_url")).alias("k"), F.col("id").alias("company"), F.col("name").alias("company_name"), F.col("linkedin_slug").alias("company_slug"))
    return leads.withColumn("k", U.company_url_key(F.col("current_company_url"))).join(c, "k").select(F.col("id").alias("lead_id"), F.col("linkedin_url").alias("lead_linkedin_url"), F.col("name").alias("lead_name"), "current_title", "company", "company_name", "company_slug")


def leads_at_related(leads: DataFrame, companies: DataFrame, relationships: DataFrame, relationship: str) -> DataFrame:
    """Leads at companies in a relationship, with its scope, source and notes."""
    r = relationships.where(F.col("relationship") == relationship).select(F.col("company_id").alias("company"), F.col("scope").alias("related_scope"), F.col("source").alias("tag_source"), F.col("notes").alias("related_notes"))
    return leads_at_companies(leads, companies).join(r, "company").withColumnRenamed("company", "company_id")


def related_companies(companies: DataFrame, relationships: DataFrame, relationship: str) -> DataFrame:
    """Companies in a relationship, with all that is on record about it (scope, source, notes, status, what is wanted of them), by name."""
    own = [c for c in companies.columns if c not in relationships.columns]
    r = relationships.where(F.col("relationship") == relationship).drop("relationship")
    return companies.select(*own).join(r, companies["id"] == r["company_id"]).drop("company_id").orderBy("name", "id")


def pipeline_state(leads: DataFrame, sources: DataFrame, q: DataFrame, tags: DataFrame, members: DataFrame, campaigns: DataFrame) -> DataFrame:
    """One row a lead with what every child table knows, each summed up once; null where a table knows nothing."""
    s = sources.groupBy("lead_id").agg(sorted_set("source_type").alias("source_types"), sorted_set("source_label").alias("source_labels"), F.min("recorded_at").alias("first_seen_at"))
    t = tags.groupBy("lead_id").agg(sorted_set("tag").alias("tags"))
    c = members.where(~F.col("status").isin(OVER)).join(campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("campaign")), "campaign_id")
    a = c.groupBy("lead_id").agg(sorted_set("campaign").alias("active_campaigns"))
    now = current_qualification(q).select("lead_id", "qualifier_name", "qualifier_version", "qualified", F.col("persona").alias("verdict_persona"), "qualified_at")
    out = leads.select(F.col("id").alias("lead_id"), "name", "linkedin_url", "current_title", "current_company", "country")
    for x in (s, t, now, a):
        out = out.join(x, "lead_id", "left")
    return out


def engager_report(posts: DataFrame, engagements: DataFrame, leads: DataFrame) -> DataFrame:
    """Per poster and persona of who engaged (without oneself): people and posts. Null personas show as (unqualified)."""
    j = engagements.join(posts.select(F.col("id").alias("post_id"), "poster_lead_id"), "post_id").where("lead_id <> poster_lead_id")
    j = j.join(leads.select(F.col("id").alias("lead_id"), F.col("persona").alias("raw_persona")), "lead_id")
    g = j.groupBy("poster_lead_id", "raw_persona").agg(F.countDistinct("lead_id").alias("engager_count"), F.countDistinct("post_id").alias("posts_engaged"))
    return g.join(leads.select(F.col("id").alias("poster_lead_id"), F.col("name").alias("poster_name"), F.col("linkedin_url").alias("poster_linkedin_url")), "poster_lead_id").select("poster_lead_id", "poster_name", "poster_linkedin_url", F.coalesce("raw_persona", F.lit("(unqualified)")).alias("engager_persona"), "engager_count", "posts_engaged")


def pending_removals(members: DataFrame, q: DataFrame, leads: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Memberships marked for removal, and those in flight whose lead's verdict is false (not null)."""
    now = current_qualification(q).select("lead_id", "qualified", "persona", "disqualified_reason", "qualifier_name", "qualifier_version", "qualified_at")
    m = members.join(now, "lead_id", "left")
    auto = F.col("status").isin(IN_FLIGHT) & F.col("qualified").eqNullSafe(False)
    m = m.where((F.col("status") == "pending_removal") | auto)
    m = m.join(leads.select(F.col("id").alias("lead_id"), "linkedin_url", F.col("name").alias("lead_name")), "lead_id").join(campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("campaign_name")), "campaign_id")
    return m.select(F.col("id").alias("campaign_member_id"), "lead_id", "campaign_id", "status", "uploaded_at", "last_status_at", "linkedin_url", "lead_name", "campaign_name", "qualified", "persona", "disqualified_reason", "qualifier_name", "qualifier_version", "qualified_at", F.when(F.col("status") == "pending_removal", "manual").otherwise("auto").alias("removal_source"))


def upcoming(rows: DataFrame, key: str, at: str, as_of: str, status: str | None = None) -> DataFrame:
    """The earliest row from `as_of` on, of a status where it is given; of several at one time the greatest id."""
    f = rows.where(F.col(at) >= F.lit(as_of).cast("timestamp_ntz"))
    if status is not None:
        f = f.where(F.col("status") == status)
    best = f.groupBy(key).agg(F.min_by(F.struct(*[c for c in f.columns if c != key]), F.struct(F.col(at).alias("a"), (-F.col("id")).alias("b"))).alias("r"))
    return best.select(key, "r.*")


def deal_leads(leads: DataFrame, companies: DataFrame, deals: DataFrame) -> DataFrame:
    """Leads at a company with an open or won deal, deleted ones included; a deal meets its company by id or by slug."""
    on = deals.where("is_open or is_won")
    # one pass over the deals: both ways to a company become one list, whose repeats fall away before the shuffle
    named = on.join(companies.select(F.col("linkedin_slug").alias("match_slug"), F.col("id").alias("by_slug")), "match_slug", "left")
    hit = named.select(F.explode(F.array_distinct(F.array_compact(F.array("company_id", "by_slug")))).alias("company"), "deal_id", "company_name", "is_won", "is_open", "is_deleted", "stage_name")
    g = hit.groupBy("company").agg(
        F.bool_or("is_won").alias("is_customer"), F.bool_or("is_open").alias("has_open_deal"), F.bool_or("is_deleted").alias("has_deleted_deal"), F.max(F.when(F.col("is_open"), F.col("stage_name"))).alias("open_stage"),
        F.array_sort(F.collect_set("deal_id")).alias("deal_ids"), F.array_sort(F.collect_set("company_name")).alias("deal_companies"),
    )
    at = leads_at_companies(leads, companies).select("lead_id", F.col("lead_linkedin_url").alias("linkedin_url"), F.col("lead_name").alias("name"), "current_title", "company")
    return at.join(g, "company").drop("company")


def active_deal_companies(deals: DataFrame) -> DataFrame:
    """Null companies and slugs form groups."""
    return deals.where("is_open or is_won").groupBy("company_id", "match_slug").agg(F.max("company_name").alias("company_name"), F.bool_or("is_won").alias("is_customer"), F.bool_or("is_open").alias("has_open_deal"), F.bool_or("is_deleted").alias("has_deleted_deal"), F.max(F.when(F.col("is_open"), F.col("stage_name"))).alias("open_stage"), F.array_sort(F.collect_set("deal_id")).alias("deal_ids"), F.max("synced_at").alias("last_synced_at"))


def deleted_deals(deals: DataFrame) -> DataFrame:
    return deals.where("is_deleted and (is_open or is_won)").select("deal_id", "company_id", "company_name", "match_slug", "match_domain", "stage_name", "is_open", "is_won", "amount", "deleted_at", "synced_at").orderBy(F.desc_nulls_last("deleted_at"))


def held_by_policy(q: DataFrame, leads: DataFrame, policy: str, version: str) -> DataFrame:
    """Leads whose current verdict is the policy's refusal while their latest other verdict is true, with what the refusal says of the deal."""
    now = current_qualification(q).where((F.col("qualifier_name") == policy) & (F.col("qualifier_version") == version) & ~F.col("qualified"))
    real = latest_by(q.where(F.col("qualifier_name") != policy), ["lead_id"], ["qualified_at", "id"]).where("qualified")
    said = lambda k: F.get_json_object("full_result", f"$.{k}").alias(k)
    out = now.select("lead_id", F.col("reason").alias("deal_reason"), said("deal_companies"), said("open_stage"), F.col("qualified_at").alias("held_since")).join(real.select("lead_id", F.col("persona").alias("would_be_persona"), F.col("qualifier_name").alias("real_qualifier"), F.col("qualifier_version").alias("real_qualifier_version")), "lead_id")
    return out.join(leads.select(F.col("id").alias("lead_id"), "linkedin_url", "name", "current_title", "current_company"), "lead_id")


def vendor_customers(links: DataFrame, companies: DataFrame, relationships: DataFrame) -> DataFrame:
    """links (customer, vendor, ...) with both companies' names, the customer's URL, and the vendor's scope where it is a competitor; the companies meet the links twice."""
    c = companies.select("id", "name", "linkedin_url")
    scope = relationships.where("relationship = 'competitor'").select(F.col("company_id").alias("vendor"), F.col("scope").alias("vendor_scope"))
    j = links.join(c.select(F.col("id").alias("customer"), F.col("name").alias("customer_name"), F.col("linkedin_url").alias("customer_linkedin_url")), "customer").join(c.select(F.col("id").alias("vendor"), F.col("name").alias("vendor_name")), "vendor")
    return j.join(scope, "vendor", "left")


def vendor_links(assertions: DataFrame, edges: DataFrame, signals: DataFrame, processors: DataFrame) -> DataFrame:
    """Active assertions on an edge between companies in the older form: certainty in two steps, how it was found, and its evidence from the signal's payload."""
    p = lambda k: F.get_json_object("payload", f"$.{k}")
    a = assertions.where("removed_at is null").join(edges.select(F.col("id").alias("subject_edge_id"), F.col("from_company_id").alias("customer_company_id"), F.col("to_company_id").alias("vendor_company_id")), "subject_edge_id")
    a = a.join(signals.select(F.col("id").alias("evidence_signal_id"), "payload"), "evidence_signal_id", "left").join(processors.select(F.col("id").alias("processor_id"), F.col("method").alias("processor_method")), "processor_id", "left")
    certainty = F.when(F.col("confidence").isin("suspected", "conflicting"), "probed").otherwise("confirmed")
    return a.select("id", "customer_company_id", "vendor_company_id", certainty.alias("certainty"), F.coalesce(p("detection_method"), "processor_method").alias("detection_method"), p("evidence_url").alias("evidence_url"), F.coalesce(p("evidence_note"), "notes").alias("evidence_note"), F.col("asserted_at").alias("observed_at"), F.col("asserted_by").alias("source"))


def current_plans(plans: DataFrame, keys: list[str]) -> DataFrame:
    """The latest row of each key among those that are current."""
    return latest_by(plans.where("is_current"), keys, ["enriched_at", "id"])


def identities_of(identities: DataFrame, leads: DataFrame) -> DataFrame:
    return identities.join(leads.select(F.col("id").alias("lead_id"), "name", "linkedin_url", "current_company", "current_title"), "lead_id")


def latest_signal(signals: DataFrame, keys: list[str]) -> DataFrame:
    """The latest signal of each key, null keys being equal; ties go to the greatest id."""
    return latest_by(signals, keys, ["enriched_at", "id"])


def active(df: DataFrame, ended_at: str = "removed_at") -> DataFrame:
    return df.where(F.col(ended_at).isNull())


def monitoring_conflicts(companies: DataFrame, sources: DataFrame, label: str, wanted: Column, decided: DataFrame | None = None) -> DataFrame:
    """Companies with the number of people held whose source label begins with the company's name, and what speaks against it.

    The name works as a LIKE pattern. Names without a wildcard, the rule, meet the labels through a
    prefix join; only the others are matched as patterns, against distinct labels. With `decided`
    (company_id, value, reason, decided_by, decided_at, id) each company has its latest decision.
    """
    labels = sources.groupBy(label).agg(F.countDistinct("lead_id").alias("held"))
    wild = F.col("name").rlike(r"[%_\\]")
    plain = prefix_join(labels, label, companies.where(~wild).select("id", "name"), "name").select("id", "held")
    odd = labels.join(companies.where(wild).select("id", "name"), F.expr(f"{label} LIKE name || '%'")).select("id", "held")
    hits = plain.unionAll(odd).groupBy("id").agg(F.sum("held").alias("reps_held"))
    j = companies.withColumn("wanted", wanted).join(hits, "id", "left").withColumn("reps_held", F.coalesce("reps_held", F.lit(0)))
    if decided is not None:
        d = latest_by(decided, ["company_id"], ["decided_at", "id"])
        d = d.select(F.col("company_id").alias("id"), F.col("value").alias("monitoring_decision"), F.col("reason").alias("monitoring_reason"), F.col("decided_by").alias("monitoring_decided_by"), F.col("decided_at").alias("monitoring_decided_at"))
        j = j.join(d, "id", "left")
    return j.withColumn("conflict", F.when(F.col("wanted") & (F.col("reps_held") == 0), "wanted_but_empty").when(~F.col("wanted") & (F.col("reps_held") > 0), "held_but_unwanted"))


def subject(df: DataFrame, kinds: list[str]) -> DataFrame:
    """subject_type and subject_id of rows in which one of several id columns is set."""
    t = F.coalesce(*[F.when(F.col(f"subject_{k}_id").isNotNull(), k) for k in kinds])
    return df.withColumn("subject_type", t).withColumn("subject_id", F.coalesce(*[F.col(f"subject_{k}_id").cast("string") for k in kinds]))


def observations(assertions: DataFrame, signals: DataFrame, calls: DataFrame, kinds: list[str]) -> DataFrame:
    """Active observations with their subject and where their evidence came from: a signal, else a stored call."""
    a = subject(assertions.where("removed_at is null and kind = 'observation'"), kinds)
    a = a.join(signals.select(F.col("id").alias("evidence_signal_id"), F.col("enriched_at").alias("s_at"), F.col("enricher_name").alias("s_src")), "evidence_signal_id", "left")
    a = a.join(calls.select(F.col("id").alias("evidence_enrichment_call_id"), F.col("fetched_at").alias("c_at"), F.concat_ws(" ", "api", "endpoint").alias("c_src")), "evidence_enrichment_call_id", "left")
    return a.withColumn("evidence_at", F.coalesce("s_at", "c_at")).withColumn("evidence_source", F.coalesce("s_src", "c_src")).drop("s_at", "c_at", "s_src", "c_src")


def decisions(assertions: DataFrame, kinds: list[str]) -> DataFrame:
    a = subject(assertions.where("removed_at is null and kind = 'decision'"), kinds)
    return a.withColumn("decided_at", F.coalesce("decided_at", "asserted_at")).withColumn("reason", F.col("notes"))


def unresolved_posters(posts: DataFrame) -> DataFrame:
    """Poster URLs that lead to nobody, with their posts; the null URL is a group."""
    u = posts.where("poster_company_id is null and poster_lead_id is null")
    return u.groupBy("poster_linkedin_url").agg(F.min("poster_name").alias("poster_name"), F.count("*").alias("posts"), F.min("posted_at").alias("first_posted_at"), F.max("posted_at").alias("last_posted_at"))


def target_posts(targets: DataFrame, posts: DataFrame) -> DataFrame:
    """Targets (a company or a lead) with the posts held of them; 0 and null where there is none.

    The OR over both columns is two sums and two joins.
    """
    agg = lambda c, n: posts.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(n)).agg(F.count("*").alias(f"n_{n}"), F.max("posted_at").alias(f"at_{n}"))
    j = targets.join(agg("poster_company_id", "company_id"), "company_id", "left").join(agg("poster_lead_id", "lead_id"), "lead_id", "left")
    zero = F.lit(0).cast("bigint")
    return j.select(*targets.columns, (F.coalesce("n_company_id", zero) + F.coalesce("n_lead_id", zero)).alias("posts_held"), F.greatest("at_company_id", "at_lead_id").alias("last_post_at"))


def voices(targets: DataFrame, companies: DataFrame, leads: DataFrame, posts: DataFrame) -> DataFrame:
    """Targets as voices: what kind of one each is, its name and canonical URL, and its posts."""
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("__company"), "linkedin_slug", "is_showcase")
    l = leads.select(F.col("id").alias("lead_id"), F.col("name").alias("__lead"), F.col("linkedin_url").alias("__url"))
    person, show = F.col("lead_id").isNotNull(), F.coalesce("is_showcase", F.lit(False))
    page = F.concat(F.lit("https://www.linkedin.com/"), F.when(show, "showcase").otherwise("company"), F.lit("/"), F.col("linkedin_slug"))
    t = target_posts(targets, posts).join(c, "company_id", "left").join(l, "lead_id", "left")
    t = t.withColumn("kind", F.when(person, "person").when(show, "showcase_page").otherwise("company_page")).withColumn("name", F.coalesce("__company", "__lead")).withColumn("canonical_url", F.when(person, F.col("__url")).otherwise(page))
    return t.drop("__company", "__lead", "__url", "linkedin_slug", "is_showcase")


def merge_queue(conflicts: DataFrame, leads: DataFrame) -> DataFrame:
    """Open findings on a member token between two unmerged leads."""
    c = conflicts.where("resolved_by_merge is null and kind = 'linkedin_urn'")
    l = leads.where("merged_into is null").select("id", "name", "linkedin_url", "created_at")
    own = l.select(F.col("id").alias("owner_lead_id"), F.col("name").alias("owner_name"), F.col("linkedin_url").alias("owner_url"), F.col("created_at").alias("owner_created_at"))
    oth = l.select(F.col("id").alias("lead_id"), F.col("name").alias("other_name"), F.col("linkedin_url").alias("other_url"), F.col("created_at").alias("other_created_at"))
    return c.join(own, "owner_lead_id").join(oth, "lead_id").select(F.col("id").alias("conflict_id"), "kind", "value", "owner_lead_id", "owner_name", "owner_url", "owner_created_at", F.col("lead_id").alias("other_lead_id"), "other_name", "other_url", "other_created_at", "found_at", "source")


def chat_monitoring(decided: DataFrame, chats: DataFrame) -> DataFrame:
    return latest_by(decided, ["chat_id"], ["decided_at", "id"]).join(chats.select(F.col("id").alias("chat_id"), "operator_id", "title"), "chat_id")


def collective_members(memberships: DataFrame, collectives: DataFrame, identities: DataFrame) -> DataFrame:
    """Every membership with its collective and the lead its identity leads to; all of the membership's own columns (application, attendance, source, times) stay."""
    m = memberships.withColumnRenamed("id", "membership_id").join(collectives.select(F.col("id").alias("collective_id"), F.col("name").alias("collective_name"), "kind", *[c for c in ("provider", "operator_id") if c in collectives.columns], "parent_id"), "collective_id")
    i = identities.select(F.col("kind").alias("member_kind"), F.col("value").alias("member_value"), "lead_id")
    return m.join(i, ["member_kind", "member_value"], "left")


def match_states(matches: DataFrame, identities: DataFrame) -> DataFrame:
    """rejected, else proven where both sides are one lead's, else open."""
    i = identities.select("kind", "value", "lead_id")
    a = i.select(F.col("kind").alias("a_kind"), F.col("value").alias("a_value"), F.col("lead_id").alias("a_lead_id"))
    b = i.select(F.col("kind").alias("b_kind"), F.col("value").alias("b_value"), F.col("lead_id").alias("b_lead_id"))
    j = matches.join(a, ["a_kind", "a_value"], "left").join(b, ["b_kind", "b_value"], "left")
    return j.withColumn("state", F.when(F.col("rejected_at").isNotNull(), "rejected").when(F.col("a_lead_id") == F.col("b_lead_id"), "proven").otherwise("open"))


def small_group_ties(members: DataFrame, limit: int) -> DataFrame:
    """Members of groups that have, with their operator, fewer than `limit` people."""
    live = members.where("member_state = 'member' and kind = 'group' and operator_id is not null")
    n = live.groupBy("collective_id").agg((F.count("*") + 1).alias("group_size")).where(F.col("group_size") < limit)
    return live.where("lead_id is not null").join(n, "collective_id").select("lead_id", "operator_id", "collective_id", F.col("collective_name").alias("group_name"), "group_size")


def introductions(rows: DataFrame, identities: DataFrame, leads: DataFrame) -> DataFrame:
    """Introductions with the three people they name, each through an identity to a lead; the person introduced to may be an operator."""
    out = rows
    for side in ("by", "whom", "to"):
        i = identities.select(F.col("kind").alias(f"{side}_kind"), F.col("value").alias(f"{side}_value"), F.col("lead_id").alias(f"{side}_lead_id"))
        out = out.join(i, [f"{side}_kind", f"{side}_value"], "left").join(leads.select(F.col("id").alias(f"{side}_lead_id"), F.col("name").alias(f"{side}_name")), f"{side}_lead_id", "left")
    return out.withColumn("to_name", F.coalesce("to_name", "to_operator"))


def company_links(rows: DataFrame, identities: DataFrame, leads: DataFrame, companies: DataFrame) -> DataFrame:
    """Links that were not retired, with the person and both companies they name."""
    i = identities.select(F.col("kind").alias("person_kind"), F.col("value").alias("person_value"), F.col("lead_id").alias("person_lead_id"))
    j = rows.where("retired_at is null").join(i, ["person_kind", "person_value"], "left").join(leads.select(F.col("id").alias("person_lead_id"), F.col("name").alias("person_name")), "person_lead_id", "left")
    c = companies.select("id", "name")
    j = j.join(c.select(F.col("id").alias("company_id"), F.col("name").alias("company_name")), "company_id", "left")
    return j.join(c.select(F.col("id").alias("via_company_id"), F.col("name").alias("via_company")), "via_company_id", "left")
