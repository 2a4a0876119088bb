"""Pipelines that keep the model up to date: repair and refresh lists, memberships, deals, touches, meetings.

Each takes the tables it reads as DataFrames and gives the rows to write or to work on. What one row
a key means is a combined aggregate, lists are told apart by semi and anti joins, and conditions
over several columns are equi-joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import names as N
from tallyloom.functions import text as X
from tallyloom.functions import urls as U
from tallyloom.operators import writes as W
from tallyloom.operators.identity import match_ladder, settle_claims
from tallyloom.operators.joins import prefix_join
from tallyloom.operators.latest import latest_by


def where_text(df: DataFrame, condition: str) -> DataFrame:
    """Rows that meet a condition the user wrote, one SQL expression over the columns. A blank condition keeps all rows; what is no single boolean expression is refused."""
    if not condition.strip():
        return df
    c = F.expr(condition)
    if df.select(c.alias("c")).schema["c"].dataType.simpleString() != "boolean":
        raise ValueError("the condition gives no truth value")
    return df.where(c)


def count_where_exists(rows: DataFrame, group: list[str], key: str, marked: DataFrame, as_: str) -> DataFrame:
    """group, n, `as_`: rows of each group, and those whose key is among the marked ones; the test is a flag from one join, not a subquery a row."""
    m = marked.select(F.col(key).alias("__m")).where("__m is not null").distinct().withColumn("__hit", F.lit(True))
    j = rows.join(m, F.col(key) == F.col("__m"), "left")
    return j.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.coalesce("__hit", F.lit(False))).alias(as_))


def classified_by(leads: DataFrame, columns: list[str], classify: Callable[[dict], dict], fields: str, key: str = "lead_id") -> DataFrame:
    """key, `fields`, error: each lead's answer by a callable that was handed in, Arrow batch by Arrow batch; a row it fails on has nulls and the error's text.

    `fields` is a DDL list of the answer's members; what the answer lacks is null. The callable must
    be the same for equal input, as a lost task is run again.
    """
    kind = dict(leads.dtypes)[key]
    names = [f.split()[0].strip("`") for f in fields.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                try:
                    got, error = classify({c: None if pd.api.types.is_scalar(r[c]) and pd.isna(r[c]) else r[c] for c in columns}) or {}, None
                except Exception as e:  # one row's failure is its result
                    got, error = {}, f"{type(e).__name__}: {e}"
                rows.append((r[key], *[got.get(n) for n in names], error))
            yield pd.DataFrame(rows, columns=[key, *names, "error"], dtype=object)

    return leads.select(key, *[c for c in columns if c != key]).mapInPandas(run, f"`{key}` {kind}, {fields}, error string")


def repaired_names(leads: DataFrame, calls: DataFrame) -> DataFrame:
    """lead_id, found_name, call_id: the name in the newest stored answer about a lead that has a real one.

    An answer is about a lead by `lead_id` or by the profile handle in its params; successful ones
    with a name that is neither blank nor formatted from nothing count. Of several at one time the
    greatest id wins. `leads` are those whose names are to be repaired.
    """
    r = lambda p: F.get_json_object("response", f"$.{p}")
    joined = F.nullif(F.trim(F.concat_ws(" ", r("data.first_name"), r("data.last_name"))), F.lit(""))
    name = F.trim(F.coalesce(r("person.full_name"), r("data.full_name"), r("full_name"), r("data.name"), joined))
    c = calls.where("success").select(F.col("id").alias("call_id"), "lead_id", F.lower(U.found(F.col("params"), U.PROFILE_HANDLE, 1)).alias("handle"), name.alias("found_name"), "fetched_at")
    c = c.where((F.col("found_name") != "") & ~X.formatted_none(F.col("found_name")))
    l = leads.select(F.col("id").alias("lead_id"), F.lower(U.found(F.col("linkedin_url"), U.PROFILE_HANDLE, 1)).alias("handle"))
    by_id = c.drop("handle").join(l.select("lead_id"), "lead_id", "left_semi")
    by_handle = c.drop("lead_id").join(l, "handle").drop("handle").select(*by_id.columns)
    best = by_id.unionAll(by_handle).groupBy("lead_id").agg(F.max_by(F.struct("found_name", "call_id"), F.struct("fetched_at", "call_id")).alias("b"))
    return best.select("lead_id", "b.found_name", "b.call_id")


def size_targets(leads: DataFrame, wanted: DataFrame, companies: DataFrame, as_of: str, days: int) -> DataFrame:
    """current_company_url: the distinct company URLs of wanted leads, without those of companies whose size is younger than `days`."""
    urls = leads.where("current_company_url is not null and current_company_url <> ''").join(wanted.select(F.col("lead_id").alias("id")).distinct(), "id", "left_semi").select("current_company_url").distinct()
    since = F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {int(days)} DAYS")
    fresh = companies.where(F.col("size_fetched_at") > since).select(U.company_slug(F.col("linkedin_url"), F.lit(None).cast("string")).alias("slug")).where("slug <> ''").distinct()
    return urls.withColumn("slug", U.company_slug(F.col("current_company_url"), F.lit(None).cast("string"))).join(fresh, "slug", "left_anti").select("current_company_url")


def refresh_list(tags: DataFrame, tag: str, signals: DataFrame, enricher: str, done: DataFrame) -> DataFrame:
    """Leads that carry the tag, with their latest signal of an enricher, without those already done in this run."""
    who = tags.where(F.col("tag") == tag).select("lead_id").distinct().join(done.select("lead_id").distinct(), "lead_id", "left_anti")
    return latest_by(signals.where(F.col("enricher_name") == enricher), ["lead_id"], ["enriched_at", "id"]).join(who, "lead_id", "left_semi")


def member_index(identities: DataFrame, leads: DataFrame) -> DataFrame:
    """value, lead_id: the live lead each member token leads to; an identity counts before the lead's own column, and follows one merge.

    Of several leads of one value the smallest id counts.
    """
    i = identities.where(F.col("kind").isin("linkedin_urn", "linkedin_urn_search")).join(leads.select(F.col("id").alias("lead_id"), "merged_into"), "lead_id")
    a = i.select("value", F.coalesce("merged_into", "lead_id").alias("lead_id"), F.lit(0).alias("rank"))
    b = leads.where("member_urn is not null and merged_into is null").select(F.col("member_urn").alias("value"), F.col("id").alias("lead_id"), F.lit(1).alias("rank"))
    return a.unionAll(b).where("value is not null").groupBy("value").agg(F.min(F.struct("rank", "lead_id")).alias("m")).select("value", "m.lead_id")


def touches(events: DataFrame, posts: DataFrame, index: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """lead_id, touched_at, direction, kind, source, external_id: reactions and comments of known people, each once.

    `events`: member_id, at, post_key, direction, kind, source, external_id. A missing time is the
    post's, else the one in its key. (source, external_id) is unique where the id is there, also
    against `old`; of several the earliest counts.
    """
    p = posts.groupBy("post_key").agg(F.min("posted_at").alias("posted_at"))
    e = events.join(index.select(F.col("value").alias("member_id"), "lead_id"), "member_id").join(p, "post_key", "left")
    e = e.select("lead_id", F.coalesce("at", "posted_at", U.activity_time(F.col("post_key")).cast("timestamp_ntz")).alias("touched_at"), "direction", "kind", "source", "external_id")
    cols = e.columns
    own = ["source", "external_id"]
    keyed = e.where("external_id is not null").groupBy(*own).agg(F.min_by(F.struct("lead_id", "touched_at", "direction", "kind"), F.struct(F.col("touched_at").isNull(), "touched_at", "lead_id")).alias("r")).select(*own, "r.*").select(*cols)
    if old is not None:
        keyed = keyed.join(old.where("external_id is not null").select(*own).distinct(), own, "left_anti")
    return keyed.unionByName(e.where("external_id is null"))


def short_committees(members: DataFrame, held: DataFrame, cap: int, seeds: DataFrame | None = None, since: str | None = None) -> DataFrame:
    """company, live, total: companies with at least one and fewer than `cap` members that are not held.

    `members`: company, lead_id, seed. With `since`, only companies one of whose seeds was sent on
    or after that date; `seeds`: seed, sent_on.
    """
    h = held.select("lead_id").distinct().withColumn("held", F.lit(True))
    m = members.join(h, "lead_id", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    out = m.groupBy("company").agg(F.count_if(~F.col("held")).alias("live"), F.count("*").alias("total")).where((F.col("live") > 0) & (F.col("live") < cap))
    if since is None:
        return out
    sent = seeds.groupBy("seed").agg(F.max("sent_on").alias("sent_on")).where(F.col("sent_on") >= F.to_timestamp_ntz(F.lit(since)))
    return out.join(members.join(sent, "seed", "left_semi").select("company").distinct(), "company", "left_semi")


def curated_posters(leads: DataFrame, company: DataFrame, curated: DataFrame, tagged: DataFrame) -> DataFrame:
    """lead_id, company_id: people on a company's list, and tagged people who work there by its URL."""
    on_list = curated.select("lead_id", "company_id").join(company.select(F.col("id").alias("company_id")), "company_id", "left_semi").select("lead_id", "company_id")
    c = company.select(F.col("id").alias("company_id"), U.company_url_key(F.col("linkedin_url")).alias("k")).where("k is not null")
    there = leads.select(F.col("id").alias("lead_id"), U.company_url_key(F.col("current_company_url")).alias("k")).join(tagged.select("lead_id").distinct(), "lead_id", "left_semi").join(c, "k").select("lead_id", "company_id")
    return on_list.unionAll(there).distinct()


def event_report(events: DataFrame, members: DataFrame, role: str) -> DataFrame:
    """Events with their number of people and of those in a role, the fullest first; an event without people has zeros."""
    n = members.groupBy(F.col("collective_id").alias("id")).agg(F.count("*").alias("people"), F.count_if(F.col("role") == role).alias("in_role"), F.max("last_seen_at").alias("last_seen_at"))
    zero = F.lit(0).cast("bigint")
    j = events.join(n, "id", "left").withColumn("people", F.coalesce("people", zero)).withColumn("in_role", F.coalesce("in_role", zero))
    return j.orderBy(F.desc_nulls_last("last_seen_at"), F.desc("in_role"), "id")


def keep_earlier_identity(rows: DataFrame, memberships: DataFrame) -> DataFrame:
    """Membership rows (collective_id, lead_id, member_kind, member_value, ...) under the identity an earlier membership of that person there has, so that nobody becomes a member twice."""
    known = memberships.where("lead_id is not null").groupBy("collective_id", "lead_id").agg(F.min(F.struct("member_kind", "member_value")).alias("m"))
    j = rows.join(known, ["collective_id", "lead_id"], "left")
    return j.withColumn("member_kind", F.coalesce("m.member_kind", "member_kind")).withColumn("member_value", F.coalesce("m.member_value", "member_value")).select(*rows.columns)


def guest_memberships(sources: DataFrame, leads: DataFrame, identities: DataFrame, status_words: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(memberships, counts of statuses no word is known for) from guest rows: lead_id, event_id, status, attended, recorded_at, id.

    Rows of merged leads, without an event, or of people without an identity make no membership. Of
    several rows of one guest the last recorded counts. `identities` has one row a lead.
    """
    live = leads.where("merged_into is null").select(F.col("id").alias("lead_id"))
    word = F.lower(F.trim(F.regexp_replace("status", " ", " ")))
    names = F.create_map(*[F.lit(x) for kv in status_words.items() for x in kv])
    s = sources.where("event_id is not null and event_id <> ''").join(live, "lead_id", "left_semi").withColumn("word", word).withColumn("application", F.try_element_at(names, F.col("word")))
    last = latest_by(s, ["event_id", "lead_id"], ["recorded_at", "id"])
    m = last.join(identities.select("lead_id", F.col("kind").alias("member_kind"), F.col("value").alias("member_value")), "lead_id")
    m = m.select(F.col("event_id").alias("collective_id"), "lead_id", "member_kind", "member_value", F.lit("guest").alias("role"), "application", F.when(F.col("attended"), True).alias("attended"), F.nullif("word", F.lit("")).alias("source_status"), F.col("recorded_at").alias("first_seen_at"))
    return m, s.where("word <> '' and application is null").groupBy("word").agg(F.count("*").alias("n"))


def join_requests(sources: DataFrame, leads: DataFrame, collectives: DataFrame) -> DataFrame:
    """collective_id, lead_id, member_value, first_seen_at: requests of live leads to join a group, where exactly one group or community has that name and a number is given."""
    one = collectives.where(F.col("kind").isin("group", "community") & F.col("name").isNotNull()).groupBy(F.col("name").alias("group_name")).agg(F.count("*").alias("n"), F.min("id").alias("collective_id")).where("n = 1").drop("n")
    s = sources.withColumn("member_value", N.phone_key(F.col("phone"))).where("member_value is not null").join(leads.where("merged_into is null").select(F.col("id").alias("lead_id")), "lead_id", "left_semi")
    return s.join(one, "group_name").select("collective_id", "lead_id", "member_value", F.col("requested_at").alias("first_seen_at"))


def tag_memberships(tags: DataFrame, tag: str, leads: DataFrame, identities: DataFrame, collective: str, memberships: DataFrame) -> DataFrame:
    """Every live carrier of a tag as a member of a collective, by the identity an earlier membership has, else the given one; carriers without an identity are none."""
    t = tags.where(F.col("tag") == tag).join(leads.where("merged_into is null").select(F.col("id").alias("lead_id")), "lead_id", "left_semi")
    t = t.groupBy("lead_id").agg(F.min("tagged_at").alias("first_seen_at")).join(identities.select("lead_id", F.col("kind").alias("member_kind"), F.col("value").alias("member_value")), "lead_id")
    rows = t.select(F.lit(collective).alias("collective_id"), "lead_id", "member_kind", "member_value", F.lit("member").alias("role"), "first_seen_at")
    return keep_earlier_identity(rows, memberships)


def deal_companies(deals: DataFrame, companies: DataFrame) -> DataFrame:
    """Deals (deal_id, page, domain, ...) with match_slug, match_domain and company_id: the company of that slug, else the one whose website begins with the domain; of several the smallest id."""
    slug = F.lower(U.found(F.col("page"), r"(?i)linkedin\.[a-z.]+/company/([^/?#]+)", 1))
    d = deals.withColumn("match_slug", slug).withColumn("match_domain", F.nullif(U.site_domain(F.col("domain")), F.lit("")))
    by_slug = companies.where("linkedin_slug is not null").groupBy(F.lower("linkedin_slug").alias("match_slug")).agg(F.min("id").alias("__s"))
    site = F.regexp_replace(F.lower(F.coalesce("website", F.lit(""))), r"^https?://(?:www\.)?", "")
    want = d.where("match_domain is not null").select("match_domain").distinct()
    by_site = prefix_join(companies.select("id", site.alias("site")), "site", want, "match_domain").groupBy("match_domain").agg(F.min("id").alias("__d"))
    return d.join(by_slug, "match_slug", "left").join(by_site, "match_domain", "left").withColumn("company_id", F.coalesce("__s", "__d")).select(*deals.columns, "match_slug", "match_domain", "company_id")


def sync_deals(state: DataFrame, deals: DataFrame, companies: DataFrame, now: Column) -> DataFrame:
    """The deals after a sync: what was seen is not deleted; links to a company are not erased by nulls, stage, flags and amount are the source's."""
    new = deal_companies(deals, companies).drop("page", "domain").withColumn("is_deleted", F.lit(False)).withColumn("deleted_at", F.lit(None).cast("timestamp_ntz")).withColumn("synced_at", now)
    new = W.last_in_batch(new, ["deal_id"], ["seq"]).drop("seq")
    over = {c: W.overwrite for c in ("is_open", "is_won", "amount", "is_deleted", "deleted_at", "synced_at")}
    return W.upsert(state, new, ["deal_id"], over)


def message_effects(new: DataFrame, old: DataFrame, tags: DataFrame, members: DataFrame, tag: str = "they:replied", over: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(tags to add, memberships with their status) after new messages: whoever wrote for the first time is tagged once, and memberships that are not over become `replied`.

    A message counts as new if its provider id is not among the old ones.
    """
    wrote = new.where("role = 'lead' and lead_id is not null").join(old.select("provider_message_id").distinct(), "provider_message_id", "left_anti").groupBy("lead_id").agg(F.min("sent_at").alias("at"))
    has = tags.where(F.col("tag") == tag).select("lead_id").distinct()
    add = wrote.join(has, "lead_id", "left_anti").select("lead_id", F.lit(tag).alias("tag"), F.col("at").alias("tagged_at"))
    j = members.join(wrote.withColumnRenamed("at", "__at"), "lead_id", "left")
    moves = F.col("__at").isNotNull() & ~F.col("status").isin("replied", "meeting_booked", *over)
    out = j.withColumn("last_status_at", F.when(moves, F.greatest("last_status_at", "__at")).otherwise(F.col("last_status_at"))).withColumn("status", F.when(F.coalesce(moves, F.lit(False)), "replied").otherwise(F.col("status")))
    return add, out.select(*members.columns)


def changed_decisions(current: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """Wanted decisions that differ from the current ones; where there is none yet, every decision is a change."""
    c = current.select(F.col(key).alias("__k"), F.col(value).alias("__v"), F.lit(True).alias("__there"))
    j = wanted.join(c, F.col(key) == F.col("__k"), "left")
    return j.where(F.col("__there").isNull() | ~F.col(value).eqNullSafe(F.col("__v"))).select(*wanted.columns)


def reschedule(meetings: DataFrame, new: DataFrame) -> DataFrame:
    """Meetings after new ones are set: a lead's scheduled meetings at other times become `rescheduled`, one at the same time stays and comes in no second time. `new` has one row a lead."""
    n = new.select("lead_id", F.col("scheduled_at").alias("__at"))
    j = meetings.join(n, "lead_id", "left")
    moved = (F.col("status") == "scheduled") & (F.col("scheduled_at") != F.col("__at"))
    kept = j.withColumn("status", F.when(F.coalesce(moved, F.lit(False)), "rescheduled").otherwise(F.col("status"))).select(*meetings.columns)
    there = meetings.where("status = 'scheduled'").select("lead_id", "scheduled_at").distinct()
    fresh = new.join(there, ["lead_id", "scheduled_at"], "left_anti").withColumn("status", F.lit("scheduled"))
    return kept.unionByName(fresh, allowMissingColumns=True)


def cancel(meetings: DataFrame, leads: DataFrame) -> DataFrame:
    """Meetings with the scheduled ones of these leads cancelled."""
    gone = leads.select("lead_id", F.lit(True).alias("__gone")).distinct()
    j = meetings.join(gone, "lead_id", "left")
    return j.withColumn("status", F.when(F.coalesce(F.col("__gone") & (F.col("status") == "scheduled"), F.lit(False)), "cancelled").otherwise(F.col("status"))).select(*meetings.columns)


def with_reminder(meetings: DataFrame, sent: DataFrame) -> DataFrame:
    """Scheduled meetings with a reminder (kind, at) put behind those in `reminders_sent`, a JSON array. `sent` has one row a lead."""
    s = sent.select("lead_id", F.to_json(F.struct("kind", "at")).alias("__r"))
    j = meetings.join(s, "lead_id", "left")
    items = F.coalesce(F.regexp_extract("reminders_sent", r"(?s)^\s*\[(.*)\]\s*$", 1), F.lit(""))
    more = F.concat(F.lit("["), items, F.when(F.trim(items) != "", ",").otherwise(""), F.col("__r"), F.lit("]"))
    due = F.col("__r").isNotNull() & (F.col("status") == "scheduled")
    return j.withColumn("reminders_sent", F.when(F.coalesce(due, F.lit(False)), more).otherwise(F.col("reminders_sent"))).select(*meetings.columns)


def merged_json(old: Column, new: Column) -> Column:
    """Two JSON objects as one, the new members over the old; a null or broken side counts as empty. Members keep their JSON values."""
    m = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    return F.to_json(F.map_concat(F.map_filter(m(old), lambda k, _: ~F.array_contains(F.map_keys(m(new)), k)), m(new)))


def recorded_once(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Old rows and each new one whose keys, nulls being equal, are neither there nor given before."""
    first = new.groupBy(*keys).agg(F.min(F.struct(*[c for c in cols if c not in keys])).alias("r")).select(*keys, "r.*").select(*cols)
    return W.append_absent(old.select(*cols), first, keys)


def named_in(rows: DataFrame, columns: list[str], person: str) -> DataFrame:
    """Rows that name a person in any of the columns."""
    return rows.where(F.array_contains(F.array(*[F.col(c).cast("string") for c in columns]), person))


def registered(operators: DataFrame, accounts: DataFrame) -> DataFrame:
    """Operators after accounts were registered: channel and identifier from each account, an account registered again is active again. `accounts`: name, kind, username, phone, mail."""
    ident = F.coalesce(N.phone_key(F.col("phone")), F.nullif(F.lower(F.trim("mail")), F.lit("")), F.nullif(F.trim("username"), F.lit("")))
    a = accounts.select("name", F.lower("kind").alias("channel"), ident.alias("identifier")).where("identifier is not null").distinct().withColumn("active", F.lit(True))
    return W.upsert(operators, a, ["name", "channel", "identifier"], {"active": W.overwrite})


def token_backfill(found: DataFrame, leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens to write, duplicates): found member tokens (lead_id, token) of leads without one; where another lead owns the token, or several claim it, all but the owner are its duplicates."""
    open_ = found.where("token is not null").join(leads.where("member_urn is null").select(F.col("id").alias("lead_id")), "lead_id", "left_semi")
    owned = leads.where("member_urn is not null").select(F.lit("urn").alias("kind"), F.col("member_urn").alias("value"), F.col("id").alias("lead_id"))
    claims = open_.select(F.lit("urn").alias("kind"), F.col("token").alias("value"), "lead_id", F.lit(0).cast("bigint").alias("seq")).distinct()
    done = settle_claims(owned, claims)
    return done.where("outcome = 'inserted'").select("lead_id", F.col("value").alias("member_urn")), done.where("outcome = 'duplicate'").select("lead_id", F.col("owner").alias("owner_lead_id"), "value")


def own_posts(stored: DataFrame, walked: DataFrame) -> DataFrame:
    """Posts after a walk over one's own: keyed by the first of urn, post_urn, share_urn and the activity id; counters are the new ones where there are some, ever smaller ones included."""
    key = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("urn", "post_urn", "share_urn")], F.concat(F.lit("urn:li:activity:"), F.nullif(F.trim("activity_id"), F.lit(""))))
    w = walked.withColumn("post_key", key).where("post_key is not null")
    w = latest_by(w.select("post_key", "likes", "comments_count", "fetched_at"), ["post_key"], ["fetched_at", "likes", "comments_count"]).drop("fetched_at")
    return W.upsert(stored, w, ["post_key"], {})


def imported_people(rows: DataFrame, leads: DataFrame, fills: list[str], owner: str) -> DataFrame:
    """Leads after a network export: met by profile URL, `fills` only where they are empty, the rest of what is new over the old. Rows without a URL are left out; of one URL the last by `connected_on` counts."""
    r = rows.withColumn("linkedin_url", U.profile_url(F.col("url"))).where("linkedin_url <> ''").withColumn("network_of", F.lit(owner)).drop("url")
    return W.upsert(leads, W.last_in_batch(r, ["linkedin_url"], ["connected_on"]), ["linkedin_url"], {c: W.old_text_wins for c in fills})


def guests_matched(guests: DataFrame, leads: DataFrame, identities: DataFrame) -> DataFrame:
    """Guests (email, url) with the lead they are and how that is known: by an e-mail identity, by the lead's own e-mail, by profile URL; a bare handle counts as a URL."""
    mail = F.nullif(F.lower(F.trim("email")), F.lit(""))
    bare = F.trim("url")
    url = F.when(bare.contains("/"), U.profile_url(bare)).when(bare != "", F.concat(F.lit("https://www.linkedin.com/in/"), F.regexp_replace(bare, "^@", "")))
    own = leads.withColumn("__mail", F.lower(F.trim("email"))).withColumn("__u", F.nullif(U.profile_url(F.col("linkedin_url")), F.lit("")))
    return match_ladder(guests, "email", [
        ("email_identity", mail, identities.where("kind = 'email'").withColumn("value", F.lower("value")), "value", "lead_id"), ("email", mail, own, "__mail", "id"),
        ("url_identity", url, identities.where("kind = 'linkedin_url'"), "value", "lead_id"), ("url", url, own, "__u", "id"),
    ])


def follower_counts(leads: DataFrame, named: DataFrame, payloads: DataFrame) -> DataFrame:
    """lead_id, followers: the greatest count in a payload of the lead's own, else the one under its full name where only one lead bears it."""
    own = payloads.groupBy("lead_id").agg(F.max(F.get_json_object("payload", "$.follower_count").cast("bigint")).alias("own"))
    l = leads.select(F.col("id").alias("lead_id"), N.full_name_key(F.col("name")).alias("key"))
    sole = l.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("lead_id").alias("lead_id")).where("n = 1")
    by_name = named.select(N.full_name_key(F.col("name")).alias("key"), "followers").groupBy("key").agg(F.max("followers").alias("named")).join(sole, "key").select("lead_id", "named")
    return own.join(by_name, "lead_id", "full_outer").select("lead_id", F.coalesce("own", "named").alias("followers")).where("followers is not null")


def retagged(tags: DataFrame, group: list[str], new: DataFrame, held: DataFrame) -> DataFrame:
    """Tags after a group of them was given anew: rows of the group go, but for held leads, and the new ones come in, also but for held leads."""
    h = held.select("lead_id").distinct()
    out = tags.where(~F.col("tag").isin(group)).unionByName(tags.where(F.col("tag").isin(group)).join(h, "lead_id", "left_semi").select(*tags.columns))
    return out.unionByName(new.where(F.col("tag").isin(group)).join(h, "lead_id", "left_anti").select(*tags.columns))


def rewritten(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Rows of which a column's new form differs from what is there, with both: column, old, new."""
    out = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("old"), x.cast("string").alias("new")) for c, x in changes.items()]
    keys = [c for c in df.columns if c not in changes]
    return df.select(*keys, F.explode(F.array(*out)).alias("e")).where("not (e.old <=> e.new)").select(*keys, "e.*")


def chats_to_read(chats: DataFrame, decided: DataFrame, policy: dict[str, bool], as_of: str, hours: int) -> DataFrame:
    """Chats to read now: monitored by decision, else by the policy for their kind, and either stale by `hours` or with an incomplete history."""
    by_kind = F.create_map(*[F.lit(x) for kv in policy.items() for x in kv])
    j = chats.join(decided.select("chat_id", "monitor"), "chat_id", "left")
    on = F.coalesce("monitor", F.try_element_at(by_kind, F.col("kind")), F.lit(False))
    due = F.col("last_read_at").isNull() | (F.col("last_read_at") < F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {int(hours)} HOURS")) | ~F.coalesce("history_complete", F.lit(False))
    return j.where(on & due).select(*chats.columns)


def changed_identity_claims(old: DataFrame, new: DataFrame) -> DataFrame:
    """lead_id, kind, value: what leads newly say of themselves; an unchanged column claims nothing, and a URL in token form is no profile URL."""
    o = old.select(F.col("id").alias("__id"), F.col("linkedin_url").alias("__url"), F.col("linkedin_urn").alias("__urn"))
    j = new.join(o, F.col("id") == F.col("__id"), "left")
    u = U.profile_url(F.col("linkedin_url"))
    url = F.when(~F.col("linkedin_url").eqNullSafe(F.col("__url")) & (u != "") & U.member_token(u).isNull(), u)
    urn = F.when(~F.col("linkedin_urn").eqNullSafe(F.col("__urn")), F.nullif(F.trim("linkedin_urn"), F.lit("")))
    each = F.array(F.struct(F.lit("linkedin_url").alias("kind"), url.alias("value")), F.struct(U.identity_kind(urn).alias("kind"), urn.alias("value")))
    return j.select(F.col("id").alias("lead_id"), F.explode(each).alias("e")).select("lead_id", "e.*").where("value is not null")


def conflicts_backfilled(leads: DataFrame, identities: DataFrame) -> DataFrame:
    """lead_id, kind, value, owner_lead_id: what unmerged leads say of themselves and another lead owns as an identity."""
    u, t = F.nullif(U.profile_url(F.col("linkedin_url")), F.lit("")), F.col("member_urn")
    each = F.array(F.struct(F.lit("linkedin_url").alias("kind"), u.alias("value")), F.struct(F.lit("linkedin_urn").alias("kind"), t.alias("value")))
    said = leads.where("merged_into is null").select(F.col("id").alias("lead_id"), F.explode(each).alias("e")).select("lead_id", "e.*").where("value is not null")
    own = identities.select("kind", "value", F.col("lead_id").alias("owner_lead_id"))
    return said.join(own, ["kind", "value"]).where("lead_id <> owner_lead_id").select("lead_id", "kind", "value", "owner_lead_id").distinct()


def usage_costs(usage: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Usage (keys, calls, ...) with the latest price of its keys and what the calls cost by it; null where there is no price. `prices`: keys, price, seen_at, id."""
    p = latest_by(prices.select(*keys, "price", "seen_at", "id"), keys, ["seen_at", "id"]).select(*keys, "price")
    return usage.join(p, keys, "left").withColumn("est_cost", F.col("calls") * F.col("price"))


def backfill_state(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """How far back a history was read: the oldest and newest time seen, complete once it was said to be."""
    return W.upsert(old, new, [key], {"oldest": W.least, "newest": W.greatest, "complete": W.either})
