"""The roles of the data model, read off the star tables, in Spark and as SQL for the comparison.

A role is a table of the model (leads, campaigns, ...) with the columns the views need. Each is
given twice: as a DataFrame and as the SELECT DuckDB runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import table

AS_OF = "1998-01-01 00:00:00"
STATUS = {"NO": "staged", "NF": "uploaded", "AO": "message_sent", "AF": "replied", "RO": "removed_other", "RF": "completed"}
# The declared order of membership states.
STATUS_ORDER = ["staged", "uploaded", "connection_sent", "connected", "message_sent", "replied", "meeting_booked", "completed", "pending_removal", "disqualified", "removed_blocked", "removed_other"]


class Roles:
    """Lazily built role tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def __getitem__(self, role: str) -> DataFrame:
        return _BUILD[role](self)


def _companies(r: Roles) -> DataFrame:
    slug = F.lower(F.regexp_replace("s_name", "#", "-"))
    return r.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("country"), slug.alias("linkedin_slug"), F.concat(F.lit("https://www.linkedin.example/company/"), slug).alias("linkedin_url"))


def _leads(r: Roles) -> DataFrame:
    """A lead works for the company its key leads to; every second URL is written in capitals and with a slash."""
    n = r.raw("supplier").agg(F.count("*").alias("n_companies"))
    c = r.raw("customer").crossJoin(F.broadcast(n)).withColumn("company_id", F.col("c_custkey") % F.col("n_companies"))
    url = F.concat(F.lit("https://www.linkedin.example/company/supplier-"), F.lpad(F.col("company_id").cast("string"), 9, "0"))
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("persona"), "company_id", F.col("c_acctbal").alias("score"),
        F.concat(F.lit("https://www.linkedin.example/in/"), F.lower(F.regexp_replace("c_name", "#", "-"))).alias("linkedin_url"),
        F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.concat(F.lit("Head of "), F.lower("c_mktsegment"))).alias("current_title"), F.concat(F.lit("Supplier "), F.col("company_id")).alias("current_company"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.upper(url), F.lit("/"))).otherwise(url).alias("current_company_url"),
    )


def _lead_sources(r: Roles) -> DataFrame:
    return r.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("lead_id"), F.col("o_orderpriority").alias("source_type"), F.col("o_orderstatus").alias("source_label"), F.col("o_orderdate").alias("recorded_at"))


def _lead_qualifications(r: Roles) -> DataFrame:
    o = r.raw("orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("lead_id"), F.when(F.col("o_orderkey") % 7 == 0, "policy").otherwise(F.col("o_orderpriority")).alias("qualifier_name"),
        F.when(F.col("o_orderkey") % 7 == 0, "active_deal_dq_v1.0").otherwise(F.concat(F.lit("v"), (F.col("o_orderkey") % 3).cast("string"))).alias("qualifier_version"),
        (F.col("o_orderstatus") == "F").alias("qualified"), F.col("o_orderpriority").alias("persona"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("qualified_at"),
        F.lower("o_orderstatus").alias("seniority"), F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("status "), F.col("o_orderstatus"))).alias("disqualified_reason"), F.concat(F.lit("deal of "), F.col("o_orderpriority")).alias("reason"),
        F.concat(F.lit('{"open_stage":"'), F.col("o_orderstatus"), F.lit('","deal_companies":["c'), F.col("o_custkey"), F.lit('"]}')).alias("full_result"),
    )


def _campaigns(r: Roles) -> DataFrame:
    return r.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "linkedin").otherwise("email").alias("channel"))


def _campaign_members(r: Roles) -> DataFrame:
    j = r.raw("lineitem").join(r.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = j.groupBy(F.col("o_custkey").alias("lead_id"), F.col("l_suppkey").alias("campaign_id")).agg(F.min("l_shipdate").alias("staged_at"), F.max("l_shipdate").alias("last_status_at"), F.max(F.concat("l_returnflag", "l_linestatus")).alias("code"))
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return g.select(F.concat_ws(":", "lead_id", "campaign_id").alias("id"), "lead_id", "campaign_id", "staged_at", F.when(F.col("code") != "NO", F.col("staged_at")).alias("uploaded_at"), "last_status_at", F.try_element_at(status, F.col("code")).alias("status"))


def _company_deals(r: Roles) -> DataFrame:
    j = r.raw("lineitem").join(r.raw("orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = j.groupBy(F.col("l_orderkey").alias("deal_id"), F.col("l_suppkey").alias("company_id")).agg(
        F.max(F.col("o_orderstatus") == "O").alias("is_open"), F.max(F.col("o_orderstatus") == "F").alias("is_won"), F.max(F.col("l_returnflag") == "R").alias("is_deleted"), F.sum("l_extendedprice").alias("amount"), F.max("l_shipdate").alias("synced_at"), F.min("l_returnflag").alias("stage_name"),
    )
    g = g.withColumn("company_name", F.concat(F.lit("Supplier "), F.col("company_id"))).withColumn("match_domain", F.concat(F.lit("s"), F.col("company_id"), F.lit(".example")))
    # deals whose number ends in 9 are known by slug only
    slug = F.concat(F.lit("supplier-"), F.lpad(F.col("company_id").cast("string"), 9, "0"))
    return g.withColumn("match_slug", F.when(F.col("deal_id") % 10 >= 5, slug)).withColumn("company_id", F.when(F.col("deal_id") % 10 != 9, F.col("company_id"))).withColumn("deleted_at", F.when(F.col("is_deleted"), F.col("synced_at")))


def _posts(r: Roles) -> DataFrame:
    return r.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("poster"), (F.col("p_partkey") % 40).alias("poster_lead_id"), F.col("p_size").alias("likes"), F.col("p_type").alias("kind"))


def _post_engagements(r: Roles) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return r.raw("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("lead_id"), k.alias("post_id"), F.col("event_type").alias("engagement_type"), F.col("ts").alias("at"))


def _signals(r: Roles) -> DataFrame:
    return r.raw("events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("lead_id"), F.col("event_type").alias("enricher_name"), F.col("value"), F.col("props").alias("payload"), F.col("ts").alias("enriched_at"))


def _calls(r: Roles) -> DataFrame:
    return r.raw("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("api"), F.col("props").alias("params"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("cost"), F.col("ts").alias("fetched_at"))


def _star_tags(r: Roles) -> DataFrame:
    return r.raw("events").groupBy(F.col("user_id").alias("lead_id"), F.col("event_type").alias("tag")).agg(F.max("ts").alias("tagged_at"))


def _memberships(r: Roles) -> DataFrame:
    return r.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("collective_id"), F.lit("customer").alias("member_kind"), F.col("c_custkey").cast("string").alias("member_value"), F.when(F.col("c_acctbal") < 0, "left").otherwise("member").alias("member_state"), F.when(F.col("c_custkey") % 5 == 0, "host").otherwise("guest").alias("role"))


def _collectives(r: Roles) -> DataFrame:
    return r.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent_id"), F.when(F.col("n_nationkey") % 3 == 0, "event").otherwise("group").alias("kind"), F.concat(F.lit("op"), F.col("n_regionkey")).alias("operator_id"), F.lit("chat").alias("provider"))


_BUILD: dict[str, Callable[[Roles], DataFrame]] = {
    "companies": _companies, "leads": _leads, "lead_sources": _lead_sources, "lead_qualifications": _lead_qualifications, "campaigns": _campaigns, "campaign_members": _campaign_members, "company_deals": _company_deals,
    "posts": _posts, "post_engagements": _post_engagements, "signals": _signals, "enrichment_calls": _calls, "star_tags": _star_tags, "memberships": _memberships, "collectives": _collectives,
}

_slug = "'supplier-' || lpad(CAST(company_id AS VARCHAR), 9, '0')"
SQL = {
    "r_companies": "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS country, lower(replace(s_name, '#', '-')) AS linkedin_slug, 'https://www.linkedin.example/company/' || lower(replace(s_name, '#', '-')) AS linkedin_url FROM supplier",
    "r_leads": f"""SELECT id, name, country, persona, company_id, score, linkedin_url, CASE WHEN persona <> 'HOUSEHOLD' THEN 'Head of ' || lower(persona) END AS current_title, 'Supplier ' || company_id AS current_company, CASE WHEN id % 2 = 0 THEN upper(u) || '/' ELSE u END AS current_company_url FROM (
        SELECT *, 'https://www.linkedin.example/company/' || {_slug} AS u FROM (
        SELECT c_custkey AS id, c_name AS name, c_nationkey AS country, c_mktsegment AS persona, c_custkey % (SELECT count(*) FROM supplier) AS company_id, c_acctbal AS score, 'https://www.linkedin.example/in/' || lower(replace(c_name, '#', '-')) AS linkedin_url FROM customer))""",
    "r_lead_sources": "SELECT o_orderkey AS id, o_custkey AS lead_id, o_orderpriority AS source_type, o_orderstatus AS source_label, o_orderdate AS recorded_at FROM orders",
    "r_lead_qualifications": "SELECT o_orderkey AS id, o_custkey AS lead_id, CASE WHEN o_orderkey % 7 = 0 THEN 'policy' ELSE o_orderpriority END AS qualifier_name, CASE WHEN o_orderkey % 7 = 0 THEN 'active_deal_dq_v1.0' ELSE 'v' || (o_orderkey % 3) END AS qualifier_version, o_orderstatus = 'F' AS qualified, o_orderpriority AS persona, o_totalprice AS amount, o_orderdate AS qualified_at, lower(o_orderstatus) AS seniority, CASE WHEN o_orderstatus <> 'F' THEN 'status ' || o_orderstatus END AS disqualified_reason, 'deal of ' || o_orderpriority AS reason, '{\"open_stage\":\"' || o_orderstatus || '\",\"deal_companies\":[\"c' || o_custkey || '\"]}' AS full_result FROM orders",
    "r_campaigns": "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'linkedin' ELSE 'email' END AS channel FROM supplier",
    "r_campaign_members": "SELECT lead_id || ':' || campaign_id AS id, lead_id, campaign_id, staged_at, CASE WHEN code <> 'NO' THEN staged_at END AS uploaded_at, last_status_at, CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END AS status FROM (SELECT o_custkey AS lead_id, l_suppkey AS campaign_id, min(l_shipdate) AS staged_at, max(l_shipdate) AS last_status_at, max(l_returnflag || l_linestatus) AS code FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)",
    "r_company_deals": f"""SELECT deal_id, CASE WHEN deal_id % 10 <> 9 THEN company_id END AS company_id, CASE WHEN deal_id % 10 >= 5 THEN {_slug} END AS match_slug, 'Supplier ' || company_id AS company_name, 's' || company_id || '.example' AS match_domain, is_open, is_won, is_deleted, amount, synced_at, stage_name, CASE WHEN is_deleted THEN synced_at END AS deleted_at FROM (
        SELECT l_orderkey AS deal_id, l_suppkey AS company_id, bool_or(o_orderstatus = 'O') AS is_open, bool_or(o_orderstatus = 'F') AS is_won, bool_or(l_returnflag = 'R') AS is_deleted, sum(l_extendedprice) AS amount, max(l_shipdate) AS synced_at, min(l_returnflag) AS stage_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)""",
    "r_posts": "SELECT p_partkey AS id, p_brand AS poster, p_partkey % 40 AS poster_lead_id, p_size AS likes, p_type AS kind FROM part",
    "r_post_engagements": "SELECT event_id AS id, user_id AS lead_id, CAST(props ->> 'k' AS BIGINT) AS post_id, event_type AS engagement_type, ts AS at FROM events",
    "r_signals": "SELECT event_id AS id, CASE WHEN event_id % 11 <> 0 THEN user_id END AS lead_id, event_type AS enricher_name, value, props AS payload, ts AS enriched_at FROM events",
    "r_enrichment_calls": "SELECT event_id AS id, event_type AS api, props AS params, event_type <> 'error' AS success, value AS cost, ts AS fetched_at FROM events",
    "r_star_tags": "SELECT user_id AS lead_id, event_type AS tag, max(ts) AS tagged_at FROM events GROUP BY ALL",
    "r_memberships": "SELECT c_custkey AS id, c_nationkey AS collective_id, 'customer' AS member_kind, CAST(c_custkey AS VARCHAR) AS member_value, CASE WHEN c_acctbal < 0 THEN 'left' ELSE 'member' END AS member_state, CASE WHEN c_custkey % 5 = 0 THEN 'host' ELSE 'guest' END AS role FROM customer",
    "r_collectives": "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS parent_id, CASE WHEN n_nationkey % 3 = 0 THEN 'event' ELSE 'group' END AS kind, 'op' || n_regionkey AS operator_id, 'chat' AS provider FROM nation",
}


def with_roles(body: str) -> str:
    """The SQL with the roles it names put before it."""
    import re

    used = [k for k in SQL if re.search(rf"\b{k}\b", body)]
    head = ", ".join(f"{k} AS ({SQL[k]})" for k in used)
    body = body.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[len('WITH RECURSIVE'):]}"
    return f"WITH {head}, {body[len('WITH'):]}" if body.upper().startswith("WITH") else f"WITH {head} {body}"
