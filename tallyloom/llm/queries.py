"""The subpackage's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import canonical, conversations, groups, leaks, mixing, orgs, pii, sentences, survivor
from tallyloom.llm.sql import SQL
from tallyloom.session import table


def live_keywords(spark: SparkSession, d: str) -> list[str]:
    """The live entries; a policy table is a short list kept by hand."""
    live = table(spark, d, "voice_policy").where("superseded_at is null").select(F.explode("title_keywords").alias("k")).where("k is not null").distinct()
    return [r["k"] for r in live.collect()]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    got = canonical.map_to_entries(table(spark, d, "leads"), "id", "current_title", live_keywords(spark, d))
    return got.select(F.col("id").alias("lead_id"), F.col("entry").alias("title_keyword"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Leads with a real title that names no live entry."""
    leads = table(spark, d, "leads").where(survivor.real_text(F.col("current_title")))
    got = canonical.map_to_entries(leads, "id", "current_title", live_keywords(spark, d), report_unmatched=True)
    return got.where("entry is null").select(F.col("id").alias("lead_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    lead = table(spark, d, "leads").select(F.col("id").alias("lead"), "current_company")
    pairs, clusters = orgs.link_names(lead, "lead", "current_company", table(spark, d, "companies").select("id", "name"), "id", "name")
    typed = pairs.select(F.concat(F.lit("company:"), "id").alias("key_a"), F.concat(F.lit("lead:"), "lead").alias("key_b"))
    # organisations have few rows each, so that pairs within a cluster stay few
    c = clusters.select("group_id", F.concat(F.lit("company:"), "node").alias("k"))
    same = c.select("group_id", F.col("k").alias("key_a")).join(c.select("group_id", F.col("k").alias("key_b")), "group_id").where("key_a < key_b").select("key_a", "key_b")
    return typed.unionAll(same)


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Companies of one organisation: one row a company with its cluster and the cluster's size."""
    lead = table(spark, d, "leads").select(F.col("id").alias("lead"), "current_company")
    _, clusters = orgs.link_names(lead.limit(0), "lead", "current_company", table(spark, d, "companies").select("id", "name"), "id", "name")
    n = clusters.groupBy("group_id").agg(F.count("*").alias("n_rows"))
    return clusters.join(n, "group_id").select(F.col("node").alias("company_id"), "group_id", "n_rows")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    g = groups.connected_groups(table(spark, d, "lead_identity_conflicts"), "lead_id", "owner_lead_id")
    return g.select(F.col("node").alias("lead_id"), "group_id")


def p3_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("group_id").agg(F.count("*").alias("n_leads"))


def p4_rows(spark: SparkSession, d: str, time: str) -> DataFrame:
    leads = table(spark, d, "leads")
    roots = survivor.merge_roots(leads, "id", "merged_into")
    rows = roots.join(leads.select("id", "current_title", "current_company", "linkedin_url", "updated_at", "created_at", "last_enriched_at"), "id").withColumnRenamed("root", "keeper_id")
    fields = {c: survivor.real_text(F.col(c)) for c in ("current_title", "current_company")} | {"linkedin_url": survivor.real_profile_url(F.col("linkedin_url"))}
    return survivor.survivors(rows, "keeper_id", "id", fields, time, ["created_at"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_rows(spark, d, "updated_at").select("keeper_id", "field_name", F.col("id").alias("lead_id"))


def p4_by_currency(spark: SparkSession, d: str) -> DataFrame:
    """Survivors by the enrichment time, which many rows lack: there the learned precedences decide."""
    return p4_rows(spark, d, "last_enriched_at").select("keeper_id", "field_name", F.col("id").alias("lead_id"), "value")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.left_out(table(spark, d, "lead_messages")).select("conversation_id")


def p5_sessions(spark: SparkSession, d: str) -> DataFrame:
    msgs = conversations.messages(table(spark, d, "lead_messages"), bodies=False).where("readable").drop("readable")
    return conversations.session_summary(conversations.sessions(conversations.turns(msgs)))


def free_texts(spark: SparkSession, d: str) -> DataFrame:
    parts = [("lead_messages", "body"), ("lead_tags", "notes"), ("posts", "post_text")]
    out = None
    for t, c in parts:
        own = table(spark, d, t).where(F.col(c).isNotNull()).select(F.lit(t).alias("source_table"), F.col("id").alias("record_id"), F.col(c).alias("text"))
        out = own if out is None else out.unionAll(own)
    return out


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_types(free_texts(spark, d), ["source_table", "record_id"], "text", pii.known_names(table(spark, d, "leads"), "name")).distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every free text with typed placeholders in the place of personal information."""
    return pii.redact(free_texts(spark, d), ["source_table", "record_id"], "text", pii.known_names(table(spark, d, "leads"), "name"))


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The kept conversations: their messages in order, with sessions, roles and bodies."""
    return conversations.rebuilt(table(spark, d, "lead_messages"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Test items with the documents that carry them."""
    return p8_leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.round(F.max("share"), 4).alias("most"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixed corpus: uses of documents in training order."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"), "doc_id", "text")


def p10_sentences_per_document(spark: SparkSession, d: str) -> DataFrame:
    return p10_found(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_sentences"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_unmatched, p2_found, p2_clusters, p3_found, p3_group_sizes, p4_found, p4_by_currency, p5_found, p5_sessions, p5_conversations, p6_found, p6_redacted, p8_found, p8_leaked_items, p9_mix, p9_shares, p10_found, p10_sentences_per_document]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}
