"""Who is who: claims on identifiers, match ladders, duplicate reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import names as N
from tallyloom.functions import urls as U
from tallyloom.operators.joins import pairs_within


def settle_claims(owned: DataFrame, claims: DataFrame, holder: str = "lead_id") -> DataFrame:
    """Claims with `owner` and `outcome`: empty, inserted, ours, or duplicate.

    A (kind, value) belongs to whoever owns it already, else to the first claim by `seq` (then by
    the holder's id); the outcome is the one claims would have one after another. `owned` has kind,
    value and holder; `claims` has these and `seq`. One grouped minimum a value, so that a value a
    third of all rows claim is one row a task before the shuffle.
    """
    blank = F.col("value").isNull() | (F.trim("value") == "")
    real = claims.where(~blank)
    bids = real.select("kind", "value", F.lit(1).alias("late"), F.col("seq").cast("string").alias("s"), F.col("seq"), F.col(holder).alias("h"))
    held = owned.select("kind", "value", F.lit(0).alias("late"), F.lit("").alias("s"), F.lit(0).cast(dict(claims.dtypes)["seq"]).alias("seq"), F.col(holder).alias("h"))
    first = bids.unionByName(held).groupBy("kind", "value").agg(F.min(F.struct("late", "seq", "h")).alias("w")).select("kind", "value", F.col("w.h").alias("owner"), (F.col("w.late") == 0).alias("was_owned"), F.col("w.seq").alias("won_at"))
    j = claims.join(first, ["kind", "value"], "left")
    mine = F.col(holder) == F.col("owner")
    new = mine & ~F.col("was_owned") & (F.col("seq") == F.col("won_at"))
    outcome = F.when(blank, "empty").when(new, "inserted").when(mine, "ours").otherwise("duplicate")
    return j.withColumn("outcome", outcome).withColumn("owner", F.when(~blank, F.col("owner"))).drop("was_owned", "won_at")


def match_ladder(rows: DataFrame, key: str, steps: list[tuple[str, Column, DataFrame, str, str]]) -> DataFrame:
    """rows with `matched_id` and `matched_by`: the first step, in order, whose key is found.

    A step is (name, key of the row, table, the table's key, the table's id). Each table is brought
    to one id a key (the smallest) first, so that rows never multiply; null keys match nothing.
    """
    out, ids, how = rows, [], []
    for i, (name, value, df, k, v) in enumerate(steps):
        t = df.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"__k{i}")).agg(F.min(v).alias(f"__v{i}"))
        out = out.withColumn(f"__x{i}", value).join(t, F.col(f"__x{i}") == F.col(f"__k{i}"), "left")
        ids.append(F.col(f"__v{i}"))
        how.append(F.when(F.col(f"__v{i}").isNotNull(), name))
    return out.select(*[F.col(c) for c in rows.columns], F.coalesce(*ids).alias("matched_id"), F.coalesce(*how).alias("matched_by"))


def _profile_steps(url: str, leads: DataFrame, identities: DataFrame) -> list[tuple[str, Column, DataFrame, str, str]]:
    u = U.profile_url(F.col(url))
    token = U.member_token(F.col(url))
    is_kind = lambda *k: identities.where(F.col("kind").isin(*k))
    return [
        ("identity_url", u, is_kind("linkedin_url"), "value", "lead_id"),
        ("identity_urn", token, is_kind("linkedin_urn", "linkedin_urn_search"), "value", "lead_id"),
        ("lead_url", u, leads.withColumn("__u", U.profile_url(F.col("linkedin_url"))).where("__u != ''"), "__u", "id"),
        ("lead_urn", token, leads, "member_urn", "id"),
        ("public_id", U.public_id(F.col(url)), leads.where(~F.col("public_id").startswith("AC")), "public_id", "id"),
    ]


def resolve_profiles(rows: DataFrame, url: str, leads: DataFrame, identities: DataFrame) -> DataFrame:
    """The lead a profile URL belongs to: by its identity URL, its member token, then the leads' own URL, token and public id."""
    return match_ladder(rows, url, _profile_steps(url, leads, identities))


def duplicate_groups(leads: DataFrame, key: Column, label: str) -> DataFrame:
    """label, value, n, smallest id: keys that several unmerged leads share."""
    k = leads.where("merged_into is null").select(key.alias("value"), "id").where("value is not null and value != ''")
    return k.groupBy("value").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1").select(F.lit(label).alias("basis"), "value", "n", "first_id")


def keeper_order(leads: DataFrame) -> Column:
    """A key whose greatest row is the one to keep: a member token, a URL in token form, then recency."""
    return F.struct(F.col("linkedin_urn").isNotNull().alias("a"), F.coalesce(F.col("linkedin_url").rlike(r"/in/AC[ow]AA"), F.lit(False)).alias("b"), F.coalesce("last_enriched_at", "created_at").alias("c"), F.col("updated_at").alias("d"), F.col("id").alias("e"))


def relationship_score(children: list[tuple[DataFrame, str]]) -> DataFrame:
    """lead_id, score: a lead's rows over all child tables."""
    each = [df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("lead_id")).agg(F.count("*").alias("n")) for df, c in children]
    return reduce(DataFrame.unionByName, each).groupBy("lead_id").agg(F.sum("n").alias("score"))


def same_name_pairs(people: DataFrame, context: str, key: str, name: str, most: int = 3) -> DataFrame:
    """context, name_key, a, b: people of one context under one full name, where at most `most` share it."""
    d = people.withColumn("name_key", N.full_name_key(F.col(name)))
    return pairs_within(d, [context, "name_key"], key, most)


def member_ids(identities: DataFrame, kinds: list[str]) -> DataFrame:
    """lead_id, value: the member token each lead goes by, of the kinds given.

    A token of the member form comes first, then the member kind, then the primary row, then the
    oldest (rows without a time last), then the smallest value.
    """
    order = F.struct(~F.col("value").startswith("ACoAA"), F.col("kind") != "linkedin_urn", ~F.coalesce("is_primary", F.lit(False)), F.col("created_at").isNull(), "created_at", "value")
    return identities.where(F.col("kind").isin(kinds)).groupBy("lead_id").agg(F.min_by("value", order).alias("value"))


def canonical_urls(rows: DataFrame, url: str, hint: str, leads: DataFrame, identities: DataFrame) -> DataFrame:
    """rows with `canonical_url`: the URL of the lead a profile URL belongs to, found by the URL itself, then by the token in `hint`; the URL as it is where no lead, or none with a URL, is found."""
    token = U.member_token(F.col(hint))
    urns = identities.where(F.col("kind").isin("linkedin_urn", "linkedin_urn_search"))
    found = match_ladder(rows, url, [*_profile_steps(url, leads, identities), ("hint_identity", token, urns, "value", "lead_id"), ("hint_lead", token, leads, "member_urn", "id")])
    own = leads.select(F.col("id").alias("matched_id"), F.nullif("linkedin_url", F.lit("")).alias("__own"))
    return found.join(own, "matched_id", "left").select(*rows.columns, F.when(F.coalesce(F.col(url), F.lit("")) != "", F.coalesce("__own", url)).otherwise(F.col(url)).alias("canonical_url"))


def best_identity(identities: DataFrame, priority: list[str]) -> DataFrame:
    """One identity a lead: the first kind of the list, then the smallest value."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.col("kind")), F.lit(0)), F.lit(len(priority) + 1))
    return identities.groupBy("lead_id").agg(F.min(F.struct(rank.alias("r"), "kind", "value")).alias("m")).select("lead_id", "m.kind", "m.value")


def resolve_posters(posts: DataFrame, leads: DataFrame, identities: DataFrame, companies: DataFrame) -> DataFrame:
    """Posts with the lead or the company their poster URL names: a person by identity URL, token, then lead URL; a company by slug, as written, then in lower case."""
    url = F.col("poster_linkedin_url")
    person = U.profile_handle(url) != ""
    u = F.when(person, U.profile_url(url))
    p = match_ladder(posts, "poster_linkedin_url", [
        ("identity_url", u, identities.where("kind = 'linkedin_url'"), "value", "lead_id"),
        ("identity_urn", F.when(person, U.member_token(url)), identities.where("kind = 'linkedin_urn'"), "value", "lead_id"),
        ("lead_url", u, leads.withColumn("__u", U.profile_url(F.col("linkedin_url"))).where("__u != ''"), "__u", "id"),
    ]).withColumnRenamed("matched_id", "resolved_lead_id").drop("matched_by")
    slug = U.found(url, r"/(?:company|showcase|school)/([^/?#\s]+)", 1)
    c = match_ladder(p, "poster_linkedin_url", [("slug", slug, companies, "linkedin_slug", "id"), ("slug_lower", F.lower(slug), companies.withColumn("__s", F.lower("linkedin_slug")), "__s", "id")])
    return c.withColumnRenamed("matched_id", "resolved_company_id").drop("matched_by")
