"""Composite pipelines."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import names as N
from tallyloom.operators.joins import chain_roots
from tallyloom.operators.latest import latest_by, most_common


def flat_comments(df: DataFrame, comments: str) -> DataFrame:
    """One row a comment and a reply to it, from an array of struct<author, text, replies: array<struct<author, text>>>."""
    own = df.withColumn("c", F.explode(comments))
    keep = [c for c in df.columns if c != comments]
    top = own.select(*keep, F.col("c.author").alias("author"), F.col("c.text").alias("text"), F.lit(False).alias("is_reply"))
    return top.unionAll(own.withColumn("r", F.explode("c.replies")).select(*keep, F.col("r.author"), F.col("r.text"), F.lit(True)))


def twins(collectives: DataFrame, members: DataFrame, least: int = 20, most_head: int = 5) -> DataFrame:
    """id, head: groups of one provider under one name, where the largest has at least `least` members; their head is the smallest id among the others with at most `most_head`.

    Every group of the twins hangs below the head, which itself hangs below nothing.
    """
    n = members.groupBy(F.col("collective_id").alias("id")).agg(F.count("*").alias("n"))
    c = collectives.join(n, "id", "left").select("id", "provider", F.array_join(N.name_words(F.col("name")), " ").alias("key"), F.coalesce("n", F.lit(0)).alias("n")).where("key != ''")
    g = c.groupBy("provider", "key").agg(F.count("*").alias("size"), F.max(F.struct(F.col("n"), (-F.hash("id")).alias("h"), F.col("id"))).alias("big"))
    g = g.where((F.col("size") > 1) & (F.col("big.n") >= least)).select("provider", "key", F.col("big.id").alias("big"))
    j = c.join(g, ["provider", "key"])
    head = j.where((F.col("n") <= most_head) & (F.col("id") != F.col("big"))).groupBy("provider", "key").agg(F.min("id").alias("head"))
    return j.join(head, ["provider", "key"]).where("id != head").select("id", "head")


def stems(collectives: DataFrame) -> DataFrame:
    """stem, id: groups sharing the first two words of their names, where at least two names differ."""
    w = N.name_words(F.col("name"))
    c = collectives.select("id", w.alias("w")).where(F.size("w") >= 2).where((F.length(F.col("w")[0]) >= 2) & (F.length(F.col("w")[1]) >= 2))
    c = c.select("id", F.concat_ws(" ", F.slice("w", 1, 2)).alias("stem"), F.array_join("w", " ").alias("whole"))
    some = c.groupBy("stem").agg(F.countDistinct("whole").alias("names"), F.countDistinct("id").alias("n")).where("names >= 2 and n >= 2")
    return c.join(some, "stem", "left_semi").select("stem", "id")


def withdrawn_links(collectives: DataFrame, monitored: DataFrame) -> DataFrame:
    """Collectives without the inferred links whose root holds no monitored group; decided links stay."""
    top = chain_roots(collectives, "id", "parent_id")
    live = top.join(monitored.select("id").distinct(), "id", "left_semi").select("root").distinct().withColumn("live", F.lit(True))
    j = collectives.join(top, "id").join(live, "root", "left")
    drop = (F.col("parent_source") == "inferred") & F.col("live").isNull()
    return j.withColumn("parent_id", F.when(~F.coalesce(drop, F.lit(False)), F.col("parent_id"))).withColumn("parent_source", F.when(~F.coalesce(drop, F.lit(False)), F.col("parent_source"))).select(*collectives.columns)


def dossiers(leads: DataFrame, parts: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """Leads with one JSON array of rows a child table, in order; a table is (rows, lead column, columns, the first one being the order)."""
    out = leads
    for name, (df, key, cols) in parts.items():
        rows = df.groupBy(F.col(key).alias("__k")).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*cols)))).alias(name))
        out = out.join(rows, out["id"] == rows["__k"], "left").drop("__k").withColumn(name, F.coalesce(name, F.lit("[]")))
    return out


def bench_counts(leads: DataFrame, seeds: str, by_url: DataFrame, url: str, value: str) -> DataFrame:
    """Leads whose JSON array of seed URLs is opened, with the distinct values of those seeds, joined by ` | `, and their number."""
    opened = leads.select("id", F.explode(F.from_json(seeds, "array<string>")).alias(url))
    hits = opened.join(by_url, url).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(value)), " | ").alias("values"), F.countDistinct(url).alias("n_seeds"))
    return leads.join(hits, "id", "left").withColumn("n_seeds", F.coalesce("n_seeds", F.lit(0)))


def chat_people(members: DataFrame, identities: DataFrame, order: list[str]) -> DataFrame:
    """One row a chat member: the most common name that is no number, and the lead of the first kind of identifier, in `order`, that is known.

    `members`: member_id, name, and one column for each kind in `order`.
    """
    named = most_common(members.where(~F.col("name").rlike(r"^[+\d\s().-]+$")), ["member_id"], "name").drop("n")
    ids = members.groupBy("member_id").agg(*[F.min(k).alias(k) for k in order])
    found = []
    for k in order:
        t = identities.where(F.col("kind") == k).groupBy(F.col("value").alias(k)).agg(F.min("lead_id").alias(f"__{k}"))
        ids = ids.join(t, k, "left")
        found.append(F.col(f"__{k}"))
    return ids.select("member_id", F.coalesce(*found).alias("lead_id")).join(named, "member_id", "left")


def sole_evidence(forward: DataFrame, backward: DataFrame, leads: DataFrame) -> DataFrame:
    """Tokens that stored answers tie to a lead, looked up either way (lead_id, token, answered_name): kept where a lead has exactly one and the names share a word."""
    both = forward.select("lead_id", "token", "answered_name").unionAll(backward.select("lead_id", "token", "answered_name")).where("lead_id is not null and token is not null")
    one = both.groupBy("lead_id").agg(F.countDistinct("token").alias("n"), F.min(F.struct("token", "answered_name")).alias("e")).where("n = 1")
    j = one.join(leads.select(F.col("id").alias("lead_id"), "name"), "lead_id")
    return j.where(F.arrays_overlap(N.name_words(F.col("name")), N.name_words(F.col("e.answered_name")))).select("lead_id", "e.token", "name", "e.answered_name")


def to_sync(chats: DataFrame, synced: DataFrame) -> DataFrame:
    """Chats never synced, or changed since."""
    j = chats.join(synced.select("chat_id", "last_synced_at"), "chat_id", "left")
    return j.where(F.col("last_synced_at").isNull() | (F.col("last_synced_at") < F.col("changed_at")))


def replace_groups(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows with the groups that were fetched again replaced by what was fetched."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def fill_from_verdicts(leads: DataFrame, verdicts: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Leads whose empty fields are filled from the latest verdict's JSON; `fields` maps a column to its key."""
    v = latest_by(verdicts.select("lead_id", "qualified_at", "id", "full_result"), ["lead_id"], ["qualified_at", "id"])
    v = v.select(F.col("lead_id").alias("__l"), *[F.nullif(F.get_json_object("full_result", f"$.{k}"), F.lit("")).alias(f"__{c}") for c, k in fields.items()])
    j = leads.join(v, leads["id"] == v["__l"], "left")
    return j.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")).alias(c) if c in fields else F.col(c) for c in leads.columns])


def supersede(active: DataFrame, new: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """All rows, in which an active row whose key (nulls being equal) a new one has is ended at `at`; an equal value ends nothing and comes in once."""
    on = None
    n = new.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("value").alias("__value"))
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = c if on is None else on & c
    j = active.join(n.dropDuplicates([f"__{k}" for k in keys]).withColumn("__hit", F.lit(True)), on, "left")
    ends = F.col("__hit") & F.col("removed_at").isNull() & ~F.col("value").eqNullSafe(F.col("__value"))
    kept = j.withColumn("removed_at", F.when(ends, at).otherwise(F.col("removed_at"))).select(*active.columns)
    same = active.where("removed_at is null")
    on2 = F.col("o.value").eqNullSafe(F.col("n.value"))
    for k in keys:
        on2 = on2 & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    fresh = new.alias("n").join(same.alias("o"), on2, "left_anti").select(*[F.col(f"n.{c}") if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in active.dtypes])
    return kept.unionByName(fresh)


def _slot(text: str) -> tuple[str, str] | None:
    """(record, JSON path within it) of what stands in a slot: names joined by dots, or keys in brackets; None for anything else."""
    word = lambda w: w.isidentifier() and w.isascii()
    rest = text.strip()
    head = next((rest[:i] for i in range(len(rest)) if rest[i] in ".["), rest)
    rest, path = rest[len(head):], ""
    while rest:
        if rest[0] == ".":
            part = next((rest[1:i] for i in range(1, len(rest)) if rest[i] in ".["), rest[1:])
            if not word(part):
                return None
            path, rest = f"{path}.{part}", rest[1 + len(part):]
        elif rest[0] == "[" and "]" in rest[2:]:
            key = rest[1:rest.index("]", 2)]
            rest = rest[len(key) + 2:]
            path += f"[{key.strip()}]" if key.strip().isdigit() else "." + key.strip("'\" ")
        else:
            return None
    return (head, path) if word(head) else None


def render(template: str, df: DataFrame, records: dict[str, str]) -> Column:
    """The template with its `{{ record.field[0] }}` slots filled from JSON columns; what is not there is nothing.

    Compiled to one concatenation: a slot is a JSON path into the column of its record.
    """
    before, *pieces = template.split("{{")
    parts = [F.lit(before)]
    for p in pieces:
        inner, closed, after = p.partition("}}")
        slot = _slot(inner) if closed else None
        if slot is None:
            parts.append(F.lit("{{" + p))
            continue
        head, path = slot
        if head in records:
            parts.append(F.coalesce(F.get_json_object(records[head], "$" + path) if path else F.col(records[head]), F.lit("")))
        parts.append(F.lit(after))
    return F.concat(*parts)


def posting_stats(posts: DataFrame, by: str, likes: str, at: str, as_of: str, months: int = 3) -> DataFrame:
    """Per poster: posts, mean and median reactions, and posts of the last months; the definition is ours."""
    recent = F.col(at) >= F.add_months(F.to_timestamp_ntz(F.lit(as_of)), -months)
    return posts.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("posts"), F.count_if(recent).alias("posts_recent"), F.round(F.avg(likes), 4).alias("mean_reactions"), F.percentile(likes, F.lit(0.5)).alias("median_reactions"))


@F.pandas_udf(T.BooleanType())
def name_on_page(name: pd.Series, text: pd.Series) -> pd.Series:
    """Whether a name is printed on a page, whatever its case and accents."""
    from tallyloom.functions.names import unaccented

    return pd.Series([bool(n) and bool(t) and unaccented(n) in unaccented(t) for n, t in zip(name, text)])


def visible_speakers(speakers: DataFrame, pages: DataFrame, near: int = 200) -> DataFrame:
    """Speakers whose name is on their page, with a title and a company only where these stand within `near` characters of it."""
    j = speakers.join(pages.select("page_id", F.lower("text").alias("page_text")), "page_id").where(name_on_page(F.col("name"), F.col("page_text")))
    at = lambda c: F.instr(F.col("page_text"), F.lower(F.col(c)))
    close = lambda c: F.when((at(c) > 0) & (F.abs(at(c) - at("name")) <= near + F.length("name")), F.col(c))
    return j.withColumn("title", close("title")).withColumn("company", close("company")).drop("page_text")
