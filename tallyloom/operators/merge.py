"""Folding duplicate leads into their keepers, in bulk.

The state is a dict of DataFrames; a merge gives a new one, nothing is changed in place. One round
folds at most one duplicate into a keeper, so that what one merge leaves decides what the next one
may move; rounds go by the order given. A round is a fixed number of equi-joins whatever the number
of pairs. Nothing is deleted except the keeper's own flags that named the duplicate, and each of
these is returned as an audit row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import urls as U
from tallyloom.operators.lineage import cut

# Child tables, their lead column, and the rest of their unique key (None: there is none).
CHILDREN: dict[str, tuple[str, list[str] | None]] = {
    "enrichment_calls": ("lead_id", None), "lead_sources": ("lead_id", None), "lead_qualifications": ("lead_id", None), "campaign_members": ("lead_id", ["campaign_id"]), "lead_actions": ("lead_id", None), "posts": ("poster_lead_id", None),
    "post_engagements": ("lead_id", None), "lead_tags": ("lead_id", ["tag"]), "lead_signals": ("lead_id", ["enricher_name", "enricher_version"]), "lead_conversations": ("lead_id", ["operator_id", "channel"]), "lead_meetings": ("lead_id", None),
    "signals": ("subject_lead_id", None), "assertions": ("subject_lead_id", None), "targets": ("lead_id", ["purpose"]), "lead_touches": ("lead_id", None), "crm_leads": ("lead_id", None), "crm_contacts": ("lead_id", None),
}
FILL = ["name", "headline", "current_title", "current_company", "current_company_url", "city", "country", "bio", "last_enriched_at"]
IDENTITY = ["linkedin_url", "linkedin_urn", "member_urn", "public_id"]
FLAGS = ["flag:duplicate_lead", "expansion:do_not_push"]


def refusals(state: dict[str, DataFrame], pairs: DataFrame) -> DataFrame:
    """pairs (dup, keeper) with `refused`: why a pair cannot be merged, null where it can.

    Both must be there, differ and be unmerged, and an open finding on a member token must tie them.
    """
    l = state["leads"].select("id", "merged_into")
    j = pairs.join(l.select(F.col("id").alias("dup"), F.lit(True).alias("d_is"), F.col("merged_into").alias("d_in")), "dup", "left")
    j = j.join(l.select(F.col("id").alias("keeper"), F.lit(True).alias("k_is"), F.col("merged_into").alias("k_in")), "keeper", "left")
    open_ = state["lead_identity_conflicts"].where("resolved_by_merge is null and kind = 'linkedin_urn'").select("kind", "value", "lead_id", "owner_lead_id")
    own = state["lead_identities"].where("kind = 'linkedin_urn'").select("kind", "value", F.col("lead_id").alias("owner_lead_id"))
    tied = open_.join(own, ["kind", "value", "owner_lead_id"], "left_semi")
    ways = tied.select(F.col("lead_id").alias("dup"), F.col("owner_lead_id").alias("keeper")).union(tied.select(F.col("owner_lead_id").alias("dup"), F.col("lead_id").alias("keeper"))).distinct().withColumn("tied", F.lit(True))
    j = j.join(ways, ["dup", "keeper"], "left")
    why = (
        F.when(F.col("dup").isNull() | F.col("keeper").isNull(), "both are required").when(F.col("dup") == F.col("keeper"), "the same row").when(F.col("d_is").isNull() | F.col("k_is").isNull(), "no such lead")
        .when(F.col("d_in").isNotNull() | F.col("k_in").isNotNull(), "already merged").when(F.col("tied").isNull(), "no shared member token")
    )
    return j.select(*pairs.columns, why.alias("refused"))


def merge_queue_pairs(state: dict[str, DataFrame], score: DataFrame) -> DataFrame:
    """dup, keeper, merge_order, from the open findings: of those tied by one token, the one with the longest history is kept, then the oldest, then the smallest id; the token's owner merges first."""
    c = state["lead_identity_conflicts"].where("resolved_by_merge is null and kind = 'linkedin_urn' and owner_lead_id is not null and lead_id <> owner_lead_id")
    who = c.select("value", F.col("lead_id").alias("id"), F.lit(1).alias("late")).union(c.select("value", F.col("owner_lead_id").alias("id"), F.lit(0).alias("late"))).groupBy("value", "id").agg(F.min("late").alias("late"))
    l = state["leads"].where("merged_into is null").select("id", "created_at").join(score.select(F.col("lead_id").alias("id"), "score"), "id", "left")
    r = who.join(l, "id")
    keep = r.groupBy("value").agg(F.min_by("id", F.struct((-F.coalesce("score", F.lit(0))).alias("a"), F.col("created_at").alias("b"), F.col("id").alias("c"))).alias("keeper"))
    d = r.join(keep, "value").where("id <> keeper").groupBy(F.col("id").alias("dup")).agg(F.min(F.struct("late", "value", "keeper")).alias("m"))
    return d.select("dup", "m.keeper", F.col("m.late").alias("merge_order"))


def merge_round(state: dict[str, DataFrame], pairs: DataFrame, by: str, at: str) -> dict[str, DataFrame]:
    """The state after merging the pairs (dup, keeper), each dup and each keeper in one pair only, none both. Refused pairs are in `lead_merges_refused`."""
    judged = cut(refusals(state, pairs.select("dup", "keeper")), "judged").df
    p = judged.where("refused is null").select("dup", "keeper", F.sha2(F.concat_ws(">", "dup", "keeper", F.lit(by)), 256).alias("merge_id"))
    out = dict(state)
    out["lead_merges_refused"] = judged.where("refused is not null")
    moved_counts = []
    for t, (col, unique) in CHILDREN.items():
        if t not in state:
            continue
        df, mark = state[t], f"merged_from_{col}"
        if mark not in df.columns:
            df = df.withColumn(mark, F.lit(None).cast(dict(df.dtypes)[col]))
        j = df.join(p.select(F.col("dup").alias(col), F.col("keeper").alias("__k")), col, "left")
        stays = F.lit(False)
        if unique:
            taken = df.select(F.col(col).alias("__k"), *[F.col(u).alias(f"__u_{u}") for u in unique]).distinct().withColumn("__taken", F.lit(True))
            on = F.col("__k") == F.col("__tk")
            for u in unique:
                on = on & (F.col(u) == F.col(f"__u_{u}"))
            j = j.join(taken.withColumnRenamed("__k", "__tk"), on, "left")
            stays = F.coalesce(F.col("__taken"), F.lit(False))
        if t == "lead_tags":
            flagged = df.where(F.col("tag") == FLAGS[0]).select(F.col(col).alias("__f")).distinct().withColumn("__flag", F.lit(True))
            j = j.join(flagged, F.col(col) == F.col("__f"), "left")
            stays = stays | (F.col("tag") == FLAGS[0]) | ((F.col("tag") == FLAGS[1]) & F.coalesce(F.col("__flag"), F.lit(False)))
        go = F.col("__k").isNotNull() & ~stays
        done = j.withColumn("__go", go).withColumn(mark, F.when(F.col("__go"), F.col(col)).otherwise(F.col(mark))).withColumn(col, F.when(F.col("__go"), F.col("__k")).otherwise(F.col(col)))
        out[t] = cut(done.select(*df.columns), t).df
        moved_counts.append(out[t].join(p, (F.col(col) == F.col("keeper")) & (F.col(mark) == F.col("dup"))).groupBy("merge_id").agg(F.count("*").alias("n")).select("merge_id", F.lit(f"{t}.{col}").alias("what"), "n"))
    ids = state["lead_identities"]
    if "merged_from_lead_id" not in ids.columns:
        ids = ids.withColumn("merged_from_lead_id", F.lit(None).cast("string"))
    j = ids.join(p.select(F.col("dup").alias("lead_id"), F.col("keeper").alias("__k")), "lead_id", "left")
    go = F.col("__k").isNotNull()
    ids = j.select(*[{"lead_id": F.coalesce("__k", "lead_id"), "is_primary": F.col("is_primary") & ~go, "merged_from_lead_id": F.when(go, F.col("lead_id")).otherwise(F.col("merged_from_lead_id"))}.get(c, F.col(c)).alias(c) for c in ids.columns])

    leads = state["leads"]
    fill = [c for c in FILL if c in leads.columns]
    dup = leads.join(p, F.col("id") == F.col("dup")).select("keeper", "merge_id", F.col("dup").alias("__d"), *[F.col(c).alias(f"__d_{c}") for c in [*fill, *IDENTITY, "email"]])
    held = ids.where("kind = 'email'").groupBy("value").agg(F.min("lead_id").alias("__owner"))
    dup = dup.join(leads.select(F.col("id").alias("keeper"), F.col("email").alias("__k_email")), "keeper").withColumn("__mail", F.nullif(F.lower(F.trim("__d_email")), F.lit(""))).join(held, F.col("__mail") == F.col("value"), "left").drop("value")
    fate = (
        F.when(F.col("__mail").isNull(), "none").when(F.coalesce(F.trim("__k_email"), F.lit("")) == "", "filled").when(F.lower(F.trim("__k_email")) == F.col("__mail"), "same")
        .when(F.col("__owner").isNull(), "identity").when(F.col("__owner") == F.col("keeper"), "already the keeper's").otherwise("owned by another lead")
    )
    dup = cut(dup.withColumn("email_fate", fate), "folded").df
    urn_form = F.coalesce(F.col("linkedin_url").rlike("(?i)/in/" + U.MEMBER_TOKEN), F.lit(False)) & ~F.coalesce(F.col("__d_linkedin_url").rlike("(?i)/in/" + U.MEMBER_TOKEN), F.lit(True))
    j = leads.join(dup.drop("__k_email"), F.col("id") == F.col("keeper"), "left").join(p.select(F.col("dup").alias("__me"), F.col("keeper").alias("__to")), F.col("id") == F.col("__me"), "left")
    gone = F.col("__me").isNotNull()
    new = {c: F.coalesce(F.col(c), F.col(f"__d_{c}")) for c in fill}
    new |= {c: F.when(gone, None).otherwise(F.coalesce(F.col(c), F.col(f"__d_{c}"))) for c in IDENTITY}
    new["linkedin_url"] = F.when(gone, None).when(urn_form, F.col("__d_linkedin_url")).otherwise(F.coalesce("linkedin_url", "__d_linkedin_url"))
    new["email"] = F.when(gone, None).when(F.col("email_fate") == "filled", F.col("__d_email")).otherwise(F.col("email"))
    new["merged_into"] = F.when(gone, F.col("__to")).otherwise(F.col("merged_into"))
    out["leads"] = cut(j.select(*[new.get(c, F.col(c)).alias(c) for c in leads.columns]), "leads").df
    extra = dup.where("email_fate = 'identity'").select(*[{"lead_id": F.col("keeper"), "kind": F.lit("email"), "value": F.col("__mail"), "is_primary": F.lit(False), "source": F.lit("merge"), "id": F.sha2(F.concat("merge_id", F.lit("email")), 256)}.get(c, F.lit(None).cast(t)).alias(c) for c, t in ids.dtypes])
    out["lead_identities"] = cut(ids.unionByName(extra), "identities").df

    out["lead_identity_conflicts"] = cut(_conflicts(state["lead_identity_conflicts"], p), "conflicts").df
    if "lead_tags" in out:
        out["lead_tags"], out["retired_flags"] = _retire(out["lead_tags"], dup.select("keeper", "merge_id", F.col("__d").alias("dup"), F.col("__d_linkedin_url").alias("url")))
    old = state.get("lead_merges")
    counts = None
    for m in moved_counts:
        counts = m if counts is None else counts.unionAll(m)
    ledger = p.join(dup.select("merge_id", "email_fate"), "merge_id", "left")
    if counts is not None:
        ledger = ledger.join(counts.groupBy("merge_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("what", "n"))))).alias("moved")), "merge_id", "left")
    else:
        ledger = ledger.withColumn("moved", F.lit(None).cast("string"))
    ledger = ledger.select("merge_id", F.col("dup").alias("dup_id"), F.col("keeper").alias("keeper_id"), F.lit(by).alias("merged_by"), F.lit(at).cast("timestamp_ntz").alias("merged_at"), "moved", "email_fate")
    out["lead_merges"] = cut(ledger if old is None else old.unionByName(ledger), "merges").df
    return out


def _conflicts(c: DataFrame, p: DataFrame) -> DataFrame:
    """The pair's findings resolved; the duplicate's other open ones handed to the keeper, unless it holds the same already."""
    cols = c.columns
    for m in ("merged_from_lead_id", "merged_from_owner_lead_id"):
        if m not in cols:
            c = c.withColumn(m, F.lit(None).cast("string"))
    cols = c.columns
    both = p.select(F.col("dup").alias("__a"), F.col("keeper").alias("__b"), "merge_id").union(p.select(F.col("keeper"), F.col("dup"), F.col("merge_id")))
    c = c.join(both, (F.col("lead_id") == F.col("__a")) & (F.col("owner_lead_id") == F.col("__b")), "left")
    c = c.withColumn("resolved_by_merge", F.coalesce("resolved_by_merge", "merge_id")).select(*cols)
    own = c.join(p.select(F.col("dup").alias("owner_lead_id"), F.col("keeper").alias("__k")), "owner_lead_id", "left")
    go = F.col("resolved_by_merge").isNull() & F.col("__k").isNotNull() & (F.col("lead_id") != F.col("__k"))
    c = own.withColumn("merged_from_owner_lead_id", F.when(go, F.col("owner_lead_id")).otherwise(F.col("merged_from_owner_lead_id"))).withColumn("owner_lead_id", F.when(go, F.col("__k")).otherwise(F.col("owner_lead_id"))).select(*cols)
    c = cut(c, "handed").df
    taken = c.select(F.col("lead_id").alias("__k"), F.col("kind").alias("__kind"), F.col("value").alias("__value")).distinct().withColumn("__taken", F.lit(True))
    j = c.join(p.select(F.col("dup").alias("lead_id"), F.col("keeper").alias("__to")), "lead_id", "left").join(taken, (F.col("__to") == F.col("__k")) & (F.col("kind") == F.col("__kind")) & (F.col("value") == F.col("__value")), "left")
    go = F.col("resolved_by_merge").isNull() & F.col("__to").isNotNull() & F.col("__taken").isNull() & ~F.coalesce(F.col("owner_lead_id") == F.col("__to"), F.lit(False))
    # several rows of one (kind, value) of the duplicate: the first is handed over
    w = Window.partitionBy("__to", "kind", "value").orderBy("id")
    j = j.withColumn("__go", go & (F.row_number().over(w) == 1))
    return j.withColumn("merged_from_lead_id", F.when(F.col("__go"), F.col("lead_id")).otherwise(F.col("merged_from_lead_id"))).withColumn("lead_id", F.when(F.col("__go"), F.col("__to")).otherwise(F.col("lead_id"))).select(*cols)


def _retire(tags: DataFrame, folded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags left, flags retired): the keeper's flags whose notes name the duplicate, by id or by its whole URL."""
    j = tags.join(folded.select(F.col("keeper").alias("__k"), "dup", "url", "merge_id"), (F.col("lead_id") == F.col("__k")) & F.col("tag").isin(FLAGS), "left")
    notes = F.coalesce(F.col("notes"), F.lit(""))
    after = F.expr("substr(coalesce(notes, ''), instr(coalesce(notes, ''), url) + length(url), 1)")
    named = F.contains(notes, F.col("dup")) | (F.contains(notes, F.col("url")) & ~after.rlike("[A-Za-z0-9_%-]"))
    j = cut(j.withColumn("__gone", F.coalesce(F.col("__k").isNotNull() & named, F.lit(False))), "flags").df
    return j.where("not __gone").select(*tags.columns), j.where("__gone").select(*tags.columns, F.concat(F.lit("resolved by merge "), "merge_id").alias("removed_reason"))


def merge_all(state: dict[str, DataFrame], pairs: DataFrame, by: str, at: str, order: str = "merge_order", most_rounds: int | None = None) -> dict[str, DataFrame]:
    """Merge pairs round after round, one duplicate a keeper each; a pair waits while its keeper is another pair's duplicate.

    Rounds go on until no pair is left. Pairs that can never run, as their rows lead to each other
    in a circle, are refused; so are those left after `most_rounds`, where it is given.
    """
    left = cut(pairs.select("dup", "keeper", F.col(order).alias("o")).distinct(), "left").df
    refused = None
    rounds = 0
    while not left.isEmpty():
        if rounds == most_rounds:
            rest = left.select("dup", "keeper", F.lit(f"not reached in {most_rounds} rounds").alias("refused"))
            refused = rest if refused is None else refused.unionByName(rest)
            break
        rounds += 1
        # a duplicate that is itself a keeper waits until what folds into it has done so
        leaf = left.join(left.select(F.col("keeper").alias("dup")).distinct(), "dup", "left_anti")
        one = leaf.withColumn("__r", F.row_number().over(Window.partitionBy("keeper").orderBy("o", "dup"))).where("__r = 1").drop("__r")
        one = cut(one.withColumn("__d", F.row_number().over(Window.partitionBy("dup").orderBy("o", "keeper"))).where("__d = 1").drop("__d"), "round").df
        if one.isEmpty():
            bad = left.select("dup", "keeper", F.lit("a circle of pairs").alias("refused"))
            refused = bad if refused is None else refused.unionByName(bad)
            break
        state = merge_round(state, one, by, at)
        r = state.pop("lead_merges_refused")
        refused = r if refused is None else refused.unionByName(r)
        left = cut(left.join(one.select("dup", "keeper"), ["dup", "keeper"], "left_anti"), "left").df
    if refused is not None:
        state = state | {"lead_merges_refused": refused}
    return state


def row_counts(state: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of every table: a merge changes none of them but the ledger's and those of retired flags and filed e-mails."""
    return {t: df.count() for t, df in state.items()}
