"""Rules on writes: observations and decisions, retired tags, merged leads, tripwires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import urls as U
from tallyloom.operators.latest import latest_by
from tallyloom.operators.writes import overwrite, upsert


def undisciplined(assertions: DataFrame) -> DataFrame:
    """Assertions with `broken`, the first rule they break: an observation has evidence and no decider, a decision a decider, a way, a reason and no evidence of its own."""
    obs, dec = F.col("kind") == "observation", F.col("kind") == "decision"
    evidence = F.col("evidence_signal_id").isNotNull() | F.col("evidence_enrichment_call_id").isNotNull()
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    why = (
        F.when(F.col("kind").isNotNull() & ~F.col("kind").isin("observation", "decision"), "unknown kind").when(obs & F.col("decided_by").isNotNull(), "an observation is not decided").when(obs & ~evidence, "an observation needs evidence")
        .when(dec & blank("decided_by"), "a decision needs a decider").when(dec & blank("via"), "a decision needs a way").when(dec & blank("notes"), "a decision needs a reason").when(dec & evidence, "a decision's evidence is its basis")
    )
    return assertions.withColumn("broken", why).where("broken is not null")


def baseless(assertions: DataFrame, key: str = "id", basis: str = "basis") -> DataFrame:
    """key, missing: basis entries that are no observation; an empty basis is one as well, with a null entry."""
    d = assertions.where(F.col(basis).isNotNull())
    each = d.select(key, F.explode_outer(basis).alias("missing"))
    seen = assertions.where("kind = 'observation'").select(F.col(key).alias("missing"))
    return each.join(seen, "missing", "left_anti").select(key, "missing")


def refused_tags(tags: DataFrame, definitions: DataFrame) -> DataFrame:
    """Tags that are retired, with the message their definition gives."""
    d = definitions.where("retired_message is not null").select(F.concat_ws(":", F.nullif("namespace", F.lit("")), "key").alias("tag"), "retired_message")
    return tags.join(d, "tag")


def writes_to_merged(children: dict[str, tuple[DataFrame, str]], leads: DataFrame) -> DataFrame:
    """table_name, n, merged leads that rows of child tables still name."""
    gone = leads.where("merged_into is not null").select(F.col("id").alias("__m"))
    out = None
    for name, (df, c) in children.items():
        one = df.join(gone, F.col(c) == F.col("__m"), "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionAll(one)
    return out.where("n > 0")


def lowered_tokens(leads: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Leads whose URL holds a member token in lower case, which leads nowhere; those of the baseline are known."""
    bad = leads.where(F.col("linkedin_url").rlike(r"/in/ac[a-z0-9_\-]{15,}$") & ~F.col("linkedin_url").rlike("/in/" + U.MEMBER_TOKEN)).select("id", "linkedin_url")
    return bad if baseline is None else bad.join(baseline.select("id").distinct(), "id", "left_anti")


def swap_tags(tags: DataFrame, verdicts: DataFrame, yes: str, no: str, queue: str) -> DataFrame:
    """Tags after verdicts (lead_id, qualified): the queue's and the opposite tag are gone, the verdict's tag is there once."""
    v = verdicts.where("qualified is not null").select("lead_id", F.when(F.col("qualified"), yes).otherwise(no).alias("tag")).distinct()
    drop = v.select("lead_id", F.lit(queue).alias("tag")).unionAll(v.select("lead_id", F.when(F.col("tag") == yes, no).otherwise(yes).alias("tag")))
    left = tags.join(drop, ["lead_id", "tag"], "left_anti")
    new = v.join(left.select("lead_id", "tag").distinct(), ["lead_id", "tag"], "left_anti")
    return left.select(*tags.columns).unionByName(new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in tags.dtypes]))


def import_outcomes(verdicts: DataFrame, tags: DataFrame, log: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(verdicts, tags) after a log of row_id, lead_id, at, outcome: rows are added once by row_id; a lead's `prefix` tags give way to its latest outcome.

    Importing the same log again changes nothing.
    """
    fresh = log.join(verdicts.select("row_id").distinct(), "row_id", "left_anti").dropDuplicates(["row_id"])
    all_ = verdicts.unionByName(fresh.select(*verdicts.columns))
    last = latest_by(log.where("lead_id is not null").select("lead_id", "at", "row_id", "outcome"), ["lead_id"], ["at", "row_id"])
    keep = tags.join(last.select("lead_id"), "lead_id", "left_anti").unionByName(tags.join(last.select("lead_id"), "lead_id", "left_semi").where(~F.col("tag").startswith(prefix)))
    new = last.select("lead_id", F.concat(F.lit(prefix), "outcome").alias("tag"))
    return all_, keep.select(*tags.columns).unionByName(new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in tags.dtypes]))


def register(processors: DataFrame, specs: DataFrame) -> DataFrame:
    """Programs by name and version, a spec given again replacing the text and keeping when it was created."""
    return upsert(processors, specs, ["name", "version"], {"created_at": lambda old, new: F.coalesce(old, new)}, overwrite)


def ignored_note_ok(tag: Column, notes: Column) -> Column:
    """Notes of `ignored:*` tags read `category: ...; detail: ...; via: ...`, with a category and a detail; other tags need none."""
    return F.coalesce(~tag.startswith("ignored:") | notes.rlike(r"^category: \S[^;]*; detail: \S[^;]*(?:; via: \S.*)?$"), F.lit(False))
