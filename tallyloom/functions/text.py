"""Text, notes and JSON."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


_LINKED = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script", re.I | re.S)
# Elements whose content is not shown.
UNSEEN = {"script", "style", "noscript", "svg"}


class _Page(HTMLParser):
    """Collects what a page shows."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.shown: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.shown.append(" ")
        if tag in UNSEEN:
            self.inside.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.shown.append(" ")

    def handle_endtag(self, tag: str) -> None:
        self.shown.append(" ")
        if tag in self.inside:
            del self.inside[self.inside.index(tag):]

    def handle_data(self, data: str) -> None:
        if not self.inside:
            self.shown.append(data)


def page_text(page: str) -> str:
    p = _Page()
    p.feed(page)
    p.close()
    return " ".join("".join(p.shown).split())


@F.pandas_udf(T.StringType())
def visible_text(page: pd.Series) -> pd.Series:
    """A page's visible text, blanks squeezed: no tags, no content of elements that are not shown, entities read."""
    return page.map(lambda t: page_text(t) if isinstance(t, str) else None)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("name", "title", "company", "url")])))
def linked_people(page: pd.Series) -> pd.Series:
    """The people in a page's JSON-LD blocks, wherever they are nested: name, title, company and URL. Blocks that are no JSON are passed over."""

    def text(x: object) -> str | None:
        if isinstance(x, list):
            x = x[0] if x else None
        if isinstance(x, dict):
            x = x.get("name")
        return x.strip() or None if isinstance(x, str) else None

    def walk(root: object) -> Iterator[dict]:
        todo = [root]
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                kinds = x.get("@type")
                if "Person" in (kinds if isinstance(kinds, list) else [kinds]):
                    yield x
                todo += reversed(list(x.values()))
            elif isinstance(x, list):
                todo += reversed(x)

    def people(t: object) -> list[dict]:
        out: list[dict] = []
        for block in _LINKED.findall(t) if isinstance(t, str) else ():
            try:
                found = list(walk(json.loads(html.unescape(block) if "&quot;" in block else block)))
            except ValueError:
                continue
            for x in found:
                row = {"name": text(x.get("name")), "title": text(x.get("jobTitle")), "company": text(x.get("worksFor") or x.get("affiliation")), "url": text(x.get("sameAs") or x.get("url"))}
                if row["name"] and row not in out:
                    out.append(row)
        return out

    return page.map(people)


def note_value(notes: Column, key: str) -> Column:
    """What follows `key:` on its line of the notes; null where there is none."""
    x = F.trim(F.regexp_extract(notes, rf"(?m)(?:^|\s){key}:[ \t]*([^\n]*)", 1))
    return F.when(x != "", x)


def canonical_json(params: Column) -> Column:
    """A flat JSON object with its keys sorted and its values as strings, so that 1 and "1" are one."""
    m = F.from_json(params, "map<string,string>")
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def json_has_key(doc: Column, key: str) -> Column:
    """Whether the object has the key, also where its value is null."""
    return F.coalesce(F.array_contains(F.json_object_keys(doc), key), F.lit(False))


# The keys of an activity rule, and whom it may always include.
RULE_NUMBERS = ["own_posts_90d_min", "own_posts_365d_min", "median_own_reactions_min"]
RULE_ALWAYS = ["founder", "company_page", "own_asset"]


def activity_rule_ok(doc: Column) -> Column:
    """Null, or a JSON object of known keys whose numbers are not negative and whose `always_include` is an array of known words."""
    keys = F.json_object_keys(doc)
    v = F.try_parse_json(doc)
    has = lambda k: F.array_contains(keys, k)
    kind = lambda k: F.schema_of_variant(F.variant_get(v, f"$.{k}", "variant"))
    ok = F.size(F.array_except(keys, F.array(*map(F.lit, [*RULE_NUMBERS, "always_include"])))) == 0
    for k in RULE_NUMBERS:
        ok &= ~has(k) | (kind(k).rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)") & F.coalesce(F.try_variant_get(v, f"$.{k}", "double") >= 0, F.lit(False)))
    words = F.try_variant_get(v, "$.always_include", "array<string>")
    known = F.forall(words, lambda w: F.coalesce(w.isin(RULE_ALWAYS), F.lit(False)))
    ok &= ~has("always_include") | (kind("always_include").startswith("ARRAY") & F.coalesce(known, F.lit(False)))
    return doc.isNull() | F.coalesce(keys.isNotNull() & ok, F.lit(False))


def without_nul(c: Column) -> Column:
    """NUL signs dropped, plain and as a JSON escape."""
    return F.regexp_replace(F.regexp_replace(c, "\u0000", ""), r"\\u0000", "")


def formatted_none(c: Column) -> Column:
    """A name that was formatted from nothing."""
    return F.coalesce(c.rlike(r"(^|\s)None(\s|$)"), F.lit(False))


# Marks of a reshare in a stored post.
RESHARE_FLAGS, RESHARE_LINKS = ["reshared", "is_repost"], ["repost_urn", "reposted_post", "shared_post"]


def is_reshare(raw: Column, poster_slug: Column) -> Column:
    """Whether a stored post was written by somebody other than its poster, or carries a reshare's marks; a post without an author's URL, or of an unknown poster, is one by its marks only."""
    author = F.lower(F.regexp_extract(F.coalesce(F.get_json_object(raw, "$.author.url"), F.lit("")), r"/(?:in|company)/([^/?#]+)", 1))
    other = (author != "") & (F.coalesce(poster_slug, F.lit("")) != "") & (author != F.lower(poster_slug))
    flags = F.from_json(raw, ", ".join(f"{k} boolean" for k in RESHARE_FLAGS))
    marked = F.lower(F.get_json_object(raw, "$.type")) == "repost"
    out = F.coalesce(other, F.lit(False)) | F.coalesce(marked, F.lit(False))
    for k in RESHARE_FLAGS:
        out |= F.coalesce(flags[k], F.lit(False))
    for k in RESHARE_LINKS:
        out |= F.coalesce(~F.get_json_object(raw, f"$.{k}").isin("", "false", "0", "{}", "[]"), F.lit(False))
    return out


def campaign_name_ok(c: Column) -> Column:
    """Five tokens joined by `_`: four in camel case, with dots for versions, and a month of six digits."""
    return F.coalesce(c.rlike(r"^(?:[a-z][A-Za-z0-9.]*_){4}[0-9]{6}$"), F.lit(False))


def tag_parts(tag: Column) -> tuple[Column, Column]:
    """(namespace, key) of `namespace:key`; a tag without a colon has the namespace ''."""
    return F.when(tag.contains(":"), F.split_part(tag, F.lit(":"), F.lit(1))).otherwise(""), F.regexp_replace(tag, r"^[^:]*:", "")
