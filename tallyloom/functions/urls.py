"""URLs and the identities they carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of profile, member and post identifiers.
MEMBER_TOKEN = r"AC[A-Za-z0-9_\-]{15,}"
PROFILE_HANDLE = r"/in/([A-Za-z0-9_\-]+)"
POST_KEY = r"^urn:li:(?:activity|ugcPost|share):[0-9]{15,}$"
URL_PARTS = r"(?i)^(https?://)?((?:[a-z0-9-]+\.)+[a-z]{2,})((?:/.*)?)$"


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, null where there is none."""
    x = F.regexp_extract(c, pattern, group)
    return F.when(x != "", x)


def percent_decoded(path: Column, passes: int = 3) -> Column:
    """Percent escapes undone up to `passes` times; `+` stays, and a path with a broken escape stays as it is."""
    # a fold names each step's result once, where nested expressions would repeat it
    once = lambda p, _: F.coalesce(F.try_url_decode(F.regexp_replace(p, r"\+", "%2B")), p)
    return F.reduce(F.sequence(F.lit(1), F.lit(passes)), path, once)


def profile_url(url: Column) -> Column:
    """The canonical form of a profile URL: https, lower-case host (`www.` before a bare linkedin.com), decoded path in its own case, no query, fragment or last slash. Null and blank give ''."""
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"[?#].*$", "")
    host = F.lower(F.regexp_extract(u, URL_PARTS, 2))
    host = F.when(host == "linkedin.com", "www.linkedin.com").otherwise(host)
    path = percent_decoded(F.regexp_replace(F.regexp_extract(u, URL_PARTS, 3), r"/+$", ""))
    return F.when(u == "", "").when(host == "", percent_decoded(F.regexp_replace(u, r"/+$", ""))).otherwise(F.concat(F.lit("https://"), host, path))


def company_url_key(url: Column) -> Column:
    return F.regexp_replace(F.lower(url), r"/+$", "")


def profile_handle(url: Column) -> Column:
    """The tail of `/in/`, up to the first sign that is no letter, digit, `_` or `-`; '' where there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), PROFILE_HANDLE, 1)


def member_token(*values: Column) -> Column:
    """The first member token in any of the values, in their order."""
    return F.coalesce(*[found(v, MEMBER_TOKEN) for v in values])


def member_urn(url: Column, urn: Column) -> Column:
    return F.coalesce(found(url, r"in/(" + MEMBER_TOKEN + ")", 1), found(urn, MEMBER_TOKEN))


def public_id(url: Column) -> Column:
    """The vanity handle of a profile URL; null where the handle is a member token."""
    h = found(url, PROFILE_HANDLE, 1)
    return F.when(~h.rlike(r"(?i)^AC.{15,}$"), h)


def identity_kind(value: Column) -> Column:
    """Where a handle is filed: member token, search token, or vanity URL."""
    return F.when(value.startswith("ACoAA"), "linkedin_urn").when(value.startswith("ACwAA"), "linkedin_urn_search").otherwise("linkedin_url")


def company_slug(url: Column, name: Column) -> Column:
    """The slug in a company URL, else the name slugified; '' where neither gives one."""
    from_url = F.lower(found(url, r"(?i)/company/([A-Za-z0-9_\-]+)", 1))
    from_name = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(from_url, from_name, F.lit(""))


def site_domain(url: Column) -> Column:
    """Lower case, without scheme, `www.` and path."""
    return F.split(F.regexp_replace(F.regexp_replace(F.lower(url), r"^https?://", ""), r"^www\.", ""), "/")[0]


def post_key_ok(urn: Column, url: Column) -> Column:
    """A post key is well formed, and its number occurs in the URL, if there is one."""
    return F.coalesce(urn.rlike(POST_KEY) & (url.isNull() | (F.instr(url, F.regexp_extract(urn, r"([0-9]+)$", 1)) > 0)), F.lit(False))


def activity_time(urn: Column) -> Column:
    """The time an activity id carries in its upper bits: milliseconds since 1970, for ids of 18 digits or more."""
    n = found(urn, r"([0-9]{18,19})\D*$", 1).try_cast("bigint")
    return F.timestamp_millis(F.shiftright(n, 22))


def clean_url(url: Column) -> Column:
    """Scheme and host in lower case, no `utm_` parameters, no last slash, no fragment."""
    u = F.regexp_replace(F.trim(url), r"#.*$", "")
    head, query = F.regexp_extract(u, r"^([^?]*)", 1), F.regexp_extract(u, r"\?(.*)$", 1)
    scheme = F.lower(F.regexp_extract(head, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(head, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host, path = F.lower(F.regexp_extract(rest, r"^([^/]*)", 1)), F.regexp_replace(F.regexp_extract(rest, r"^[^/]*(/.*)?$", 1), r"/+$", "")
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_")), "&")
    return F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
