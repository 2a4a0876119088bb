import pytest
from pyspark.sql import functions as F

from tallyloom.functions import names as N
from tallyloom.functions import text as X
from tallyloom.functions import urls as U


def run(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first()["r"]


@pytest.mark.parametrize("form", [
    "https://www.linkedin.com/in/jos%C3%A9-1/", "http://LinkedIn.com/in/jos%c3%a9-1?x=1#y", "linkedin.com/in/josé-1", " HTTPS://WWW.LINKEDIN.COM/in/jos%25C3%25A9-1// ", "www.linkedin.com/in/josé-1#top",
])
def test_forms_of_one_profile(spark, form):
    assert run(spark, U.profile_url, form) == "https://www.linkedin.com/in/josé-1"
    assert run(spark, U.profile_url, run(spark, U.profile_url, form)) == "https://www.linkedin.com/in/josé-1"


def test_profiles_that_differ(spark):
    got = {run(spark, U.profile_url, u) for u in ["https://www.linkedin.com/in/ACoAAAbc", "https://www.linkedin.com/in/acoaaabc", "https://www.linkedin.com/in/Ann", "https://www.linkedin.com/in/ann", "https://www.linkedin.com/in/a+b", "https://www.linkedin.com/in/a%20b"]}
    assert len(got) == 6
    assert run(spark, U.profile_url, None) == run(spark, U.profile_url, "  ") == ""
    assert run(spark, U.profile_url, "https://www.linkedin.com/in/bad%zz") == "https://www.linkedin.com/in/bad%zz"


def test_identities(spark):
    token = "ACoAA" + "x" * 14
    assert run(spark, U.profile_handle, "https://x/in/ann-b%20") == "ann-b" and run(spark, U.profile_handle, None) == ""
    assert run(spark, U.member_token, "nothing", f"u/{token}") == token and run(spark, U.member_token, None, "ACshort") is None
    assert run(spark, U.public_id, f"https://x/in/{token}") is None and run(spark, U.public_id, "https://x/in/ann") == "ann"
    assert run(spark, U.member_urn, f"https://x/in/{token}", "z") == token
    assert [run(spark, U.identity_kind, v) for v in (token, "ACwAAxyz", "https://x/in/a")] == ["linkedin_urn", "linkedin_urn_search", "linkedin_url"]
    assert run(spark, U.company_slug, "https://www.linkedin.com/company/Acme-X/", "n") == "acme-x" and run(spark, U.company_slug, None, "Acme, Inc.") == "acme-inc" and run(spark, U.company_slug, None, None) == ""


@pytest.mark.parametrize(("urn", "url", "ok"), [
    ("urn:li:activity:716412978179607062", "https://x/update/urn:li:activity:716412978179607062", True), ("urn:li:share:716412978179607062", None, True), ("urn:li:ugcPost:716412978179607062", "https://x/716412978179607062-abc", True),
    ("urn:li:activity:716412978179607062", "https://x/999", False), ("716412978179607062", None, False), ("urn:li:comment:716412978179607062", None, False), ("urn:li:activity:123", None, False), (None, None, False),
])
def test_post_keys(spark, urn, url, ok):
    assert run(spark, U.post_key_ok, urn, url) is ok


def test_clean_url_and_site(spark):
    assert run(spark, U.clean_url, "HTTPS://Ex.Com/A/b/?utm_source=x&q=1&UTM_medium=y#f") == "https://ex.com/A/b?q=1"
    assert run(spark, U.clean_url, "ex.com/") == "https://ex.com"
    assert run(spark, U.site_domain, "https://www.Ex.com/a/b") == "ex.com"


def test_names(spark):
    assert run(spark, N.full_name_key, "José  O'Núñez (he/him) | x") == "jose nunez"
    assert run(spark, N.full_name_key, "Ann") is None and run(spark, N.full_name_key, None) is None
    assert run(spark, N.name_words, "(N)YC Founders & co-2") == ["nyc", "founders", "co", "2"]
    assert run(spark, N.slug, "Crème  Brûlée! Fest") == "creme-brulee-fest"
    assert run(spark, N.company_key, "The Acme Holdings, Inc.") == "acme"
    assert run(spark, N.company_keys_match, "northwind", "northwind planning suite") is True
    assert run(spark, N.company_keys_match, "ey", "eyewear") is False and run(spark, N.company_keys_match, "", "x") is False
    assert run(spark, N.company_of_headline, "", "CTO at Acme at Home") == "Acme at Home" and run(spark, N.title_of_headline, "CTO at Acme at Home") == "CTO" and run(spark, N.title_of_headline, "Founder") == "Founder"
    assert run(spark, N.phone_key, "(02) 5550 0153") == "+0255500153" and run(spark, N.phone_key, "12") is None
    assert str(run(spark, N.first_date, " ", "2024-05-06T10:00", "2020-01-01")) == "2024-05-06" and run(spark, N.first_date, "soon") is None
    assert run(spark, N.title_is_at, "CFO at Acme Corp", "Acme") is True and run(spark, N.title_is_at, "CFO @ Other", "Acme") is False and run(spark, N.title_is_at, "CFO", "Acme") is True


def test_text_and_json(spark):
    page = "<html><script>var x='<p>no</p>';</script><style>p{}</style><p>Fish &amp; <b>chips</b></p>\n<svg>z</svg></html>"
    assert run(spark, X.visible_text, page) == "Fish & chips"
    assert run(spark, lambda c: X.note_value(c, "not_before"), "a\nnot_before: 2025-02-12\nb") == "2025-02-12"
    assert run(spark, X.canonical_json, '{"b":1,"a":"x"}') == run(spark, X.canonical_json, '{"a":"x","b":"1"}')
    assert run(spark, lambda c: X.json_has_key(c, "k"), '{"k":null}') is True and run(spark, lambda c: X.json_has_key(c, "k"), "no json") is False
    assert run(spark, X.without_nul, '{"a":"x\\u0000y"}') == '{"a":"xy"}'
    assert run(spark, X.formatted_none, "Ann None") is True and run(spark, X.formatted_none, "Nonesuch") is False
    assert run(spark, X.is_reshare, '{"author":{"url":"https://x/in/bob"}}', "ann") is True and run(spark, X.is_reshare, "{}", "ann") is False
    assert run(spark, X.campaign_name_ok, "acme_outreach_emea_cfo_202405") is True and run(spark, X.campaign_name_ok, "acme_202413") is False


@pytest.mark.parametrize(("title", "company", "ok"), [
    ("CEO at Acme | Advisor at Beta", "Beta", False), ("CEO at Acme | Advisor at Beta", "Acme Inc", True), ("Board member, Beta - at Acme", "Acme", True), ("CFO@Acme/Beta", "Beta", False), ("Chef (at) home", "Beta", True), ("Head of Chat", "Beta", True), ("Ops at\tBeta; ex Acme", "Beta Group", True), (None, "Beta", True), ("", None, True), ("CEO at Acme", "", True), ("CEO at Acme\nnow elsewhere", "Beta", True),
])
def test_title_is_at(spark, title, company, ok):
    assert run(spark, N.title_is_at, title, company) is ok


@pytest.mark.parametrize(("name", "handles"), [
    ("Ben & Jerry's", ["ben-and-jerrys", "benandjerrys", "ben-and", "benand", "ben", "ben-jerrys", "benjerrys", "ben-&-jerrys", "ben&jerrys", "ben-&"]), ("Acme Planning, Inc.", ["acme-planning", "acmeplanning", "acme", "acme-planning-inc", "acmeplanninginc"]), ("Acme-Widgets LP", ["acme-widgets", "acmewidgets", "acme", "acme-widgets-lp", "acmewidgetslp"]), ("Holdings", ["holdings"]), ("  ", []), (None, []),
])
def test_slug_candidates(spark, name, handles):
    assert run(spark, N.slug_candidates, name) == handles


@pytest.mark.parametrize(("rule", "ok"), [
    (None, True), ("{}", True), ('{"own_posts_90d_min": 5}', True), ('{"own_posts_90d_min": "5"}', False), ('{"own_posts_90d_min": -1}', False), ('{"own_posts_365d_min": 2.5, "always_include": ["founder", "own_asset"]}', True), ('{"always_include": ["founder"]}', True), ('{"always_include": ["x"]}', False), ('{"always_include": "founder"}', False), ('{"always_include": [null]}', False), ('{"always_include": []}', True), ('{"own_posts_90d_min": null}', False), ('{"other": 1}', False), ("null", False), ("[1]", False), ("no json", False),
])
def test_activity_rule(spark, rule, ok):
    assert run(spark, X.activity_rule_ok, rule) is ok


@pytest.mark.parametrize(("raw", "poster", "ok"), [
    ('{"reshared": false}', "ann", False), ('{"reshared": true}', "ann", True), ('{"is_repost": true}', None, True), ('{"author": {"url": "https://x/in/Ann"}}', "ann", False), ('{"author": {"url": "https://x/in/bob"}}', "ann", True), ('{"author": {"url": "https://x/in/bob"}}', "", False), ('{"type": "Repost"}', "ann", True), ('{"type": "post"}', "ann", False), ('{"shared_post": {"id": 1}}', "ann", True), ('{"shared_post": {}}', "ann", False), ('{"repost_urn": ""}', "ann", False), ('{"reposted_post": "urn:x"}', "ann", True), (None, "ann", False),
])
def test_reshares(spark, raw, poster, ok):
    assert run(spark, X.is_reshare, raw, poster) is ok


@pytest.mark.parametrize(("name", "ok"), [("srcV1.0_cto_seq_desc_202401", True), ("a_b_c_d_202413", True), ("A_b_c_d_202401", False), ("a_b_c_202401", False), ("a_b_c_d_20240", False), (None, False)])
def test_campaign_names(spark, name, ok):
    assert run(spark, X.campaign_name_ok, name) is ok


def test_pages(spark):
    page = "<p>A<br/>b &lt;c&gt;</p><noscript><p>no</p></noscript><svg><g>x</g></svg>d<!-- e --> <script>if (a < b) {}</script>f"
    assert run(spark, X.visible_text, page) == "A b <c> d f" and run(spark, X.visible_text, None) is None and run(spark, X.visible_text, "") == ""
    block = '<script type="application/ld+json">{"@graph": [{"@type": "Event", "performer": [{"@type": ["Person"], "name": " Ann B ", "jobTitle": "CTO", "worksFor": {"name": "Acme"}, "sameAs": ["https://x/in/ann"]}, {"@type": "Person", "name": ""}]}]}</script><script type="application/ld+json">{broken</script>'
    assert [tuple(p) for p in run(spark, X.linked_people, block * 2)] == [("Ann B", "CTO", "Acme", "https://x/in/ann")] and run(spark, X.linked_people, None) == []
