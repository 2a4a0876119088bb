import pytest

from tallyloom.operators import rules

ROWS = [
    {"title": "Head of Sales, EMEA", "n": 7, "tags": ["b", "a", "b"]}, {"title": "cto", "n": -7, "tags": []}, {"title": "", "n": 0, "tags": ["x"]}, {"title": "Sales sales", "n": 3, "tags": ["Top:a", "c"]},
]
RULES = [
    "lead['title'][:4] == 'Head'", "lead['title'][-5:].lower() == 'sales'", "lead['title'][2:1] == ''", "len(lead['tags'][1:]) > 1", "len(lead['tags'][:1]) == 1", "lead['n'] // 2 == 3", "lead['n'] % 4 == 1", "lead['n'] % -4 == -1", "lead['n'] ** 2 == 49", "+lead['n'] > 1", "round(lead['n'] / 2) == 4", "lead['title'].rfind('s') > 5", "lead['title'].find('a') == 2",
    "any(t.startswith('Top') for t in lead['tags'])", "all(len(t) == 1 for t in lead['tags'])", "any(t == 'b' for t in lead['tags'] if t != 'b')", "all(t == 'b' for t in lead['tags'] if t != 'a')", "len([t for t in lead['tags'] if t == 'b']) == 2", "len([k for k in ['sales', 'emea'] if k in lead['title'].lower()]) == 2", "sum([k in lead['title'].lower() for k in ['sales', 'emea', 'cto']]) == 1",
    "{'cto': 1, '': 2}.get(lead['title'], 0) == 2", "{'cto': 'yes'}.get(lead['title']) == 'yes'", "lead['title'] in {'cto': 1}", "max([lead['n'], 3]) == 3", "min([lead['n'], 3]) == 3", "isinstance(lead['title'], str)", "isinstance(lead['n'], (str, list))", "len(set(lead['tags'])) == 2", "sorted(['b', lead['title']])[0] == 'b'", "'b' in {'a': 1, 'b': 2}.keys()", "2 in {'a': 1, 'b': 2}.values()", "len(lead['title'].rsplit()) == 2", "[1, lead['n']][1] == 7", "any([k in lead['title'] for k in ['x', 'Head']])",
]


@pytest.mark.parametrize("rule", RULES)
def test_rules_are_those_of_python(spark, rule):
    df = spark.createDataFrame([tuple(r.values()) for r in ROWS], "title string, n int, tags array<string>")
    got = [r["m"] for r in df.select(rules.Compiler({"lead": rules.fields_of(df)}).condition(rule).alias("m")).collect()]
    assert got == [bool(eval(rule, {"lead": r})) for r in ROWS]


@pytest.mark.parametrize("rule", ["lead['title'][::2] == 'x'", "lead['n'][1:] == 2", "{**{}}", "lead['title'].format(1)", "__import__('os')", "(lambda: 1)()", "{'a': 1, 'b': 'x'}['a']", "lead.title"])
def test_refused(spark, rule):
    df = spark.createDataFrame([tuple(r.values()) for r in ROWS], "title string, n int, tags array<string>")
    with pytest.raises(rules.RuleError):
        rules.Compiler({"lead": rules.fields_of(df)}).condition(rule)
