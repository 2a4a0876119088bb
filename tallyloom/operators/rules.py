"""Rule and SQL classifiers.

Rules are small Python expressions over a record, as `"ciso" in lead["title"].lower()`. They are
compiled into Column expressions, so that a whole rule set is one projection inside the JVM. What
the grammar does not name is refused when the rules are compiled, not when they run.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.latest import latest_by


class RuleError(ValueError):
    """An expression the rule grammar does not have."""


class Value:
    """A compiled value: a column with what is known of its type, or a list of values."""

    def __init__(self, col: Column | None, kind: str, items: list[Value] | None = None):
        self.col, self.kind, self.items = col, kind, items


class Compiler:
    """`records` maps each name an expression may use to its fields and their types (string, number, bool, array)."""

    def __init__(self, records: dict[str, dict[str, tuple[Column, str]]]):
        self.records, self.local = records, {}

    def condition(self, text: str) -> Column:
        """The truth of an expression; a bare comprehension says nothing of what is asked of it, so `any`, `all` or `len` must be around it."""
        n = self._parse(text)
        if isinstance(n, (ast.ListComp, ast.SetComp, ast.GeneratorExp)):
            raise RuleError("a bare comprehension is no condition")
        return self.truth(self.value(n))

    def outcome(self, text: str) -> Column:
        return self.value(self._parse(text)).col

    def _parse(self, text: str) -> ast.expr:
        try:
            return ast.parse(text, mode="eval").body
        except SyntaxError as e:
            raise RuleError(f"no expression: {text!r}") from e

    def truth(self, v: Value) -> Column:
        """Python's truth: null, 0, '' and empty lists are false."""
        if v.items is not None:
            return F.lit(bool(v.items))
        if v.kind == "bool":
            return F.coalesce(v.col, F.lit(False))
        if v.kind == "number":
            return F.coalesce(v.col != 0, F.lit(False))
        if v.kind == "array":
            return F.coalesce(F.size(v.col) > 0, F.lit(False))
        if v.kind == "null":
            return F.lit(False)
        return F.coalesce(v.col != "", F.lit(False))

    def value(self, n: ast.expr) -> Value:
        got = getattr(self, f"_{type(n).__name__}", None)
        if got is None:
            raise RuleError(f"not in the grammar: {type(n).__name__}")
        return got(n)

    def _Constant(self, n: ast.Constant) -> Value:
        v = n.value
        if v is None:
            return Value(F.lit(None), "null")
        kind = "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else None
        if kind is None:
            raise RuleError(f"constant {v!r}")
        return Value(F.lit(v), kind)

    def _Name(self, n: ast.Name) -> Value:
        if n.id in self.local:
            return self.local[n.id]
        raise RuleError(f"unknown name {n.id}")

    def _field(self, record: ast.expr, key: ast.expr, default: Value | None = None) -> Value:
        if not (isinstance(record, ast.Name) and record.id in self.records and isinstance(key, ast.Constant)):
            raise RuleError("only fields of the record can be read")
        got = self.records[record.id].get(key.value)
        if got is None:
            if default is not None:
                return default
            return Value(F.lit(None), "null")
        c, kind = got
        return Value(F.coalesce(c, default.col) if default is not None and default.kind != "null" else c, kind)

    def _Subscript(self, n: ast.Subscript) -> Value:
        if isinstance(n.value, ast.Name) and n.value.id in self.records:
            return self._field(n.value, n.slice)
        if isinstance(n.value, ast.Dict):
            return self._looked_up(n.value, n.slice, None)
        v = self.value(n.value)
        if isinstance(n.slice, ast.Slice):
            return self._part(v, n.slice)
        if v.items is not None and isinstance(n.slice, ast.Constant) and isinstance(n.slice.value, int) and -len(v.items) <= n.slice.value < len(v.items):
            return v.items[n.slice.value]
        if isinstance(n.slice, ast.Constant) and isinstance(n.slice.value, int):
            i = n.slice.value
            if v.kind == "array":
                return Value(F.try_element_at(v.col, F.lit(i + 1 if i >= 0 else i)), "string")
            return Value(F.substring(v.col, i + 1 if i >= 0 else i, 1), "string")
        raise RuleError("index")

    def _part(self, v: Value, cut: ast.Slice) -> Value:
        """A slice between written ends, of a text or a list."""

        def end(x: ast.expr | None) -> int | None:
            if x is None:
                return None
            try:
                got = ast.literal_eval(x)
            except ValueError as e:
                raise RuleError("a slice needs written ends") from e
            if not isinstance(got, int):
                raise RuleError("a slice needs whole ends")
            return got

        a, b = end(cut.lower), end(cut.upper)
        if cut.step is not None:
            raise RuleError("a slice with a step")
        if v.items is not None:
            return Value(None, "list", v.items[a:b])
        if v.kind not in ("string", "array"):
            raise RuleError(f"slice of {v.kind}")
        size = F.length(v.col) if v.kind == "string" else F.size(v.col)
        at = lambda x: F.least(F.lit(x), size) if x >= 0 else F.greatest(size + x, F.lit(0))
        first, last = at(a or 0), size if b is None else at(b)
        n = F.greatest(last - first, F.lit(0))
        return Value(v.col.substr(first + 1, n) if v.kind == "string" else F.slice(v.col, first + 1, n), v.kind)

    def _looked_up(self, d: ast.Dict, key: ast.expr, default: Value | None) -> Value:
        """What a written table has for a key: the last entry that is equal, else the default."""
        k, vals = self.value(key), [self.value(x) for x in d.values]
        kinds = {v.kind for v in [*vals, *([default] if default else [])]} - {"null"}
        if any(x is None for x in d.keys) or len(kinds) > 1 or "list" in kinds:
            raise RuleError("a table of values of one kind")
        out = default.col if default else F.lit(None)
        for x, v in zip(d.keys, vals):
            out = F.when(k.col.eqNullSafe(self.value(x).col), v.col).otherwise(out)
        return Value(out, kinds.pop() if kinds else "null")

    def _Dict(self, n: ast.Dict) -> Value:
        """A table by itself is the list of its keys."""
        if any(x is None for x in n.keys):
            raise RuleError("a table of values")
        return Value(None, "list", [self.value(x) for x in n.keys])

    def _comprehension(self, n: ast.ListComp | ast.GeneratorExp | ast.SetComp) -> Value:
        """A list of elements: of an array as an array, of a written list without conditions as a list, with conditions as an array without nulls."""
        g = n.generators[0]
        over = self.value(g.iter)
        if len(n.generators) == 1 and isinstance(g.target, ast.Name) and over.kind == "array":
            kept = over.col
            if g.ifs:
                kept = F.filter(kept, lambda x: self._bound(g.target.id, Value(x, "string"), lambda: reduce(lambda a, b: a & b, [self.truth(self.value(c)) for c in g.ifs])))
            return Value(F.transform(kept, lambda x: self._bound(g.target.id, Value(x, "string"), lambda: self.value(n.elt).col)), "array")
        if not g.ifs:
            return Value(None, "list", self._each(n))
        ok = [v.col for v in self._each(ast.ListComp(elt=ast.Constant(True), generators=n.generators))]
        vals = self._each(ast.ListComp(elt=n.elt, generators=[ast.comprehension(target=g.target, iter=g.iter, ifs=[], is_async=0)]))
        return Value(F.array_compact(F.array(*[F.when(c, v.col) for c, v in zip(ok, vals)])), "array")

    _ListComp = _GeneratorExp = _SetComp = _comprehension

    def _bound(self, name: str, v: Value, then: Callable[[], Column]) -> Column:
        before, self.local = self.local, self.local | {name: v}
        try:
            return then()
        finally:
            self.local = before

    def _List(self, n: ast.List | ast.Tuple | ast.Set) -> Value:
        return Value(None, "list", [self.value(x) for x in n.elts])

    _Tuple = _Set = _List

    def _BoolOp(self, n: ast.BoolOp) -> Value:
        vs = [self.value(x) for x in n.values]
        if len({v.kind for v in vs} - {"null"}) == 1 and vs[0].kind not in ("bool", "list"):
            out = vs[-1].col  # a value, as in `x or "none"`
            for v in reversed(vs[:-1]):
                t = self.truth(v)
                out = F.when(t, v.col).otherwise(out) if isinstance(n.op, ast.Or) else F.when(t, out).otherwise(v.col)
            return Value(out, vs[0].kind)
        out = self.truth(vs[0])
        for v in vs[1:]:
            out = (out & self.truth(v)) if isinstance(n.op, ast.And) else (out | self.truth(v))
        return Value(out, "bool")

    def _UnaryOp(self, n: ast.UnaryOp) -> Value:
        v = self.value(n.operand)
        if isinstance(n.op, ast.Not):
            return Value(~self.truth(v), "bool")
        if isinstance(n.op, (ast.USub, ast.UAdd)) and v.kind == "number":
            return Value(-v.col if isinstance(n.op, ast.USub) else v.col, "number")
        raise RuleError("sign")

    def _BinOp(self, n: ast.BinOp) -> Value:
        a, b = self.value(n.left), self.value(n.right)
        if isinstance(n.op, ast.Add) and a.kind == b.kind == "string":
            return Value(F.concat(a.col, b.col), "string")
        ops: dict[type, Callable[[Column, Column], Column]] = {ast.Add: lambda x, y: x + y, ast.Sub: lambda x, y: x - y, ast.Mult: lambda x, y: x * y, ast.Div: F.try_divide, ast.Mod: lambda x, y: x - F.floor(F.try_divide(x, y)) * y, ast.FloorDiv: lambda x, y: F.floor(F.try_divide(x, y)), ast.Pow: F.pow}
        if type(n.op) not in ops or a.kind != "number" or b.kind != "number":
            raise RuleError(f"operator {type(n.op).__name__} on {a.kind} and {b.kind}")
        return Value(ops[type(n.op)](a.col, b.col), "number")

    def _IfExp(self, n: ast.IfExp) -> Value:
        a, b = self.value(n.body), self.value(n.orelse)
        return Value(F.when(self.truth(self.value(n.test)), a.col).otherwise(b.col), a.kind if a.kind != "null" else b.kind)

    def _Compare(self, n: ast.Compare) -> Value:
        out, left = None, self.value(n.left)
        for op, r in zip(n.ops, n.comparators):
            right = self.value(r)
            c = self._one(op, left, right)
            out, left = c if out is None else out & c, right
        return Value(out, "bool")

    def _one(self, op: ast.cmpop, a: Value, b: Value) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            if b.items is not None:
                got = F.lit(False)
                for v in b.items:
                    got = got | a.col.eqNullSafe(v.col)
            elif b.kind == "array":
                got = F.coalesce(F.array_contains(b.col, a.col), F.lit(False))
            elif b.kind == "string" and a.kind == "string":
                got = F.coalesce(F.contains(b.col, a.col), F.lit(False))
            else:
                raise RuleError(f"{a.kind} in {b.kind}")
            return ~got if isinstance(op, ast.NotIn) else got
        if isinstance(op, (ast.Is, ast.Eq)):
            return a.col.eqNullSafe(b.col)
        if isinstance(op, (ast.IsNot, ast.NotEq)):
            return ~a.col.eqNullSafe(b.col)
        c = {ast.Lt: lambda: a.col < b.col, ast.LtE: lambda: a.col <= b.col, ast.Gt: lambda: a.col > b.col, ast.GtE: lambda: a.col >= b.col}[type(op)]()
        return F.coalesce(c, F.lit(False))

    def _Call(self, n: ast.Call) -> Value:
        if n.keywords:
            raise RuleError("named arguments")
        if isinstance(n.func, ast.Attribute):
            return self._method(n.func, n.args)
        if not isinstance(n.func, ast.Name):
            raise RuleError("call")
        name = n.func.id
        if name in ("any", "all") and len(n.args) == 1 and isinstance(n.args[0], (ast.GeneratorExp, ast.ListComp, ast.SetComp)):
            g = n.args[0].generators[0]
            if len(n.args[0].generators) == 1 and isinstance(g.target, ast.Name) and self.value(g.iter).kind == "array":
                wanted = [*g.ifs, n.args[0].elt] if name == "any" else [n.args[0].elt]
                held = lambda x, cs: self._bound(g.target.id, Value(x, "string"), lambda: reduce(lambda a, b: a & b, [self.truth(self.value(c)) for c in cs], F.lit(True)))
                over = self.value(g.iter).col
                if name == "all" and g.ifs:
                    over = F.filter(over, lambda x: held(x, g.ifs))
                return Value(F.coalesce((F.exists if name == "any" else F.forall)(over, lambda x: held(x, wanted)), F.lit(name == "all")), "bool")
            cs = [self.truth(v) for v in self._each(n.args[0])]
            out = F.lit(name == "all")
            for c in cs:
                out = (out & c) if name == "all" else (out | c)
            return Value(out, "bool")
        if name == "isinstance" and len(n.args) == 2:
            types = [t.id for t in (n.args[1].elts if isinstance(n.args[1], ast.Tuple) else [n.args[1]]) if isinstance(t, ast.Name)]
            v = self.value(n.args[0])
            known = {"string": ["str"], "number": ["int", "float"], "bool": ["bool", "int"], "array": ["list"], "list": ["list"]}.get(v.kind, [])
            return Value((F.lit(True) if v.items is not None else v.col.isNotNull()) & F.lit(bool(set(known) & set(types))), "bool")
        args = [self.value(a) for a in n.args]
        if name in ("list", "tuple", "set") and len(args) == 1 and args[0].kind in ("list", "array"):
            return Value(F.array_distinct(args[0].col), "array") if name == "set" and args[0].kind == "array" else args[0]
        if name in ("sum", "min", "max", "sorted", "reversed") and len(args) == 1 and args[0].kind in ("list", "array"):
            return self._of_list(name, args[0])
        if name == "round" and 1 <= len(args) <= 2:
            return Value(F.bround(args[0].col, n.args[1].value if len(args) == 2 and isinstance(n.args[1], ast.Constant) else 0), "number")
        if name == "len" and len(args) == 1:
            v = args[0]
            return Value(F.lit(len(v.items)), "number") if v.items is not None else Value(F.coalesce(F.size(v.col) if v.kind == "array" else F.length(v.col), F.lit(0)), "number")
        if name in ("int", "float") and len(args) == 1:
            return Value(args[0].col.try_cast("bigint" if name == "int" else "double"), "number")
        if name == "str" and len(args) == 1:
            return Value(args[0].col.cast("string"), "string")
        if name == "bool" and len(args) == 1:
            return Value(self.truth(args[0]), "bool")
        if name == "abs" and len(args) == 1:
            return Value(F.abs(args[0].col), "number")
        if name in ("min", "max") and len(args) > 1:
            return Value((F.least if name == "min" else F.greatest)(*[a.col for a in args]), "number")
        raise RuleError(f"function {name}")

    def _of_list(self, name: str, v: Value) -> Value:
        if name == "reversed":
            return Value(None, "list", v.items[::-1]) if v.items is not None else Value(F.reverse(v.col), "array")
        if v.items is not None and len({x.kind for x in v.items} - {"null"}) > 1:
            raise RuleError(f"{name} of values of several kinds")
        col = v.col if v.items is None else F.array(*[x.col.cast("int") if x.kind == "bool" else x.col for x in v.items])
        kind = "string" if v.items is None else v.items[0].kind if v.items else "number"
        if name == "sum":
            return Value(F.reduce(F.transform(col, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), "number")
        if name == "sorted":
            return Value(F.array_sort(col), "array")
        return Value((F.array_min if name == "min" else F.array_max)(col), "number" if kind == "bool" else kind)

    def _each(self, n: ast.GeneratorExp | ast.ListComp) -> list[Value]:
        """The element for each value of a written list."""
        if len(n.generators) != 1 or not isinstance(n.generators[0].target, ast.Name):
            raise RuleError("comprehension")
        g = n.generators[0]
        over = self.value(g.iter)
        if over.items is None:
            raise RuleError("a comprehension needs a written list")
        out = []
        for item in over.items:
            before, self.local = self.local, self.local | {g.target.id: item}
            ok = F.lit(True)
            for c in g.ifs:
                ok = ok & self.truth(self.value(c))
            v = self.value(n.elt)
            out.append(Value(ok & self.truth(v), "bool") if g.ifs else v)
            self.local = before
        return out

    def _method(self, f: ast.Attribute, args: list[ast.expr]) -> Value:
        if f.attr in ("keys", "values", "items") and not args and isinstance(f.value, ast.Dict):
            d = f.value
            return Value(None, "list", [self.value(x) for x in (d.keys if f.attr == "keys" else d.values)]) if f.attr != "items" else Value(None, "list", [Value(None, "list", [self.value(k), self.value(x)]) for k, x in zip(d.keys, d.values)])
        if f.attr == "get" and args and isinstance(f.value, ast.Dict):
            return self._looked_up(f.value, args[0], self.value(args[1]) if len(args) > 1 else None)
        if f.attr == "get" and args:
            return self._field(f.value, args[0], self.value(args[1]) if len(args) > 1 else None)
        v, a = self.value(f.value), [self.value(x) for x in args]
        if v.kind not in ("string", "null"):
            raise RuleError(f"method {f.attr} of {v.kind}")
        c = F.coalesce(v.col, F.lit(""))
        none = {"lower": F.lower, "upper": F.upper, "title": F.initcap, "strip": F.trim, "lstrip": F.ltrim, "rstrip": F.rtrim}
        if f.attr in none and not a:
            return Value(none[f.attr](c), "string")
        if f.attr in ("startswith", "endswith") and len(a) == 1:
            one = F.startswith if f.attr == "startswith" else F.endswith
            out = F.lit(False)
            for x in a[0].items or [a[0]]:
                out = out | one(c, x.col)
            return Value(out, "bool")
        if f.attr == "replace" and len(a) == 2:
            return Value(F.replace(c, a[0].col, a[1].col), "string")
        if f.attr == "find" and len(a) == 1:
            return Value(F.position(a[0].col, c) - 1, "number")
        if f.attr == "rfind" and len(a) == 1:
            back = F.position(F.reverse(a[0].col), F.reverse(c))
            return Value(F.when(a[0].col == "", F.length(c)).when(back > 0, F.length(c) - F.length(a[0].col) - back + 1).otherwise(-1), "number")
        if f.attr == "count" and len(a) == 1:
            return Value((F.length(c) - F.length(F.replace(c, a[0].col, F.lit("")))) / F.length(a[0].col), "number")
        if f.attr in ("split", "rsplit") and len(a) <= 1:
            return Value(F.split(F.trim(c), r"\s+") if not a else F.split(c, r"\Q" + str(args[0].value) + r"\E"), "array")
        if f.attr in ("isdigit", "isalpha", "isspace") and not a:
            return Value(c.rlike({"isdigit": r"^\p{Nd}+$", "isalpha": r"^\p{L}+$", "isspace": r"^\s+$"}[f.attr]), "bool")
        raise RuleError(f"method {f.attr}")


KINDS = {"string": "string", "boolean": "bool", "array<string>": "array"}


def fields_of(df: DataFrame) -> dict[str, tuple[Column, str]]:
    return {c: (F.col(c), KINDS.get(t, "number")) for c, t in df.dtypes if t in KINDS or t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")}


def classify(df: DataFrame, rules: list[dict], outputs: list[str], record: str = "lead") -> DataFrame:
    """df with `outputs`, of the first rule whose `if` is true; a rule without `if` always is.

    A rule's outcome is a constant, or an expression where it begins with `=`. Rows no rule matches
    get qualified false and reason "no rule matched". An unknown field is null; what the grammar
    lacks raises RuleError.
    """
    c = Compiler({record: fields_of(df)})
    when = [c.condition(r["if"]) if "if" in r else F.lit(True) for r in rules]
    out = df
    for o in outputs:
        expr = F.lit({"qualified": False, "reason": "no rule matched"}.get(o))
        for cond, r in reversed(list(zip(when, rules))):
            v = r.get(o)
            expr = F.when(cond, c.outcome(v[1:]) if isinstance(v, str) and v.startswith("=") else F.lit(v)).otherwise(expr)
        out = out.withColumn(o, expr.cast("boolean") if o == "qualified" else expr.cast("string"))
    return out


def classify_by_sql(spark: SparkSession, targets: DataFrame, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The result of a query over the view `target_leads` and the given tables; it must have lead_id and qualified."""
    targets.createOrReplaceTempView("target_leads")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    out = spark.sql(sql)
    missing = {"lead_id", "qualified"} - set(out.columns)
    if missing:
        raise ValueError(f"the query lacks {sorted(missing)}")
    return out


def unclassified(targets: DataFrame, verdicts: DataFrame, name: str, version: str) -> DataFrame:
    """Targets without a verdict of this classifier and version."""
    done = verdicts.where((F.col("qualifier_name") == name) & (F.col("qualifier_version") == version)).select("lead_id").distinct()
    return targets.join(done, "lead_id", "left_anti")


def gather_inputs(targets: DataFrame, verdicts: DataFrame, signals: DataFrame, inputs: dict[str, str]) -> DataFrame:
    """Targets with one column an input: `from-qualification:<name>:<key>` or `from-signal:<name>:<key>`, the key's text in the latest such JSON; `missing` lists inputs that are not there."""
    out, names = targets, []
    for col, source in inputs.items():
        kind, name, key = source.split(":", 2)
        if kind == "from-qualification":
            own = latest_by(verdicts.where(F.col("qualifier_name") == name).select("lead_id", "qualified_at", "id", F.col("full_result").alias("doc")), ["lead_id"], ["qualified_at", "id"])
        elif kind == "from-signal":
            own = latest_by(signals.where(F.col("enricher_name") == name).select("lead_id", "enriched_at", "id", F.col("payload").alias("doc")), ["lead_id"], ["enriched_at", "id"])
        else:
            raise ValueError(f"input {source!r}")
        out = out.join(own.select("lead_id", F.get_json_object("doc", f"$.{key}").alias(col)), "lead_id", "left")
        names.append(col)
    gaps = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in names])) if names else F.array().cast("array<string>")
    return out.withColumn("missing", gaps)


def newest_version(processors: DataFrame, wanted: str) -> DataFrame:
    """The classifier `name` or `name@version`; without a version the newest that nothing supersedes."""
    name, _, version = wanted.partition("@")
    p = processors.where((F.col("name") == name) & (F.col("type") == "classifier"))
    return p.where(F.col("version") == version) if version else latest_by(p.where("superseded_at is null"), ["name"], ["created_at", "version"])
