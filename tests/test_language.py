from __future__ import annotations

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from ruleframe import RuleblockInput, RuleError, generate_manifest, parse, serialize_manifest, write_manifest
from ruleframe.expr import names
from ruleframe.expr import parse as expression
from ruleframe.graph import dependencies, find_cycle, ordered, prune_inputs, prune_outputs, subset, transform
from ruleframe.model import Bind, Compute, Fetch
from ruleframe.parser import parse_block, split, statements


def rules(text, name="main"):
    return parse_block(RuleblockInput(name, text)).rules


def blocks(**programs):
    return parse([RuleblockInput(n, t) for n, t in programs.items()])


def linked(*edges):
    """Blocks from ``name: sources`` pairs."""
    return blocks(**{n: "x => eadv.a.val.last();" + "".join(f"b{i} => rout_{s}.x.val.bind();" for i, s in enumerate(src)) for n, src in edges})


def test_fetch_forms():
    (f,) = rules("v => eadv.lab_bld_egfr.val.last();")
    assert f == Fetch("v", "eadv", ("lab_bld_egfr",), "val", "last")
    (f,) = rules("v => eadv.[a, b%,\n c].dt.Count().where(dt > sysdate - 30);")
    assert (f.attributes, f.property, f.function, f.predicate) == (("a", "b%", "c"), "dt", "count", "dt > sysdate - 30")
    (f,) = rules("v => eadv.a.val.nth(2)\n   .where(val!? and (loc = 1 or loc = 2));")
    assert (f.params, f.predicate) == (("2",), "val!? and (loc = 1 or loc = 2)")


@pytest.mark.parametrize(("text", "params"), [("|", ("|",)), ("", ()), (",", (",",)), ('", "', (", ",)), ("';'", (";",)), ("round(val,0)~dt", ("round(val,0)~dt",)), ("'//'", ("//",))])
def test_parameters(text, params):
    assert rules(f"v => eadv.a.val.serialize({text});")[0].params == params


def test_literals_may_hold_any_mark():
    f, c = rules("v => eadv.a.val.count().where(dt > '2020-01-01 10:00:00'); w : {v = `a;b//}` => 'x => y'}, {=> \"/* z */\"};")
    assert f.predicate == "dt > '2020-01-01 10:00:00'"
    assert [x.value for x in c.conditions] == ["'x => y'", '"/* z */"']


def test_comments_directives_self_name_and_prose():
    b = parse_block(RuleblockInput("rb", "// x => eadv.a.val.last();\n/* y\n*/ #doc([[rb_id]], {a: 1}); [[rb_id]]_v => eadv.a.val.last(); some prose; other"))
    assert [r.variable for r in b.rules] == ["rb_v"]
    assert len(b.warnings) == 2


def test_bind_and_compute():
    b, c = rules("e => rout_base.e_val.val.bind(); s : {e < 30 => 5}, {e? => null}, {=> 0};")
    assert b == Bind("e", "base", "e_val", "val")
    assert isinstance(c, Compute) and [(x.predicate, x.value) for x in c.conditions] == [("e < 30", "5"), ("e?", "null"), (None, "0")]


@pytest.mark.parametrize("text", ["v => eadv.a.val;", "v => eadv.a.val.last() extra;", "v => eadv.[a.val.last();", "s : {a => };", "s : {a};", "v => eadv.a.b.c.val.last();"])
def test_bad_statements(text):
    with pytest.raises(RuleError):
        rules(text)


@pytest.mark.parametrize("name", ["123invalid", "", "a-b", "x" * 101, "7th_try"])
def test_bad_names(name):
    with pytest.raises(RuleError):
        RuleblockInput(name, "")


@given(st.lists(st.text(alphabet="abc;,'()[] \n", max_size=8), max_size=6))
def test_split_joins_back(parts):
    text = ";".join(parts)
    assert ";".join(split(text, ";")) == text


@given(st.text(alphabet="ab'`/*\n; =>", max_size=40))
def test_parts_of_any_text(text):
    try:
        parts = statements(text)
    except RuleError as e:
        assert "Unclosed quote" in str(e)
        return
    assert sum(map(len, parts)) <= len(text) + text.count("/*")


def test_prose_keeps_its_apostrophes_to_itself():
    b = parse_block(RuleblockInput("rb", "the patient's record; v => eadv.a.val.last(); 'tis `odd; w => eadv.b.val.count().where(val = 'x;y'); dogs' // it's\n; #doc({a: 'b;c'}); u /* c */ => eadv.c.val.sum();"))
    assert [r.variable for r in b.rules] == ["v", "w", "u"] and b.rules[1].predicate == "val = 'x;y'" and len(b.warnings) == 3
    with pytest.raises(RuleError, match="Unclosed quote"):
        rules("v => eadv.a.val.last().where(val = 'x); w => eadv.b.val.last();")


def test_names_of_an_expression():
    assert names(expression("a > nvl(B, 3) and `c d` = 'e' and dt - sysdate < extract(year from f)")) == {"a", "b", "dt", "f"}
    for bad in ("a >", "a ~ b", "(a", "case end", "a b"):
        with pytest.raises(RuleError):
            expression(bad)


def test_order():
    assert [b.name for b in ordered(linked(("rb3", ["rb2"]), ("rb1", []), ("rb2", ["rb1"])))] == ["rb1", "rb2", "rb3"]
    assert [b.name for b in ordered(linked(("a", []), ("b", []), ("c", ["unknown"])))] == ["a", "b", "c"]
    assert [b.name for b in ordered(linked(("d", ["b", "c"]), ("b", ["a"]), ("c", ["a"]), ("a", [])))] == ["a", "b", "c", "d"]
    long = linked(*((f"b{i}", [f"b{i + 1}"] if i < 2999 else []) for i in range(3000)))
    assert ordered(long)[0].name == "b2999"


def test_cycles():
    with pytest.raises(RuleError, match="Circular dependency detected: rb1 -> rb2 -> rb1"):
        ordered(linked(("rb1", ["rb2"]), ("rb2", ["rb1"])))
    assert find_cycle({"a": ["a"]}) == ["a", "a"]
    assert find_cycle({"a": ["b"], "b": ["c"], "c": []}) is None
    with pytest.raises(RuleError, match="Duplicate"):
        ordered([*linked(("a", [])), *linked(("A", []))])


def test_choosing():
    tree = linked(("source", []), ("child1", ["source"]), ("child2", ["source"]), ("grandchild", ["child1"]), ("unrelated", []))
    name = lambda bs: [b.name for b in bs]
    assert name(prune_inputs(tree, ["SOURCE"])) == ["source", "child1", "child2", "grandchild"]
    assert name(prune_inputs(tree, ["child1"])) == ["child1", "grandchild"]
    assert name(prune_outputs(tree, ["grandchild"])) == ["source", "child1", "grandchild"]
    line = linked(("a", []), ("b", ["a"]), ("c", ["b"]), ("d", ["c"]), ("unrelated", []))
    assert name(transform(line, [], ["a"], ["c"])) == ["a", "b", "c"]
    assert name(transform(line, [], ["b"], ["d"])) == ["b", "c", "d"]
    assert name(subset(line, ["A", "d"])) == ["a", "d"] and subset(line, []) == line
    final = linked(("base1", []), ("base2", []), ("derived1", ["base1"]), ("derived2", ["base2"]), ("final", ["derived1"]))
    assert name(transform(final, ["base1", "derived1", "derived2", "final"], [], ["final"])) == ["base1", "derived1", "final"]
    assert dependencies(final)["derived2"] == ["base2"]


def test_manifest(tmp_path):
    bs = ordered(linked(("Derived", ["base"]), ("base", [])))
    m = generate_manifest(bs)
    d = json.loads(serialize_manifest(m))
    assert [e["targetTable"] for e in d["entries"]] == ["rout_base", "rout_derived"]
    assert d["entries"][1] == {"ruleblockId": "Derived", "executionOrder": 1, "targetTable": "rout_derived", "dependencies": ["base"], "outputVariables": ["x", "b0"], "sqlIndex": 1}
    assert (d["version"], d["dialect"], d["totalRuleblocks"], d["dependencyGraph"]) == ("1.0.0", "spark", 2, {"base": [], "Derived": ["base"]})
    target = tmp_path / "deep" / "m.json"
    with pytest.raises(OSError):
        write_manifest(m, str(target), create_dir=False)
    write_manifest(m, str(target), indent=4)
    assert '\n    "version"' in target.read_text()
    write_manifest(m, str(target), pretty=False)
    assert "\n" not in target.read_text()
