"""Grammar, type rules, lint and schema differences; no Spark needed."""

import pytest

from hopline.errors import CheckError, HoplineError, ParseError, SchemaError
from hopline.functions.text import default_edits, tokens_of
from hopline.plans import ast as A
from hopline.plans.check import check
from hopline.plans.lint import lint
from hopline.plans.migration import diff
from hopline.plans.parser import parse_queries
from hopline.plans.schema import parse_schema

SCHEMA = """
node Person @description("a person") { name: String @key  age: I32?  born: Date?  tags: [String]?  v: Vector(3)?  mood: enum(sad, glad)?  seen: DateTime? }
node Company { name: String @key  size: I64?  text: String? }
edge Knows: Person -> Person { since: Date? }
edge WorksAt: Person -> Company
edge Contains: Company -> Person
"""


def one(body, sig=""):
    return parse_queries(f"query q({sig}) {{ {body} }}")["q"]


def run(body, sig=""):
    return check(parse_schema(SCHEMA), one(body, sig))


# schema


def test_schema():
    c = parse_schema(SCHEMA + " /* block */ // line")
    assert c.nodes["Person"].key == "name" and c.nodes["Person"].description == "a person"
    assert c.edge("worksAt").name == c.edge("WorksAt").name == "WorksAt" and c.edge("worksat") is None
    assert c.nodes["Person"].props["mood"].type.enum == ("glad", "sad")
    assert c.describe()["edges"][0] == {"name": "Knows", "from": "Person", "to": "Person", "properties": [{"name": "since", "type": "Date?", "nullable": True}]}


def test_inheritance_is_optional():
    text = "node A { x: String } node B : A { y: String }"
    assert list(parse_schema(text).nodes["B"].props) == ["y"]
    assert list(parse_schema(text, inherit=True).nodes["B"].props) == ["x", "y"]
    with pytest.raises(SchemaError):
        parse_schema("node B : Nope { y: String }", inherit=True)


@pytest.mark.parametrize(
    "text",
    [
        "node A { x: String x: I32 }",
        "node A { x: String } node A { y: String }",
        "edge E: A -> B",
        "node A { x: String @key y: String @key }",
        "node A { x: [String] @key }",
        "node A { x: String? @key }",
        "node A { x: String @index @index }",
        "node A { x: String @what }",
        "node A { v: Vector(0) }",
        "node A { v: String @embed(t) t: String }",
        "node A { v: Vector(3) @embed(t) }",
        "node A { u: String @media_uri(m) }",
        "node A { e: enum(a, a) }",
        'node A @description("") { x: String }',
        "node A { x: String } edge E: A -> A { y: String @unique }",
        "node A @key { x: String }",
    ],
)
def test_bad_schemas(text):
    with pytest.raises(SchemaError):
        parse_schema(text)


@pytest.mark.parametrize("text", ["nod A {}", "node a {}", "node A { x String }", "node A { x: Text }", "node A { x: [Vector(3)] }", "node A {", "node A { x: String } ~"])
def test_schema_syntax(text):
    with pytest.raises(HoplineError):
        parse_schema(text)


# queries


def test_contains_is_an_edge_between_variables():
    walk, member = one('match { $c contains $p  $p.tags contains "x" } return { $p.name }').match
    assert isinstance(walk, A.Traversal) and walk.edge == "contains"
    assert isinstance(member, A.Filter) and member.op == "contains"


def test_parsed_shapes():
    q = parse_queries('query a($x: I64?, $v: Vector(3)) @description("d") @instruction("i") { match { $p: Person { name: "q\\"x", age: $x, } $p knows{1,3} $_ not { $p worksAt $c } search($p.name, "a") } return { $p.name as n $p count($p) } order { n desc, $p.age } limit 5 }')["a"]
    assert (q.description, q.instruction, q.limit) == ("d", "i", 5)
    assert q.match[0].matches[0][1] == A.Lit("String", 'q\\"x')
    assert q.match[1] == A.Traversal("p", "knows", "_", 1, 3)
    assert q.match[3] == A.Filter(A.Call("search", (A.Access("p", "name"), A.Lit("String", "a"))), "=", A.Lit("Bool", True))
    assert [p.name for p in q.returns] == ["n", "p", "count"]
    assert [o.descending for o in q.order] == [True, False]


@pytest.mark.parametrize(
    "body",
    [
        "match { } return { 1 }",
        "match { $p: Person } return { }",
        "return { 1 }",
        "match { $p: Person } return { $p.name } limit -1",
        "match { $p: Person } limit 1 return { $p.name }",
        "match { $p: person } return { $p.name }",
        "match { $p.age > -1 } return { $p.name }",
        "match { $p: Person } return { upper($p.name) }",
        "match { $p: Person } return { $p.name } order { nearest($p.v, $p.v) desc } limit 1",
        "match { $p: Person } return { count($p, $p) }",
        "insert Person { }",
        "update Person set { age: 1 }",
        "delete Person where tags contains 1",
        "match { $p: Person  bm25($p.name, \"a\") } return { $p.name }",
    ],
)
def test_syntax_errors(body):
    with pytest.raises(ParseError):
        one(body)


def test_repeated_names_and_notes():
    with pytest.raises(ParseError):
        parse_queries("query a() { match { $p: P } return { 1 } } query a() { match { $p: P } return { 1 } }")
    with pytest.raises(ParseError):
        parse_queries('query a() @description("x") @description("y") { match { $p: P } return { 1 } }')


@pytest.mark.parametrize(
    "code, body, sig",
    [
        ("T1", "match { $p: Alien } return { 1 }", ""),
        ("T2", "match { $p: Person { hat: 1 } } return { 1 }", ""),
        ("T3", 'match { $p: Person { age: "x" } } return { 1 }', ""),
        ("T3", 'match { $p: Person { mood: "angry" } } return { 1 }', ""),
        ("T3", 'match { $p: Person { tags: ["a"] } } return { 1 }', ""),
        ("T3", "match { $p: Person { v: [1, 2] } } return { 1 }", ""),
        ("T7", "match { $p: Person { age: $x } } return { 1 }", "$x: String"),
        ("T4", "match { $p: Person  $p likes $q } return { 1 }", ""),
        ("T5", "match { $c: Company  $c knows $q } return { 1 }", ""),
        ("T5", "match { $p: Person  $c: Company  $p knows $c } return { 1 }", ""),
        ("T6", "match { $p: Person  $q.age > 1 } return { 1 }", ""),
        ("T6", "match { $p: Person } return { $p.hat }", ""),
        ("T7", 'match { $p: Person  $p.age > "x" } return { 1 }', ""),
        ("T7", "match { $p: Person  $p.tags = \"x\" } return { 1 }", ""),
        ("T7", "match { $p: Person  $p.name contains \"x\" } return { 1 }", ""),
        ("T7", "match { $p: Person  $p.tags contains 1 } return { 1 }", ""),
        ("T7", "match { $p: Person  $p.v = $p.v } return { 1 }", ""),
        ("T7", 'match { $p: Person  $p.born > datetime("2020-01-01T00:00:00Z") } return { 1 }', ""),
        ("T8", "match { $p: Person } return { sum($p.name) }", ""),
        ("T8", "match { $p: Person } return { avg($p) }", ""),
        ("T9", "match { $p: Person  not { $q knows $r } } return { 1 }", ""),
        ("T15", "match { $p: Person  $p knows{0,2} $q } return { 1 }", ""),
        ("T15", "match { $p: Person  $p knows{1,} $q } return { 1 }", ""),
        ("T15", "match { $p: Person  $p knows{3,2} $q } return { 1 }", ""),
        ("T15", "match { $p: Person } return { nearest($p.name, $q) }", "$q: String"),
        ("T15", "match { $p: Person } return { nearest($p.v, $q) }", "$q: Vector(4)"),
        ("T15", "match { $p: Person } return { nearest($p.v, [1.0, 2.0]) }", ""),
        ("T17", "match { $p: Person } return { $p.name } order { nearest($p.v, $q) }", "$q: Vector(3)"),
        ("T18", "match { $p: Person } return { $p.name as n } order { nearest($p.v, $q), n } limit 1", "$q: Vector(3)"),
        ("T19", 'match { $p: Person  search($p.age, "x") } return { 1 }', ""),
        ("T19", 'match { $p: Person  fuzzy($p.name, "x", 1.5) } return { 1 }', ""),
        ("T20", 'match { $p: Person } return { bm25($p.age, "x") }', ""),
        ("T21", 'match { $p: Person } return { $p.name } order { rrf(bm25($p.name, "a"), bm25($p.name, "b")) desc }', ""),
        ("T21", 'match { $p: Person } return { rrf(bm25($p.name, "a"), bm25($p.name, "b"), 0) as r } order { r } limit 1', ""),
        ("T10", "insert Alien { name: \"x\" }", ""),
        ("T11", "insert Person { name: \"x\", hat: 1 }", ""),
        ("T12", "insert Person { age: 1 }", ""),
        ("T12", 'insert Knows { from: "a" }', ""),
        ("T13", "update Person set { age: 1, age: 2 } where name = \"x\"", ""),
        ("T14", "update Person set { age: $x } where name = \"x\"", ""),
        ("T16", "update Knows set { since: $d } where from = \"x\"", "$d: Date"),
        ("T11", "delete Person where hat = 1", ""),
        ("T7", "update Person set { age: now() } where name = \"x\"", ""),
    ],
)
def test_rules(code, body, sig):
    with pytest.raises(CheckError) as e:
        run(body, sig)
    assert e.value.code == code


def test_output_schema():
    c = run("match { $p: Person  $p knows $q } return { $p.age as a, count($q), avg($q.age) as m, sum($q.age) as s, $p, max($q.born) as b }")
    shown = [(n, str(t) if hasattr(t, "scalar") else t.type) for n, t in c.output()]
    assert shown == [("a", "I32?"), ("count", "I64?"), ("m", "F64?"), ("s", "I64?"), ("p", "Person"), ("b", "Date?")]


def test_reserved_parameter():
    with pytest.raises(CheckError):
        run("match { $p: Person } return { 1 }", "$__hopline_now: DateTime")


def test_lint():
    text = 'query a() { update Person set { age: 1 } where name = "x" } query b() { match { $p: Nope } return { 1 } }'
    found = lint(parse_schema(SCHEMA), text)
    assert [f.code for f in found if f.level == "error"] == ["T1"]
    assert {f.where for f in found if f.code == "L201"} == {"Person.born", "Person.tags", "Person.v", "Person.mood", "Person.seen"}


def test_tokens():
    assert tokens_of("Graph-DB 2.0, Éclair's") == ["graph", "db", "2", "0", "Éclair", "s"]
    assert [default_edits("a" * n) for n in (1, 2, 3, 5, 6, 9)] == [0, 0, 1, 1, 2, 2]


def steps(a, b):
    return [(s.kind, s.safety) for s in diff(parse_schema(a), parse_schema(b))]


def test_schema_differences():
    old = "node User { name: String @key  age: I32?  role: enum(a, b) } edge Knows: User -> User"
    assert steps(old, old) == []
    assert steps(old, 'node Account @rename_from("User") { full: String @key @rename_from("name")  age: I32?  role: enum(a, b) } edge Linked: Account -> Account @rename_from("Knows")') == [
        ("rename_node_type", "safe"), ("rename_property", "safe"), ("rename_edge_type", "safe")]
    assert ("add_property", "blocked") in steps(old, old.replace("age: I32?", "age: I32?  email: String"))
    assert ("add_property", "safe") in steps(old, old.replace("age: I32?", "age: I32?  email: String?"))
    assert ("drop_property", "confirm") in steps(old, old.replace("age: I32?", ""))
    assert ("change_type", "confirm") in steps(old, old.replace("age: I32?", "age: I64?"))
    assert ("require_property", "confirm") in steps(old, old.replace("age: I32?", "age: I32"))
    assert ("grow_enum", "safe") in steps(old, old.replace("enum(a, b)", "enum(a, b, c)"))
    assert ("shrink_enum", "confirm") in steps(old, old.replace("enum(a, b)", "enum(a)"))
    assert ("rebind_edge", "blocked") in steps(old + " node C { x: String @key }", old.replace("-> User", "-> C") + " node C { x: String @key }")
    assert ("drop_edge_type", "confirm") in steps(old, old.replace("edge Knows: User -> User", ""))
    assert ("change_key", "blocked") in steps(old, old.replace("@key", "@unique"))
