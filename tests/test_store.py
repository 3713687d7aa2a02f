"""Migration of stored graphs, the change stream and the command line."""

import json

import pytest

from hopline.cli import main
from hopline.errors import MigrationError
from hopline.session import GraphSession
from hopline.streaming.changes import counts, tail

USERS = "node User { name: String @key  age: I32?  code: String?  role: enum(a, b)? } edge Knows: User -> User { since: Date? }"
LINES = ['{"type":"User","data":{"name":"x","age":1,"code":"7","role":"a"}}\n{"type":"User","data":{"name":"y","code":"8"}}\n{"edge":"Knows","from":"x","to":"y","data":{"since":"2020-01-01"}}']


@pytest.fixture
def users(spark):
    g = GraphSession.in_memory(spark, USERS)
    g.load(LINES)
    return g


def test_rename_keeps_ids_and_edges(users):
    before = users.graph().node("User").select("__id", "name").collect()
    new = 'node Account @rename_from("User") { full: String @key @rename_from("name")  age: I64?  code: I32?  role: enum(a, b, c)? } edge Linked: Account -> Account @rename_from("Knows") { since: Date? }'
    with pytest.raises(MigrationError, match="confirm"):
        users.migrate(new)
    steps = users.migrate(new, confirm=True)
    assert {s.kind for s in steps} == {"rename_node_type", "rename_edge_type", "rename_property", "change_type", "grow_enum"}
    after = users.graph().node("Account")
    assert sorted((r["__id"], r["full"]) for r in after.collect()) == sorted((r["__id"], r["name"]) for r in before)
    assert sorted(r.code for r in after.collect()) == [7, 8] and dict(after.dtypes)["age"] == "bigint"
    got = users.run("query q() { match { $a: Account  $a linked $b } return { $a.full, $b.full } }").collect()
    assert [tuple(r) for r in got] == [("x", "y")]


@pytest.mark.parametrize(
    "old, new",
    [
        ("age: I32?", "age: I32"),  # a null row
        ("name: String", "name: I32"),  # keys that are no numbers
        ("role: enum(a, b)?", "role: enum(b)?"),  # a row holds a
        ("age: I32?", "age: I32?  email: String"),
    ],
)
def test_blocked_by_data(users, old, new):
    with pytest.raises(MigrationError):
        users.migrate(USERS.replace(old, new), confirm=True)
    assert users.version == 1


def test_drop(users):
    assert [s.safety for s in users.migrate(USERS.replace("code: String?", ""), dry_run=True)] == ["confirm"]
    users.migrate(USERS.replace("code: String?", ""), confirm=True)
    assert "code" not in users.graph().node("User").columns
    users.migrate("node User { name: String @key  age: I32?  role: enum(a, b)? }", confirm=True)
    assert users.describe()["edges"] == []


def test_change_stream(spark, users, tmp_path):
    stream = tail(users)
    q = counts(stream).writeStream.outputMode("complete").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        users.run('query q() { insert User { name: "z" } }')
        q.processAllAvailable()
        got = {(r.graph_version, r.type_name, r.change_kind): r.n for r in spark.table("seen").collect()}
    finally:
        q.stop()
    assert got == {(1, "User", "insert"): 2, (1, "Knows", "insert"): 1, (2, "User", "insert"): 1}


def test_command_line(spark, tmp_path, capsys):
    schema, data, queries, graph = (tmp_path / n for n in ("s.pg", "d.jsonl", "q.gq", "g"))
    schema.write_text(USERS)
    data.write_text(LINES[0])
    queries.write_text("query all($n: I64) { match { $u: User } return { $u.name, $u.age } order { $u.name } limit 5 }\nquery bad() { match { $u: Nope } return { 1 } }")

    def run(*args):
        code = main([str(a) for a in args], spark)
        return code, capsys.readouterr().out

    assert run("init", graph, schema) == (0, "")
    assert json.loads(run("load", graph, data)[1]) == {"User": 2, "Knows": 1}
    assert json.loads(run("run", graph, queries, "--name", "all", "--param", "n=1", "--format", "json")[1]) == [{"name": "x", "age": 1}, {"name": "y"}]
    assert run("run", graph, queries, "--name", "all", "--param", "n=1", "--format", "csv")[1].split() == ["name,age", "x,1", "y,"]
    assert run("run", graph, queries, "--name", "all", "--param", "n=1")[1].splitlines()[2] == "x    | 1"
    assert run("lint", schema, queries)[0] == 1
    assert run("run", graph, queries, "--name", "nope")[0] == 1
    assert json.loads(run("delete", graph, "User", 'name = "x"')[1]) == [{"affected_nodes": 1, "affected_edges": 1}]
    assert run("doctor", graph)[0] == 0
    assert len(run("changes", graph, "--after", 1)[1].splitlines()) == 2
    assert run("export", graph, tmp_path / "out")[0] == 0
    assert run("describe", graph)[0] == 0 and run("compact", graph)[0] == 0 and run("cleanup", graph, "--keep", 1)[0] == 0
    assert json.loads(run("schema-diff", schema, schema)[1] or "[]") == []


def test_aliases(spark, tmp_path, capsys):
    (tmp_path / "queries").mkdir()
    (tmp_path / "queries" / "q.gq").write_text("query by_name($n: String) { match { $u: User { name: $n } } return { $u.name, $u.code } }")
    (tmp_path / "hopline.toml").write_text('[db]\ndefault_path = "g"\n[query]\nroots = ["queries"]\n[cli]\noutput_format = "csv"\n[query_aliases.who]\nquery = "q.gq"\nname = "by_name"\nargs = ["n"]\n')
    g = GraphSession.init(spark, str(tmp_path / "g"), USERS)
    g.load(['{"type":"User","data":{"name":"7","code":"seven"}}'])

    def run(*args):
        code = main(["alias", *args, "--config", str(tmp_path / "hopline.toml")], spark)
        return code, capsys.readouterr().out.split()

    assert run("who", "7") == (0, ["name,code", "7,seven"])
    assert run("who", "x", "--param", 'n="7"') == (0, ["name,code", "7,seven"])
    assert run("who", "7", "--format", "kv") == (0, ["name:", "7", "code:", "seven"])
    assert run("who", "7", "8")[0] == 1 and run("nobody")[0] == 1
