"""The registered graph queries, and the SQL that says the same over the plain tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopline import catalog_stored, catalog_writes
from hopline.functions.vector import embed
from hopline.graph import Graph
from hopline.sources.adapters import star_graph

Query = Callable[[SparkSession, str], DataFrame]

#: name: (query text, parameters, SQL); SQL is None where the result isn't determined.
READS: dict[str, tuple[str, dict, str | None]] = {}


def read(name: str, body: str, sql: str | None, params: str = "", given: dict | None = None) -> None:
    READS[name] = (f"query {name}({params}) {{ {body} }}", given or {}, sql)


#: The language's tokens in SQL.
TOKENS = "list_filter(string_split_regex(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
INCLUDES = "(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"
SHIPPED = "(SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)"
BORDERS = "(SELECT DISTINCT n_nationkey AS a, b FROM (SELECT n_nationkey, unnest([(n_nationkey + 1) % 25, (3 * n_nationkey + 1) % 25]) AS b FROM nation))"
TURNS = "(SELECT conv_id * 1000 + turn AS k, * FROM conversations)"
NEXT = f"(SELECT a.k AS a, b.k AS b FROM (SELECT DISTINCT k FROM {TURNS}) a JOIN (SELECT DISTINCT k FROM {TURNS}) b ON b.k = a.k + 1)"

# scans and filters
read("scan_filter", "match { $c: Customer  $c.c_acctbal > 9000.0 } return { $c.c_custkey, $c.c_name, $c.c_acctbal }",
     "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 9000.0")
read("scan_inline_match", 'match { $c: Customer { c_mktsegment: "BUILDING", c_nationkey: 3 } } return { $c.c_custkey, $c.c_name }',
     "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
read("scan_key_lookup", "match { $c: Customer { c_custkey: $k } } return { $c.c_custkey, $c.c_name, $c.c_acctbal } limit 1",
     "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 77", "$k: I64", {"k": 77})
read("filter_flip_literal", "match { $c: Customer  9000.0 < $c.c_acctbal } return { $c.c_custkey }",
     "SELECT c_custkey FROM customer WHERE c_acctbal > 9000.0")
read("filter_cast_trunc", "match { $p: Part  $p.p_size > 25.9 } return { $p.p_partkey, $p.p_size }",
     "SELECT p_partkey, p_size FROM part WHERE p_size > 25")
read("filter_cast_null", "match { $p: Part  $p.p_size < 99999999999 } return { $p.p_partkey }",
     "SELECT p_partkey FROM part WHERE p_size < TRY_CAST(99999999999 AS INTEGER)")
read("filter_negative_param", "match { $c: Customer  $c.c_acctbal < $low } return { $c.c_custkey, $c.c_acctbal }",
     "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -500.5", "$low: F64", {"low": -500.5})
read("filter_datetime", 'match { $o: Order  $o.o_orderdate >= datetime("1995-06-01T00:00:00Z")  $o.o_orderdate < datetime("1996-01-01T00:00:00Z") } return { $o.o_orderkey, $o.o_orderdate }',
     "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
read("filter_string_ne", 'match { $n: Nation  $n.n_name != "NATION_3"  $n.n_name >= "NATION_1" } return { $n.n_nationkey, $n.n_name }',
     "SELECT n_nationkey, n_name FROM nation WHERE n_name <> 'NATION_3' AND n_name >= 'NATION_1'")
read("filter_bool_free", 'match { $d: Doc  search($d.text, "the") = false } return { $d.doc_id }',
     f"SELECT doc_id FROM documents WHERE NOT coalesce(list_contains({TOKENS.format('text')}, 'the'), false)")
read("filter_theta_same_node", "match { $o: Order  $o.o_orderkey < $o.o_custkey } return { $o.o_orderkey, $o.o_custkey }",
     "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < o_custkey")
read("list_contains", 'match { $d: Doc  $d.tags contains "de" } return { $d.doc_id, $d.lang }',
     "SELECT doc_id, lang FROM documents WHERE list_contains([lang, source], 'de')")
read("list_inline_match", "match { $d: Doc { tags: $t } } return { $d.doc_id, $d.tags }",
     "SELECT doc_id, [lang, source] AS tags FROM documents WHERE list_contains([lang, source], 'src3')", "$t: String", {"t": "src3"})

# projections
read("project_alias", "match { $s: Supplier } return { $s.s_name as supplier, $s.s_acctbal as balance, $s.s_suppkey }",
     "SELECT s_name AS supplier, s_acctbal AS balance, s_suppkey FROM supplier")
read("project_node_struct", "match { $r: Region } return { $r }",
     "SELECT r_regionkey::BIGINT AS id, r_regionkey, r_name FROM region")
read("project_literal_param", 'match { $r: Region } return { $r.r_name, "x" as tag, 7, $p }',
     "SELECT r_name, 'x' AS tag, 7::BIGINT AS literal, 2.5::DOUBLE AS p FROM region", "$p: F64", {"p": 2.5})
read("project_now", "match { $r: Region } return { $r.r_name, now() as at }", None)
read("filter_now", "match { $o: Order  $o.o_orderdate < now()  now() > datetime(\"2024-01-01T00:00:00Z\") } return { $o.o_orderkey }",
     "SELECT o_orderkey FROM orders WHERE o_orderdate < now()")

# traversals
read("hop_out", "match { $c: Customer  $c customerIn $n } return { $c.c_custkey, $n.n_name }",
     "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
read("hop_in", "match { $n: Nation { n_nationkey: 7 }  $c customerIn $n } return { $c.c_custkey, $c.c_name, $n.n_name }",
     "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey = 7")
read("hop_in_filter", "match { $n: Nation  $n customerIn $c  $c.c_acctbal > 9500.0 } return { $n.n_name, $c.c_custkey }",
     "SELECT n_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9500.0")
read("hop_chain3", "match { $c: Customer  $c customerIn $n  $n inRegion $r  $c placed $o  $o.o_totalprice > 400000.0 } return { $c.c_custkey, $r.r_name, $o.o_orderkey, $o.o_totalprice }",
     """SELECT c_custkey, r_name, o_orderkey, o_totalprice FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000.0""")  # fmt: skip
read("hop_dedup_edge", "match { $o: Order  $o includes $p  $p.p_size = 1 } return { $o.o_orderkey, $p.p_partkey }",
     f"SELECT o_orderkey, p_partkey FROM orders JOIN {INCLUDES} e ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size = 1")
read("hop_cycle_close", "match { $c: Customer  $c customerIn $n  $c placed $o  $o shippedBy $s  $s supplierIn $n } return { $c.c_custkey, $o.o_orderkey, $s.s_suppkey, $n.n_name }",
     f"""SELECT c_custkey, o_orderkey, s_suppkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
        JOIN {SHIPPED} e ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = n_nationkey""")  # fmt: skip
read("hop_both_bound", "match { $a: Nation  $b: Nation  $a borders $b } return { $a.n_nationkey as a, $b.n_nationkey as b }",
     f"SELECT a::INTEGER AS a, b::INTEGER AS b FROM {BORDERS}")
read("hop_wildcard", "match { $u: User  $u did $_ } return { $u.user_id }",
     "SELECT user_id FROM events WHERE user_id IS NOT NULL")
read("hop_exact2", "match { $a: Nation  $a borders{2,2} $b } return { $a.n_nationkey as a, $b.n_nationkey as b }",
     f"SELECT DISTINCT x.a::INTEGER AS a, y.b::INTEGER AS b FROM {BORDERS} x JOIN {BORDERS} y ON x.b = y.a")
read("hop_range_1_3", "match { $t: Turn { turn: 0 }  $t nextTurn{1,3} $u } return { $t.turn_key as a, $u.turn_key as b }",
     f"""WITH e AS {NEXT}, s AS (SELECT k FROM {TURNS} WHERE turn = 0)
        SELECT k AS a, e.b FROM s JOIN e ON k = e.a UNION SELECT k, f.b FROM s JOIN e ON k = e.a JOIN e f ON e.b = f.a
        UNION SELECT k, g.b FROM s JOIN e ON k = e.a JOIN e f ON e.b = f.a JOIN e g ON f.b = g.a""")  # fmt: skip
read("hop_range_cycle", "match { $a: Nation { n_nationkey: 2 }  $a borders{2,4} $b } return { $b.n_nationkey as b, $b.n_name }",
     f"""WITH e AS {BORDERS}, l1 AS (SELECT b FROM e WHERE a = 2), l2 AS (SELECT DISTINCT e.b FROM l1 JOIN e ON l1.b = e.a),
        l3 AS (SELECT DISTINCT e.b FROM l2 JOIN e ON l2.b = e.a), l4 AS (SELECT DISTINCT e.b FROM l3 JOIN e ON l3.b = e.a)
        SELECT n_nationkey AS b, n_name FROM nation WHERE n_nationkey IN (SELECT b FROM l2 UNION SELECT b FROM l3 UNION SELECT b FROM l4)""")  # fmt: skip
read("hop_reverse_2", "match { $b: Nation { n_nationkey: 5 }  $a borders{1,2} $b } return { $a.n_nationkey as a }",
     f"""WITH e AS {BORDERS} SELECT a::INTEGER AS a FROM e WHERE b = 5 UNION SELECT x.a::INTEGER FROM e x JOIN e y ON x.b = y.a WHERE y.b = 5""")
read("hop_range_two_types", "match { $c: Customer { c_nationkey: 4 }  $c customerIn{1,3} $n } return { $c.c_custkey, $n.n_name }",
     "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey = 4")
read("theta_cross", "match { $a: Nation  $b: Nation  $a.n_regionkey = $b.n_regionkey  $a.n_nationkey < $b.n_nationkey } return { $a.n_name as x, $b.n_name as y }",
     "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
read("cross_pairs", "match { $a: Region  $b: Nation } return { $a.r_name, $b.n_name }", "SELECT r_name, n_name FROM region, nation")
read("duplicate_names", "match { $a: Nation  $a borders $b } return { $a.n_name as a, $b.n_name as b, $a.n_nationkey }",
     f"SELECT x.n_name AS a, y.n_name AS b, x.n_nationkey FROM nation x JOIN {BORDERS} e ON x.n_nationkey = e.a JOIN nation y ON y.n_nationkey = e.b")

# negation
read("not_simple", "match { $d: Doc  not { $d hasLabel $l } } return { $d.doc_id }",
     "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
read("not_wildcard", "match { $d: Doc  $d.lang = \"es\"  not { $d hasLabel $_ } } return { $d.doc_id }",
     "SELECT doc_id FROM documents WHERE lang = 'es' AND doc_id NOT IN (SELECT doc_id FROM labels)")
read("not_inner_filter", "match { $c: Customer  not { $c placed $o  $o.o_totalprice > 100000.0 } } return { $c.c_custkey }",
     "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000.0)")
read("not_two_vars", "match { $c: Customer  $c placed $o  $p: Part { p_size: 1 }  $o.o_totalprice > 450000.0  not { $o includes $p } } return { $o.o_orderkey, $p.p_partkey }",
     f"""SELECT o_orderkey, p_partkey FROM customer JOIN orders ON o_custkey = c_custkey, part WHERE p_size = 1 AND o_totalprice > 450000.0
        AND NOT EXISTS (SELECT 1 FROM {INCLUDES} e WHERE l_orderkey = o_orderkey AND l_partkey = p_partkey)""")  # fmt: skip
read("not_filter_only", "match { $c: Customer  $c customerIn $n  not { $c.c_custkey = $n.n_nationkey } } return { $c.c_custkey }",
     "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey <> n_nationkey")
read("not_nested", "match { $c: Customer  not { $c placed $o  not { $o includes $p  $p.p_size < 25 } } } return { $c.c_custkey }",
     f"""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT EXISTS
        (SELECT 1 FROM {INCLUDES} e JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND p_size < 25))""")  # fmt: skip
read("not_left_anonymous", "match { $n: Nation  not { $_ supplierIn $n } } return { $n.n_name }",
     "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")

# aggregates
read("agg_count_node", "match { $n: Nation  $c customerIn $n } return { $n.n_name, count($c) as customers }",
     "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
read("agg_count_prop", "match { $d: Doc } return { $d.lang, count($d.source) as n }", "SELECT lang, count(source) AS n FROM documents GROUP BY lang")
read("agg_sum_avg", "match { $c: Customer  $c placed $o } return { $c.c_mktsegment, sum($o.o_totalprice) as total, avg($o.o_totalprice) as mean }",
     "SELECT c_mktsegment, sum(o_totalprice) AS total, avg(o_totalprice) AS mean FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment")
read("agg_sum_int", "match { $p: Part } return { $p.p_brand, sum($p.p_size) as sizes, avg($p.p_size) as mean }",
     "SELECT p_brand, sum(p_size)::BIGINT AS sizes, avg(p_size) AS mean FROM part GROUP BY p_brand")
read("agg_min_max", "match { $p: Part } return { $p.p_type, min($p.p_retailprice) as low, max($p.p_retailprice) as high, min($p.p_size) as small }",
     "SELECT p_type, min(p_retailprice) AS low, max(p_retailprice) AS high, min(p_size) AS small FROM part GROUP BY p_type")
read("agg_min_max_date", "match { $o: Order } return { min($o.o_orderdate) as first, max($o.o_orderdate) as last }",
     "SELECT min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders")
read("agg_global", "match { $o: Order } return { count($o) as n, sum($o.o_totalprice) as total }", "SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders")
read("agg_global_empty", "match { $o: Order  $o.o_totalprice < 0.0 } return { count($o) as n, sum($o.o_totalprice) as total, min($o.o_totalprice) as low }",
     "SELECT count(*) AS n, sum(o_totalprice) AS total, min(o_totalprice) AS low FROM orders WHERE o_totalprice < 0.0")
read("agg_group_multi", "match { $c: Customer  $c placed $o  $c customerIn $n } return { $n.n_name, $o.o_orderstatus, count($o) as orders, max($o.o_totalprice) as top }",
     """SELECT n_name, o_orderstatus, count(*) AS orders, max(o_totalprice) AS top FROM customer JOIN orders ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, o_orderstatus""")  # fmt: skip
read("agg_literal", "match { $r: Region } return { count(1) as n, sum(2) as twos }", "SELECT count(*) AS n, (2 * count(*))::BIGINT AS twos FROM region")
read("agg_alias_order_limit", "match { $c: Customer  $c placed $o } return { $c.c_custkey, count($o) as orders } order { orders desc, $c.c_custkey asc } limit 10",
     "SELECT c_custkey, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY orders DESC, c_custkey LIMIT 10")
# order and limit
read("sort_nulls", "match { $e: Event } return { $e.event_id, $e.value } order { $e.value desc, $e.event_id } limit 50",
     "SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 50")
read("topk", "match { $o: Order } return { $o.o_orderkey, $o.o_totalprice } order { $o.o_totalprice desc, $o.o_orderkey } limit 20",
     "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
read("sort_not_projected", "match { $c: Customer } return { $c.c_name } order { $c.c_acctbal asc, $c.c_custkey } limit 15",
     "SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 15")
read("limit_only", "match { $c: Customer } return { $c.c_name } limit 7", None)
read("limit_beyond", "match { $r: Region } return { $r.r_name } limit 100000", "SELECT r_name FROM region")

# text
read("text_search", 'match { $d: Doc  search($d.text, "The AND") } return { $d.doc_id }',
     f"SELECT doc_id FROM documents WHERE list_has_all({TOKENS.format('text')}, ['the', 'and'])")
read("text_match_text", 'match { $d: Doc  match_text($d.text, "of the") } return { $d.doc_id }',
     f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ', ' of the ')")
read("text_fuzzy", 'match { $d: Doc  fuzzy($d.text, "stupit") } return { $d.doc_id }',
     f"SELECT doc_id FROM documents WHERE len(list_filter({TOKENS.format('text')}, lambda t: levenshtein(t, 'stupit') <= 2)) > 0")
read("text_fuzzy_k", 'match { $d: Doc  fuzzy($d.text, "idiot clown", 1) } return { $d.doc_id }',
     f"""SELECT doc_id FROM documents WHERE len(list_filter({TOKENS.format('text')}, lambda t: levenshtein(t, 'idiot') <= 1)) > 0
        AND len(list_filter({TOKENS.format('text')}, lambda t: levenshtein(t, 'clown') <= 1)) > 0""")  # fmt: skip
read("text_empty_query", 'match { $d: Doc  search($d.text, " -- ") } return { $d.doc_id }', "SELECT doc_id FROM documents WHERE false")
read("text_projected", 'match { $p: Part } return { $p.p_partkey, search($p.p_name, "part") as hit, match_text($p.p_name, "part 1") as phrase }',
     f"""SELECT p_partkey, coalesce(list_contains({TOKENS.format('p_name')}, 'part'), false) AS hit,
        contains(' ' || array_to_string({TOKENS.format('p_name')}, ' ') || ' ', ' part 1 ') AS phrase FROM part""")  # fmt: skip


def _bm25(rows: str, key: str, text: str, terms: list[str]) -> str:
    """SQL: (key, score) of the formula over a relation."""
    score = " + ".join(
        f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean))) ELSE 0 END" for i in range(len(terms))
    )
    tf = ", ".join(f"len(list_filter(tok, lambda t: t = '{t}'))::DOUBLE AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    return f"""(WITH tk AS (SELECT {key}, {TOKENS.format(text)} AS tok FROM {rows}), f AS (SELECT {key}, len(tok)::DOUBLE AS dl, {tf} FROM tk),
        s AS (SELECT count(dl) AS n, avg(dl) AS mean, {df} FROM f) SELECT {key}, coalesce({score}, 0) AS score FROM f, s)"""


read("bm25_topk", 'match { $d: Doc } return { $d.doc_id, bm25($d.text, "stupid idiot") as score } order { bm25($d.text, "stupid idiot") desc, $d.doc_id } limit 20',
     f"SELECT doc_id, score FROM {_bm25('documents', 'doc_id', 'text', ['idiot', 'stupid'])} ORDER BY round(score, 9) DESC, doc_id LIMIT 20")
read("bm25_all", 'match { $p: Part } return { $p.p_partkey, bm25($p.p_name, "part") as score }',
     f"SELECT p_partkey, score FROM {_bm25('part', 'p_partkey', 'p_name', ['part'])}")
read("bm25_graph_scoped", 'match { $l: Label { toxic: 1 }  $d hasLabel $l } return { $d.doc_id, bm25($d.text, "stupid") as score }',
     f"SELECT doc_id, score FROM {_bm25('(SELECT doc_id, text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)', 'doc_id', 'text', ['stupid'])}")

QUERY_VECTOR = [round(((i * 37) % 64 - 32) / 32, 5) for i in range(64)]


def _distance(query: list[float]) -> str:
    """SQL: the cosine distance of ``embedding`` to a vector, in doubles."""
    q = "[" + ", ".join(map(repr, query)) + "]::FLOAT[]"
    return f"""(1 - list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ({q})[i]::DOUBLE)) /
    (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({q}, lambda x: x::DOUBLE * x::DOUBLE)))))"""


_DISTANCE = _distance(QUERY_VECTOR)
read("nearest_topk", "match { $v: Vec } return { $v.vec_id, nearest($v.embedding, $q) as distance } order { nearest($v.embedding, $q) } limit 10",
     f"SELECT vec_id, {_DISTANCE} AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 10", "$q: Vector(64)", {"q": QUERY_VECTOR})
read("nearest_filtered", "match { $v: Vec  $v.label = 3 } return { $v.vec_id, nearest($v.embedding, $q) as distance } order { nearest($v.embedding, $q) } limit 5",
     f"SELECT vec_id, {_DISTANCE} AS distance FROM embeddings WHERE label = 3 ORDER BY distance, vec_id LIMIT 5", "$q: Vector(64)", {"q": QUERY_VECTOR})
read("nearest_projected", "match { $v: Vec } return { $v.vec_id, nearest($v.embedding, $q) as distance }",
     f"SELECT vec_id, {_DISTANCE} AS distance FROM embeddings", "$q: Vector(64)", {"q": QUERY_VECTOR})
read("nearest_string", 'match { $v: Vec } return { $v.vec_id } order { nearest($v.embedding, "a question") } limit 5',
     f"SELECT vec_id FROM embeddings ORDER BY {_distance(embed('a question', 64, 'query'))}, vec_id LIMIT 5")


def _rrf(first: list[str], second: list[str], k: int) -> str:
    return f"""SELECT doc_id, 1.0::DOUBLE / ({k} + row_number() OVER (ORDER BY round(a.score, 12) DESC, doc_id)) + 1.0::DOUBLE / ({k} + row_number() OVER (ORDER BY round(b.score, 12) DESC, doc_id)) AS score
        FROM {_bm25('documents', 'doc_id', 'text', first)} a JOIN {_bm25('documents', 'doc_id', 'text', second)} b USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10"""


read("rrf_bm25_bm25", 'match { $d: Doc } return { $d.doc_id, rrf(bm25($d.text, "stupid"), bm25($d.text, "clown")) as score } order { rrf(bm25($d.text, "stupid"), bm25($d.text, "clown")) desc, $d.doc_id } limit 10',
     _rrf(["stupid"], ["clown"], 60))
read("rrf_k", 'match { $d: Doc } return { $d.doc_id, rrf(bm25($d.text, "idiot"), bm25($d.text, "worthless"), 5) as score } order { score desc, $d.doc_id } limit 10',
     _rrf(["idiot"], ["worthless"], 5))

read("rrf_parts", 'match { $d: Doc } return { $d.doc_id, rrf(bm25($d.text, "stupid"), bm25($d.text, "clown")) as score } order { score desc, $d.doc_id } limit 40',
     _rrf(["stupid"], ["clown"], 60).replace("LIMIT 10", "LIMIT 40"))

read("bm25_type_corpus", 'match { $l: Label { toxic: 1 }  $d hasLabel $l } return { $d.doc_id, bm25($d.text, "stupid") as score }',
     f"SELECT doc_id, score FROM {_bm25('documents', 'doc_id', 'text', ['stupid'])} JOIN labels USING (doc_id) WHERE toxic = 1")
read("not_first_var", "match { $a: Nation  $b: Nation  $a.n_regionkey = $b.n_regionkey  not { $a borders $b } } return { $a.n_nationkey as a, $b.n_nationkey as b }",
     f"""WITH p AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey)
        SELECT a, b FROM p WHERE a NOT IN (SELECT p.a FROM p JOIN {BORDERS} e ON p.a = e.a AND p.b = e.b)""")  # fmt: skip
# the same over tables with nulls
DOCS_N = "(SELECT * REPLACE (CASE WHEN doc_id % 3 <> 0 THEN text END AS text, CASE WHEN doc_id % 4 <> 0 THEN lang END AS lang), CASE WHEN doc_id % 5 <> 0 THEN [lang, source] END AS tags FROM documents)"
EVENTS_N = "(SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type) FROM events)"
VECS_N = "(SELECT * REPLACE (CASE WHEN vec_id % 6 <> 0 THEN embedding END AS embedding) FROM embeddings)"
read("null_string_ne", 'match { $d: Doc  $d.lang != "en" } return { $d.doc_id, $d.lang }', f"SELECT doc_id, lang FROM {DOCS_N} WHERE lang <> 'en'")
read("null_inline_match", 'match { $d: Doc { lang: "de" } } return { $d.doc_id }', f"SELECT doc_id FROM {DOCS_N} WHERE lang = 'de'")
read("null_negated", 'match { $d: Doc  not { $d.lang = "en" } } return { $d.doc_id }', f"SELECT doc_id FROM {DOCS_N} WHERE coalesce(lang <> 'en', true)")
read("null_list_contains", 'match { $d: Doc  $d.tags contains "de" } return { $d.doc_id }', f"SELECT doc_id FROM {DOCS_N} WHERE list_contains(tags, 'de')")
read("null_list_negated", 'match { $d: Doc  not { $d.tags contains "de" } } return { $d.doc_id, $d.tags }',
     f"SELECT doc_id, tags FROM {DOCS_N} WHERE NOT coalesce(list_contains(tags, 'de'), false)")
for way, first in (("asc", "ASC"), ("desc", "DESC")):
    read(f"null_sort_{way}", f"match {{ $e: Event  $e.event_id < 60 }} return {{ $e.event_id, $e.value }} order {{ $e.value {way}, $e.event_id }} limit 55",
         f"SELECT event_id, value FROM {EVENTS_N} WHERE event_id < 60 ORDER BY value {first} NULLS LAST, event_id LIMIT 55")
read("null_aggregates", "match { $e: Event } return { $e.event_type, count($e) as n, count($e.value) as values, min($e.value) as low, max($e.value) as high }",
     f"SELECT event_type, count(*) AS n, count(value) AS values, min(value) AS low, max(value) AS high FROM {EVENTS_N} GROUP BY event_type")
read("null_search", 'match { $d: Doc } return { $d.doc_id, search($d.text, "the") as hit, match_text($d.text, "of the") as phrase, fuzzy($d.text, "stupit") as near }',
     f"""SELECT doc_id, coalesce(list_contains({TOKENS.format('text')}, 'the'), false) AS hit,
        coalesce(contains(' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ', ' of the '), false) AS phrase,
        coalesce(len(list_filter({TOKENS.format('text')}, lambda t: levenshtein(t, 'stupit') <= 2)) > 0, false) AS near FROM {DOCS_N}""")  # fmt: skip
read("null_bm25", 'match { $d: Doc } return { $d.doc_id, bm25($d.text, "stupid idiot") as score }', f"SELECT doc_id, score FROM {_bm25(DOCS_N, 'doc_id', 'text', ['idiot', 'stupid'])}")
read("null_nearest", "match { $v: Vec  $v.vec_id < 40 } return { $v.vec_id, nearest($v.embedding, $q) as distance } order { nearest($v.embedding, $q) } limit 38",
     f"SELECT vec_id, {_DISTANCE} AS distance FROM {VECS_N} WHERE vec_id < 40 ORDER BY distance NULLS LAST, vec_id LIMIT 38", "$q: Vector(64)", {"q": QUERY_VECTOR})
read("bm25_beside_rrf", 'match { $d: Doc } return { $d.doc_id, bm25($d.text, "stupid") as a, rrf(bm25($d.text, "stupid"), bm25($d.text, "clown")) as score } order { score desc, $d.doc_id } limit 10',
     f"SELECT r.doc_id, b.score AS a, r.score FROM ({_rrf(['stupid'], ['clown'], 60)}) r JOIN {_bm25('documents', 'doc_id', 'text', ['stupid'])} b USING (doc_id) ORDER BY score DESC, doc_id")
#: Options of queries that need other than the default ones.
OPTIONS = {"rrf_parts": {"ranks": "parts"}, "bm25_type_corpus": {"corpus": "type"}, "not_first_var": {"negation": "first_var"}}
#: Sums and scores are rounded on both sides: engines add doubles in different orders.
DIGITS = {
    "agg_sum_avg": {"total": 2, "mean": 4}, "agg_sum_int": {"mean": 6}, "agg_global": {"total": 2},
    **{n: {"score": 6} for n in READS if n.startswith(("bm25_", "rrf_", "null_bm25"))}, "bm25_beside_rrf": {"a": 6, "score": 6}, "null_nearest": {"distance": 6},
    "nearest_topk": {"distance": 6}, "nearest_filtered": {"distance": 6}, "nearest_projected": {"distance": 6},
}


def _rounded(name: str, sql: str) -> str:
    if name not in DIGITS:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {d}) AS {c}' for c, d in DIGITS[name].items())}) FROM ({sql})"


def _with_nulls(g: Graph) -> Graph:
    """The graph with nulls where the tables have none."""

    def null(kind: str, **when: str) -> None:
        made = g.node(kind)
        g.nodes[kind] = made.withColumns({c: F.when(~F.expr(cond), F.col(c)) for c, cond in when.items()})

    null("Doc", text="doc_id % 3 = 0", lang="doc_id % 4 = 0", tags="doc_id % 5 = 0")
    null("Event", value="event_id % 7 = 0", event_type="event_id % 5 = 0")
    null("Vec", embedding="vec_id % 6 = 0")
    return g


def _run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, given, _ = READS[name]
    graph = star_graph(spark, sf_dir)
    out = (_with_nulls(graph) if name.startswith("null_") else graph).query(text, given, **OPTIONS.get(name, {}))
    out = out.withColumns({c: F.round(c, d) for c, d in DIGITS.get(name, {}).items()})
    return out.select("r.*") if name == "project_node_struct" else out


QUERIES: dict[str, Query] = {name: partial(_run, name=name) for name in READS} | catalog_writes.QUERIES | catalog_stored.QUERIES
ORACLE: dict[str, str] = {name: _rounded(name, sql) for name, (_, _, sql) in READS.items() if sql} | catalog_writes.ORACLE | catalog_stored.ORACLE
