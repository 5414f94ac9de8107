import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import javasource as J
from tidemark.operators import codegraph as C
from tidemark.operators import differential as D
from tidemark.operators import extract as E
from tidemark.operators import graph as G
from tidemark.operators import quality as Q
from tidemark.operators import relational as R
from tidemark.operators.components import connected_components
from tidemark.operators.similarity import contained_pairs
from tidemark.plans import gateway


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_components_against_union_find(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(None, 1), (3, None), (4, 4), (7, 8), (7, 8)] + [(i, i + 1) for i in range(300, 340)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert dict(rows(connected_components(edges(spark, pairs)))) == {x: find(x) for x in list(parent)}


def test_components_of_nothing(spark):
    assert connected_components(edges(spark, [])).count() == 0


def test_strong_components(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1), (None, 2), (1, 2)]
    assert rows(G.strong_components(edges(spark, pairs))) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert G.strong_components(edges(spark, [(1, 2)])).count() == 0


def test_chains_and_depths(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (1, 3)])
    starts = spark.createDataFrame([(1,)], "id long")
    assert sorted(map(tuple, (r.path for r in G.chains(e, starts, 5).collect()))) == [(1, 2), (1, 2, 3), (1, 3)]
    assert rows(G.breadth_first(e, starts, 4)) == [(1, 1, 0), (1, 2, 1), (1, 3, 1)]


def test_support_chains_and_explanations(spark):
    e = spark.createDataFrame([(1, 2, 0.9), (2, 3, None), (4, 3, 0.5), (5, 6, 0.7), (6, 5, 0.7), (5, 7, 1.0), (None, 3, 0.1), (8, 9, 1.0), (9, 10, 1.0)], "src long, dst long, conf double")
    goals = spark.createDataFrame([(3,), (1,), (7,), (10,)], "id long")
    chains = G.support_chains(e, goals)
    assert sorted((r.goal, r.path, r.strength) for r in chains.collect()) == [(3, [1, 2, 3], 0.9), (3, [4, 3], 0.5), (10, [8, 9, 10], 1.0)]  # 7 is reached by a circle alone
    assert sorted((r.root, r.depth) for r in G.support_chains(e, goals, 1).collect()) == [(2, 1), (4, 1), (5, 1), (9, 1)]
    claims = spark.createDataFrame([(3,), (8,), (99,)], "id long")
    assert sorted(map(tuple, G.explained(chains, goals, claims, e).collect())) == [(1, False, 0, 0, 0, None), (3, True, 2, 2, 0, 0.9), (7, False, 0, 0, 0, None), (10, False, 1, 1, 1, 1.0)]
    assert G.support_chains(e.where("false"), goals).count() == 0


def test_long_paths_and_text_vertices_settle(spark):
    e = spark.createDataFrame([(f"v{i:03}", f"v{i + 1:03}") for i in range(16)] + [("v016", "v000"), ("x", "y")], "src string, dst string")
    got = G.strong_components(e).collect()
    assert {r.component for r in got} == {"v000"} and len(got) == 17
    assert G.strong_components(e.where("src = 'x'")).count() == 0


def test_integrity(spark):
    claims = spark.createDataFrame([(1,), (3,), (1,), (None,)], "id long")
    twice = edges(spark, [(1, 2), (2, 3), (1, 2)])
    assert rows(G.integrity(spark.createDataFrame([(1,), (2,), (3,)], "id long"), twice, claims)) == [("duplicate-edge", 1), ("unsupported-claim", 1)]
    nodes = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "id long")
    assert rows(G.integrity(nodes, edges(spark, [(1, 2), (2, 3), (2, 2)]))) == [("dangling-edge", 3), ("duplicate-node", 1), ("orphan", 9), ("self-loop", 2)]


def test_guarded_fold_is_not_a_running_sum(spark):
    df = spark.createDataFrame([(1, i, Decimal(a)) for i, a in enumerate((100, -60, -60, -40, 5))] + [(2, 0, Decimal(-1)), (None, 1, Decimal(1)), (3, 1, None)], "k long, o long, amount decimal(18,4)")
    got = {(r.k, r.o): (r.accepted, float(r.balance)) for r in R.guarded_fold(df, "k", "o", "amount").collect()}
    assert got == {(1, 0): (True, 100), (1, 1): (True, 40), (1, 2): (False, 40), (1, 3): (True, 0), (1, 4): (True, 5), (2, 0): (False, 0)}


def test_islands_sessions_and_numbers(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 6, 9, 20)], "k string, at long")
    assert rows(R.islands(df, ["k"], "at", 3)) == [("a", 1, 2, 2), ("a", 20, 20, 1), ("a", 6, 9, 2)]
    seq = spark.createDataFrame([("r", 1, 0), ("r", 2, 1), ("r", 3, 1), ("r", 4, 0), ("r", 5, 5)], "run string, pos long, seq long")
    assert [r.session for r in R.reset_sessions(seq, ["run"], [F.col("pos")], "seq").orderBy("pos").collect()] == [1, 1, 2, 3, 3]
    numbered = R.number_after(df, "at", spark.createDataFrame([(10,)], "top long"), "id", ranges=3)
    assert [(r.at, r.id) for r in numbered.orderBy("at").collect()] == [(1, 11), (2, 12), (6, 13), (9, 14), (20, 15)]


def test_types_are_checked(spark):
    df = spark.createDataFrame([("FEE",), ("X",)], "t string")
    assert R.of_type(df, "t", " fee ").count() == 1 and R.of_type(df, "t", None).count() == 2
    with pytest.raises(ValueError):
        R.of_type(df, "t", "FEE' OR 1=1")


def test_immutable_rows(spark):
    old = spark.createDataFrame([(1, "S", 1), (2, "S", 2), (3, "P", 3), (4, "S", None)], "id long, status string, v long")
    new = spark.createDataFrame([(1, "S", 1), (3, "P", 9), (4, "S", 5)], "id long, status string, v long")
    assert rows(R.immutability_violations(old, new, "id", "status = 'S'", ["v"])) == [(2, "deleted"), (4, "changed")]


def test_differences(spark):
    schema = "case long, path string, value string"
    base = spark.createDataFrame([(1, "fee", "0.53"), (1, "n", "60"), (1, "id", "7"), (1, "createdAt", '"x"'), (1, "gone", "1"), (1, "nul", "null"), (2, "a", "1"), (3, "a", "1")], schema)
    probe = spark.createDataFrame([(1, "fee", "0.53"), (1, "id", "8")], schema)
    cand = spark.createDataFrame([(1, "fee", "0.54"), (1, "n", '"60.0000"'), (1, "id", "9"), (1, "createdAt", '"y"'), (1, "nul", "null"), (1, "more", "1"), (3, "a", "1.0")], schema)
    compared = D.compare(base, probe, cand, ["case"])
    assert {r.path: r.difference for r in compared.where("case = 1").collect()} == {"fee": "precision", "n": "type-difference", "id": None, "createdAt": None, "gone": "missing-field", "nul": None}
    cases = spark.createDataFrame([(1, "passing-against-legacy", True, "completed"), (2, "passing-against-legacy", True, None), (3, "passing-against-legacy", True, "completed")], "case long, status string, holds boolean, execution string")
    outcomes = D.case_outcomes(compared, cases, ["case"])
    assert rows(outcomes.drop("reason")) == [(1, "divergent", 3, "MAJOR"), (2, "inconclusive", 0, None), (3, "equal", 0, None)]
    assert D.verdict(outcomes).first().verdict == "NOT_EQUIVALENT"
    assert D.verdict(outcomes.where("case > 1")).first().verdict == "INCONCLUSIVE"
    assert D.verdict(outcomes.where("case = 3")).first().verdict == "EQUIVALENT"
    assert D.verdict(outcomes.where("false")).first().confidence == 0.0
    with pytest.raises(Exception, match="unknown case"):
        D.case_outcomes(compared, cases, ["case"], spark.createDataFrame([(9,)], "case long")).collect()


def test_quality(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id long, v string")
    assert rows(Q.violations(df, "id", {"required": F.col("v").isNull(), "short": F.length("v") < 2})) == [(1, "required"), (2, "short")]
    assert rows(Q.acceptance(spark, {"all": Q.all_where(df.where("false"), F.col("v") == "x"), "none": Q.none_where(df, F.col("v").isNull())})) == [("all", True), ("none", False)]


def test_containment_pairs_against_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    texts = []
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(40)]
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            for _ in range(rnd.randrange(6)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(copy[: rnd.choice([40, 30, 22])])
    bodies = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "a b"), (903, " ".join(texts[0]))]
    members, pairs = contained_pairs(spark.createDataFrame(bodies, "id long, text string"))
    sets = {i: {(a, b) for a, b in zip(t, t[1:])} for i, t in enumerate(texts)}
    rep = {}
    for i in sorted(sets):
        rep.setdefault(frozenset(sets[i]), i)
    reps = {r: set(s) for s, r in rep.items() if len(s) >= 10}
    want = {(a, b) for a in reps for b in reps if a < b and min(len(reps[a]), len(reps[b])) * 5 >= 3 * max(len(reps[a]), len(reps[b])) and 4 * len(reps[a] & reps[b]) >= 3 * min(len(reps[a]), len(reps[b]))}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
    assert {r.id: r.rep for r in members.collect()}[903] == rep[frozenset(sets[0])]


def test_statement_splitter():
    sql = "-- lead\nSELECT ';' FROM t; /* a;b */ CREATE FUNCTION f() RETURNS int AS $x$ BEGIN; END; $x$ LANGUAGE plpgsql;\n\n\nDROP TABLE \"a;b\""
    got = E.split_statements(sql)
    assert [(n, line) for n, line, _ in got] == [(0, 2), (1, 2), (2, 5)]
    assert E.split_statements("") == E.split_statements("  -- only a comment\n") == []
    assert E.split_statements("SELECT 'open")[0][2] == "SELECT 'open"


def test_schema_objects_and_outlines():
    objs = E.ddl_objects("CREATE TABLE IF NOT EXISTS a (id BIGINT PRIMARY KEY, amt NUMERIC(18,4) NOT NULL, memo TEXT, CONSTRAINT c CHECK (amt > 0));\nCREATE UNIQUE INDEX i ON a (id);")
    assert [(o[0], o[1], o[3], o[5], o[6]) for o in objs] == [("table", "a", "id", False, None), ("table", "a", "amt", False, 18), ("table", "a", "memo", True, None), ("index", "i", None, None, None)]
    src = 'class A {\n  // void no() {\n  public static List<String> go(int a) throws X {\n    String s = "}";\n    if (a > 1) { return null; }\n  }\n  A() {}\n}\n'
    assert [(m.name, m.type, " ".join(m.modifiers), m.line, m.end_line) for m in J.analyse(src).of("method")] == [("go", "List<String>", "public static", 3, 6)]
    facts = C.java_facts('@RestController\n@RequestMapping("/api")\nclass C {\n @GetMapping("/x/{id}")\n void a() {}\n @PostMapping\n void b() {}\n}')
    assert [(f[1], f[2]) for f in facts if f[0] == "route"] == [("GET /api/x/{id}", "C#a"), ("POST /api", "C#b")]
    assert E.settings("a.properties", "# c\na.b = 1\ndb.password: x\n") == [("a.b", "1", False), ("db.password", None, True)]
    assert E.settings("a.yml", "a:\n  b: 1\n  c:\n    token: t\nd: 'x'\n") == [("a.b", "1", False), ("a.c.token", None, True), ("d", "x", False)]


def test_quote_anchoring():
    text = "alpha beta\nthe fee is rounded half up\nto two decimal places\nend"
    assert E.anchor(text, "The fee is rounded half-up\nto two decimals places")[0][:2] == (2, 3)
    assert E.anchor("", "x") == E.anchor("abc", "") == []
    assert E.fuzzy_overlap(["decimals"], ["decimal"]) == 1.0 and E.fuzzy_overlap([], ["a"]) == 0.0


def test_gateway_refuses_writes(spark):
    for sql in ("DROP TABLE x", "SELECT 1; SELECT 2", "WITH a AS (DELETE FROM t RETURNING *) SELECT * FROM a", "", "INSERT INTO t VALUES (1)"):
        with pytest.raises(gateway.NotReadOnly):
            gateway.require_read_only(sql)
    gateway.require_read_only("SELECT 'drop; table' AS x -- delete\n;")
    page = gateway.run(spark, "SELECT id FROM range(10)", max_rows=3)
    assert page.truncated and page.rows.count() == 3
    assert not gateway.run(spark, "SELECT id FROM range(3)", max_rows=3).truncated


def test_declarations():
    assert E.dependencies("a/package.json", '{"dependencies": {"zod": "^3"}, "devDependencies": {"vitest": "1"}}') == [("zod", "^3", "runtime"), ("vitest", "1", "dev")]
    assert E.dependencies("pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency>") == [("g:a", "1", "compile")]
    assert E.dependencies("requirements.txt", "numpy==1.2\nregex\n") == [("numpy", "1.2", "runtime"), ("regex", None, "runtime")]
    assert E.scheduled_jobs('@Scheduled(cron = "0 0 * * *")\nvoid a() {}\n@Scheduled(fixedRate=5)') == [("cron", "0 0 * * *", 1), ("fixedRate", "5", 3)]
    assert E.json_in_prose('text {not json} then {"b": [1], "a": "}"} end') == [('{"a": "}", "b": [1]}',)]
    assert E.json_in_prose("none") == [] and E.json_in_prose("```json\n[1]\n```") == [("[1]",)]
    assert E.imports("package a.b;\nimport c.D;\nimport static e.F.*;\n// class X\nclass Y {}") == [("a.b.Y", "c.D"), ("a.b.Y", "e.F.*")]
    src = 'x = "a // b"; /* c\n d */ y'
    assert len(E.masked(src)) == len(src) and E.masked(src).split() == ["x", "=", ";", "y"]


def test_first_wins_takes_the_second_list_too_and_stops_at_its_bound(spark, sf):
    from tidemark.queries import more

    a, b = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string"), spark.createDataFrame([(2, "b"), (3, "c")], "id long, name string")
    assert rows(more.first_wins(a, b)) == [(1, "a"), (2, None), (3, "c")]
    got = more.ordered_union_first_wins(spark, sf)
    assert got.count() == 200 and got.where("id >= 150").count() > 0


def test_quotes_wrapped_over_other_line_ends_are_anchored():
    text = "alpha beta\nthe fee for a transfer is\nrounded half up to two\ndecimal places here\nend of it"
    quote = "the fee for a\ntransfer is rounded half\nup to two decimal\nplaces here"
    assert E.anchor(text, quote) == [(2, 4, 1.0)]
    assert E.anchor(text, "the fee for a transfer is rounded half up to two decimal places here") == [(2, 4, 1.0)]
    assert E.anchor(text, "decimal places here") == [(4, 4, 1.0)]
    assert E.anchor("a b c\n\nd", "a b c") == [(1, 1, 1.0)]
    words = ["fee", "transfers", "transfer", "half", "up", "end"]
    rnd = random.Random(3)
    for _ in range(200):  # the bound leaves nothing out
        lines, q = [[rnd.choice(words) for _ in range(rnd.randrange(4))] for _ in range(8)], [rnd.choice(words) for _ in range(rnd.randrange(1, 8))]
        scores = [E.fuzzy_overlap(q, sum(lines[i:j], [])) for i in range(8) for j in range(i + 2, min(i + 5, 8) + 1) if lines[i] and lines[j - 1]]
        found = E.best_window(q, lines, 0.6)
        assert (found[2] if found else None) == (max(scores) if max(scores, default=0) >= 0.6 else None)
