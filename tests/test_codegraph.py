"""The dependency graph, findings and structure of a small repository, worked out by hand."""

import pytest

from tidemark.functions import javasource as J
from tidemark.operators import codegraph as C

FILES = {
    "src/AccountController.java": '''package app.web;
import app.core.TransferService;
@RestController
@RequestMapping("/api")
public class AccountController extends Base {
  private final TransferService service;
  private static int hits;
  @GetMapping("/accounts/{id}")
  public String one(long id) { hits++; service.load(id); return audit.toString(); }
  @PostMapping(value = "/transfers", produces = "application/json")
  @PreAuthorize("x")
  public String send(Transfer t) { TransferService s = pick(); s.book(t); return helper(); }
  private String helper() { return "helper("; }
  private String unused() { return null; }
}
''',
    "src/TransferService.java": '''package app.core;
public class TransferService implements Loader {
  private AccountRepository accounts;
  public void book(Transfer t) {
    try { jdbc.update("UPDATE ledger SET a = 1 WHERE id = 2"); jdbc.query("SELECT a FROM ledger JOIN accounts ON x"); } catch (Exception e) { log.warn("x"); }
    accounts.saveAll(t);
    accounts.findById(1);
  }
  @Scheduled(cron = "0 0 * * *")
  public void nightly() { if (System.currentTimeMillis() > 4500) { retry(); this.store.insert("a"); } }
  @SuppressWarnings("unchecked")
  List<String> cast(Object o) { return (List<String>) o; }
  @Transactional(propagation = Propagation.REQUIRES_NEW)
  public int size() { return this.size; }
  public static void main(String[] args) { }
}
''',
    "src/Loader.java": "package app.core;\npublic interface Loader { default void load(long id) { } }\n",
    "src/Base.java": "package app.web;\nclass Base { } // TODO remove\n",
    "src/AccountRepository.java": "package app.core;\ninterface AccountRepository extends JpaRepository<Account, Long> { long countByName(String n); }\n",
    "src/Account.java": 'package app.core;\n@Table(name = "accounts")\nclass Account { String getName() { return this.name; } }\n',
    "db/V1.sql": "CREATE TABLE accounts (id BIGINT);\nCREATE TRIGGER audit_accounts AFTER UPDATE ON accounts FOR EACH ROW EXECUTE FUNCTION f();\nCREATE FUNCTION f() RETURNS int AS $$ SELECT 1 $$ LANGUAGE sql;",
    "cut.java": "package app; class Cut { void open(",
}
M = "method:app.core.TransferService#"


@pytest.fixture(scope="module")
def known(spark):
    rows = [("r", i, p, t, "clash") for i, (p, t) in enumerate(FILES.items())] + [("r", 90, "x.java", None, ""), (None, 91, "y.java", "class Y { private void p() { } }", ""), ("r", None, "z.java", "class Z {}", ""), ("r", 92, None, "class Z {}", "")]
    return C.facts(spark.createDataFrame(rows, "repository string, file_id long, file_path string, file_content string, line string"))


def test_edges(known):
    got = {(r.src, r.dst, r.kind) for r in C.edges(known).where("repository = 'r'").collect()}
    web = "method:app.web.AccountController#"
    assert got == {
        ("class:app.web.AccountController", "class:app.core.TransferService", "imports"),
        ("class:app.web.AccountController", "class:app.web.Base", "extends"), ("class:app.core.TransferService", "class:app.core.Loader", "extends"),
        (web + "one", "method:app.core.Loader#load", "calls"), (web + "send", M + "book", "calls"),
        (M + "book", "method:app.core.AccountRepository#saveAll", "calls"), (M + "book", "method:app.core.AccountRepository#findById", "calls"),
        ("method:app.core.AccountRepository#saveAll", "table:accounts", "writes"), ("method:app.core.AccountRepository#findById", "table:accounts", "reads"), ("method:app.core.AccountRepository#countByName", "table:accounts", "reads"),
        (M + "book", "table:ledger", "writes"), (M + "book", "table:accounts", "reads"), (M + "book", "table:x", "reads"),
        ("trigger:audit_accounts", "table:accounts", "triggers"),
        ("endpoint:GET /api/accounts/{id}", web + "one", "http"), ("endpoint:POST /api/transfers", web + "send", "http"),
    }


def test_nodes(known):
    kinds = {r.id: r.kind for r in C.nodes(known, C.edges(known)).where("repository = 'r'").collect()}
    assert kinds["class:app.core.Account"] == "class" and kinds["table:ledger"] == "table" and kinds["endpoint:GET /api/accounts/{id}"] == "endpoint" and kinds["function:f"] == kinds[M + "size"] == "function"
    assert len(kinds) == len(set(kinds))


def test_findings(known):
    got = {(r.category, r.name, r.detail) for r in C.findings(known).where("repository = 'r'").collect()}
    assert got == {
        ("static-mutable-state", "hits", "int"), ("authorization-gap", "one", "1"), ("dead-code", "unused", None), ("swallowed-exception", None, "only logs"), ("time-dependence", "nightly", None),
        ("retry-without-idempotency", "nightly", None), ("unchecked-cast", "cast", None), ("transaction-boundary-anomaly", "size", "REQUIRES_NEW"), ("magic-number", "nightly", "4500"),
        ("misleading-comment", None, "// TODO remove"), ("db-side-behavior", "audit_accounts", "trigger"), ("db-side-behavior", "f", "function")}
    assert [r.name for r in C.findings(known).where("repository = ''").collect()] == ["p"]


def test_entries_and_accessors(known):
    assert {(r.name, r.other) for r in known.where("fact = 'entry'").collect()} == {("app.core.TransferService#main", "startup"), ("TransferService#nightly", "scheduled cron: 0 0 * * *")}
    assert {(r.type, r.name) for r in C.methods_of(known).where("accessor").collect()} == {("app.core.TransferService", "size"), ("app.core.Account", "getName"), ("app.web.AccountController", "unused")}


def test_a_name_of_several_types_is_resolved_by_file_then_import(spark):
    rows = [("r", 1, "A.java", "package a; class X { } class U extends X { }"), ("r", 2, "B.java", "package b; class X { }"), ("r", 3, "C.java", "package c;\nimport b.X;\nclass V extends X { }"), ("r", 4, "D.java", "package d; class W extends X { }")]
    f = C.facts(spark.createDataFrame(rows, "repository string, file_id long, file_path string, file_content string"))
    assert {(r.src, r.dst) for r in C.edges(f).where("kind = 'extends'").collect()} == {("class:a.U", "class:a.X"), ("class:c.V", "class:b.X")}


def test_empty(spark):
    f = C.facts(spark.createDataFrame([], "repository string, file_id long, file_path string, file_content string"))
    assert C.edges(f).count() == C.findings(f).count() == C.nodes(f, C.edges(f)).count() == 0


def test_structure():
    f = J.analyse('package p;\nimport a.B;\nimport static c.D.*;\nclass A<T extends C> extends B<T> implements I<K, V>, J {\n  int x = 1, y;\n  A(int q) { }\n  <R> Map<String, R> m(int... a) throws E { return "a { b" + \'{\'; }\n  enum E { ONE(1) { void z() { } }, TWO; void k() { } }\n}\n')
    assert (f.package, f.imports, f.static_imports, [t for _, t in f.literals]) == ("p", ["a.B"], ["c.D.*"], ["a { b"])
    assert [(m.what, m.name, m.owner, m.type, m.line, m.end_line) for m in f.members] == [
        ("class", "A", None, "", 4, 9), ("field", "x", "A", "int", 5, 5), ("constructor", "A", "A", "A", 6, 6), ("method", "m", "A", "Map<String, R>", 7, 7), ("enum", "E", "A", "", 8, 8), ("method", "k", "E", "void", 8, 8)]
    assert f.members[0].extends == ["B<T>"] and f.members[0].implements == ["I<K, V>", "J"]
    assert J.signals(f)["cyclomatic"] == 1 and J.analyse("").members == []
    assert len(J.analyse("class A { " * 2000).members) == 2000
