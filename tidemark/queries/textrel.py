"""Queries that draw relations from source texts and join them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import table
from ..operators import extract as E
from ..operators import quotes as Q
from ..operators.components import connected_components
from ..operators.similarity import bigrams, contained_pairs
from .registry import query

_LEAD = r"'^(?:\s+|--[^\n]*(?:\n|$)|/\*(?:[^*]|\*+[^*/])*\*+/)+'"


def statements(spark, sf):
    return table(spark, sf, "sql_statements")


@query(f"""SELECT statement_id, CASE WHEN starts_with(b, 'create') THEN CASE WHEN regexp_matches(b, '\\btrigger\\b') THEN 'trigger' WHEN regexp_matches(b, '\\bfunction\\b') THEN 'function' WHEN regexp_matches(b, '\\bprocedure\\b') THEN 'procedure' ELSE 'ddl' END
  WHEN regexp_matches(b, '^(select|with)') THEN 'select' WHEN regexp_matches(b, '^insert') THEN 'insert' WHEN regexp_matches(b, '^(update|merge)') THEN 'update' WHEN regexp_matches(b, '^delete') THEN 'delete' WHEN regexp_matches(b, '^(alter|drop|truncate)') THEN 'ddl' ELSE 'unknown' END AS kind
  FROM (SELECT statement_id, lower(regexp_replace(raw_text, {_LEAD}, '')) AS b FROM sql_statements WHERE raw_text IS NOT NULL)""")
def statement_verbs(spark, sf):
    return statements(spark, sf).where("raw_text is not null").select("statement_id", E.verb_of(F.col("raw_text")).alias("kind"))


@query("""WITH w AS (SELECT statement_id, list_concat(regexp_extract_all(raw_text, '(?i)\\bFROM\\s+([A-Za-z_][\\w$.]*)', 1), regexp_extract_all(raw_text, '(?i)\\bJOIN\\s+([A-Za-z_][\\w$.]*)', 1), regexp_extract_all(raw_text, '(?i)\\bINTO\\s+([A-Za-z_][\\w$.]*)', 1),
  regexp_extract_all(raw_text, '(?i)\\bUPDATE\\s+([A-Za-z_][\\w$.]*)', 1), regexp_extract_all(raw_text, '(?i)\\bTABLE(?:\\s+IF\\s+(?:NOT\\s+)?EXISTS)?\\s+([A-Za-z_][\\w$.]*)', 1), regexp_extract_all(raw_text, '(?i)\\bON\\s+([A-Za-z_][\\w$.]*)', 1)) AS t FROM sql_statements WHERE raw_text IS NOT NULL)
  SELECT statement_id, array_to_string(list_sort(list_distinct(list_filter(t, lambda x: upper(x) NOT IN ('SELECT', 'UNNEST', 'GENERATE_SERIES', 'LATERAL', 'DUAL', 'ONLY', 'OF', 'SET', 'WHERE')))), ',') AS tables FROM w""")
def statement_tables(spark, sf):
    return statements(spark, sf).where("raw_text is not null").select("statement_id", F.array_join(E.tables_of(F.col("raw_text")), ",").alias("tables"))


@query("""SELECT statement_id, regexp_matches(s, '\\b(ROUND|TRUNC|NUMERIC)\\s*\\(|\\bCAST\\s*\\([^)]*\\bAS\\b[^)]*(NUMERIC|DECIMAL)') AS rounding, regexp_matches(s, '\\bORDER\\s+BY\\b') AS ordering, regexp_matches(s, '\\b(COUNT|SUM|AVG|MIN|MAX)\\s*\\(') AS aggregate, regexp_matches(raw_text, '\\|\\||\\bCONCAT\\s*\\(') AS concat,
  regexp_matches(s, '\\b(BEGIN|COMMIT|ROLLBACK|START\\s+TRANSACTION|SAVEPOINT)\\b') AS transaction FROM (SELECT statement_id, raw_text, upper(raw_text) AS s FROM sql_statements WHERE raw_text IS NOT NULL)""")
def statement_signals(spark, sf):
    return statements(spark, sf).where("raw_text is not null").select("statement_id", *(c.alias(n) for n, c in E.sql_signals(F.col("raw_text")).items()))


@query("""SELECT span_id FROM (SELECT span_id, upper(trim(literal_value)) AS s FROM source_spans) WHERE length(s) >= 12 AND regexp_matches(s, '^(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|WITH|MERGE|TRUNCATE)\\b') AND regexp_matches(s, '\\b(FROM|INTO|SET|VALUES|TABLE|INDEX|VIEW|TRIGGER|FUNCTION|PROCEDURE|WHERE|SELECT)\\b')""")
def literals_that_look_like_sql(spark, sf):
    return table(spark, sf, "source_spans").where(E.looks_like_sql(F.col("literal_value"))).select("span_id")


@query("""SELECT method_id, CASE WHEN regexp_matches(body, 'nativeQuery\\s*=\\s*true') THEN 'native-query' WHEN regexp_matches(body, '\\bjdbc\\w*\\.\\w+\\(') THEN 'jdbc-template' WHEN regexp_matches(body, '(?i)"\\s*(select|insert|update|delete)\\b') THEN 'raw-sql' WHEN regexp_matches(body, '\\w*[rR]epository\\d*\\.\\w+\\(') THEN 'orm' ELSE 'none' END AS mechanism FROM java_methods WHERE body IS NOT NULL""")
def database_access(spark, sf):
    return table(spark, sf, "java_methods").where("body is not null").select("method_id", E.access_mechanism(F.col("body")).alias("mechanism"))


@query()
def external_dependencies(spark, sf):
    """Other systems that masked Java uses, with the first eight files of each, and those that settings name by address, with the first four: bounds of the report."""
    files = table(spark, sf, "model_files")
    java = files.where(F.lower("file_path").endswith(".java"))
    uses = E.extracted(java, "file_id", ["file_content"], E.external_uses, "name string, kind string, nondeterministic boolean, line bigint").withColumn("key", F.lit(None).cast("string")).withColumn("most", F.lit(8))
    value = F.coalesce("value", F.lit(""))
    named = configuration_settings(spark, sf).withColumn("name", F.when(value.rlike("^jdbc:"), "jdbc-url").when(value.rlike("^https?://") & ~value.rlike(r"localhost|127\.0\.0\.1"), "external-http-service")).where("name is not null")
    named = named.select("file_id", "name", F.when(F.col("name") == "jdbc-url", "database").otherwise("network").alias("kind"), (F.col("name") != "jdbc-url").alias("nondeterministic"), F.lit(None).cast("bigint").alias("line"), "key", F.lit(4).alias("most"))
    rows = uses.unionByName(named).withColumn("rn", F.row_number().over(W.partitionBy("name").orderBy("file_id", "key")))
    return rows.where("rn <= most").drop("rn", "most")


@query()
def script_statements(spark, sf):
    files = table(spark, sf, "model_files").where(F.lower("file_path").endswith(".sql"))
    return E.extracted(files, "file_id", ["file_content"], E.split_statements, "number bigint, line bigint, statement string")


@query()
def schema_objects(spark, sf):
    files = table(spark, sf, "model_files").where(F.lower("file_path").endswith(".sql"))
    return E.extracted(files, "file_id", ["file_content"], E.ddl_objects, "kind string, name string, line bigint, column string, type string, nullable boolean, precision bigint")


@query()
def configuration_settings(spark, sf):
    files = table(spark, sf, "model_files").where(F.lower("file_path").rlike(r"\.(properties|ini|ya?ml)$"))
    return E.extracted(files, "file_id", ["file_path", "file_content"], E.settings, "key string, value string, secret boolean")


@query("""WITH t AS (SELECT method_id, regexp_extract_all(regexp_replace(regexp_replace(body, '"(?:[^"\\\\\n]|\\\\.)*"', ' STR ', 'g'), '\\b\\d+(?:\\.\\d+)?\\b', ' NUM ', 'g'), '[A-Za-z_$][\\w$]*|[^\\sA-Za-z_$]') AS t FROM java_methods WHERE body IS NOT NULL)
  SELECT method_id, len(list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS pairs FROM t""")
def token_bigrams(spark, sf):
    return table(spark, sf, "java_methods").where("body is not null").select("method_id", F.size(bigrams(F.col("body"))).alias("pairs"))


_SIM = """t AS (SELECT method_id AS id, regexp_extract_all(regexp_replace(regexp_replace(normalized_body, '"(?:[^"\\\\\n]|\\\\.)*"', ' STR ', 'g'), '\\b\\d+(?:\\.\\d+)?\\b', ' NUM ', 'g'), '[A-Za-z_$][\\w$]*|[^\\sA-Za-z_$]') AS t FROM java_methods WHERE normalized_body IS NOT NULL),
  g AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS g FROM t), k AS (SELECT min(id) AS id, g, len(g) AS n FROM g WHERE len(g) >= 10 GROUP BY g),
  pairs AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g)) AS common, a.n AS size_a, b.n AS size_b FROM k a JOIN k b ON a.id < b.id AND 5 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)),
  sim AS (SELECT * FROM pairs WHERE 4 * common >= 3 * least(size_a, size_b))"""


@query(f"WITH {_SIM} SELECT * FROM sim")
def duplicated_calculations(spark, sf):
    """Pairs of representatives of equal bodies; membership is in duplicated_calculation_groups."""
    bodies = table(spark, sf, "java_methods").select(F.col("method_id").alias("id"), F.col("normalized_body").alias("text"))
    return contained_pairs(bodies)[1]


@query()
def duplicated_calculation_groups(spark, sf):
    """One row per method: its class of equal bodies, linked group, links and mean similarity of its class."""
    bodies = table(spark, sf, "java_methods").select(F.col("method_id").alias("id"), F.col("normalized_body").alias("text"))
    members, pairs = contained_pairs(bodies)
    groups = connected_components(pairs, "a", "b").withColumnRenamed("id", "rep")
    score = F.col("common") / F.least("size_a", "size_b")
    ends = pairs.select(F.col("a").alias("rep"), score.alias("score")).unionByName(pairs.select(F.col("b").alias("rep"), score.alias("score")))
    links = ends.groupBy("rep").agg(F.count("*").alias("links"), F.round(F.avg("score"), 3).alias("similarity"))
    return members.join(links, "rep", "left").join(groups, "rep", "left").select("id", "rep", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), "similarity")


def range_join(points, spans, key, at, lo, hi, width: int = 32):
    """Points within spans of the same key, by an equi-join on cells of ``width`` that a span covers."""
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return points.withColumn("_cell", F.floor(F.col(at) / width)).join(cells, [key, "_cell"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("_cell")


@query("""SELECT declaring_type, CASE WHEN count(DISTINCT relative_path) = 1 THEN min(relative_path) END AS resolved FROM java_methods WHERE declaring_type IS NOT NULL GROUP BY declaring_type""")
def unambiguous_types(spark, sf):
    m = table(spark, sf, "java_methods").where("declaring_type is not null")
    return m.groupBy("declaring_type").agg(F.when(F.count_distinct("relative_path") == 1, F.min("relative_path")).alias("resolved"))


@query("SELECT span_id FROM source_spans ANTI JOIN (SELECT file_id FROM model_files WHERE lang_hint = 'java') f USING (file_id)")
def dangling_references(spark, sf):
    return table(spark, sf, "source_spans").join(table(spark, sf, "model_files").where("lang_hint = 'java'").select("file_id"), "file_id", "left_anti").select("span_id")


_TEMPLATES = ("/api/accounts/{id}/ledger", "/api/accounts/{id}", "/api/transfers/{id}", "/api/{x}/{y}")


@query("""WITH l AS (SELECT log_id, regexp_extract(message, '\\b(?:GET|POST|PUT|DELETE) (/[^ ?]*)', 1) AS path FROM log_records), t(template, pat) AS (VALUES ('/api/accounts/{id}/ledger', '^/api/accounts/[^/]+/ledger$'), ('/api/accounts/{id}', '^/api/accounts/[^/]+$'), ('/api/transfers/{id}', '^/api/transfers/[^/]+$'), ('/api/{x}/{y}', '^/api/[^/]+/[^/]+$'))
  SELECT log_id, template FROM l JOIN t ON regexp_matches(path, pat) WHERE path <> ''""")
def route_template_matches(spark, sf):
    import re

    path = F.regexp_extract("message", r"\b(?:GET|POST|PUT|DELETE) (/[^ ?]*)", 1)
    pats = {t: "^" + re.sub(r"\\\{[^}]*\\\}", "[^/]+", re.escape(t)) + "$" for t in _TEMPLATES}
    hit = F.array_compact(F.array(*(F.when(path.rlike(p), t) for t, p in pats.items())))
    return table(spark, sf, "log_records").where(path != "").select("log_id", F.explode(hit).alias("template"))


@query("""WITH k AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(item_text), '[^a-z]+'), lambda x: length(x) > 9)) AS k FROM eval_items), m AS (SELECT item_id, doc_id, len(list_filter(k, lambda x: contains(lower(text), x))) AS n FROM k JOIN documents ON text IS NOT NULL) SELECT item_id, count(*) FILTER (WHERE n >= 2) AS docs, bool_or(n >= 2) AS found FROM m GROUP BY item_id""")
def keyword_matches(spark, sf):
    """Stated items (a table of fixed size) against all documents: a document counts if it holds two of an item's long words.

    Keywords become one lookup table joined on words, so documents are not paired with items."""
    kw = table(spark, sf, "eval_items").select("item_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("item_text"), "[^a-z]+"), lambda x: F.length(x) > 9))).alias("word"))
    words = kw.select("word").distinct().agg(F.collect_list("word").alias("words"))  # bounded by the fixed table
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.lower("text").alias("low")).withColumn("words", words.scalar())
    held = docs.select("doc_id", F.explode(F.filter("words", lambda w: F.contains(F.col("low"), w))).alias("word"))
    hits = held.join(kw, "word").groupBy("item_id", "doc_id").agg(F.count("*").alias("n")).where("n >= 2").groupBy("item_id").agg(F.count("*").alias("docs"))
    items = table(spark, sf, "eval_items").select("item_id").distinct()
    return items.join(hits, "item_id", "left").select("item_id", F.coalesce("docs", F.lit(0)).alias("docs"), F.col("docs").isNotNull().alias("found"))


@query("""SELECT s.span_id, CASE WHEN f.file_id IS NULL THEN 'file-missing' WHEN s.end_pos > length(f.file_content) THEN 'out-of-range' WHEN substr(f.file_content, CAST(s.start_pos + 1 AS INTEGER), CAST(s.end_pos - s.start_pos AS INTEGER)) = coalesce(s.raw_text, s.comment_text) THEN 'matched'
  WHEN contains(f.file_content, coalesce(s.raw_text, s.comment_text)) THEN 'relocated' ELSE 'drifted' END AS verdict FROM source_spans s LEFT JOIN model_files f ON f.file_id = s.file_id""")
def citation_recheck(spark, sf):
    s = table(spark, sf, "source_spans").select("span_id", F.col("file_id").alias("cited"), "start_pos", "end_pos", F.coalesce("raw_text", "comment_text").alias("quote"))
    f = table(spark, sf, "model_files").select("file_id", "file_content")
    at = F.substr("file_content", (F.col("start_pos") + 1).cast("int"), (F.col("end_pos") - F.col("start_pos")).cast("int"))
    verdict = F.when(F.col("file_id").isNull(), "file-missing").when(F.col("end_pos") > F.length("file_content"), "out-of-range").when(at == F.col("quote"), "matched").when(F.contains("file_content", F.col("quote")), "relocated").otherwise("drifted")
    return s.join(f, F.col("cited") == F.col("file_id"), "left").select("span_id", verdict.alias("verdict"))


@query()
def quotes_anchored(spark, sf):
    """The place of each long comment in its file, found by words alone."""
    s = table(spark, sf, "source_spans").where("comment_text is not null and line_no is not null and span_id is not null")
    quotes = s.groupBy("file_id").agg(F.collect_list(F.struct("span_id", "comment_text")).alias("quotes"))  # bounded by one text
    both = table(spark, sf, "model_files").select("file_id", F.col("file_content").alias("content")).join(quotes, "file_id")
    return E.extracted(both, "file_id", ["content", "quotes"], E.anchors, "span_id bigint, first_line bigint, last_line bigint, score double").drop("file_id")


@query("""SELECT repository, count(*) AS statements, count(*) FILTER (WHERE verb IS NULL) AS unclassified, count(*) FILTER (WHERE writes) AS writing FROM sql_statements GROUP BY repository""")
def repository_statements(spark, sf):
    return statements(spark, sf).groupBy("repository").agg(F.count("*").alias("statements"), F.count_if(F.col("verb").isNull()).alias("unclassified"), F.count_if("writes").alias("writing"))


@query("""WITH u AS (SELECT repository, unnest(tables_used) AS t FROM sql_statements) SELECT repository, array_to_string(list_sort(list(DISTINCT t)), ',') AS stores FROM u GROUP BY repository""")
def stores_by_repository(spark, sf):
    return statements(spark, sf).select("repository", F.explode("tables_used").alias("t")).groupBy("repository").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("stores"))


@query("""SELECT repository, method_name, count(*) AS n, count(DISTINCT relative_path) AS files FROM java_methods WHERE method_name IS NOT NULL GROUP BY repository, method_name HAVING count(*) > 1""")
def colliding_names(spark, sf):
    """Names that are declared more than once in a repository, and in how many files."""
    per = table(spark, sf, "java_methods").where("method_name is not null").groupBy("repository", "method_name").agg(F.count("*").alias("n"), F.count_distinct("relative_path").alias("files"))
    return per.where("n > 1")


@query("""WITH l AS (SELECT file_id, unnest(string_split(file_content, chr(10))) AS line, generate_subscripts(string_split(file_content, chr(10)), 1) AS pos FROM model_files WHERE lower(file_path) LIKE '%.yaml')
  SELECT file_id, pos AS first, array_to_string(list(line) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), '|') AS three FROM l""")
def line_windows(spark, sf):
    lines = table(spark, sf, "model_files").where(F.lower("file_path").endswith(".yaml")).select("file_id", F.posexplode(F.split("file_content", "\n")).alias("pos", "line"))
    w = W.partitionBy("file_id").orderBy("pos").rowsBetween(0, 2)
    return lines.select("file_id", (F.col("pos") + 1).cast("bigint").alias("first"), F.array_join(F.collect_list("line").over(w), "|").alias("three"))


_CATCH = r"\bcatch[ \t]*\([^)]*\)[ \t]*\{\s*\}"
_ONLY_LOGS = r"\bcatch[ \t]*\([^)]*\)[ \t]*\{([^{};]*\b(log(ger)?|LOG|System\.err|System\.out)\b[^{};]*;\s*)+\}"


def _quoted(pattern):
    return "'" + pattern.replace("'", "''") + "'"


@query(rf"""SELECT method_id, unnest(list_filter([CASE WHEN regexp_matches(body, {_quoted(_CATCH)}) OR regexp_matches(body, {_quoted(_ONLY_LOGS)}) THEN 'swallowed-exception' END,
  CASE WHEN regexp_matches(body, {_quoted(E.CLOCKS)}) OR regexp_matches(body, {_quoted(E.SQL_CLOCKS)}) THEN 'time-dependence' END,
  CASE WHEN regexp_matches(body, {_quoted(E.TRANSACTIONS)}) THEN 'transaction-boundary-anomaly' END,
  CASE WHEN regexp_matches(body, '(?i)retry|retries|attempt') AND regexp_matches(body, {_quoted(E.WRITES)}) AND NOT regexp_matches(body, {_quoted(E.REPEATABLE)}) THEN 'retry-without-idempotency' END,
  CASE WHEN len(list_filter(regexp_extract_all(regexp_replace(body, '"(?:[^"\\\n]|\\.)*"', '""', 'g'), '(?:[<>=!]=?|\+|-|\*|/|%|return)[ \t]*(-?\d+(?:\.\d+)?)', 1), lambda n: n NOT IN ('0', '1', '2', '-1', '10', '0.0', '1.0'))) > 0 THEN 'magic-number' END,
  CASE WHEN len(list_filter(regexp_extract_all(body, '(//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/)', 1), lambda c: regexp_matches(c, {_quoted(E.UNFINISHED)}))) > 0 THEN 'misleading-comment' END], lambda x: x IS NOT NULL)) AS finding FROM java_methods""")
def suspicious_code(spark, sf):
    """The detectors that need a method's body alone; those that need the file or the repository are in code_findings."""
    return table(spark, sf, "java_methods").where("body is not null").select("method_id", F.explode(E.suspicious(F.col("body"))).alias("finding"))


@query("""SELECT c.span_id AS comment, l.span_id AS literal FROM source_spans c JOIN source_spans l ON l.file_id = c.file_id AND l.origin = 'literal' AND c.line_no BETWEEN l.line_no AND l.line_no + 20 WHERE c.origin = 'comment'""")
def range_join_lines(spark, sf):
    """Comments on the twenty lines from a literal of the same file on."""
    s = table(spark, sf, "source_spans")
    points = s.where("origin = 'comment'").select("file_id", F.col("span_id").alias("comment"), F.col("line_no").alias("at"))
    spans = s.where("origin = 'literal'").select("file_id", F.col("span_id").alias("literal"), F.col("line_no").alias("lo"), (F.col("line_no") + 20).alias("hi"))
    return range_join(points, spans, "file_id", "at", "lo", "hi").select("comment", "literal")


@query(f"""WITH q AS (SELECT DISTINCT file_id, x AS quote FROM (SELECT file_id, trim(regexp_replace(unnest([literal_value, comment_text]), '[ \t\n\r\f]+', ' ', 'g')) AS x FROM source_spans) WHERE length(x) >= {Q.SHORTEST}), d AS (SELECT DISTINCT quote FROM q),
  h AS (SELECT quote, m.file_id AS other FROM d JOIN (SELECT file_id, regexp_replace(file_content, '[ \t\n\r\f]+', ' ', 'g') AS c FROM model_files) m ON contains(m.c, quote)), r AS (SELECT q.file_id, q.quote, other, row_number() OVER (PARTITION BY q.file_id, q.quote ORDER BY other) AS rn FROM q JOIN h ON h.quote = q.quote AND other <> q.file_id) SELECT file_id, quote, other FROM r WHERE rn <= 3""")
def quotes_found_elsewhere(spark, sf):
    """Up to three other files that hold the text of a literal or comment anywhere, white space aside; three is the bound of the hint."""
    plain = lambda c: F.regexp_replace(c, r"[ \t\n\r\f]+", " ")
    s = table(spark, sf, "source_spans").select("file_id", F.explode(F.array("literal_value", "comment_text")).alias("quote")).where("quote is not null")
    return Q.held_elsewhere(s.withColumn("quote", F.trim(plain("quote"))), table(spark, sf, "model_files").select("file_id", plain("file_content").alias("content")))
