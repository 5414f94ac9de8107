"""Queries over event logs, log records, commands and other operational tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import table
from ..functions import files as C
from ..functions import text as T
from ..operators import relational as R
from .registry import query


def logs(spark, sf):
    return table(spark, sf, "log_records")


@query("""WITH x AS (SELECT run_id, log_id, minute(logged_at) AS seq FROM log_records WHERE run_id IS NOT NULL),
  f AS (SELECT *, CASE WHEN seq > lag(seq) OVER (PARTITION BY run_id ORDER BY log_id) THEN 0 ELSE 1 END AS new FROM x)
  SELECT run_id, log_id, sum(new) OVER (PARTITION BY run_id ORDER BY log_id) AS session FROM f""")
def sessions_by_sequence_reset(spark, sf):
    x = logs(spark, sf).where("run_id is not null").select("run_id", "log_id", F.minute("logged_at").alias("seq"))
    return R.reset_sessions(x, ["run_id"], [F.col("log_id")], "seq").select("run_id", "log_id", "session")


@query("""SELECT run_id, count(*) AS records, strftime(arg_min(logged_at, log_id), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(arg_max(logged_at, log_id), '%Y-%m-%d %H:%M:%S') AS last_at, count(DISTINCT task_id) AS tasks
  FROM log_records WHERE run_id IS NOT NULL GROUP BY run_id""")
def run_summary(spark, sf):
    fmt = "yyyy-MM-dd HH:mm:ss"
    return logs(spark, sf).where("run_id is not null").groupBy("run_id").agg(
        F.count("*").alias("records"), F.date_format(F.min_by("logged_at", "log_id"), fmt).alias("first_at"), F.date_format(F.max_by("logged_at", "log_id"), fmt).alias("last_at"), F.count_distinct("task_id").alias("tasks"))


@query("""WITH c AS (SELECT run_id, component, min(log_id) AS pos FROM log_records WHERE run_id IS NOT NULL AND component IS NOT NULL GROUP BY ALL)
  SELECT run_id, string_agg(component, '>' ORDER BY pos) AS components FROM c GROUP BY run_id""")
def components_in_first_seen_order(spark, sf):
    c = logs(spark, sf).where("run_id is not null and component is not null").groupBy("run_id", "component").agg(F.min("log_id").alias("pos"))
    return c.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "component"))), lambda x: x["component"]), ">").alias("components"))  # bounded by the components


@query("SELECT upper(log_level) AS level, count(*) AS n FROM log_records GROUP BY upper(log_level) ORDER BY n DESC, level")
def level_frequencies(spark, sf):
    return R.frequencies(logs(spark, sf).select(F.upper("log_level").alias("level")), "level")


@query("""WITH s(level, rank) AS (VALUES ('INFO', 0), ('WARN', 1), ('ERROR', 2), ('FATAL', 3)), l AS (SELECT run_id, rank FROM log_records LEFT JOIN s ON level = upper(log_level) WHERE run_id IS NOT NULL)
  SELECT run_id, coalesce((SELECT level FROM s WHERE s.rank = m), 'INFO') AS highest FROM (SELECT run_id, max(rank) AS m FROM l GROUP BY run_id)""")
def highest_level_per_run(spark, sf):
    lv = F.upper("log_level")
    rank = F.when(lv == "FATAL", 3).when(lv == "ERROR", 2).when(lv == "WARN", 1).when(lv == "INFO", 0)
    name = F.element_at(F.array(*(F.lit(x) for x in ("INFO", "WARN", "ERROR", "FATAL"))), F.coalesce(F.max(rank), F.lit(0)) + 1)
    return logs(spark, sf).where("run_id is not null").groupBy("run_id").agg(name.alias("highest"))


@query("""WITH s(level) AS (VALUES ('INFO'), ('WARN'), ('ERROR'), ('FATAL')) SELECT level, count(log_id) AS n FROM s LEFT JOIN log_records ON upper(log_level) = level GROUP BY level""")
def counts_with_zero_levels(spark, sf):
    names = ("INFO", "WARN", "ERROR", "FATAL")
    row = logs(spark, sf).agg(*(F.count_if(F.upper("log_level") == n).alias(n) for n in names))
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.col(n).alias("n")) for n in names))).alias("x")).select("x.*")


@query("SELECT run_id, sum(CAST(regexp_extract(message, 'model call used ([0-9]+) tokens', 1) AS BIGINT)) AS tokens, count(*) AS calls FROM log_records WHERE regexp_matches(message, 'model call used [0-9]+ tokens') GROUP BY run_id")
def token_usage_per_run(spark, sf):
    used = F.regexp_extract("message", r"model call used ([0-9]+) tokens", 1)
    return logs(spark, sf).where(used != "").groupBy("run_id").agg(F.sum(used.cast("bigint")).alias("tokens"), F.count("*").alias("calls"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def event_type_frequency(spark, sf):
    return R.frequencies(table(spark, sf, "events"), "event_type")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type NOT IN ('view', 'click')) AS visible FROM events")
def visible_events(spark, sf):
    return table(spark, sf, "events").agg(F.count("*").alias("total"), F.count_if(~F.col("event_type").isin("view", "click")).alias("visible"))


@query("""SELECT event_id, CASE event_type WHEN 'purchase' THEN 'amount' WHEN 'error' THEN 'code' ELSE 'k' END AS label,
  CASE event_type WHEN 'purchase' THEN CAST(CAST(round(value, 2) AS DECIMAL(18,2)) AS VARCHAR) ELSE json_extract_string(props, '$.k') END AS shown FROM events""")
def fields_by_event_type(spark, sf):
    label = F.when(F.col("event_type") == "purchase", "amount").when(F.col("event_type") == "error", "code").otherwise("k")
    shown = F.when(F.col("event_type") == "purchase", F.round("value", 2).cast("decimal(18,2)").cast("string")).otherwise(F.get_json_object("props", "$.k"))
    return table(spark, sf, "events").select("event_id", label.alias("label"), shown.alias("shown"))


@query("SELECT log_id, CASE WHEN run_id IS NULL THEN 'run_id' WHEN message IS NULL THEN 'message' ELSE 'component' END AS missing FROM log_records WHERE run_id IS NULL OR message IS NULL OR component IS NULL")
def rows_lacking_required_fields(spark, sf):
    missing = F.when(F.col("run_id").isNull(), "run_id").when(F.col("message").isNull(), "message").when(F.col("component").isNull(), "component")
    return logs(spark, sf).select("log_id", missing.alias("missing")).where("missing is not null")


@query("SELECT command, max(command_id) AS last_id, arg_max(exit_code, command_id) AS exit_code, arg_min(cwd, command_id) AS cwd FROM command_results WHERE exit_code IS NOT NULL AND cwd IS NOT NULL GROUP BY command")
def last_value_first_columns(spark, sf):
    c = table(spark, sf, "command_results").where("exit_code is not null and cwd is not null")
    return c.groupBy("command").agg(F.max("command_id").alias("last_id"), F.max_by("exit_code", "command_id").alias("exit_code"), F.min_by("cwd", "command_id").alias("cwd"))


@query("""SELECT run_id, CASE WHEN count(*) FILTER (WHERE exit_code = 0) = count(*) THEN 'SUCCEEDED' WHEN count(*) FILTER (WHERE exit_code = 0) = 0 THEN 'FAILED' ELSE 'PARTIAL' END AS status FROM command_results WHERE run_id IS NOT NULL GROUP BY run_id""")
def status_from_outcomes(spark, sf):
    good, n = F.count_if(F.col("exit_code") == 0), F.count("*")
    return table(spark, sf, "command_results").where("run_id is not null").groupBy("run_id").agg(F.when(good == n, "SUCCEEDED").when(good == 0, "FAILED").otherwise("PARTIAL").alias("status"))


@query("SELECT run_id, coalesce(bool_and(coalesce(exit_code = 0, false)) FILTER (WHERE NOT timed_out), true) AS passed FROM command_results WHERE run_id IS NOT NULL GROUP BY run_id")
def all_hold_but_excused(spark, sf):
    ok = F.bool_and(F.when(~F.col("timed_out"), F.coalesce(F.col("exit_code") == 0, F.lit(False))))
    return table(spark, sf, "command_results").where("run_id is not null").groupBy("run_id").agg(F.coalesce(ok, F.lit(True)).alias("passed"))


@query("""WITH f AS (SELECT run_id, min(command_id) AS stop FROM command_results WHERE exit_code <> 0 GROUP BY run_id)
  SELECT c.run_id, command_id FROM command_results c LEFT JOIN f ON f.run_id = c.run_id WHERE c.run_id IS NOT NULL AND (stop IS NULL OR command_id <= stop)""")
def steps_up_to_first_failure(spark, sf):
    c = table(spark, sf, "command_results").where("run_id is not null")
    stop = c.where("exit_code <> 0").groupBy("run_id").agg(F.min("command_id").alias("stop"))
    return c.join(stop, "run_id", "left").where("stop is null or command_id <= stop").select("run_id", "command_id")


@query("SELECT command_id, greatest(0, (epoch_us(finished_at) - epoch_us(started_at)) // 1000) AS ms FROM command_results WHERE started_at IS NOT NULL AND finished_at IS NOT NULL")
def clamped_durations(spark, sf):
    from ..functions.scalars import elapsed_ms

    c = table(spark, sf, "command_results").where("started_at is not null and finished_at is not null")
    return c.select("command_id", elapsed_ms(F.col("started_at"), F.col("finished_at")).alias("ms"))


@query("SELECT result_id FROM query_results WHERE row_count IS DISTINCT FROM len(result_rows)")
def stored_counts_that_differ(spark, sf):
    return table(spark, sf, "query_results").where(~F.col("row_count").eqNullSafe(F.size("result_rows").cast("bigint"))).select("result_id")


@query("SELECT sum(len(tables_used)) AS uses, sum(len(list_distinct(tables_used))) AS distinct_uses FROM sql_statements")
def nested_list_sizes(spark, sf):
    return table(spark, sf, "sql_statements").agg(F.sum(F.size("tables_used")).alias("uses"), F.sum(F.size(F.array_distinct("tables_used"))).alias("distinct_uses"))


@query("SELECT (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)) AS covered, coalesce((SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)), '') AS uncovered")
def coverage_sets(spark, sf):
    n = R.first_per_key(table(spark, sf, "nation").where("n_nationkey is not null"), ["n_nationkey"], [F.col("n_name")]).agg(F.collect_set("n_nationkey").alias("known"), F.collect_set(F.struct("n_nationkey", "n_name")).alias("pairs")).withColumn("names", F.map_from_entries("pairs"))
    s = table(spark, sf, "supplier").agg(F.collect_set("s_nationkey").alias("seen"))
    named = lambda a: F.array_join(F.array_sort(F.transform(a, lambda k: F.element_at("names", k))), ",")
    return n.withColumn("seen", s.scalar()).select(named(F.array_intersect("known", "seen")).alias("covered"), named(F.array_except("known", "seen")).alias("uncovered"))


@query("SELECT n_name, CAST(coalesce(avg(CAST(s_acctbal AS DECIMAL(18,4))) FILTER (WHERE s_acctbal > 9500), 0) AS DOUBLE) AS mean FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def mean_of_nothing_is_zero(spark, sf):
    s = table(spark, sf, "supplier").where("s_acctbal > 9500").groupBy("s_nationkey").agg((F.sum(F.col("s_acctbal").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("mean"))
    return table(spark, sf, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.coalesce("mean", F.lit(0.0)).alias("mean"))


@query("SELECT CAST(round(100.0 * count(*) FILTER (WHERE found) / count(*), 1) AS DOUBLE) AS recall, count(*) FILTER (WHERE NOT found) AS missed FROM (SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS found FROM customer)")
def recall_over_truth(spark, sf):
    seen = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("found", F.lit(True))
    t = table(spark, sf, "customer").join(seen, "c_custkey", "left").select(F.coalesce("found", F.lit(False)).alias("found"))
    return t.agg(F.round(F.lit(100.0) * F.count_if("found") / F.greatest(F.count("*"), F.lit(1)), 1).alias("recall"), F.count_if(~F.col("found")).alias("missed"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE array_has_all(argv, ['test'])) AS tests FROM command_results WHERE argv IS NOT NULL")
def array_contains_filter(spark, sf):
    return table(spark, sf, "command_results").where("argv is not null").agg(F.count("*").alias("n"), F.count_if(F.array_contains("argv", "test")).alias("tests"))


@query("""WITH e AS (SELECT DISTINCT run_id, task_id FROM log_records WHERE run_id IS NOT NULL AND task_id IS NOT NULL), o AS (SELECT run_id, count(*) AS commands, max(exit_code) AS worst FROM command_results GROUP BY run_id)
  SELECT e.run_id, e.task_id, coalesce(commands, 0) AS commands, CASE WHEN worst IS NULL THEN 'UNKNOWN' WHEN worst = 0 THEN 'OK' ELSE 'BAD' END AS outcome FROM e LEFT JOIN o ON o.run_id = e.run_id""")
def tasks_with_outcome_defaults(spark, sf):
    e = logs(spark, sf).where("run_id is not null and task_id is not null").select("run_id", "task_id").distinct()
    o = table(spark, sf, "command_results").groupBy("run_id").agg(F.count("*").alias("commands"), F.max("exit_code").alias("worst"))
    return e.join(o, "run_id", "left").select("run_id", "task_id", F.coalesce("commands", F.lit(0)).alias("commands"), F.when(F.col("worst").isNull(), "UNKNOWN").when(F.col("worst") == 0, "OK").otherwise("BAD").alias("outcome"))


@query("""WITH a AS (SELECT log_id, component, row_number() OVER (PARTITION BY component ORDER BY log_id) AS rn FROM log_records WHERE component IS NOT NULL AND log_level ILIKE 'error'),
  b AS (SELECT command_id, coalesce(signal_name, cwd) AS k, row_number() OVER (PARTITION BY coalesce(signal_name, cwd) ORDER BY command_id) AS rn FROM command_results)
  SELECT coalesce(component, k) AS part, log_id, command_id FROM a FULL JOIN b ON component = k AND a.rn = b.rn""")
def consuming_one_to_one_join(spark, sf):
    a = logs(spark, sf).where("component is not null and lower(log_level) = 'error'").select("log_id", F.col("component").alias("part"))
    b = table(spark, sf, "command_results").select("command_id", F.coalesce("signal_name", "cwd").alias("part"))
    a = R.with_sequence(a, ["part"], [F.col("log_id")], "rn")
    b = R.with_sequence(b, ["part"], [F.col("command_id")], "rn")
    return a.join(b, ["part", "rn"], "full_outer").select("part", "log_id", "command_id")


@query("SELECT repository, count(*) AS files, sum(n_bytes) AS bytes, string_agg(DISTINCT lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)), ',' ORDER BY lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1))) AS exts FROM model_files GROUP BY repository")
def language_summary(spark, sf):
    ext = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))
    return table(spark, sf, "model_files").groupBy("repository").agg(F.count("*").alias("files"), F.sum("n_bytes").alias("bytes"), F.array_join(F.array_sort(F.collect_set(ext)), ",").alias("exts"))


@query("SELECT regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS files FROM model_files GROUP BY 1")
def folder_counts(spark, sf):
    return table(spark, sf, "model_files").groupBy(F.regexp_extract("file_path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"))


@query("SELECT repository, arg_max(file_id, (n_bytes, -file_id)) AS file_id FROM model_files GROUP BY repository")
def best_row_multi_key(spark, sf):
    best = R.first_per_key(table(spark, sf, "model_files").select("repository", "file_id", "n_bytes"), ["repository"], [F.desc("n_bytes"), F.col("file_id")])
    return best.select("repository", "file_id")


@query("SELECT repository || '-M' || row_number() OVER (PARTITION BY repository ORDER BY file_id) AS label, file_id FROM model_files")
def ordinal_labels(spark, sf):
    rn = F.row_number().over(W.partitionBy("repository").orderBy("file_id"))
    return table(spark, sf, "model_files").select(F.concat("repository", F.lit("-M"), rn.cast("string")).alias("label"), "file_id")


@query("SELECT file_id, file_path FROM model_files WHERE regexp_matches(file_path, '^(?:.*/)?[^/]*\\.(?:java|sql)$') OR regexp_matches(file_path, '^config/(?:fees|ledger)/[^/]*\\.y[^/]*ml$')")
def glob_filter(spark, sf):
    p = F.col("file_path")
    return table(spark, sf, "model_files").where(p.rlike(T.glob_pattern("**/*.{java,sql}")) | p.rlike(T.glob_pattern("config/{fees,ledger}/*.y*ml"))).select("file_id", "file_path")


@query("""WITH f AS (SELECT file_id, file_path AS p, lower(file_path) AS l, regexp_extract(file_path, '([^/]*)$', 1) AS b, CASE WHEN regexp_matches(file_path, '[^/]\\.[^./]+$') THEN lower(regexp_extract(file_path, '(\\.[^./]+)$', 1)) ELSE '' END AS e FROM model_files)
  SELECT file_id, CASE WHEN regexp_matches(p, '(^|/)migrations?(/|$)') OR regexp_matches(b, '^v[0-9]+__') THEN 'migration' WHEN e = '.sql' AND regexp_matches(b, '(?i)schema|seed|ddl') THEN 'schema' WHEN regexp_matches(p, '(^|/)(test|tests|__tests__)(/|$)') OR regexp_matches(b, '\\.(test|spec)\\.[a-z]+$') THEN 'test'
  WHEN e IN ('.md', '.txt') OR b = 'LICENSE' THEN 'documentation' WHEN b IN ('pom.xml', 'build.gradle', 'package.json', 'Makefile') OR e = '.gradle' THEN 'build' WHEN e IN ('.sh', '.bash') OR b IN ('Dockerfile', 'Procfile') THEN 'script'
  WHEN e IN ('.properties', '.yaml', '.yml', '.toml', '.ini', '.env') OR b = 'application.xml' OR contains(l, '/config/') OR ends_with(l, '.conf') THEN 'configuration' WHEN contains(l, '/generated/') OR contains(l, '/target/') OR contains(l, '/build/') THEN 'generated'
  WHEN e IN ('.java', '.ts', '.py', '.js') THEN 'source' WHEN e IN ('.xml', '.json') THEN 'configuration' ELSE 'other' END AS category FROM f""")
def file_categories(spark, sf):
    return table(spark, sf, "model_files").select("file_id", C.category(F.col("file_path")).alias("category"))


@query("""SELECT file_id, CASE lower(regexp_extract(file_path, '(\\.[^./]+)$', 1)) WHEN '.java' THEN 'Java' WHEN '.ts' THEN 'TypeScript' WHEN '.sql' THEN 'SQL' WHEN '.py' THEN 'Python' WHEN '.json' THEN 'JSON' WHEN '.yml' THEN 'YAML' WHEN '.yaml' THEN 'YAML' WHEN '.xml' THEN 'XML' WHEN '.md' THEN 'Markdown' WHEN '.properties' THEN 'Properties' WHEN '.txt' THEN 'Text' END AS language FROM model_files""")
def language_by_extension(spark, sf):
    return table(spark, sf, "model_files").select("file_id", C.language(F.col("file_path")).alias("language"))


@query("SELECT file_id, NOT list_contains(string_split(file_path, '/'), '') AND NOT list_contains(string_split(file_path, '/'), '..') AND NOT list_contains(string_split(file_path, '/'), '.') AS safe, file_path = 'config' OR starts_with(file_path, 'config/') AS inside FROM model_files")
def path_safety(spark, sf):
    return table(spark, sf, "model_files").select("file_id", T.safe_path(F.col("file_path")).alias("safe"), T.inside(F.col("file_path"), "config").alias("inside"))


@query("""WITH l AS (SELECT command_id, unnest(string_split(stdout, chr(10))) AS line, generate_subscripts(string_split(stdout, chr(10)), 1) AS line_no FROM command_results WHERE stdout IS NOT NULL),
  p(label, pat) AS (VALUES ('url', 'https?://[a-z0-9.-]+'), ('sha', '[0-9a-f]{40}'), ('home', '/home/[a-z]+'))
  SELECT command_id, line_no, label, left(regexp_extract(line, pat, 0), 4) || '***' AS masked FROM l JOIN p ON regexp_matches(line, pat)""")
def masked_line_scan(spark, sf):
    lines = table(spark, sf, "command_results").where("stdout is not null").select("command_id", F.posexplode(F.split("stdout", "\n")).alias("pos", "line"))
    pats = {"url": "https?://[a-z0-9.-]+", "sha": "[0-9a-f]{40}", "home": "/home/[a-z]+"}
    hits = F.array(*(F.struct(F.lit(k).alias("label"), F.regexp_extract("line", p, 0).alias("hit")) for k, p in pats.items()))
    out = lines.select("command_id", (F.col("pos") + 1).alias("line_no"), F.explode(F.filter(hits, lambda h: h["hit"] != "")).alias("h"))
    return out.select("command_id", F.col("line_no").cast("bigint").alias("line_no"), "h.label", F.concat(F.substring("h.hit", 1, 4), F.lit("***")).alias("masked"))


@query("""WITH l AS (SELECT file_id, file_path, unnest(string_split(file_content, chr(10))) AS line, generate_subscripts(string_split(file_content, chr(10)), 1) AS line_no FROM model_files),
  m AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS rn FROM l WHERE regexp_matches(line, '\\bTODO\\b')) SELECT file_id, line_no FROM m WHERE rn <= 20""")
def line_grep_capped_per_file(spark, sf):
    """A search by lines, at most 20 of a file, which is the feature's own bound."""
    lines = table(spark, sf, "model_files").select("file_id", F.posexplode(F.split("file_content", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"\bTODO\b"))
    ranked = lines.withColumn("rn", F.row_number().over(W.partitionBy("file_id").orderBy("pos"))).where("rn <= 20")
    return ranked.select("file_id", (F.col("pos") + 1).cast("bigint").alias("line_no"))


_NAMES = ("zebra", "Zebra", "apple", "Apple", "äpfel", "apples", "Öl", "ol", "_x", "10", "9", "a-b", "ab")


@query("SELECT * FROM (VALUES (1, '_x'), (2, '10'), (3, '9'), (4, 'a-b'), (5, 'ab'), (6, 'äpfel'), (7, 'apple'), (8, 'Apple'), (9, 'apples'), (10, 'ol'), (11, 'Öl'), (12, 'zebra'), (13, 'Zebra')) t(place, name)")
def locale_order(spark, sf):
    """Names in the order of a locale, where letters go before case and accents; code units would put Z before a."""
    df = spark.createDataFrame([(n,) for n in _NAMES], "name string")
    return df.select(F.row_number().over(W.orderBy(F.collate("name", "UNICODE"))).alias("place"), "name")


@query("SELECT component, count(*) AS n FROM log_records WHERE component IS NOT NULL GROUP BY component")
def components_in_locale_order(spark, sf):
    """Counted names, sorted as a locale does."""
    return table(spark, sf, "log_records").where("component is not null").groupBy("component").agg(F.count("*").alias("n")).orderBy(F.collate("component", "UNICODE"))
