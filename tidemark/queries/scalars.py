"""Queries over scalar functions: numbers, dates, texts, JSON, arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..common import table
from ..functions import jsons as J
from ..functions import scalars as S
from ..functions import text as T
from .registry import query

c = F.col


@query("SELECT s_suppkey, CAST(floor(CAST(s_acctbal AS DECIMAL(18,4)) + 0.5) AS BIGINT) AS nearest FROM supplier")
def rounding_ties_up(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", S.round_half_up_to_plus(c("s_acctbal").cast("decimal(18,4)")).cast("bigint").alias("nearest"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.85 THEN 'HIGH' WHEN l_discount * 10 >= 0.6 THEN 'MEDIUM' WHEN l_discount * 10 > 0 THEN 'LOW' ELSE 'NONE' END AS band FROM lineitem")
def confidence_bands(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.band(c("l_discount") * 10).alias("band"))


@query("SELECT s_suppkey, CASE WHEN v < 0 THEN '-' ELSE '' END || CAST(abs(v) // 100 AS VARCHAR) || '.' || lpad(CAST(abs(v) % 100 AS VARCHAR), 2, '0') AS shown FROM (SELECT s_suppkey, CAST(floor(s_acctbal) AS BIGINT) AS v FROM supplier)")
def cents_as_text(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", S.cents_text(F.floor("s_acctbal")).alias("shown"))


@query("SELECT doc_id, TRY_CAST(trim(regexp_extract(text, '(-?[0-9]+\\.[0-9]+)', 1)) AS DECIMAL(18,4))::DOUBLE AS dec, CAST(trunc(TRY_CAST(trim(regexp_extract(text, '(-?[0-9]+\\.[0-9]+)', 1)) AS DECIMAL(38,6))) AS BIGINT) AS whole FROM documents WHERE text IS NOT NULL")
def lenient_casts(spark, sf):
    n = F.regexp_extract("text", r"(-?[0-9]+\.[0-9]+)", 1)
    return table(spark, sf, "documents").where("text is not null").select("doc_id", S.lenient_decimal(n).cast("double").alias("dec"), S.lenient_long(n).alias("whole"))


@query("SELECT method_id, len(regexp_extract_all(body, '\\b(?:if|for|while|case|catch)\\b|&&|\\|\\||\\?')) AS branches FROM java_methods WHERE body IS NOT NULL")
def branch_counts(spark, sf):
    return table(spark, sf, "java_methods").where("body is not null").select("method_id", S.branch_count(c("body")).alias("branches"))


@query("""SELECT o_orderkey, strftime(d + CAST(CASE dayofweek(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INTEGER), '%Y-%m-%d') AS next_day, dayofweek(d) IN (0, 6) AS weekend FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def business_days(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(S.next_business_day(d), "yyyy-MM-dd").alias("next_day"), S.is_weekend(d).alias("weekend"))


@query("""SELECT DISTINCT id, strftime(CASE WHEN hour(created_at) >= 17 THEN CAST(created_at AS DATE) + CAST(CASE dayofweek(created_at) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INTEGER) ELSE CAST(created_at AS DATE) END, '%Y-%m-%d') AS value_on,
  date_diff('day', value_date, CAST(created_at AS DATE)) AS late FROM ledger_entries WHERE created_at IS NOT NULL""")
def cut_off_dates(spark, sf):
    led = table(spark, sf, "ledger_entries").where("created_at is not null")
    return led.select("id", F.date_format(S.value_date(c("created_at")), "yyyy-MM-dd").alias("value_on"), F.date_diff(F.to_date("created_at"), c("value_date")).alias("late")).distinct()


@query("SELECT event_id, strftime(ts - INTERVAL 730 DAY, '%Y-%m-%d %H:%M') AS before, strftime(ts + INTERVAL 23 HOUR, '%Y-%m-%d %H:%M') AS after, strftime(ts, '%Y-%m-%d %H:%M') || ' UTC' AS shown FROM events")
def interval_arithmetic(spark, sf):
    f = "yyyy-MM-dd HH:mm"
    return table(spark, sf, "events").select("event_id", F.date_format(F.expr("ts - INTERVAL 730 DAYS"), f).alias("before"), F.date_format(F.expr("ts + INTERVAL 23 HOURS"), f).alias("after"), S.display_utc(c("ts")).alias("shown"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN '  ' ELSE 'n/a' END AS s FROM events)
  SELECT event_id, strftime(CASE WHEN length(trim(s)) = 10 THEN TRY_CAST(trim(s) AS TIMESTAMP) ELSE TRY_CAST(trim(s) AS TIMESTAMP) END, '%Y-%m-%d %H:%M:%S') AS parsed FROM t""")
def day_or_time_parsing(spark, sf):
    m = c("event_id") % 4
    s = F.when(m == 0, F.date_format("ts", "yyyy-MM-dd")).when(m == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(m == 2, "  ").otherwise("n/a")
    return table(spark, sf, "events").select("event_id", F.date_format(S.parse_day_or_time(s), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("SELECT target_name, sum(CASE WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,9})?(Z|[+-][0-9]{2}:[0-9]{2})$') THEN 1 ELSE 0 END) AS instants, count(*) AS n FROM (SELECT target_name, coalesce(json_extract_string(r, '$.createdAt'), json_extract_string(r, '$.created_at'), '') AS v FROM (SELECT target_name, unnest(result_rows) AS r FROM query_results)) GROUP BY target_name")
def instant_validation(spark, sf):
    r = table(spark, sf, "query_results").select("target_name", F.explode("result_rows").alias("r"))
    v = F.coalesce(F.get_json_object("r", "$.createdAt"), F.get_json_object("r", "$.created_at"), F.lit(""))
    return r.groupBy("target_name").agg(F.count_if(S.is_instant(v)).alias("instants"), F.count("*").alias("n"))


@query("SELECT n_nationkey, 'ACCT-' || (1000 + n_nationkey) AS code, CASE WHEN length(n_name) < 10 THEN rpad(n_name, 10, ' ') ELSE n_name END || '|' AS padded, CASE WHEN length(n_name) > 6 THEN left(n_name, 5) || '…' ELSE n_name END AS clipped FROM nation")
def keys_padding_clipping(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("ACCT-"), (1000 + c("n_nationkey")).cast("string")).alias("code"), F.concat(T.pad_right(c("n_name"), 10), F.lit("|")).alias("padded"), T.clip(c("n_name"), 6).alias("clipped"))


@query("SELECT id, trim(regexp_replace(memo, '\\s+', ' ', 'g')) AS memo, upper(trim(memo)) AS up FROM (SELECT DISTINCT id, memo FROM ledger_entries WHERE memo IS NOT NULL)")
def blanks_collapsed(spark, sf):
    return table(spark, sf, "ledger_entries").where("memo is not null").select("id", "memo").distinct().select("id", T.collapse_blanks(c("memo")).alias("memo"), F.upper(F.trim("memo")).alias("up"))


@query("SELECT doc_id, len(t) AS n, array_to_string(t[1:5], ' ') AS head FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL)")
def word_tokens(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", T.tokens(c("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n"), F.array_join(F.slice("t", 1, 5), " ").alias("head"))


@query("SELECT a.item_id AS a, b.item_id AS b, CAST(round(len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)), 6) AS DOUBLE) AS score FROM (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(item_text), '[^a-z0-9_]+'), lambda x: x <> '')) AS t FROM eval_items) a JOIN (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(item_text), '[^a-z0-9_]+'), lambda x: x <> '')) AS t FROM eval_items) b ON b.item_id = a.item_id + 1")
def set_containment(spark, sf):
    t = table(spark, sf, "eval_items").select("item_id", F.array_distinct(T.tokens(c("item_text"))).alias("t"))
    a, b = t.select(c("item_id").alias("a"), c("t").alias("ta")), t.select(c("item_id").alias("b"), c("t").alias("tb"))
    return a.join(b, c("b") == c("a") + 1).select("a", "b", F.round(T.containment(c("ta"), c("tb")), 6).alias("score"))


@query("""SELECT command_id, regexp_replace(cwd, '(^|[^\\w.-])/(?:Users|home|private|var|tmp|opt|Volumes)/[^\\s"''`)\\]},;]*', '\\1[host path withheld]', 'g') AS cwd FROM command_results WHERE cwd IS NOT NULL""")
def host_paths_masked(spark, sf):
    return table(spark, sf, "command_results").where("cwd is not null").select("command_id", T.mask_paths(c("cwd")).alias("cwd"))


@query("""WITH a AS (SELECT log_id, regexp_replace(message, '\\bsk-[A-Za-z0-9_-]{8,}', '[redacted api key]', 'g') AS m FROM log_records WHERE message IS NOT NULL), b AS (SELECT log_id, regexp_replace(regexp_replace(regexp_replace(m, '\\bAQ\\.[A-Za-z0-9_.-]{8,}', '[redacted api key]', 'g'), '(?i)\\bBearer\\s+[A-Za-z0-9._~+/=-]{8,}', 'Bearer [redacted]', 'g'), '(?i)\\bAuthorization\\s*[:=]\\s*[^\\s"''`]{8,}', 'Authorization: [redacted]', 'g') AS m FROM a)
  SELECT log_id, m FROM b""")
def secrets_masked(spark, sf):
    return table(spark, sf, "log_records").where("message is not null").select("log_id", T.mask_secrets(c("message")).alias("m"))


@query("SELECT c_custkey, left(regexp_replace(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 120) AS slug, sha256(c_name) AS digest FROM customer")
def slugs_and_digests(spark, sf):
    name = F.concat("c_name", F.lit(" / "), "c_mktsegment")
    return table(spark, sf, "customer").select("c_custkey", T.slug(name).alias("slug"), F.sha2("c_name", 256).alias("digest"))


@query("""WITH RECURSIVE f AS (SELECT n_name, 0 AS i, CAST(2166136261 AS BIGINT) AS h FROM nation UNION ALL SELECT n_name, i + 1, CAST((CAST(xor(h, CAST(ascii(substr(n_name, i + 1, 1)) AS BIGINT)) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT) FROM f WHERE i < length(n_name))
  SELECT n_name, lpad(lower(printf('%x', h)), 8, '0') AS fnv FROM f WHERE i = length(n_name)""")
def fnv_hash(spark, sf):
    return table(spark, sf, "nation").select("n_name", T.fnv1a32(c("n_name")).alias("fnv"))


@query("SELECT method_id, (length(body) - length(replace(body, 'jdbc', ''))) // 4 AS uses, length(replace(body, 'jdbc', 'db')) AS shorter FROM java_methods WHERE body IS NOT NULL")
def literal_replacement(spark, sf):
    return table(spark, sf, "java_methods").where("body is not null").select("method_id", T.occurrences(c("body"), "jdbc").alias("uses"), F.length(F.replace("body", F.lit("jdbc"), F.lit("db"))).alias("shorter"))


@query("SELECT s.span_id, s.line_no AS stored, length(left(f.file_content, CAST(s.start_pos AS INTEGER))) - length(replace(left(f.file_content, CAST(s.start_pos AS INTEGER)), chr(10), '')) + 1 AS found FROM source_spans s JOIN model_files f ON f.file_id = s.file_id")
def offset_to_line(spark, sf):
    s = table(spark, sf, "source_spans").select("span_id", "file_id", "line_no", "start_pos")
    f = table(spark, sf, "model_files").select("file_id", "file_content")
    return s.join(f, "file_id").select("span_id", c("line_no").alias("stored"), T.line_of(c("file_content"), c("start_pos").cast("int")).cast("bigint").alias("found"))


@query("SELECT file_id, regexp_replace('/' || repository || '/' || '//' || file_path, '/{2,}', '/', 'g') AS full_path FROM model_files WHERE file_path IS NOT NULL AND NOT ends_with(file_path, '/')")
def joined_paths(spark, sf):
    return table(spark, sf, "model_files").where("file_path is not null and not endswith(file_path, '/')").select("file_id", T.join_path(c("repository"), F.concat(F.lit("//"), c("file_path"))).alias("full_path"))


def all_names(files):
    """(file_id, names) of every file with a template variable, these in order."""
    return files.select("file_id", T.template_variables(c("file_content")).alias("v")).where(F.size("v") > 0).select("file_id", F.array_join("v", ",").alias("names"))


@query("SELECT file_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS names FROM (SELECT file_id, regexp_extract_all(file_content, '\\{\\{\\s*([A-Za-z_][\\w.]*)\\s*\\}\\}', 1) AS l FROM model_files) WHERE len(l) > 0")
def template_names(spark, sf):
    """The variables of every file that has one, in order of their first use."""
    return all_names(table(spark, sf, "model_files"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 60) || chr(10) || '…[' || (length(text) - 100) || ' characters omitted]…' || chr(10) || right(text, 40) ELSE text END AS short FROM documents WHERE text IS NOT NULL")
def head_and_tail_clip(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", T.head_and_tail(c("text"), 100).alias("short"))


@query("SELECT source, CASE WHEN count(*) = 1 THEN '1 document' ELSE count(*) || ' documents' END AS shown FROM documents WHERE source IS NOT NULL GROUP BY source")
def counted_labels(spark, sf):
    return table(spark, sf, "documents").where("source is not null").groupBy("source").agg(T.counted(F.count("*"), "document").alias("shown"))


def all_paths(files):
    """(file_id, paths) of every file that cites a path, the first eight in order."""
    return files.select("file_id", T.cited_paths(c("file_content")).alias("p")).where(F.size("p") > 0).select("file_id", F.array_join("p", " ").alias("paths"))


@query("SELECT file_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:8], ' ') AS paths FROM (SELECT file_id, regexp_extract_all(file_content, '((?:[\\w.-]+/)+[\\w.-]+\\.\\w+)', 1) AS l FROM model_files) WHERE len(l) > 0")
def paths_cited(spark, sf):
    """The paths that each file cites, in order, the first eight: the bound of the feature."""
    return all_paths(table(spark, sf, "model_files"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.a.b') AS none, json_type(props, '$.k') IS NOT NULL AS present FROM events")
def path_read(spark, sf):
    return table(spark, sf, "events").select("event_id", J.get_path(c("props"), "k").alias("k"), J.get_path(c("props"), "a.b").alias("none"), J.has_path(c("props"), "k").alias("present"))


@query("""WITH r AS (SELECT result_id, unnest(result_rows) AS j, generate_subscripts(result_rows, 1) - 1 AS pos FROM query_results), k AS (SELECT result_id, pos, unnest(json_keys(j)) AS path, j FROM r)
  SELECT result_id, pos, path, CASE WHEN regexp_matches(json_extract_string(j, '$.' || path), '^-?[0-9]+[.][0-9]+$') THEN regexp_replace(json_extract_string(j, '$.' || path), '[.]?0+$', '') ELSE json_extract_string(j, '$.' || path) END AS value FROM k""")
def leaf_paths(spark, sf):
    rows = table(spark, sf, "query_results").select("result_id", F.posexplode("result_rows").alias("pos", "j"))
    leaves = J.leaves(rows, "j", ["result_id", "pos"])
    text = c("value").cast("string")
    return leaves.select("result_id", c("pos").cast("bigint").alias("pos"), "path", F.when(text.rlike(r"^-?[0-9]+[.][0-9]+$"), F.regexp_replace(text, r"[.]?0+$", "")).otherwise(text).alias("value"))


@query()
def canonical_hashes(spark, sf):
    """Hash of the canonical text of each page row: equal objects hash alike whatever the order of keys."""
    rows = table(spark, sf, "query_results").select("result_id", F.posexplode("result_rows").alias("pos", "j"))
    return rows.select("result_id", "pos", J.content_hash(c("j")).alias("digest"))


@query("SELECT event_id, CASE WHEN json_type(props, '$.k') IS NULL THEN 'absent' ELSE json_extract(props, '$.k')::VARCHAR END AS shown FROM events")
def rendered_values(spark, sf):
    return table(spark, sf, "events").select("event_id", J.rendered(c("props"), "k").alias("shown"))


@query("SELECT count(*) FILTER (WHERE list_sort(tables_used) = list_sort(list_reverse(tables_used))) AS same_members, count(*) AS n FROM sql_statements WHERE tables_used IS NOT NULL")
def multiset_equality(spark, sf):
    return table(spark, sf, "sql_statements").where("tables_used is not null").agg(F.count_if(F.array_sort("tables_used") == F.array_sort(F.reverse("tables_used"))).alias("same_members"), F.count("*").alias("n"))


@query("SELECT statement_id, array_to_string(list_sort(list_distinct(tables_used)), ',') AS tables, list_contains(tables_used, 'accounts') AS accounts, list_position(tables_used, 'accounts') AS place FROM sql_statements WHERE tables_used IS NOT NULL")
def array_idioms(spark, sf):
    t = c("tables_used")
    return table(spark, sf, "sql_statements").where("tables_used is not null").select("statement_id", F.array_join(F.array_sort(F.array_distinct(t)), ",").alias("tables"), F.array_contains(t, "accounts").alias("accounts"), F.nullif(F.array_position(t, "accounts"), F.lit(0)).alias("place"))


@query("SELECT repository, sha256(string_agg(DISTINCT verb, '|' ORDER BY verb)) AS digest FROM sql_statements WHERE verb IS NOT NULL GROUP BY repository")
def order_free_set_hash(spark, sf):
    return table(spark, sf, "sql_statements").where("verb is not null").groupBy("repository").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("verb")), "|"), 256).alias("digest"))


@query("SELECT command_id, date_diff('day', CAST(started_at AS DATE), DATE '2026-09-01') AS age_days, started_at < TIMESTAMP '2026-09-01 00:00:00' AS past FROM command_results WHERE started_at IS NOT NULL")
def age_as_of(spark, sf):
    """Ages against a day that the caller gives; no query reads a clock of its own."""
    as_of = F.lit("2026-09-01")
    held = table(spark, sf, "command_results").where("started_at is not null")
    return held.select("command_id", F.date_diff(as_of.cast("date"), F.col("started_at").cast("date")).cast("bigint").alias("age_days"), (F.col("started_at") < as_of.cast("timestamp_ntz")).alias("past"))
