"""Queries over the ledger: scans, filters, joins, aggregates, windows and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..common import table
from ..operators import relational as R
from ..plans import gateway
from .registry import query


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ledger_entries")


def ledger_once(spark: SparkSession, sf: str) -> DataFrame:
    """Entries without second deliveries: one row per id."""
    return R.first_per_key(ledger(spark, sf), ["id"], [F.col("created_at")])


_ONCE = "once AS (SELECT * FROM ledger_entries QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1)"


@query("SELECT id, account_id, CAST(amount AS DOUBLE) AS amount FROM ledger_entries WHERE status = 'POSTED' AND batch_id IS NULL ORDER BY id")
def scan_filter_order(spark, sf):
    return ledger(spark, sf).where("status = 'POSTED' and batch_id is null").select("id", "account_id", F.col("amount").cast("double").alias("amount")).orderBy("id")


@query("SELECT id, entry_type, CAST(amount AS DOUBLE) AS amount FROM ledger_entries WHERE account_id = (SELECT account_id FROM ledger_entries GROUP BY account_id ORDER BY count(*) DESC, account_id LIMIT 1) ORDER BY id")
def entries_of_busiest_account(spark, sf):
    led = ledger(spark, sf)
    top = led.groupBy("account_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "account_id").limit(1)
    return led.join(F.broadcast(top.select("account_id")), "account_id", "left_semi").select("id", "entry_type", F.col("amount").cast("double").alias("amount")).orderBy("id")  # one row is broadcast


@query("SELECT id, account_id, entry_type, (SELECT count(*) FROM ledger_entries WHERE amount < 0) > 500 AS truncated FROM ledger_entries WHERE amount < 0 ORDER BY id, created_at LIMIT 500")
def gateway_capped_page(spark, sf):
    ledger(spark, sf).createOrReplaceTempView("gateway_ledger")
    page = gateway.run(spark, "SELECT id, account_id, entry_type FROM gateway_ledger WHERE amount < :low ORDER BY id, created_at", 500, {"low": 0})
    return page.rows.withColumn("truncated", F.lit(page.truncated))


@query("SELECT id, entry_type AS typ, CAST(amount AS DOUBLE) AS amt, reference AS ref, memo FROM ledger_entries")
def projection_renamed(spark, sf):
    return ledger(spark, sf).select("id", F.col("entry_type").alias("typ"), F.col("amount").cast("double").alias("amt"), F.col("reference").alias("ref"), "memo")


@query("""SELECT id AS "entryId", account_id AS "accountId", entry_type AS "entryType", CAST(amount AS DOUBLE) AS "amount", strftime(value_date, '%Y-%m-%d') AS "valueDate", strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS "createdAt" FROM ledger_entries""")
def projection_wire_names(spark, sf):
    return ledger(spark, sf).select(
        F.col("id").alias("entryId"), F.col("account_id").alias("accountId"), F.col("entry_type").alias("entryType"), F.col("amount").cast("double").alias("amount"),
        F.date_format("value_date", "yyyy-MM-dd").alias("valueDate"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("createdAt"))


@query("SELECT id, strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS posted_on FROM ledger_entries WHERE CAST(created_at AS DATE) BETWEEN DATE '2026-01-01' AND DATE '2026-03-31'")
def date_range_statement(spark, sf):
    return R.between_days(ledger(spark, sf), "created_at", "2026-01-01", "2026-03-31").select("id", F.date_format("created_at", "yyyy-MM-dd").alias("posted_on"))


@query("SELECT 'FEE' AS asked, count(*) AS n FROM ledger_entries WHERE entry_type = 'FEE' UNION ALL SELECT 'ALL', count(*) FROM ledger_entries")
def optional_type_filter(spark, sf):
    count = lambda typ: R.of_type(ledger(spark, sf), "entry_type", typ).agg(F.count("*").alias("n")).select(F.lit(typ.strip().upper()).alias("asked"), "n")
    return count(" fee ").unionByName(count("all"))


@query("SELECT id, reference FROM ledger_entries WHERE entry_type IN ('REVERSAL', 'RECON_ADJUST') AND status = 'SETTLED' ORDER BY id")
def in_list_filter(spark, sf):
    return ledger(spark, sf).where(F.col("entry_type").isin("REVERSAL", "RECON_ADJUST") & (F.col("status") == "SETTLED")).select("id", "reference").orderBy("id")


@query("SELECT count(*) AS n FROM ledger_entries WHERE entry_type = 'FEE' AND abs(amount) < 1000")
def conjunction_filter(spark, sf):
    return ledger(spark, sf).where((F.col("entry_type") == "FEE") & (F.abs("amount") < 1000)).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT account_id FROM ledger_entries l WHERE EXISTS (SELECT 1 FROM ledger_entries r WHERE r.account_id = l.account_id AND r.entry_type = 'RECON_ADJUST')")
def exists_semi_join(spark, sf):
    led = ledger(spark, sf)
    return led.select("account_id").distinct().join(led.where("entry_type = 'RECON_ADJUST'").select("account_id"), "account_id", "left_semi")


@query("SELECT count(*) AS n FROM ledger_entries WHERE status = 'SETTLED' AND memo IS NULL")
def count_with_predicate(spark, sf):
    return ledger(spark, sf).where("status = 'SETTLED' and memo is null").agg(F.count("*").alias("n"))


@query("SELECT CAST(round(coalesce(sum(amount), 0), 2) AS DOUBLE) AS total, (SELECT CAST(round(coalesce(sum(amount), 0), 2) AS DOUBLE) FROM ledger_entries WHERE entry_type = 'NONE') AS nothing FROM ledger_entries")
def global_sum_empty_is_zero(spark, sf):
    led = ledger(spark, sf)
    none = F.sum(F.when(F.col("entry_type") == "NONE", F.col("amount")))
    return led.agg(F.round(F.coalesce(F.sum("amount"), F.lit(0)), 2).cast("double").alias("total"), F.round(F.coalesce(none, F.lit(0)), 2).cast("double").alias("nothing"))


@query("SELECT entry_type, count(*) AS n, CAST(round(sum(amount), 2) AS DOUBLE) AS total FROM ledger_entries GROUP BY entry_type ORDER BY entry_type")
def grouped_count_and_sum(spark, sf):
    return ledger(spark, sf).groupBy("entry_type").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).cast("double").alias("total")).orderBy("entry_type")


@query("SELECT account_id, strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day, entry_type, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM ledger_entries GROUP BY ALL")
def daily_rollup_view(spark, sf):
    R.daily_rollup(ledger(spark, sf)).createOrReplaceTempView("daily_rollup")
    return spark.sql("SELECT account_id, date_format(day, 'yyyy-MM-dd') AS day, entry_type, n, CAST(total AS DOUBLE) AS total FROM daily_rollup")


@query("SELECT greatest(coalesce(max(id), 0), 5000) AS next_floor, greatest(coalesce(max(CASE WHEN id < 0 THEN id END), 0), 1) AS none FROM ledger_entries")
def max_with_floor(spark, sf):
    return ledger(spark, sf).agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(5000)).alias("next_floor"), F.greatest(F.coalesce(F.max(F.when(F.col("id") < 0, F.col("id"))), F.lit(0)), F.lit(1)).alias("none"))


@query("SELECT c.c_custkey, c.c_name, CAST(coalesce((SELECT sum(CAST(o.o_totalprice AS DECIMAL(18,4))) FROM orders o WHERE o.o_custkey = c.c_custkey), 0) AS DOUBLE) AS ordered FROM customer c")
def correlated_sum_per_row(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return R.with_lookup_sum(c, o, "c_custkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,4)"), "ordered").select("c_custkey", "c_name", F.col("ordered").cast("double").alias("ordered"))


@query("SELECT o.o_orderkey, l.l_linenumber FROM orders o JOIN (SELECT *, CASE WHEN l_linenumber = 1 THEN 'XFER-' ELSE 'FEE-' END || l_orderkey AS ref FROM lineitem) l ON l.ref IN ('XFER-' || o.o_orderkey, 'FEE-' || o.o_orderkey)")
def join_on_built_key(spark, sf):
    refs = table(spark, sf, "lineitem").select("l_linenumber", F.concat(F.when(F.col("l_linenumber") == 1, "XFER-").otherwise("FEE-"), F.col("l_orderkey").cast("string")).alias("ref"))
    keys = table(spark, sf, "orders").select("o_orderkey", F.explode(F.array(*(F.concat(F.lit(p), F.col("o_orderkey").cast("string")) for p in ("XFER-", "FEE-")))).alias("ref"))
    return keys.join(refs, "ref").select("o_orderkey", "l_linenumber")


@query(f"WITH {_ONCE}, b AS (SELECT account_id, sum(amount) AS s, sum(round(amount, 2)) AS r FROM once GROUP BY account_id) SELECT count(*) AS checked, count(*) FILTER (WHERE abs(s - r) > 0 AND abs(s - r) <= 0.01) AS tolerated, count(*) FILTER (WHERE abs(s - r) > 0.01) AS adjusted FROM b")
def tolerance_counters(spark, sf):
    sums = ledger_once(spark, sf).groupBy("account_id").agg((F.sum("amount") - F.sum(F.round("amount", 2))).alias("d"))
    return sums.agg(F.count("*").alias("checked"), F.count_if(R.within_tolerance(F.col("d"), "0.01")).alias("tolerated"), F.count_if(F.abs("d") > F.lit("0.01").cast("decimal(5,2)")).alias("adjusted"))


@query("SELECT account_id, id, row_number() OVER (PARTITION BY account_id ORDER BY created_at, id, amount) - 1 AS seq FROM (SELECT DISTINCT account_id, id, created_at, amount FROM ledger_entries)")
def dense_sequence_per_key(spark, sf):
    rows = ledger(spark, sf).select("account_id", "id", "created_at", "amount").distinct()
    return R.with_sequence(rows, ["account_id"], [F.col("created_at"), F.col("id"), F.col("amount")], "seq").select("account_id", "id", F.col("seq").cast("bigint").alias("seq"))


@query("SELECT account_id, entry_type, max(id) AS id, CAST(max_by(amount, id) AS DOUBLE) AS amount FROM ledger_entries GROUP BY account_id, entry_type")
def latest_per_kind(spark, sf):
    last = R.last_per_key(ledger(spark, sf), ["account_id", "entry_type"], F.col("id"), ["id", "amount"])
    return last.select("account_id", "entry_type", "id", F.col("amount").cast("double").alias("amount"))


@query(f"WITH {_ONCE}, r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY abs(amount) DESC, id) AS rn, count(*) OVER (PARTITION BY account_id) AS n FROM once) SELECT account_id, id, rn, greatest(n - 5, 0) AS overflow FROM r WHERE rn <= 5")
def top_n_with_overflow(spark, sf):
    top = R.top_per_key(ledger_once(spark, sf), ["account_id"], [F.abs("amount").desc(), F.col("id")], 5)
    return top.select("account_id", "id", F.col("rn").cast("bigint").alias("rn"), "overflow")


@query("""WITH days AS (SELECT DISTINCT account_id, CAST(created_at AS DATE) AS d FROM ledger_entries WHERE created_at IS NOT NULL),
  f AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY account_id ORDER BY d) <= 3 THEN 0 ELSE 1 END AS new FROM days),
  g AS (SELECT *, sum(new) OVER (PARTITION BY account_id ORDER BY d) AS island FROM f)
  SELECT account_id, strftime(min(d), '%Y-%m-%d') AS lo, strftime(max(d), '%Y-%m-%d') AS hi, count(*) AS days FROM g GROUP BY account_id, island""")
def islands_of_activity(spark, sf):
    days = ledger(spark, sf).where("created_at is not null").select("account_id", F.to_date("created_at").alias("d")).distinct()
    isl = R.islands(days, ["account_id"], "d", 3, distance=lambda a, b: F.date_diff(a, b))
    return isl.select("account_id", F.date_format("lo", "yyyy-MM-dd").alias("lo"), F.date_format("hi", "yyyy-MM-dd").alias("hi"), F.col("size").alias("days"))


@query("SELECT count(*) AS n, count(running_balance) AS with_balance FROM ledger_entries")
def running_balance_unset(spark, sf):
    return ledger(spark, sf).agg(F.count("*").alias("n"), F.count("running_balance").alias("with_balance"))


@query(f"WITH {_ONCE} SELECT account_id, id, CAST(sum(amount) OVER (PARTITION BY account_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM once")
def running_balance_computed(spark, sf):
    w = W.partitionBy("account_id").orderBy("created_at", "id").rowsBetween(W.unboundedPreceding, 0)
    return ledger_once(spark, sf).select("account_id", "id", F.sum("amount").over(w).cast("double").alias("balance"))


@query("SELECT id, account_id FROM ledger_entries ORDER BY id DESC, account_id LIMIT 1")
def newest_by_id(spark, sf):
    return ledger(spark, sf).select("id", "account_id").orderBy(F.desc("id"), "account_id").limit(1)


@query("SELECT DISTINCT id, strftime(value_date, '%Y-%m-%d') AS value_date FROM ledger_entries ORDER BY value_date DESC NULLS LAST, id")
def nulls_last_order(spark, sf):
    return ledger(spark, sf).select("id", F.date_format("value_date", "yyyy-MM-dd").alias("value_date")).distinct().orderBy(F.desc_nulls_last("value_date"), "id")


@query("SELECT entry_type, count(*) AS n FROM ledger_entries GROUP BY entry_type ORDER BY n DESC, entry_type")
def frequency_table(spark, sf):
    return R.frequencies(ledger(spark, sf), "entry_type")


@query("SELECT id, count(*) AS n FROM ledger_entries GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return R.repeated(ledger(spark, sf), ["id"])


@query("WITH h AS (SELECT sha256(concat_ws('|', id, account_id, entry_type, CAST(amount AS VARCHAR), coalesce(reference, '~'), coalesce(memo, '~'))) AS fp FROM ledger_entries) SELECT count(*) AS groups, sum(n) AS copies FROM (SELECT fp, count(*) AS n FROM h GROUP BY fp HAVING count(*) > 1)")
def duplicate_rows_by_fingerprint(spark, sf):
    fp = F.sha2(F.concat_ws("|", "id", "account_id", "entry_type", F.col("amount").cast("string"), F.coalesce("reference", F.lit("~")), F.coalesce("memo", F.lit("~"))), 256)
    return ledger(spark, sf).groupBy(fp.alias("fp")).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("groups"), F.sum("n").alias("copies"))


@query("SELECT id, reference, CASE WHEN row_number() OVER (PARTITION BY coalesce(reference, 'id-' || id) ORDER BY id, created_at, amount) = 1 THEN 0 ELSE 1 END AS dup FROM (SELECT DISTINCT id, reference, created_at, amount FROM ledger_entries)")
def idempotent_insert_replay(spark, sf):
    rows = ledger(spark, sf).select("id", "reference", "created_at", "amount").distinct()
    key = F.coalesce("reference", F.concat(F.lit("id-"), F.col("id").cast("string")))
    rn = F.row_number().over(W.partitionBy(key).orderBy("id", "created_at", "amount"))
    return rows.withColumn("dup", F.when(rn == 1, 0).otherwise(1)).select("id", "reference", "dup")


@query("WITH k AS (SELECT DISTINCT doc_id AS id, source || '-' || CASE WHEN doc_id % 3 = 0 THEN upper(coalesce(lang, 'x')) ELSE lower(coalesce(lang, 'x')) END AS raw FROM documents WHERE source IS NOT NULL), f AS (SELECT lower(raw) AS low, min(id) AS first FROM k GROUP BY lower(raw)) SELECT id, CASE WHEN first < id THEN 1 ELSE 0 END AS dup FROM k LEFT JOIN f ON low = raw")
def dedupe_with_lowered_journal(spark, sf):
    k = table(spark, sf, "documents").where("source is not null").select(F.col("doc_id").alias("id"), F.concat("source", F.lit("-"), F.when(F.col("doc_id") % 3 == 0, F.upper(F.coalesce("lang", F.lit("x")))).otherwise(F.lower(F.coalesce("lang", F.lit("x"))))).alias("raw")).distinct()
    return R.seen_before(k, "id", "raw").select("id", "dup")


@query("WITH led AS (SELECT DISTINCT id, memo FROM ledger_entries) SELECT id, length(memo) AS n FROM led WHERE memo IS NOT NULL AND length(memo) <= 20")
def silently_dropped_long_memos(spark, sf):
    return ledger(spark, sf).select("id", "memo").distinct().where(F.col("memo").isNotNull() & (F.length("memo") <= 20)).select("id", F.length("memo").alias("n"))


@query("SELECT (SELECT max(id) FROM ledger_entries) + row_number() OVER (ORDER BY o_orderkey) AS id, o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def insert_with_new_ids(spark, sf):
    new = table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    return R.number_after(new, "o_orderkey", ledger(spark, sf).agg(F.max("id").alias("top")), "id").select("id", "o_orderkey")


@query("SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(18,4)) + coalesce(d, 0) AS DOUBLE) AS balance FROM customer LEFT JOIN (SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(18,4))) AS d FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def update_by_summed_deltas(spark, sf):
    amount = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1) * F.col("o_totalprice").cast("decimal(18,4)")
    base = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(18,4)").alias("balance"))
    return R.apply_deltas(base, table(spark, sf, "orders").select("o_custkey", amount.alias("delta")), "c_custkey", "o_custkey", "balance").withColumn("balance", F.col("balance").cast("double"))


@query("SELECT id, CASE WHEN status = 'POSTED' AND batch_id IS NULL THEN 'PENDING' ELSE status END AS status FROM ledger_entries")
def update_by_predicate(spark, sf):
    return ledger(spark, sf).select("id", F.when((F.col("status") == "POSTED") & F.col("batch_id").isNull(), "PENDING").otherwise(F.col("status")).alias("status"))


@query("""SELECT 'unique id' AS rule, count(*) AS violations FROM (SELECT id FROM ledger_entries GROUP BY id HAVING count(*) > 1)
  UNION ALL SELECT 'memo not null', count(*) FROM ledger_entries WHERE memo IS NULL
  UNION ALL SELECT 'known type', count(*) FROM ledger_entries WHERE entry_type NOT IN ('CREDIT', 'DEBIT', 'FEE', 'REVERSAL', 'RECON_ADJUST') OR entry_type IS NULL
  UNION ALL SELECT 'order has customer', count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey""")
def constraint_checks(spark, sf):
    led = ledger(spark, sf)
    return R.rule_counts(spark, {
        "unique id": R.repeated(led, ["id"]), "memo not null": led.where("memo is null"),
        "known type": led.where(~F.coalesce(F.col("entry_type").isin("CREDIT", "DEBIT", "FEE", "REVERSAL", "RECON_ADJUST"), F.lit(False))),
        "order has customer": table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
    })


@query("""WITH old AS (SELECT DISTINCT id, status, amount, memo FROM ledger_entries), new AS (SELECT id, status, CASE WHEN id % 50 = 0 THEN amount + 1 ELSE amount END AS amount, memo FROM old WHERE id % 97 <> 0)
  SELECT old.id, CASE WHEN new.id IS NULL THEN 'deleted' ELSE 'changed' END AS violation FROM old LEFT JOIN new ON old.id = new.id WHERE old.status = 'SETTLED' AND (new.id IS NULL OR new.amount <> old.amount OR new.memo IS DISTINCT FROM old.memo)""")
def immutable_rows_violated(spark, sf):
    old = ledger(spark, sf).select("id", "status", "amount", "memo").distinct()
    new = old.where("id % 97 <> 0").withColumn("amount", F.when(F.col("id") % 50 == 0, F.col("amount") + 1).otherwise(F.col("amount")))
    return R.immutability_violations(old, new, "id", "status = 'SETTLED'", ["amount", "memo"])


@query("""WITH o AS (SELECT id, entry_type, account_id, amount FROM ledger_entries WHERE status = 'CORRECTED' GROUP BY ALL), legs AS (SELECT id, account_id, 'REVERSAL' AS kind, -amount AS amount FROM o UNION ALL SELECT id, account_id, 'REPOST', round(amount, 1) FROM o)
  SELECT account_id, kind, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM legs GROUP BY ALL""")
def correction_legs(spark, sf):
    o = ledger(spark, sf).where("status = 'CORRECTED'").select("id", "entry_type", "account_id", "amount").distinct()
    legs = R.legs(o, {"REVERSAL": -F.col("amount"), "REPOST": F.round("amount", 1).cast("decimal(18,4)")}, "kind", "amount")
    return legs.groupBy("account_id", "kind").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


@query()
def guarded_fold_per_account(spark, sf):
    """Entries in id order take effect only while the balance stays at or above zero."""
    rows = ledger_once(spark, sf).where("amount is not null").select("account_id", "id", "amount")
    return R.guarded_fold(rows, "account_id", "id", "amount").select("account_id", "id", "accepted", F.col("balance").cast("double").alias("balance"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE '%A%'")
def inner_equi_join(spark, sf):
    return table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where(F.col("r_name").contains("A")).select("n_name", "r_name")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf):
    return table(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"))
