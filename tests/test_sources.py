import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import jsons as J
from tidemark.functions import scalars as S
from tidemark.functions import text as T
from tidemark.sources import readers as R
from tidemark.streaming import events as stream


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first().r


def test_event_lines(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"runId": "r", "seq": 0, "type": "a"}\n\n{"runId": "r", "seq": 1, "type": "b"}\n')
    bad = tmp_path / "bad.jsonl"
    bad.write_text(good.read_text() + "not json\n")
    assert R.read_events_strict(spark, str(good)).count() == 2
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ_FILE"):
        R.read_events_strict(spark, str(bad)).collect()
    lenient = R.read_events_lenient(spark, str(bad))
    assert lenient.count() == 3 and lenient.where("_corrupt is not null").count() == 1
    R.append_events(R.read_events_strict(spark, str(good)), str(tmp_path / "out"))
    R.append_events(R.read_events_strict(spark, str(good)), str(tmp_path / "out"))
    assert R.read_events_strict(spark, str(tmp_path / "out")).count() == 4


def test_tree_scan(spark, tmp_path):
    for name, data in {"a/x.py": b"one\ntwo", "a/b.bin": b"\x00\x01", "node_modules/y.py": b"no", "z.md": "ü".encode()}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: (r.bytes, r.text, r.lines) for r in R.scan_tree(spark, str(tmp_path)).collect()}
    assert got == {"a/x.py": (7, "one\ntwo", 2), "a/b.bin": (2, None, None), "z.md": (2, "ü", 1)}
    assert [r.path for r in R.scan_tree(spark, str(tmp_path), "**/*.py").collect()] == ["a/x.py"]


def test_artifacts(spark, tmp_path):
    index = R.content_ids(spark.createDataFrame([("p", "one")], "path string, content string"), "content").select("path", "artifact_id")
    rows = spark.createDataFrame([("p", "one"), ("q", "two")], "path string, content string")
    assert [r.path for r in R.new_artifacts(index, rows).collect()] == ["q"]
    with pytest.raises(PySparkException):
        R.new_artifacts(index, spark.createDataFrame([("p", "other")], "path string, content string")).collect()
    R.write_envelopes(rows, str(tmp_path / "env"), "finding", "run_1")
    assert R.read_payloads(spark, str(tmp_path / "env"), "path string, content string").orderBy("path").collect()[0].content == "one"
    doc = json.loads(spark.read.text(str(tmp_path / "env")).first().value)
    assert list(doc) == sorted(doc) and doc["kind"] == "finding"


def test_versioned_names(spark):
    p = spark.createDataFrame([("a/verdict.json",), ("verdict-r2.json",), ("verdict-r3-attempt-task_x.json",), ("change-report-r1.json",)], "path string")
    assert [(r.kind, r.iteration, r.task) for r in R.versioned_files(p).collect()] == [("verdict", 0, None), ("verdict", 2, None), ("verdict", 3, "task_x"), ("change-report", 1, None)]
    m = R.migrations(spark.createDataFrame([("db/V1__init_schema.sql",), ("R__views.sql",), ("x.sql",), (None,)], "path string"))
    assert [(r.version, r.description, r.repeatable) for r in m.collect()] == [("1", "init schema", False), (None, "views", True)]


def test_json_functions(spark):
    doc = '{"b": {"c": [1, {"d": null}]}, "a": 60.0, "e": {}, "s": "60.0000"}'
    assert one(spark, doc, lambda c: J.get_path(c, "b.c.0")) == "1"
    assert one(spark, doc, lambda c: J.get_path(c, "b.x.y")) is None
    assert one(spark, doc, lambda c: J.has_path(c, "b.c.1.d")) is True and one(spark, doc, lambda c: J.has_path(c, "zz")) is False
    assert one(spark, "{bad", lambda c: J.get_path(c, "a")) is None
    assert one(spark, doc, lambda c: J.same_value(c, F.lit('{"a": 60, "s": "60.0000", "e": {}, "b": {"c": [1, {"d": null}]}}'))) is True
    assert one(spark, '{"a": 60}', lambda c: J.same_value(c, F.lit('{"a": "60"}'))) is False
    leaves = J.leaves(spark.createDataFrame([(1, doc), (2, "[]"), (3, None), (4, "{bad")], "k long, j string"), "j", ["k"])
    assert sorted((r.k, r.path) for r in leaves.select("k", "path").collect()) == [(1, "a"), (1, "b.c.0"), (1, "b.c.1.d"), (1, "e"), (1, "s"), (2, "")]


def test_text_functions(spark):
    assert one(spark, "abc", lambda c: T.pad_right(c, 2)) == "abc" and one(spark, "a", lambda c: T.pad_right(c, 3)) == "a  "
    assert one(spark, "abcdef", lambda c: T.clip(c, 4)) == "abc…" and one(spark, None, lambda c: T.clip(c, 4)) is None
    assert one(spark, " Ab / cD..", T.slug) is None and one(spark, "/x", T.slug) is None and one(spark, "--Ab c!", T.slug) == "ab-c"
    assert one(spark, "a", T.fnv1a32) == "e40c292c" and one(spark, "foobar", T.fnv1a32) == "bf9cf968"
    assert one(spark, "aXbXX", lambda c: T.occurrences(c, "X")) == 3
    assert one(spark, "a\nb\nc", lambda c: T.line_of(c, F.lit(4))) == 3
    assert one(spark, "{{ a }} {{b.c}} {{a}}", T.template_variables) == ["a", "b.c"]
    assert T.glob_pattern("src/**/*.{ts,js}") == "^src/(?:.*/)?[^/]*\\.(?:ts|js)$"
    assert T.glob_pattern("a{b?c") == "^a\\{b[^/]c$" and T.glob_pattern("{a.b, c}") == "^(?:a\\.b|c)$"
    assert one(spark, "A b", T.stable_slug).endswith("-a-b") and len(one(spark, "x" * 99, T.stable_slug)) == 69


def test_scalar_functions(spark):
    import datetime as dt

    assert [one(spark, x, S.round_half_up_to_plus, "double") for x in (-2.5, 2.5, 2.4)] == [-2, 3, 2]
    assert one(spark, dt.date(2026, 1, 2), S.next_business_day, "date") == dt.date(2026, 1, 5)
    assert one(spark, dt.datetime(2026, 1, 2, 17), S.value_date, "timestamp_ntz") == dt.date(2026, 1, 5)
    assert one(spark, -105, S.cents_text, "long") == "-1.05"
    assert [one(spark, x, S.lenient_long) for x in ("12.9", "x", None)] == [12, None, None]
    assert one(spark, "2026-01-01T00:00:00Z", S.is_instant) is True and one(spark, "2026-01-01", S.is_instant) is False and one(spark, None, S.is_instant) is False


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2026-01-01T10:00:00", "a"), (1, "2026-01-01T10:10:00", "b"), (1, "2026-01-02T10:00:00", "a")], "user_id long, t string, event_type string").select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"), "event_type")
    rows.write.parquet(str(tmp_path / "e"))
    counted = stream.drain(stream.daily_counts(stream.open_parquet(spark, str(tmp_path / "e"))), "t", "update", ["day", "event_type"])
    assert counted.columns == ["day", "event_type", "n"] and counted.count() == 3 and counted.agg(F.sum("n")).first()[0] == 3
    assert stream.drain(stream.first_per_key(stream.open_parquet(spark, str(tmp_path / "e")), ["event_type"]), "t2", "append").count() == 2
    assert stream.drain(stream.first_per_key(stream.open_parquet(spark, str(tmp_path / "e")), ["event_type"], "1 day").select("event_type"), "t4", "append").count() == 2
    assert stream.drain(stream.sessions(stream.open_parquet(spark, str(tmp_path / "e"))), "t3", "complete").count() == 2


def test_folders_snapshots_and_exports(spark, tmp_path):
    for name in ("b.txt", "a.txt", "sub/c.txt"):
        (tmp_path / "d" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "d" / name).write_text("x")
    page, more = R.list_folder(spark, str(tmp_path / "d"), limit=1)
    assert [r.path for r in page.collect()] == ["a.txt"] and more
    page, more = R.list_folder(spark, str(tmp_path / "d"), recursive=True)
    assert page.count() == 3 and not more
    rows = spark.createDataFrame([(1, "x")], "id long, v string")
    R.snapshot({"t": rows}, str(tmp_path / "snap"))
    with pytest.raises(PySparkException):
        R.snapshot({"t": rows}, str(tmp_path / "snap"))
    assert R.restore(spark, str(tmp_path / "snap"), ["t"])["t"].collect() == rows.collect()
    with pytest.raises(ValueError, match="total"):
        R.export_checked(rows, str(tmp_path / "e1"), {"total": (F.count("*"), 2)})
    R.export_checked(rows, str(tmp_path / "e2"), {"total": (F.count("*"), 1)})
    (tmp_path / "index.json").write_text('[{"id": "art_1", "kind": "k", "tags": ["a"]}]')
    assert R.read_index(spark, str(tmp_path / "index.json")).first().tags == ["a"]


def test_redaction_by_key(spark):
    got = one(spark, '{"a": {"dbPassword": "xy\\"zabc", "n": 1.50}, "token": 5, "list": [{"apiKey": null}], "passwords": {"k": "v"}, "say": "token: 1"}', J.redacted)
    assert json.loads(got) == {"a": {"dbPassword": 'xy"z***redacted***', "n": 1.5}, "token": "***redacted***", "list": [{"apiKey": "***redacted***"}], "passwords": "***redacted***", "say": "token: 1"}
    assert one(spark, "no json", J.redacted) is None and one(spark, None, J.redacted) is None and one(spark, "", J.redacted) is None


def test_files_with_several_paths_and_variables_are_kept(spark):
    from tidemark.queries import scalars

    many = " ".join(f"b{9 - i}/c.py" for i in range(10))
    files = spark.createDataFrame([(1, "x/b.md a/c.md x/b.md {{z}} {{ a.b }} {{z}}"), (2, many), (3, "none"), (4, None), (5, "{{one}} p/q.r")], "file_id long, file_content string")
    assert sorted(map(tuple, scalars.all_paths(files).collect())) == [(1, "x/b.md a/c.md"), (2, " ".join(many.split()[:8])), (5, "p/q.r")]
    assert sorted(map(tuple, scalars.all_names(files).collect())) == [(1, "z,a.b"), (5, "one")]


def test_intermediate_tables_go_when_they_are_released(spark):
    import glob

    from tidemark.common import release, shared_folder, stored

    release(spark)
    kept = stored(spark.range(5).toDF("id"))
    assert kept.count() == 5
    folder = shared_folder(spark).removeprefix("file:")
    assert len(glob.glob(f"{folder}/table-*")) == 1
    assert release(spark) == 1 and not glob.glob(f"{folder}/table-*") and release(spark) == 0


def test_spreading_runs_no_job(spark, tmp_path):
    from tidemark.common import spread

    spark.range(100).withColumn("k", F.col("id") % 7).write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    spread(df.join(df.groupBy("k").count(), "k")), spread(df.where("id > 3"))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
