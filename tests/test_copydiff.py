import datetime as dt
import json
import random
import re
from decimal import Decimal

from tidemark.operators.copydiff import INSTANT_FIELDS, NUMERIC_FIELDS, compare_copies, page_differences

SCHEMA = "result_id long, system_label string, target_name string, result_rows array<string>, executed_at timestamp_ntz, extra string, fields string"
T0 = dt.datetime(2026, 1, 1)


def pages(spark, rows):
    return spark.createDataFrame([(i, *r, "x", "clash") for i, r in enumerate(rows)], SCHEMA)


def found(spark, rows, **kw):
    return {tuple(r) for r in page_differences(pages(spark, rows), **kw).collect()}


def test_kinds_names_and_formats(spark):
    legacy = [json.dumps(x) for x in (
        {"id": 1, "amount": 10.5, "created_at": "2026-01-01 10:00:00", "memo": None, "entry_type": "FEE"}, {"id": 2, "amount": 1}, {"id": 3, "memo": "a"}, {"id": 5, "memo": None})]
    modern = [json.dumps(x) for x in (
        {"id": "1", "amount": "10.5000", "createdAt": "2026-01-01T12:00:00+02:00", "entryType": "FEE"}, {"id": 2, "amount": "1.0001"}, {"id": 4}, {"id": 5, "memo": ""})]
    assert found(spark, [(" Legacy", "t", legacy, T0), ("MODERN ", "t", modern, T0)]) == {
        ("t", 2, "amount", "value"), ("t", 3, "*", "missing_in_modern"), ("t", 4, "*", "missing_in_legacy"), ("t", 5, "memo", "value")}


def test_latest_fetch_counts_and_bad_rows_are_left_out(spark):
    rows = [("legacy", "t", ['{"id": 1, "memo": "new"}'], T0), ("modern", "t", ['{"id": 1, "memo": "new"}', "no json", "[1]", '{"memo": 1}', None], T0),
            ("legacy", "t", ['{"id": 1, "memo": "old"}'], T0 - dt.timedelta(1)), ("legacy", "t", None, T0), (None, "t", ['{"id": 9}'], T0), ("other", "t", ['{"id": 8}'], T0), ("legacy", None, ['{"id": 7}'], T0)]
    assert found(spark, rows) == set()


def test_names_that_become_equal(spark):
    rows = [("legacy", "t", ['{"id": 1, "entry_type": "A"}', '{"id": 2, "x": "1", "x": "2"}'], T0), ("modern", "t", ['{"id": 1, "entry_type": "B", "entryType": "A"}', '{"id": 2, "x": "2"}'], T0)]
    assert found(spark, rows) == set()


def test_empty_sides(spark):
    assert found(spark, []) == set()
    assert found(spark, [("legacy", "t", ['{"id": 1}'], T0)]) == {("t", 1, "*", "missing_in_modern")}


def test_against_brute_force_with_few_buckets(spark):
    rnd = random.Random(5)
    rows, last = [], {}
    for system in ("legacy", "modern"):
        for page in range(40):
            at, items = T0 + dt.timedelta(rnd.randrange(9)), []
            for pos in range(10):
                key = rnd.randrange(150)
                row = {"id": key, "amount": rnd.choice([1, 1.0, 2.5]), "memo": rnd.choice(["a", None, "b" * 3000]), "settled_at": rnd.choice([None, "2026-01-01 00:00:00", "2026-01-01T00:00:00Z"])}
                items.append(json.dumps(row))
                order = (at, len(rows), pos)
                if (system, key) not in last or last[system, key][0] < order:
                    last[system, key] = (order, row)
            rows.append((system, "t", items, at))

    def value(n, v):
        if v is None:
            return None
        if n in NUMERIC_FIELDS:
            return Decimal(str(v)).normalize()
        return re.sub("[TZ]", " ", v).strip() if n in INSTANT_FIELDS else v

    want = set()
    for key in range(150):
        a, b = last.get(("legacy", key)), last.get(("modern", key))
        if a and not b:
            want.add(("t", key, "*", "missing_in_modern"))
        elif b and not a:
            want.add(("t", key, "*", "missing_in_legacy"))
        elif a and b:
            want |= {("t", key, n, "value") for n in a[1] if value(n, a[1][n]) != value(n, b[1][n])}
    for buckets in (1, 7, 8192):
        assert found(spark, rows, buckets=buckets) == want


def test_generic_copies_with_null_keys(spark):
    schema = "g string, k long, fields map<string,string>"
    left = spark.createDataFrame([("a", 1, {"x": "1"}), ("a", None, {"x": "1"}), (None, 3, {"x": "1"}), ("b", 2, None)], schema)
    right = spark.createDataFrame([("a", 1, {"x": "2", "*": "odd"}), ("b", 2, {"y": None})], schema)
    assert {tuple(r) for r in compare_copies(left, right, "g", "k").collect()} == {("a", 1, "x", "value")}
