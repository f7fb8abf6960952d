"""Keys, references, CSV and parquet round trips, catalog listings."""

import pytest

from tests.data import hand_rows, to_model
from tidemark.operators import quality
from tidemark.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_duplicate_and_missing_keys(spark):
    data = hand_rows()
    data["users"] += [data["users"][0], data["users"][0], (None, *data["users"][1][1:])]
    got = rows(quality.pk_violations(to_model(spark, data)))
    assert got == [
        ("activity", "activity_id", 0, 0),
        ("subscription", "subscription_id", 0, 0),
        ("users", "user_id", 1, 1),
    ]
    with pytest.raises(ValueError, match="primary key"):
        quality.require_keys(to_model(spark, data))


def test_orphans_count_rows_and_include_null_users(spark):
    data = hand_rows()
    first = data["activity"][0]
    data["activity"] += [("X1", "ghost", *first[2:]), ("X2", "ghost", *first[2:]), ("X3", None, *first[2:])]
    assert rows(quality.orphan_activity(to_model(spark, data))) == [("activity", 3)]
    assert rows(quality.orphan_subscription(to_model(spark, data))) == [("subscription", 0)]


def test_csv_round_trip(spark, hand, tmp_path):
    files.write_csv_model(hand, str(tmp_path))
    loaded = files.load_csv_model(spark, str(tmp_path))
    for name, df in hand.tables().items():
        assert loaded.tables()[name].schema == df.schema
        assert rows(loaded.tables()[name]) == rows(df)


def test_csv_columns_are_taken_by_position(spark, tmp_path):
    (tmp_path / "u.csv").write_text(
        "id,since,c,d,ch,p,s\nU1,2024-01-02,US,Desktop,Email,Free,1-10\n", encoding="utf-8"
    )
    got = files.load_users(spark, str(tmp_path / "u.csv")).first()
    assert got.user_id == "U1" and str(got.register_date) == "2024-01-02"


def test_csv_that_does_not_fit_the_schema_fails(spark, tmp_path):
    header = ",".join(f.name for f in files.SUBSCRIPTION)
    (tmp_path / "s.csv").write_text(f"{header}\nS1,U1,2024-01-02,a lot,Monthly,Success\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.load_subscription(spark, str(tmp_path / "s.csv")).collect()


def test_lines_that_do_not_fit_are_put_aside(spark, hand, tmp_path):
    files.write_csv_table(hand, "subscription", str(tmp_path))
    (tmp_path / "subscription.csv" / "more.csv").write_text(
        ",".join(f.name for f in files.SUBSCRIPTION) + "\nS8,U1,2024-01-02,5.5,Monthly,Success\nS9,U1,2024-01-02,a lot,Monthly,Success\n"
        "S10,U1,no day,1.0,Monthly,Success\nS11,U1\n", encoding="utf-8",
    )
    got = files.load_checked(spark, "subscription", str(tmp_path / "subscription.csv"), str(tmp_path / "sorted"))
    known = rows(hand.subscription)
    assert got.rows.count() == len(known) + 1 and "S8" in {r.subscription_id for r in got.rows.collect()}
    assert got.rows.schema == hand.subscription.schema
    assert sorted(r.line.split(",")[0] for r in got.rejected.collect()) == ["S10", "S11", "S9"]
    counts = {r.file.split("/")[-1]: (r.loaded, r.rejected) for r in got.counts.collect()}
    assert counts.pop("more.csv") == (1, 3)
    assert sum(a for a, _ in counts.values()) == len(known) and all(b == 0 for _, b in counts.values())


def test_integrity_report_names_the_offenders(spark):
    data = hand_rows()
    data["users"] += [data["users"][0], (None, *data["users"][1][1:])]
    data["activity"] += [("X1", "ghost", *data["activity"][0][2:]), ("X1", None, *data["activity"][0][2:])]
    got = {tuple(r) for r in quality.integrity_report(to_model(spark, data)).collect()}
    assert got == {
        ("users", "repeated key", data["users"][0][0], 2), ("users", "missing key", None, 1), ("activity", "repeated key", "X1", 2),
        ("activity", "unknown user", "ghost", 1), ("activity", "unknown user", None, 1),
    }


def test_duplicate_key_stops_the_load(spark, hand, tmp_path):
    files.write_csv_model(hand, str(tmp_path))
    doubled = hand.users.unionAll(hand.users)
    doubled.write.mode("overwrite").option("header", True).csv(str(tmp_path / "users.csv"))
    with pytest.raises(ValueError, match="users"):
        files.load_csv_model(spark, str(tmp_path))


def test_parquet_round_trip(spark, hand, tmp_path):
    files.write_parquet_model(hand, str(tmp_path))
    loaded = files.load_parquet_model(spark, str(tmp_path))
    for name, df in hand.tables().items():
        assert rows(loaded.tables()[name]) == rows(df)


def test_describe_and_list(spark, hand):
    assert ("register_date", "date") in rows(quality.describe_table(hand.users))
    files.register_tables(hand)
    names = [r[0] for r in rows(quality.list_tables(hand))]
    assert {"users", "activity", "subscription"} <= set(names)
    for name in ("users", "activity", "subscription"):
        spark.catalog.dropTempView(name)
