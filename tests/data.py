"""Small tables for tests: hand-written edge cases and random rows."""

import random
from datetime import date, timedelta

import duckdb

from tidemark import schema
from tidemark.model import Model


def to_model(spark, rows) -> Model:
    return Model(*[spark.createDataFrame(rows[t], s) for t, s in schema.TABLES.items()])


SQL_TYPES = {"string": "VARCHAR", "date": "DATE", "int": "INTEGER", "double": "DOUBLE"}


def to_duckdb(rows) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table, struct in schema.TABLES.items():
        columns = ", ".join(f"{f.name} {SQL_TYPES[f.dataType.simpleString()]}" for f in struct)
        con.execute(f"CREATE TABLE {table} ({columns})")
        if rows[table]:
            marks = ", ".join("?" * len(struct))
            con.executemany(f"INSERT INTO {table} VALUES ({marks})", rows[table])
    return con


def d(text: str) -> date:
    return date.fromisoformat(text)


# user: register date, channel, plan, active day offsets, payments
HAND = {
    "h1": ("2024-03-01", "Organic", "Pro", (0, 0, 7, 8), [
        ("2024-03-01", 35.00, "Monthly", "Success"), ("2024-04-01", 35.00, "Monthly", "Success")]),
    "h2": ("2024-03-01", "Organic", "Pro", (0, 1, 2, 30), [
        ("2024-03-01", 350.10, "Annual", "Success")]),
    "h3": ("2024-03-15", "Email", "Basic", (31,), [("2024-03-15", 12.00, "Monthly", "Failed")]),
    "h4": ("2024-03-15", "Email", "Free", (), []),
    "h5": ("2024-12-02", "Google Ads", "Free", (1,), []),
    "h6": ("2024-12-03", "Social Media", "Basic", (0, 1), [
        ("2024-12-03", 12.00, "Monthly", "Refunded")]),
    "h7": ("2025-01-01", "Social Media", "Free", (0,), []),
    "h8": ("2024-01-31", "Organic", "Enterprise", (0, 1, 1, 3), [
        ("2024-02-01", 99.00, "Monthly", "Success"), ("2024-03-02", 99.00, "Monthly", "Success")]),
    "h9": ("2024-01-31", "Google Ads", "Enterprise", (0, 0, 0), [
        ("2024-02-01", 99.00, "Monthly", "Success"), ("2024-03-02", 99.00, "Monthly", "Success")]),
}


def hand_rows() -> dict:
    users, activity, subscription = [], [], []
    for user, (registered, channel, plan, offsets, payments) in HAND.items():
        start = d(registered)
        users.append((user, start, "US", "Desktop", channel, plan, "1-10"))
        for offset in offsets:
            key = f"A{len(activity):07d}"
            activity.append((key, user, start + timedelta(offset), 10, 3, "Design"))
        for day, amount, kind, status in payments:
            key = f"S{len(subscription):06d}"
            subscription.append((key, user, d(day), amount, kind, status))
    return {"users": users, "activity": activity, "subscription": subscription}


def random_rows(seed: int, n_users: int = 150, messy: bool = False) -> dict:
    """Random rows; ``messy`` adds NULLs, orphans, unknown values and one very busy user."""
    r = random.Random(seed)
    first = date(2023, 1, 1)
    users, activity, subscription = [], [], []

    def maybe(value):
        return None if messy and r.random() < 0.05 else value

    for i in range(n_users):
        users.append((
            f"U{i:05d}", maybe(first + timedelta(int(r.triangular(0, 500, 400)))), "US",
            maybe(r.choice(["Desktop", "Mobile", "Tablet"])),
            maybe(r.choice(schema.CHANNELS)), maybe(r.choice(schema.PLANS)),
            maybe(r.choice(schema.COMPANY_SIZES)),
        ))
    known = {u[0]: u[1] or first for u in users}

    def someone():
        roll = r.random()
        if messy and roll < 0.3:
            return "U00000"
        if messy and roll < 0.35:
            return None
        if messy and roll < 0.40:
            return "ghost"
        return r.choice(users)[0]

    for i in range(n_users * 8):
        user = someone()
        start = known.get(user, first)
        day = start + timedelta(int(r.expovariate(1 / 20)) - (3 if messy else 0))
        activity.append((f"A{i:07d}", user, maybe(day), 5, 2, "Share"))
    for i in range(n_users * 2):
        user = someone()
        start = known.get(user, first)
        kinds = ["Monthly", "Monthly", "Annual"] + (["Weekly"] if messy else [])
        subscription.append((
            f"S{i:06d}", user, maybe(start + timedelta(r.randrange(0, 400))),
            maybe(r.choice([12.0, 35.0, 99.0, round(r.uniform(1, 1200), 2)])),
            r.choice(kinds), r.choice(["Success"] * 8 + ["Failed", "Refunded"]),
        ))
    return {"users": users, "activity": activity, "subscription": subscription}
