"""One DuckDB statement per metric, written from the definitions.

``statements(rules, base)`` returns ``{name: sql}``. ``base`` holds CTEs that derive
``users``, ``activity`` and ``subscription``; it is empty where those tables exist.
Statements follow the plain definitions (month-range joins, ``ntile``, day windows per
user) rather than the way the Spark code computes the same numbers.
"""

from __future__ import annotations

from tidemark.model import Rules

#: View, the metric it shows, the dashboards it feeds, and its use there.
DASHBOARDS = (
    ("v_mrr_trend", "mrr_arr", "D1 / D4", "MRR and ARR over time"),
    ("v_funnel_summary", "funnel_stages", "D1 / D2", "five-stage funnel"),
    ("v_revenue_by_channel", "revenue_by_channel", "D1 / D4", "revenue share per channel"),
    ("v_revenue_by_plan", "revenue_by_plan", "D1 / D4", "revenue share per plan"),
    ("v_activation_analysis", "activation_analysis", "D2", "activation per channel and plan"),
    ("v_paid_conversion", "paid_conversion_analysis", "D2 / D4", "paid share per channel, device and company size"),
    ("cohort_retention_tableau", "cohort_retention", "D3", "cohort heat map"),
    ("retention_tableau", "retention_long", "D3", "retention curves per channel and tier"),
    ("v_renewal_analysis", "renewal_analysis", "D4", "renewal and mean number of payments"),
)

# ---- building blocks ------------------------------------------------------------


def _round_div(n: str, d: str, scale: int = 1) -> str:
    """``round(scale * n / d)``, half away from zero, on integers."""
    size = f"((2 * {scale} * abs({n}) + ({d})) // nullif(2 * ({d}), 0))"
    return f"CAST(CASE WHEN ({n}) < 0 THEN -{size} ELSE {size} END AS BIGINT)"


def _double(n: str, per_one: int) -> str:
    return f"CAST({n} AS DOUBLE) / CAST({per_one} AS DOUBLE)"


def pct(n: str, d: str) -> str:
    return _double(_round_div(n, d, 10_000), 100)


def avg2(n: str, d: str) -> str:
    return _double(_round_div(n, d, 100), 100)


def money(c: str) -> str:
    return _double(c, 100)


def money_per(c: str, d: str) -> str:
    return money(_round_div(c, d))


def month(day: str) -> str:
    return f"CAST(date_trunc('month', {day}) AS DATE)"


def week(day: str) -> str:
    return f"CAST(date_trunc('week', {day}) AS DATE)"


def big(n: str) -> str:
    return f"CAST({n} AS BIGINT)"


CENTS = "CAST(round(amount * 100) AS BIGINT)"
PAID = "plan_type <> 'Free'"
OK = "payment_status = 'Success'"

NOW = "now AS (SELECT max(activity_date) AS today FROM activity)"
PAYERS = f"""payers AS (
  SELECT user_id, count(*) AS pay_cnt, {big(f'sum({CENTS})')} AS cents,
         min(payment_date) AS first_payment, max(payment_date) AS last_payment
  FROM subscription WHERE {OK} GROUP BY user_id)"""
SPENT = """spent AS (
  SELECT u.*, p.pay_cnt, p.cents FROM users u LEFT JOIN payers p ON p.user_id = u.user_id)"""
COVER = f"""cover AS (
  SELECT user_id, {month('payment_date')} AS first_month,
         CAST({month('payment_date')} + CASE subscription_type WHEN 'Monthly' THEN INTERVAL 0 MONTH
           WHEN 'Annual' THEN INTERVAL 11 MONTH END AS DATE) AS final_month,
         {CENTS} * CASE subscription_type WHEN 'Monthly' THEN 12 WHEN 'Annual' THEN 1 END AS twelfths
  FROM subscription WHERE {OK})"""


def calendar(source: str, extra: int) -> str:
    return f"""calendar AS (
  SELECT CAST(unnest(generate_series(min(first_month), max(first_month) + INTERVAL {extra} MONTH,
              INTERVAL 1 MONTH)) AS DATE) AS month FROM {source})"""


MRR = """mrr AS (
  SELECT c.month, count(DISTINCT v.user_id) AS paying_users, sum(v.twelfths) AS twelfths
  FROM calendar c LEFT JOIN cover v ON c.month BETWEEN v.first_month AND v.final_month
  GROUP BY c.month)"""


def _facts(rules: Rules, mature: int | None = None) -> str:
    off = "(a.activity_date - u.register_date)"
    act, ret = rules.activation_days, rules.retention_days
    keep = "" if mature is None else f"WHERE u.register_date <= now.today - {mature}"
    return f"""facts AS (
  SELECT u.user_id, u.register_date, u.acquisition_channel, u.plan_type,
         CASE u.plan_type WHEN 'Free' THEN 'Free' ELSE 'Paid' END AS tier,
         now.today - u.register_date AS tenure,
         min(CASE WHEN {off} >= 1 THEN {off} END) AS back,
         count(CASE WHEN {off} BETWEEN 0 AND {act} THEN 1 END) >= {rules.activation_events} AS active,
         coalesce(bool_or({off} BETWEEN 1 AND {ret}), false) AS returned,
         coalesce(bool_or({off} BETWEEN {act + 1} AND {ret}), false) AS stayed
  FROM users u CROSS JOIN now LEFT JOIN activity a ON a.user_id = u.user_id
  {keep}
  GROUP BY ALL)"""


def _hits(flag: str) -> str:
    return f"count(*) FILTER (WHERE {flag})"


def _share(flag: str) -> str:
    return pct(_hits(flag), "count(*)")


def _long(parts: list[tuple[str, str]], table: str, columns: str) -> str:
    """Overall and per-dimension rows, as one aggregate query each."""
    queries = [f"SELECT 'overall' AS segment_type, 'all' AS segment, {columns} FROM {table}"]
    for kind, column in parts:
        queries.append(
            f"SELECT '{kind}' AS segment_type, {column} AS segment, {columns} "
            f"FROM {table} GROUP BY {column}"
        )
    return "\nUNION ALL ".join(queries)


# ---- statements -----------------------------------------------------------------


def statements(rules: Rules = Rules(), base: tuple[str, ...] = ()) -> dict[str, str]:
    def q(select: str, *ctes: str) -> str:
        parts = [*base, *ctes]
        return (f"WITH {', '.join(parts)}\n" if parts else "") + select

    out: dict[str, str] = {}
    out |= _quality(q)
    out |= _growth(q, rules)
    out |= _retention(q, rules)
    out |= _revenue(q)
    out |= _funnel(q, rules)
    out |= _views(q, out, rules)
    return out


def _quality(q) -> dict[str, str]:
    tables = {"users": "user_id", "activity": "activity_id", "subscription": "subscription_id"}
    keys = "\nUNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{k}' AS pk, "
        f"(SELECT count(*) FROM (SELECT {k} FROM {t} WHERE {k} IS NOT NULL GROUP BY {k} "
        f"HAVING count(*) > 1)) AS dup_keys, "
        f"(SELECT count(*) FROM {t} WHERE {k} IS NULL) AS null_keys"
        for t, k in tables.items()
    )

    def orphans(t):
        return (
            f"SELECT '{t}' AS table_name, count(*) AS orphans FROM {t} f "
            f"WHERE NOT EXISTS (FROM users u WHERE u.user_id = f.user_id)"
        )

    out = {
        "pk_violations": q(keys),
        "orphan_activity": q(orphans("activity")),
        "orphan_subscription": q(orphans("subscription")),
        "table_row_counts": q("\nUNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in tables
        )),
        "date_coverage": q("""SELECT (SELECT min(register_date) FROM users) AS first_register,
  (SELECT max(register_date) FROM users) AS last_register,
  min(activity_date) AS first_activity, max(activity_date) AS last_activity FROM activity"""),
        "channel_conversion_check": q(f"""SELECT acquisition_channel, count(*) AS total_users,
  {_hits(PAID)} AS paid_users, {_share(PAID)} AS conversion_pct
  FROM users GROUP BY acquisition_channel"""),
        "payments_sanity": q(f"""SELECT count(*) AS total_records, {_hits(OK)} AS success,
  {_hits("payment_status = 'Failed'")} AS failed, {_hits("payment_status = 'Refunded'")} AS refunded,
  min(payment_date) AS first_payment, max(payment_date) AS last_payment,
  {money(f"sum({CENTS}) FILTER (WHERE {OK})")} AS total_revenue FROM subscription"""),
    }
    for t, k in tables.items():
        out[f"preview_{t}"] = q(f"SELECT * FROM {t} ORDER BY {k} LIMIT 10")
    return out


def _growth(q, rules: Rules) -> dict[str, str]:
    def mix(dim, name):
        total = "(SELECT count(*) FROM users)"
        return q(f"SELECT {dim}, count(*) AS users, {pct('count(*)', total)} AS {name} "
                 f"FROM users GROUP BY {dim}")

    def active(bucket, name, value, days=None):
        recent = "" if days is None else (
            f"WHERE activity_date >= (SELECT max(activity_date) FROM activity) - {days}"
        )
        return (f"SELECT {bucket} AS {name}, count(DISTINCT user_id) AS {value} "
                f"FROM activity {recent} GROUP BY 1")

    def wide(dim, values):
        cells = ", ".join(f"{_hits(f'{dim} = {chr(39)}{v}{chr(39)}')} AS {'_'.join(v.split()).lower()}" for v in values)
        return q(f"SELECT {month('register_date')} AS month, {cells}, count(*) AS total "
                 "FROM users GROUP BY 1")

    daily = active("activity_date", "activity_date", "dau")
    monthly = active(month("activity_date"), "month", "mau")
    signups = f"SELECT {month('register_date')} AS month, count(*) AS new_users FROM users GROUP BY 1"
    to_date = "ROWS UNBOUNDED PRECEDING"
    before = "lag({}, {}) OVER (ORDER BY month)".format

    def cum(source, order, partition=""):
        running = f"sum(new_users) OVER ({partition} ORDER BY {order} {to_date})"
        return q(f"SELECT *, {big(running)} AS cum_users FROM s", f"s AS ({source})")

    by_day = "SELECT register_date, count(*) AS new_users FROM users GROUP BY 1"
    by_channel = f"""SELECT {month('register_date')} AS month, acquisition_channel,
  count(*) AS new_users FROM users GROUP BY 1, 2"""
    return {
        "mix_by_plan": mix("plan_type", "pct"),
        "mix_by_channel": mix("acquisition_channel", "pct"),
        "mix_by_plan_share": mix("plan_type", "share_pct"),
        "mix_by_channel_share": mix("acquisition_channel", "share_pct"),
        "total_registered": q("SELECT count(*) AS total_registered FROM users"),
        "dau": q(daily),
        "dau_recent_stats": q(
            f"SELECT CAST({_round_div('sum(dau)', 'count(dau)')} AS DOUBLE) AS avg_dau_30d, "
            "max(dau) AS peak_dau, min(dau) AS min_dau FROM d",
            f"d AS ({active('activity_date', 'activity_date', 'dau', 30)})",
        ),
        "top_dau_days": q("SELECT * FROM d ORDER BY dau DESC, activity_date LIMIT 10",
                          f"d AS ({daily})"),
        "wau": q(active(week("activity_date"), "week_start", "wau")),
        "wau_recent": q(active(week("activity_date"), "week_start", "wau", 56)),
        "mau": q(monthly),
        "mau_mom": q(
            f"SELECT month, mau, prev_mau, {pct('mau - prev_mau', 'prev_mau')} AS mom_pct FROM p",
            f"m AS ({monthly})", f"p AS (SELECT *, {before('mau', 1)} AS prev_mau FROM m)",
        ),
        "stickiness": q(
            f"""SELECT m.month, CAST({_round_div('sum(d.dau)', 'count(*)')} AS DOUBLE) AS avg_dau,
  m.mau, {pct('sum(d.dau)', 'count(*) * m.mau')} AS stickiness_pct
  FROM m JOIN d ON {month('d.activity_date')} = m.month GROUP BY m.month, m.mau""",
            f"d AS ({daily})", f"m AS ({monthly})",
        ),
        "signups_daily": q(by_day),
        "signups_monthly": q(signups),
        "signups_monthly_cum": cum(signups, "month"),
        "signups_monthly_by_channel": wide("acquisition_channel", rules.channels),
        "signups_monthly_by_plan": wide("plan_type", rules.plans),
        "signups_monthly_channel_long": q(by_channel),
        "cum_users_daily": cum(by_day, "register_date"),
        "cum_users_monthly_mom_yoy": q(
            f"""SELECT month, new_users,
  {big(f'sum(new_users) OVER (ORDER BY month {to_date})')} AS cum_users,
  {pct('new_users - p1', 'p1')} AS mom_pct, {pct('new_users - p12', 'p12')} AS yoy_pct FROM p""",
            f"s AS ({signups})",
            f"p AS (SELECT *, {before('new_users', 1)} AS p1, {before('new_users', 12)} AS p12 FROM s)",
        ),
        "cum_users_by_channel": cum(by_channel, "month", "PARTITION BY acquisition_channel"),
        "headline_kpis": q(
            f"""SELECT (SELECT count(*) FROM users) AS total_users,
  (SELECT count(*) FROM users WHERE {PAID}) AS paid_users,
  count(DISTINCT user_id) FILTER (WHERE activity_date = today) AS dau_today,
  count(DISTINCT user_id) FILTER (WHERE activity_date > today - 7) AS wau,
  count(DISTINCT user_id) FILTER (WHERE activity_date > today - 30) AS mau,
  (SELECT count(*) FROM users, now WHERE register_date > today - 30) AS new_users_30d
  FROM activity, now""", NOW,
        ),
    }


def _retention(q, rules: Rules) -> dict[str, str]:
    last = rules.longest_period

    def rate(n, extra="true"):
        return (_hits(f"tenure >= {n} AND back <= {n} AND {extra}"),
                _hits(f"tenure >= {n} AND {extra}"))

    rates = ", ".join(f"{pct(*rate(n))} AS d{n}_pct" for n in rules.periods)
    eligible = f"{_hits(f'tenure >= {last}')} AS n"
    facts, mature = _facts(rules), _facts(rules, last)
    cells = (
        f"""joined AS (
  SELECT {month('u.register_date')} AS cohort_month, u.user_id,
         date_diff('month', {month('u.register_date')}, {month('a.activity_date')}) AS k
  FROM users u JOIN activity a ON a.user_id = u.user_id)""",
        """cells AS (
  SELECT cohort_month, k, count(DISTINCT user_id) AS active_users
  FROM joined WHERE k >= 0 GROUP BY ALL)""",
        f"""sizes AS (
  SELECT {month('register_date')} AS cohort_month, count(*) AS cohort_users FROM users GROUP BY 1)""",
    )
    tenth = _double(_round_div("active_users", "cohort_users", 1000), 10)
    wide = ", ".join(f'max(CASE WHEN k = {k} THEN {tenth} END) AS "{k}"' for k in range(7))
    periods = "\nUNION ALL ".join(
        f"SELECT *, CAST({n} AS INTEGER) AS period FROM facts" for n in rules.periods
    )
    parts = (("overall", "'all'"), ("channel", "acquisition_channel"), ("tier", "tier"))
    long = "\nUNION ALL ".join(
        f"""SELECT {month('register_date')} AS cohort_month, '{kind}' AS segment_type,
  {column} AS segment, period, {_hits('tenure >= period')} AS cohort_size,
  {_hits('tenure >= period AND back <= period')} AS retained_users,
  {pct(_hits('tenure >= period AND back <= period'), _hits('tenure >= period'))} AS retention_pct
  FROM spread GROUP BY 1, 3, period"""
        for kind, column in parts
    )
    best = "\nUNION ALL ".join(
        f"SELECT '{label}' AS label, acquisition_channel, d{last}_pct, n FROM c "
        f"WHERE d{last}_pct = (SELECT {f}(d{last}_pct) FROM c)"
        for label, f in (("best", "max"), ("worst", "min"))
    )
    points = {
        t: _round_div(*rate(last, f"tier = '{t}'"), 10_000) for t in ("Paid", "Free")
    }
    return {
        "retention_overall": q(f"SELECT {rates} FROM facts", NOW, facts),
        "retention_by_channel": q(
            f"SELECT acquisition_channel, {rates}, {eligible} FROM facts GROUP BY 1", NOW, facts),
        "retention_by_tier": q(
            f"SELECT tier, {rates}, {eligible} FROM facts GROUP BY 1", NOW, facts),
        "retention_d30_by_plan": q(
            f"SELECT plan_type, {eligible}, {pct(*rate(last))} AS d{last}_pct FROM facts GROUP BY 1",
            NOW, facts),
        "cohort_retention": q(
            f"""SELECT cohort_month, CAST(k AS INTEGER) AS months_since_register, cohort_users,
  active_users, {pct('active_users', 'cohort_users')} AS retention_pct
  FROM cells JOIN sizes USING (cohort_month)""", *cells),
        "cohort_retention_wide": q(
            f"""SELECT cohort_month, cohort_users, {wide} FROM cells JOIN sizes USING (cohort_month)
  WHERE k <= 6 GROUP BY cohort_month, cohort_users""", *cells),
        "retention_long": q(long, NOW, facts, f"spread AS ({periods})"),
        "best_worst_channel_d30": q(
            best, NOW, mature,
            f"""c AS (SELECT acquisition_channel, count(*) AS n, {pct(*rate(last))} AS d{last}_pct
  FROM facts GROUP BY 1)"""),
        "paid_free_d30_gap": q(
            f"""SELECT {money('paid')} AS paid_d{last}, {money('free')} AS free_d{last},
  {money('(paid - free)')} AS gap_pp FROM g""", NOW, mature,
            f"g AS (SELECT {points['Paid']} AS paid, {points['Free']} AS free FROM facts)"),
    }


def _revenue(q) -> dict[str, str]:
    cal = calendar("cover", 12)
    mrr_cents = _round_div("twelfths", "12")
    seg = f"""SELECT %s, count(*) AS users, count(pay_cnt) AS paying_users,
  {big('coalesce(sum(cents), 0)')} AS cents FROM spent GROUP BY 1"""
    total = "(SELECT sum(cents) FROM s)"
    users, payers, rev = "users", "paying_users", f"{money('cents')} AS revenue"
    arpu, arppu = f"{money_per('cents', users)} AS arpu", f"{money_per('cents', payers)} AS arppu"
    share = f"{pct('cents', total)} AS revenue_share_pct"
    plan = f"s AS ({seg % 'plan_type'})"
    channel = f"s AS ({seg % 'acquisition_channel'})"
    top = """SELECT u.user_id, u.country, u.acquisition_channel, u.plan_type, u.company_size,
  {} AS lifetime_revenue, {} last_payment
  FROM users u JOIN payers p ON p.user_id = u.user_id ORDER BY p.cents DESC, u.user_id LIMIT 10"""
    pareto = (
        PAYERS,
        "tiles AS (SELECT cents, ntile(100) OVER (ORDER BY cents DESC, user_id) AS t FROM payers)",
        f"""buckets AS (
  SELECT CASE WHEN t = 1 THEN 'Top 1%' WHEN t <= 10 THEN 'Top 10%' WHEN t <= 20 THEN 'Top 20%'
         WHEN t <= 50 THEN 'Top 50%' ELSE 'Bottom 50%' END AS segment,
         CAST(min(t) AS INTEGER) AS sort_order, count(*) AS users, {big('sum(cents)')} AS cents
  FROM tiles GROUP BY 1)""",
        f"""shares AS (
  SELECT *, {_round_div('cents', '(SELECT sum(cents) FROM buckets)', 10_000)} AS share
  FROM buckets)""",
    )
    running = "sum(share) OVER (ORDER BY sort_order ROWS UNBOUNDED PRECEDING)"
    spine = f"""months AS (
  SELECT CAST(unnest(generate_series(min({month('register_date')}), max({month('register_date')}),
              INTERVAL 1 MONTH)) AS DATE) AS month FROM users)"""
    upto = f"SELECT m.month, {{}} FROM months m LEFT JOIN {{}} GROUP BY m.month"
    return {
        "cash_revenue_monthly": q(
            f"""SELECT month, payments, {money('good')} AS revenue, {money('back')} AS refunded,
  {money('(coalesce(good, 0) - coalesce(back, 0))')} AS net_revenue FROM (
  SELECT {month('payment_date')} AS month, count(*) AS payments,
         sum({CENTS}) FILTER (WHERE {OK}) AS good,
         sum({CENTS}) FILTER (WHERE payment_status = 'Refunded') AS back
  FROM subscription GROUP BY 1)"""),
        "mrr_arr": q(
            f"""SELECT month, paying_users, {money(mrr_cents)} AS mrr, {money('twelfths')} AS arr
  FROM mrr""", COVER, cal, MRR),
        "mrr_mom": q(
            f"""SELECT month, {money('c')} AS mrr, {money('p')} AS prev_mrr,
  {pct('c - p', 'p')} AS mom_pct
  FROM (SELECT *, lag(c) OVER (ORDER BY month) AS p FROM (SELECT month, {mrr_cents} AS c FROM mrr))""",
            COVER, cal, MRR),
        "mrr_by_plan": q(
            f"""SELECT c.month AS month_start, v.plan_type,
  {money(_round_div('sum(v.twelfths)', '12'))} AS mrr
  FROM calendar c LEFT JOIN known v ON c.month BETWEEN v.first_month AND v.final_month
  GROUP BY 1, 2""", COVER,
            "known AS (SELECT v.*, u.plan_type FROM cover v JOIN users u ON u.user_id = v.user_id)",
            calendar("known", 12)),
        "arpu_lifetime": q(
            f"""SELECT n AS total_users, paid AS paid_users, {money('c')} AS total_revenue,
  {money_per('c', 'n')} AS arpu, {money_per('c', 'paid')} AS arppu
  FROM (SELECT count(*) AS n, {_hits(PAID)} AS paid,
               (SELECT sum({CENTS}) FROM subscription WHERE {OK}) AS c FROM users)"""),
        "arpu_running": q(
            f"""SELECT month, {big('u')} AS cum_users, {big('p')} AS cum_paid_users,
  {money('c')} AS cum_revenue, {money_per('c', 'u')} AS arpu, {money_per('c', 'p')} AS arppu
  FROM a JOIN b USING (month)""", spine,
            "a AS (" + upto.format(
                f"count(x.user_id) AS u, {_hits('x.' + PAID)} AS p",
                f"users x ON {month('x.register_date')} <= m.month") + ")",
            "b AS (" + upto.format(
                f"coalesce(sum({CENTS}), 0) AS c",
                f"subscription x ON {OK} AND {month('x.payment_date')} <= m.month "
                f"AND {month('x.payment_date')} >= (SELECT min(month) FROM months)") + ")"),
        "paid_conversion_overall": q(
            f"""SELECT count(*) AS total_users, {_hits(PAID)} AS paid_users,
  {_share(PAID)} AS conversion_pct FROM users"""),
        "paid_pct_overall": q(
            f"""SELECT count(*) AS total_users, {_hits(PAID)} AS paid_users,
  {_share(PAID)} AS paid_pct FROM users"""),
        "paid_conversion_by_cohort": q(
            f"""SELECT {month('register_date')} AS register_month, count(*) AS users,
  {_hits(PAID)} AS paid, {_share(PAID)} AS conversion_pct FROM users GROUP BY 1"""),
        "revenue_by_plan_detail": q(
            f"SELECT plan_type, users, paying_users, {rev}, {share}, {arppu} FROM s",
            f"""s AS (SELECT u.plan_type, count(DISTINCT u.user_id) AS users,
  count(DISTINCT x.user_id) AS paying_users,
  {big(f'coalesce(sum({CENTS}) FILTER (WHERE {OK}), 0)')} AS cents
  FROM users u LEFT JOIN subscription x ON x.user_id = u.user_id GROUP BY 1)"""),
        "revenue_by_channel": q(
            f"""SELECT acquisition_channel, users, paying_users,
  {pct('paying_users', 'users')} AS conversion_pct, {rev}, {arpu}, {arppu}, {share} FROM s""",
            PAYERS, SPENT, channel),
        "revenue_by_plan": q(
            f"SELECT plan_type, users, paying_users, {rev}, {share}, {arppu} FROM s",
            PAYERS, SPENT, plan),
        "arpu_arppu_by_plan": q(
            f"SELECT plan_type, users, paying_users, {arpu}, {arppu} FROM s", PAYERS, SPENT, plan),
        "arppu_by_plan": q(
            f"SELECT plan_type, paying_users, {rev}, {arppu} FROM s WHERE paying_users > 0",
            PAYERS, SPENT, plan),
        "top_channels_by_revenue": q(
            f"""SELECT acquisition_channel, {rev} FROM s WHERE paying_users > 0
  ORDER BY cents DESC, acquisition_channel LIMIT 3""", PAYERS, SPENT, channel),
        "top_customers": q(
            top.format(money("p.cents"), "p.pay_cnt AS payment_count, p.first_payment, p."), PAYERS),
        "top_customers_table": q(
            top.format(money("p.cents"), "p.pay_cnt AS payments, p."), PAYERS),
        "revenue_pareto": q(
            f"""SELECT segment, sort_order, users, {rev}, {money('share')} AS share_pct
  FROM shares""", *pareto),
        "pareto_running_share": q(
            f"""SELECT segment, sort_order, users, {rev}, {money('share')} AS share_pct,
  {money(running)} AS cum_share_pct FROM shares""", *pareto),
    }


def _funnel(q, rules: Rules) -> dict[str, str]:
    mature = _facts(rules, rules.maturity_days)
    segment = "CASE WHEN active THEN 'Activated' ELSE 'Not Activated' END AS segment"

    def rate(flag, users, hits, name):
        return f"count(*) AS {users}, {_hits(flag)} AS {hits}, {_share(flag)} AS {name}"

    def over(columns, dim=None):
        head, tail = (f"{dim}, ", " GROUP BY 1") if dim else ("", "")
        return q(f"SELECT {head}{columns} FROM facts{tail}", NOW, mature)

    activation = rate("active", "users", "activated", "activation_pct")
    retention = rate("returned", "users", "retained", "retention_pct")
    stayed = rate("stayed", "users", "retained", "retention_pct")
    paid = rate(PAID, "users", "paid", "paid_pct")
    renewal = rate("pay_cnt >= 2", "paying_users", "renewed", "renewal_pct")
    renewal_long = rate("pay_cnt >= 2", "paying_users", "renewed_users", "renewal_pct")
    average = f"{avg2('sum(pay_cnt)', 'count(*)')} AS avg_payments"
    payers = "p AS (SELECT u.*, x.pay_cnt FROM users u JOIN payers x ON x.user_id = u.user_id)"

    flags = ["true", "active", "stayed", PAID, "coalesce(pay_cnt >= 2, false)"]
    names = ["Registered", "Activated", "Retained", "Paid", "Renewed"]
    stages = "\nUNION ALL ".join(
        f"SELECT {i + 1} AS step_order, '{name}' AS stage, "
        f"{_hits(' AND '.join(flags[:i + 1]))} AS users FROM joined"
        for i, name in enumerate(names)
    )
    funnel = (
        NOW, mature, PAYERS,
        """joined AS (
  SELECT f.*, x.pay_cnt FROM facts f LEFT JOIN payers x ON x.user_id = f.user_id)""",
        f"stages AS ({stages})",
        """steps AS (
  SELECT *, lag(users) OVER (ORDER BY step_order) AS before,
         first_value(users) OVER (ORDER BY step_order) AS base FROM stages)""",
    )
    step = f"CASE step_order WHEN 1 THEN 100.0::DOUBLE ELSE {pct('users', 'before')} END"
    whole = f"CASE step_order WHEN 1 THEN 100.0::DOUBLE ELSE {pct('users', 'base')} END"
    return {
        "activation_overall": over(
            rate("active", "eligible_users", "activated_users", "activation_pct")),
        "activation_by_channel": over(activation, "acquisition_channel"),
        "activation_by_plan": over(activation, "plan_type"),
        "activation_analysis": q(
            _long([("channel", "acquisition_channel"), ("plan", "plan_type")], "facts", activation),
            NOW, mature),
        "retention30_overall": over(
            rate("returned", "eligible_users", "retained_users", "retention_pct")),
        "retention30_by_channel": over(retention, "acquisition_channel"),
        "retention30_by_activation": over(retention, segment),
        "retention_after_activation": over(stayed, segment),
        "paid_by_channel": q(f"SELECT acquisition_channel, {paid} FROM users GROUP BY 1"),
        "paid_by_activation": over(paid, segment),
        "activation_lift": over(
            rate("returned", "users", "retained_users", "retention_pct")
            + f", {_hits(PAID)} AS paid_users, {_share(PAID)} AS paid_pct", segment),
        "paid_conversion_analysis": q(
            _long([("channel", "acquisition_channel"), ("device", "device_type"),
                   ("company_size", "company_size")], "users", paid)),
        "renewal_overall": q(f"SELECT {renewal}, {average} FROM payers", PAYERS),
        "renewal_by_plan": q(
            f"SELECT plan_type, {renewal}, {average} FROM p GROUP BY 1", PAYERS, payers),
        "renewal_by_channel": q(
            f"SELECT acquisition_channel, {renewal} FROM p GROUP BY 1", PAYERS, payers),
        "renewal_by_value_segment": q(
            f"""SELECT CASE WHEN t = 1 THEN 'Top 10% (whales)' WHEN t <= 5 THEN 'Top 11-50% (mid)'
  ELSE 'Bottom 50% (tail)' END AS value_segment, count(*) AS users,
  {money_per('sum(cents)', 'count(cents)')} AS avg_lifetime_rev, {_hits('pay_cnt >= 2')} AS renewed,
  {_share('pay_cnt >= 2')} AS renewal_pct FROM tiles GROUP BY 1""", PAYERS,
            "tiles AS (SELECT *, ntile(10) OVER (ORDER BY cents DESC, user_id) AS t FROM payers)"),
        "renewal_analysis": q(
            _long([("channel", "acquisition_channel"), ("plan", "plan_type")], "p",
                  f"{renewal_long}, {average}"), PAYERS, payers),
        "funnel_stages": q(
            f"""SELECT CAST(step_order AS INTEGER) AS step_order, stage, users,
  {step} AS step_conversion_pct, {whole} AS overall_conversion_pct FROM steps""", *funnel),
        "funnel_summary": q(
            f"SELECT stage, users, {step} AS step_pct, {whole} AS overall_pct FROM steps", *funnel),
    }


def _views(q, known: dict[str, str], rules: Rules) -> dict[str, str]:
    def sub(name: str) -> str:
        return f"({known[name]})"

    counts = "\nUNION ALL ".join(
        f"SELECT '{view}' AS view_name, count(*) AS row_count FROM {sub(metric)}"
        for view, metric, _, _ in DASHBOARDS
    )
    manifest = "\nUNION ALL ".join(
        f"""SELECT '{view}' AS view_name, '{dashboard}' AS dashboard, count(*) AS rows,
  '{use}' AS primary_use FROM {sub(metric)}"""
        for view, metric, dashboard, use in DASHBOARDS
    )
    sizes = ("1-10", "11-50", "51-200", "201-1000", "1000+")
    order = " ".join(f"WHEN '{size}' THEN {i + 1}" for i, size in enumerate(sizes))
    mean = {
        name: money(_round_div(f"(SELECT sum({column}) FROM h)", f"(SELECT count({column}) FROM h)"))
        for name, column in (("conversion", "c"), ("arpu", "a"))
    }
    cards = {
        "total_users": "CAST(total_users AS DOUBLE)",
        "mau": "CAST(mau AS DOUBLE)",
        "mrr": f"""(SELECT mrr FROM {sub('mrr_arr')} WHERE month =
    (SELECT {month('max(payment_date)')} FROM subscription WHERE {OK}))""",
        "arpu": f"(SELECT arpu FROM {sub('arpu_lifetime')})",
        "conversion_pct": f"(SELECT conversion_pct FROM {sub('paid_conversion_overall')})",
        "renewal_pct": f"(SELECT renewal_pct FROM {sub('renewal_overall')})",
    }
    last = rules.longest_period
    return {
        "view_mrr_trend": q(f"SELECT * RENAME (month AS month_start) FROM {sub('mrr_arr')}"),
        "ensure_views": counts,
        "export_manifest": manifest,
        "export_view_csv": known["cohort_retention"],
        "latest_kpi_cards": q(
            "\nUNION ALL ".join(f"SELECT '{k}' AS kpi, {v} AS value FROM h" for k, v in cards.items()),
            f"h AS (FROM {sub('headline_kpis')})"),
        "channel_quality_quadrants": q(
            f"""SELECT acquisition_channel, users, {money('c')} AS conversion_pct,
  {money('a')} AS arpu, {mean['conversion']} AS avg_conversion_pct, {mean['arpu']} AS avg_arpu
  FROM h""", PAYERS, SPENT,
            f"""s AS (SELECT acquisition_channel, count(*) AS users, count(pay_cnt) AS paying_users,
  coalesce(sum(cents), 0) AS cents FROM spent GROUP BY 1)""",
            f"""h AS (SELECT *, {_round_div('paying_users', 'users', 10_000)} AS c,
  {_round_div('cents', 'users')} AS a FROM s)"""),
        "paid_by_company_size": (
            f"SELECT *, CAST(CASE segment {order} END AS INTEGER) AS size_order "
            f"FROM {sub('paid_conversion_analysis')} WHERE segment_type = 'company_size'"),
        "slice_activation_by_channel":
            f"FROM {sub('activation_analysis')} WHERE segment_type = 'channel'",
        "slice_activation_by_plan":
            f"FROM {sub('activation_analysis')} WHERE segment_type = 'plan'",
        "slice_renewal_by_plan": f"FROM {sub('renewal_analysis')} WHERE segment_type = 'plan'",
        "slice_retention_overall": f"""FROM {sub('retention_long')}
  WHERE segment_type = 'overall' AND period = {last}""",
        "slice_retention_channel_curves":
            f"FROM {sub('retention_long')} WHERE segment_type = 'channel'",
        "slice_retention_tier_by_period":
            f"FROM {sub('retention_long')} WHERE segment_type = 'tier'",
        **{
            f"slice_retention_card_{k}":
                f"FROM {sub('retention_long')} WHERE segment_type = 'overall' AND period = {n}"
            for k, n in card_periods(rules).items()
        },
        "slice_activation_channels": f"""FROM {sub('activation_analysis')}
  WHERE segment_type <> 'channel' OR segment IN {tuple(rules.channels[:2])}""",
        "slice_renewal_plans": f"""FROM {sub('renewal_analysis')}
  WHERE segment_type <> 'plan' OR segment IN {tuple(rules.plans[1:3])}""",
        "slice_cohort_m12": f"FROM {sub('cohort_retention')} WHERE months_since_register <= 12",
        "slice_mrr_range": f"""SELECT * RENAME (month AS month_start) FROM {sub('mrr_arr')}
  WHERE month BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""",
    }


def card_periods(rules) -> dict[str, int]:
    """The periods of the dashboard's retention cards."""
    days = sorted(rules.periods)
    return {"short": days[0], "middle": days[len(days) // 2], "long": days[-1]}


# ---- the given tables as users, activity, subscription --------------------------

COMMERCE = (
    """users AS (
  SELECT c.c_custkey AS user_id, min(CAST(o.o_orderdate AS DATE)) AS register_date,
         n.n_name AS country,
         CASE c.c_custkey % 3 WHEN 0 THEN 'Desktop' WHEN 1 THEN 'Mobile' ELSE 'Tablet' END
           AS device_type,
         c.c_mktsegment AS acquisition_channel,
         CASE WHEN c.c_acctbal < 2000 THEN 'Free' WHEN c.c_acctbal < 5000 THEN 'Basic'
              WHEN c.c_acctbal < 8000 THEN 'Pro' ELSE 'Enterprise' END AS plan_type,
         CASE c.c_custkey % 5 WHEN 0 THEN '1-10' WHEN 1 THEN '11-50' WHEN 2 THEN '51-200'
              WHEN 3 THEN '201-1000' ELSE '1000+' END AS company_size
  FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY ALL)""",
    """activity AS (
  SELECT o_orderkey AS activity_id, o_custkey AS user_id,
         CAST(o_orderdate AS DATE) AS activity_date, CAST(NULL AS INTEGER) AS session_duration,
         CAST(NULL AS INTEGER) AS pages_viewed, CAST(NULL AS VARCHAR) AS feature_used
  FROM orders)""",
    """subscription AS (
  SELECT o.o_orderkey AS subscription_id, o.o_custkey AS user_id,
         CAST(o.o_orderdate AS DATE) AS payment_date, o.o_totalprice AS amount,
         CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Annual' ELSE 'Monthly' END
           AS subscription_type,
         CASE o.o_orderstatus WHEN 'F' THEN 'Success' WHEN 'O' THEN 'Failed' ELSE 'Refunded' END
           AS payment_status
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE NOT c.c_acctbal < 2000)""",
)

EVENTS = (
    """users AS (
  SELECT user_id, min(CAST(ts AS DATE)) AS register_date, CAST(NULL AS VARCHAR) AS country,
         CAST(NULL AS VARCHAR) AS device_type, CAST(NULL AS VARCHAR) AS acquisition_channel,
         CAST(NULL AS VARCHAR) AS plan_type, CAST(NULL AS VARCHAR) AS company_size
  FROM events WHERE event_type = 'signup' GROUP BY user_id)""",
    """activity AS (
  SELECT event_id AS activity_id, user_id, CAST(ts AS DATE) AS activity_date FROM events)""",
)


def loaded_tables() -> dict[str, str]:
    """The input tables after a CSV round trip, in which keys become strings."""
    keys = {
        "users": ("user_id",),
        "activity": ("activity_id", "user_id"),
        "subscription": ("subscription_id", "user_id"),
    }
    out = {}
    for name, columns in keys.items():
        casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)
        out[f"load_{name}"] = f"WITH {', '.join(COMMERCE)}\nSELECT * REPLACE ({casts}) FROM {name}"
    return out


def checked_loads() -> dict[str, str]:
    """Lines that do not fit a schema, and keys that break a rule."""
    return {
        "load_counts": f"""WITH {', '.join(COMMERCE)}
SELECT count(*) FILTER (WHERE subscription_id % 10 <> 0) AS loaded, count(*) FILTER (WHERE subscription_id % 10 = 0) AS rejected
FROM subscription""",
        "events_integrity_report": f"""WITH {', '.join(EVENTS)}
SELECT 'activity' AS table_name, 'unknown user' AS problem, CAST(user_id AS VARCHAR) AS key_value, count(*) AS uses
FROM activity a WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.user_id = a.user_id) GROUP BY user_id
UNION ALL
SELECT 'activity', CASE WHEN activity_id IS NULL THEN 'missing key' ELSE 'repeated key' END, CAST(activity_id AS VARCHAR), count(*)
FROM activity GROUP BY activity_id HAVING count(*) > 1 OR activity_id IS NULL
UNION ALL
SELECT 'users', CASE WHEN user_id IS NULL THEN 'missing key' ELSE 'repeated key' END, CAST(user_id AS VARCHAR), count(*)
FROM users GROUP BY user_id HAVING count(*) > 1 OR user_id IS NULL""",
    }
