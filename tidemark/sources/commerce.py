"""Orders and customers seen as users, activity and payments.

A customer registers with the first order; every order is an active day; orders of
customers on a paid plan are payments.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import Model, Rules

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

# Orders are months apart, so the windows are longer than for a daily product.
RULES = Rules(
    periods=(30, 90, 365),
    activation_days=90,
    activation_events=2,
    retention_days=365,
    maturity_days=365,
    channels=SEGMENTS,
)


# Columns that are read; naming them saves a pass over the file footers.
COLUMNS = {
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
}


PLAN = """
    CASE WHEN c_acctbal < 2000 THEN 'Free'
         WHEN c_acctbal < 5000 THEN 'Basic'
         WHEN c_acctbal < 8000 THEN 'Pro'
         ELSE 'Enterprise' END
"""
SUBSCRIPTION_TYPE = "if(o_orderpriority IN ('1-URGENT', '2-HIGH'), 'Annual', 'Monthly')"
PAYMENT_STATUS = """
    CASE o_orderstatus WHEN 'F' THEN 'Success' WHEN 'O' THEN 'Failed' ELSE 'Refunded' END
"""


def commerce_model(spark: SparkSession, folder: str) -> Model:
    def table(name: str) -> DataFrame:
        return spark.read.schema(COLUMNS[name]).parquet(f"{folder}/{name}.parquet")

    orders = table("orders").selectExpr("*", "CAST(o_orderdate AS DATE) AS day")
    customers = table("customer").selectExpr("*", f"{PLAN} AS plan")

    first_order = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("day").alias("register_date")
    )
    users = (
        customers.join(first_order, "c_custkey")
        .join(table("nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
        .selectExpr(
            "c_custkey AS user_id",
            "register_date",
            "n_name AS country",
            "element_at(array('Desktop', 'Mobile', 'Tablet'), int(c_custkey % 3) + 1)"
            " AS device_type",
            "c_mktsegment AS acquisition_channel",
            "plan AS plan_type",
            "element_at(array('1-10', '11-50', '51-200', '201-1000', '1000+'),"
            " int(c_custkey % 5) + 1) AS company_size",
        )
    )
    activity = orders.selectExpr(
        "o_orderkey AS activity_id",
        "o_custkey AS user_id",
        "day AS activity_date",
        "CAST(NULL AS INT) AS session_duration",
        "CAST(NULL AS INT) AS pages_viewed",
        "CAST(NULL AS STRING) AS feature_used",
        "o_orderdate AS stored_time",
    )
    # what the plan calls Free, on the stored column
    payers = customers.where("c_acctbal >= 2000 OR c_acctbal IS NULL").selectExpr("c_custkey AS user_id")
    payments = orders.selectExpr(
        "o_orderkey AS subscription_id",
        "o_custkey AS user_id",
        "day AS payment_date",
        "o_totalprice AS amount",
        f"{SUBSCRIPTION_TYPE} AS subscription_type",
        f"{PAYMENT_STATUS} AS payment_status",
        "o_orderstatus AS stored_status",
    )
    return Model(
        users, activity, payments.join(payers, "user_id", "left_semi"),
        activity_time="stored_time", payments=payments, payers=payers, success="stored_status = 'F'",
    )
