"""Seeded databases of two domains, any number of rows, from hashes of row numbers: the same on every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTRIES = ["Germany", "France", "Spain", "Poland", "Japan", "Brazil"]
FIRST_DAY, DAYS, MONTHS = "2022-01-01", 1095, 6


def _u(seed: int, name: str) -> Column:
    """A number in [0, 1) for a row and a column's name."""
    return F.pmod(F.xxhash64("id", F.lit(f"{seed}:{name}")), F.lit(1 << 30)) / float(1 << 30)


def _of(values: list[str], seed: int, name: str) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.floor(_u(seed, name) * len(values)).cast("int"))


def _whole(low: int, high: int, seed: int, name: str) -> Column:
    return (F.floor(_u(seed, name) * (high - low + 1)) + low).cast("long")


def _amount(low: float, high: float, seed: int, name: str) -> Column:
    return F.round(_u(seed, name) * (high - low) + low, 2)


def _day(seed: int, name: str) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), F.floor(_u(seed, name) * DAYS).cast("int"))


def supply_chain(spark: SparkSession, seed: int, orders: int = 400) -> dict[str, DataFrame]:
    """suppliers, products, warehouses, inventory, purchase_orders, shipments and demand_forecast."""
    few, some = max(4, orders // 20), max(6, orders // 10)
    made = {
        "suppliers": spark.range(1, few + 1).select(
            F.col("id").alias("supplier_id"), F.concat(F.lit("Supplier "), F.col("id")).alias("name"), _of(COUNTRIES, seed, "country").alias("country"), F.round(_u(seed, "rating") * 2 + 3, 1).alias("rating"), _whole(3, 60, seed, "lead").alias("lead_time_days")),
        "products": spark.range(1, some + 1).select(
            F.col("id").alias("product_id"), F.concat(F.lit("Product "), F.col("id")).alias("name"), _of(["bearings", "pumps", "valves", "motors"], seed, "category").alias("category"), _amount(2, 400, seed, "cost").alias("unit_cost"), _whole(20, 300, seed, "reorder").alias("reorder_point")),
        "warehouses": spark.range(1, 6).select(F.col("id").alias("warehouse_id"), F.concat(F.lit("City "), F.col("id")).alias("city"), _whole(2_000, 20_000, seed, "capacity").alias("capacity")),
        "inventory": spark.range(1, 5 * some + 1).select((F.col("id") % some + 1).alias("product_id"), (F.floor(F.col("id") / some) % 5 + 1).cast("long").alias("warehouse_id"), _whole(0, 200, seed, "hand").alias("quantity_on_hand"), _day(seed, "counted").alias("last_counted")),
    }
    ordered, promised = _day(seed, "ordered"), F.date_add("order_date", _whole(5, 40, seed, "promised").cast("int"))
    status = F.when(_u(seed, "status") < 0.7, "received").when(_u(seed, "status") < 0.9, "open").otherwise("cancelled")
    made["purchase_orders"] = spark.range(1, orders + 1).select(
        "id", F.col("id").alias("po_id"), _whole(1, few, seed, "supplier").alias("supplier_id"), _whole(1, some, seed, "product").alias("product_id"), _whole(1, 500, seed, "quantity").alias("quantity"), _amount(2, 500, seed, "price").alias("unit_price"), ordered.alias("order_date"), status.alias("status"),
    ).withColumn("promised_date", promised).withColumn("received_date", F.when(F.col("status") == "received", F.date_add("promised_date", _whole(-6, 9, seed, "received").cast("int")))).drop("id")
    made["shipments"] = spark.range(1, orders + 1).select(
        "id", F.col("id").alias("shipment_id"), _whole(1, orders, seed, "shipped").alias("po_id"), _of(["Blue Line", "Norda", "Quick Freight"], seed, "carrier").alias("carrier"), _amount(20, 3_000, seed, "freight").alias("freight_cost"), _day(seed, "ship").alias("ship_date"),
    ).withColumn("delivery_date", F.date_add("ship_date", _whole(1, 21, seed, "days").cast("int"))).drop("id")
    made["demand_forecast"] = spark.range(0, MONTHS * some).select((F.floor(F.col("id") / MONTHS) + 1).cast("long").alias("product_id"), F.date_format(F.add_months(F.lit(FIRST_DAY).cast("date"), (F.col("id") % MONTHS).cast("int")), "yyyy-MM").alias("month"), _whole(0, 900, seed, "forecast").alias("forecast_units"), _whole(0, 900, seed, "actual").alias("actual_units"))
    return made


def finance(spark: SparkSession, seed: int, transactions: int = 800) -> dict[str, DataFrame]:
    """customers, accounts, transactions, loans, repayments and gl_entries."""
    people = max(10, transactions // 10)
    return {
        "customers": spark.range(1, people + 1).select(F.col("id").alias("customer_id"), F.concat(F.lit("Customer "), F.col("id")).alias("name"), _of(["retail", "business", "private"], seed, "segment").alias("segment"), _of(COUNTRIES, seed, "home").alias("country"), _of(["low", "medium", "high"], seed, "risk").alias("risk_rating")),
        "accounts": spark.range(1, 2 * people + 1).select(F.col("id").alias("account_id"), (F.col("id") % people + 1).alias("customer_id"), _of(["checking", "savings", "credit"], seed, "type").alias("account_type"), _amount(-500, 50_000, seed, "balance").alias("balance"), _day(seed, "opened").alias("opened_date")),
        "transactions": spark.range(1, transactions + 1).select(F.col("id").alias("txn_id"), _whole(1, 2 * people, seed, "account").alias("account_id"), _day(seed, "txn").alias("txn_date"), _amount(1, 9_000, seed, "amount").alias("amount"), _of(["debit", "credit"], seed, "side").alias("txn_type"), _of(["card", "wire", "branch", "app"], seed, "channel").alias("channel"), _of(["grocery", "travel", "fuel", "utilities", "services"], seed, "merchant").alias("merchant_category")),
        "loans": spark.range(1, people + 1).select(F.col("id").alias("loan_id"), _whole(1, people, seed, "borrower").alias("customer_id"), _amount(1_000, 300_000, seed, "principal").alias("principal"), F.round(_u(seed, "rate") * 9 + 1, 2).alias("interest_rate"), (_whole(1, 10, seed, "term") * 12).alias("term_months"), _of(["active", "paid", "default"], seed, "loan").alias("status"), _day(seed, "origin").alias("origination_date")),
        "repayments": spark.range(1, transactions + 1).select(
            "id", F.col("id").alias("repayment_id"), _whole(1, people, seed, "paid_loan").alias("loan_id"), _day(seed, "due").alias("due_date"), _amount(50, 4_000, seed, "owed").alias("amount_due"), (_u(seed, "unpaid") < 0.1).alias("_open"),
        ).select("repayment_id", "loan_id", "due_date", F.when(~F.col("_open"), F.date_add("due_date", _whole(-4, 12, seed, "delay").cast("int"))).alias("paid_date"), "amount_due", F.when(F.col("_open"), 0.0).when(_u(seed, "short") < 0.1, F.round(F.col("amount_due") / 2, 2)).otherwise(F.col("amount_due")).alias("amount_paid")),
        # an entry is a debit or a credit, the other is 0
        "gl_entries": spark.range(1, transactions + 1).select("id", _u(seed, "entry").alias("_side"), _amount(10, 20_000, seed, "entry_amount").alias("_amount")).select(
            F.col("id").alias("entry_id"), _of(["4000", "5000", "6100", "7200"], seed, "code").alias("account_code"), _day(seed, "entered").alias("entry_date"), F.when(F.col("_side") < 0.5, F.col("_amount")).otherwise(0.0).alias("debit"), F.when(F.col("_side") >= 0.5, F.col("_amount")).otherwise(0.0).alias("credit"), _of(["sales", "support", "research"], seed, "center").alias("cost_center")),
    }


def schema_ddl(tables: dict[str, DataFrame]) -> str:
    """CREATE TABLE statements of the tables, in the order of their names."""
    kinds = {"bigint": "INTEGER", "double": "REAL", "date": "DATE", "string": "TEXT"}
    return "\n".join(f"CREATE TABLE {name} ({', '.join(f'{f.name} {kinds[f.dataType.simpleString()]}' for f in df.schema.fields)});" for name, df in sorted(tables.items()))


def as_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
