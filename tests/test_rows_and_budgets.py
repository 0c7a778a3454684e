import tempfile

from pyspark.sql import functions as F

from graintide.functions import text as T
from graintide.operators import clean, dedup
from graintide.plans import corpus
from graintide.session import table
from graintide.sources import synthetic
from graintide.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_row_ids_keep_the_order_of_ids(spark):
    ids = [-(1 << 63), -5, -1, 0, 1, 7, (1 << 63) - 1]
    made = spark.createDataFrame([(i, h) for i in ids for h in ("0" * 64, "f" * 64)], "i long, h string").select("i", "h", dedup.row_id(F.col("i"), F.col("h")).alias("row"))
    found = made.orderBy("row").collect()
    assert [(r["i"], r["h"]) for r in found] == [(i, h) for i in ids for h in ("0" * 64, "f" * 64)] and len({r["row"] for r in found}) == len(found)


def test_repeated_ids_drop_no_text_and_make_no_rows(spark):
    """Every id given twice must be judged as if the two had ids of their own, in the order of their texts' digests."""
    docs = table(spark, SF, "documents").select((F.floor(F.col("doc_id") / 2)).cast("long").alias("doc_id"), "doc_id", "source", "text").toDF("pair", "own", "source", "text")
    cleaned = clean.clean_prose(docs.select(F.col("own").alias("doc_id"), "pair", "source", "text"))
    ranked = sorted((r["pair"], r["h"], r["doc_id"]) for r in cleaned.select("doc_id", "pair", F.sha2(T.normalize(F.col("clean_text")), 256).alias("h")).collect())
    numbers = spark.createDataFrame([(own, k) for k, (_, _, own) in enumerate(ranked)], "own long, doc_id long")
    grams = corpus._grams(spark, SF)
    repeated = corpus.judged_documents(docs.select(F.col("pair").alias("doc_id"), "source", "text"), grams)
    unique = corpus.judged_documents(docs.join(numbers, "own").select("doc_id", "source", "text"), grams)
    told = lambda df: sorted(map(repr, df.select("source", "chars", "reason", "bench").collect()))
    assert told(repeated) == told(unique) and repeated.count() == docs.count()
    # rows that are wholly alike share a judgement
    twice = docs.select(F.col("own").alias("doc_id"), "source", "text")
    once = corpus.judged_documents(twice, grams)
    assert told(corpus.judged_documents(twice.union(twice), grams)) == told(once.union(once))


def test_a_hot_source_keeps_its_budget_in_parts(spark):
    """Rows come in parts of 50, so that what is held is cut over and over; the result is that of all at once."""
    folder = tempfile.mkdtemp(prefix="stream-")
    made = spark.range(1200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("source"), F.repeat(F.lit("x"), (F.col("id") * 7 % 23).cast("int")).alias("text"))
    made = made.withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    made.orderBy(F.xxhash64("doc_id")).coalesce(1).write.parquet(f"{folder}/in")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        kept = ingest.within_budget(spark.readStream.schema(made.schema).parquet(f"{folder}/in"), 2_000)
        run = kept.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    expected = set()
    for source in ("hot", "cold"):
        used = 0
        for i in range(1200):
            if (i % 10 > 0) == (source == "hot"):
                if used >= 2_000:
                    break
                expected.add((source, i, used))
                used += i * 7 % 23
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/out").select("source", "doc_id", "before").collect()} == expected


def test_synthetic_tables_have_their_columns_and_keys(spark):
    columns = {
        "suppliers": "supplier_id name country rating lead_time_days", "products": "product_id name category unit_cost reorder_point", "warehouses": "warehouse_id city capacity",
        "inventory": "product_id warehouse_id quantity_on_hand last_counted", "purchase_orders": "po_id supplier_id product_id order_date quantity unit_price status promised_date received_date",
        "shipments": "shipment_id po_id carrier ship_date delivery_date freight_cost", "demand_forecast": "product_id month forecast_units actual_units",
        "customers": "customer_id name segment country risk_rating", "accounts": "account_id customer_id account_type balance opened_date", "transactions": "txn_id account_id txn_date amount txn_type channel merchant_category",
        "loans": "loan_id customer_id principal interest_rate term_months status origination_date", "repayments": "repayment_id loan_id due_date paid_date amount_due amount_paid", "gl_entries": "entry_id account_code entry_date debit credit cost_center",
    }
    made = {**synthetic.supply_chain(spark, 4), **synthetic.finance(spark, 4)}
    assert {n: set(df.columns) for n, df in made.items()} == {n: set(c.split()) for n, c in columns.items()}
    for child, parent, key in (("inventory", "products", "product_id"), ("inventory", "warehouses", "warehouse_id"), ("shipments", "purchase_orders", "po_id"), ("demand_forecast", "products", "product_id"), ("repayments", "loans", "loan_id"), ("accounts", "customers", "customer_id")):
        assert made[child].join(made[parent], key, "left_anti").isEmpty()
    for name, key in (("inventory", ["product_id", "warehouse_id"]), ("demand_forecast", ["product_id", "month"])):
        assert made[name].groupBy(*key).count().where("count > 1").isEmpty()
    entries, paid = made["gl_entries"], made["repayments"]
    assert entries.where("debit > 0 and credit > 0 or debit + credit = 0").isEmpty() and paid.where("paid_date is null and amount_paid > 0").isEmpty()
    share = paid.where("paid_date is null").count() / paid.count()
    assert 0.05 < share < 0.16
