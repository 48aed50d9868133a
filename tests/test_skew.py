from pyspark.sql import functions as F

from ledgerloom.operators.skew import lookup, prepare
from ledgerloom.plans.faithfulness import _is_money, _occurrences
from ledgerloom.operators import candidates as K
from ledgerloom.operators import skew


def test_lookup_with_one_key_on_half_of_the_rows_and_many_without(spark):
    prepare(spark)
    k = F.col("id")
    key = F.when(k % 4 < 2, "hot").when(k % 4 == 2, F.concat(F.lit("k"), (k % 50).cast("string")))
    left = spark.range(20_000).select("id", key.alias("key"))
    right = left.filter("key is not null").select("key").distinct().withColumn("found", F.upper("key"))
    rows = lookup(left, right, ["key"], "id").withColumn("at", F.spark_partition_id())
    got = rows.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("found").eqNullSafe(F.upper("key"))).alias("right"),
        F.count_if((F.col("key") == "hot") & (F.col("found") == "HOT")).alias("hot"),
    ).first()
    assert (got.n, got.right, got.hot) == (20_000, 20_000, 10_000)
    inner = lookup(left, right, ["key"], "id", "inner")
    assert inner.count() == 15_000 and set(inner.columns) == {"id", "key", "found"}


def test_lookup_is_one_plan_at_every_size(spark):
    def plan(n):
        left = spark.range(n).select("id", F.col("id").cast("string").alias("key"))
        right = left.select("key", F.lit(1).alias("x")).groupBy("key").agg(F.max("x").alias("x"))
        text = lookup(left, right, ["key"], "id")._jdf.queryExecution().optimizedPlan().toString()
        return text.count("Join"), text.count("Range")

    assert plan(10) == plan(10_000_000)


def test_context_of_many_decimals_is_bounded(spark):
    n = 3000
    text = "confidence is 90.50 " + "pay 1.25 now " * n + "confidence 70.10. Fee 3.00"
    df = spark.createDataFrame([(text,)], "text string").select(F.explode(_occurrences(F.col("text"))).alias("o"))
    rows = df.select("o.number", _is_money(F.col("o")).alias("money"), F.length("o.before").alias("reach")).collect()
    assert len(rows) == n + 3
    assert [r.money for r in rows[:2]] == [False, True] and [r.money for r in rows[-2:]] == [False, True]
    assert max(r.reach for r in rows) < 600


def test_groups_are_shuffled_once_and_anchors_once_for_a_key(spark):
    from ledgerloom.operators.candidates import exact_groups

    pg = spark.createDataFrame([], "src_pos bigint, txn_id string, utr string, expected_net decimal(18,4), day date")
    bank = spark.createDataFrame(
        [], "src_pos bigint, bank_ref string, txn_id string, utr string, amount decimal(18,4), day date, narration string"
    )
    money = ", ".join(f"{c} decimal(18,4)" for c in ("amount", "fee", "gst", "tds"))
    bills = spark.createDataFrame([], f"src_pos bigint, invoice_id string, txn_id string, {money}, day date")
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.optimizer.excludedRules")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rules = ("PropagateEmptyRelation", "ConvertToLocalRelation")
    spark.conf.set("spark.sql.optimizer.excludedRules", ",".join(f"org.apache.spark.sql.catalyst.optimizer.{r}" for r in rules))
    try:
        plan = exact_groups(pg, bank, bills)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    tree = plan.split("\n\n")[0]
    assert tree.count("Exchange hashpartitioning") == 5  # three groups; anchors by reference and by id


def test_rows_are_not_shuffled_for_a_short_list(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    wanted = spark.createDataFrame([(3,), (3,), (7,), (None,)], "k bigint")
    found = skew.only(rows, wanted, ["k"])
    assert sorted({r.k for r in found.collect()}) == [3, 7] and found.count() == 40
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(skew, "SHORT_LIST", 1)
    long = skew.only(rows, wanted, ["k"])
    assert long.count() == 40 and "Broadcast" not in long._jdf.queryExecution().executedPlan().toString()


def test_anchors_are_wide_only_after_the_gate_is_counted(spark, small, monkeypatch):
    """Totals of the gate are looked up for short rows; the rows with their groups aren't shuffled for them."""
    staged, real = {}, K.stage
    monkeypatch.setattr(K, "stage", lambda df, name: staged.setdefault(name, real(df, name)))
    b = small.batch
    K.candidate_sets(b.pg, b.bank, b.invoice)
    assert "in_gate" in staged["exact-groups"].columns


def test_answers_are_not_joined_with_their_own_decisions(small):
    from ledgerloom.plans.registry import QUERIES

    assert "Join" not in QUERIES["ungrounded_numbers"](small)._jdf.queryExecution().optimizedPlan().toString()
