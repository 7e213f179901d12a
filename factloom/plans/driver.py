"""Graphs of facts projected from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom._cut import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Four tasks a core."""
    return 4 * spark.sparkContext.defaultParallelism


ACT_KEY = "concat('3', year(o_orderdate), substring('RLDHAQXC', cast(o_orderkey % 8 as int) + 1, 1), lpad(cast(o_orderkey % 10000 as string), 4, '0'))"


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: id, celex, dates as text, gap, labels, with missing, sentinel and impossible dates and empty keys at fixed steps."""
    k = "o_orderkey"
    date = "date_format(o_orderdate, 'yyyy-MM-dd')"
    rows = table(spark, sf_dir, "orders").selectExpr(
        f"concat('o:', {k}) as id",
        f"case when {k} % 89 = 0 then '' else {ACT_KEY} end as celex",
        f"case when {k} % 50 = 0 then '' when {k} % 51 = 0 then '1900-01-01' when {k} % 53 = 0 then '2019-02-30' when {k} % 59 = 0 then '2019' else {date} end as date_document",
        f"case when {k} % 3 = 0 then date_format(date_add(cast(o_orderdate as date), cast({k} % 400 as int)), 'yyyy-MM-dd') end as date_end_of_validity",
        f"{k} % 97 = 0 as gap",
        f"array(element_at(array('Regulation', 'Directive', 'Decision', 'Recommendation', 'Agreement', 'RulesOfProcedure', 'OtherAct', 'Communication'), cast(({k} + case when {k} % 20 = 0 then 1 else 0 end) % 8 as int) + 1), 'Work') as labels",
    )
    from factloom.functions import scalars

    return rows.withColumn("date_document_status", scalars.date_status(F.col("date_document"), F.col("celex")))


def act_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, p, o: each order acts on another; some of the repeals are mutual."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    n = orders.count()
    base = orders.selectExpr("o_orderkey as k", f"(o_orderkey * 37 + 11) % {n} as t", "case o_orderkey % 3 when 0 then 'repeals' when 1 then 'amends' else 'based_on' end as p")
    ahead = base.selectExpr("concat('o:', k) as s", "p", "concat('o:', t) as o")
    back = base.where("p = 'repeals' and k % 10 = 0").selectExpr("concat('o:', t) as s", "p", "concat('o:', k) as o")
    return ahead.unionByName(back).distinct()


def numbered(facts: DataFrame) -> DataFrame:
    """Facts with an id that follows from the triple."""
    return facts.select(F.concat(F.lit("f-"), F.substring(F.sha2(F.concat_ws("|", "s", "p", "o"), 256), 1, 16)).alias("id"), "s", "p", "o")


def ships(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(facts line -> order, nodes); a line key that repeats keeps its least date."""
    line = table(spark, sf_dir, "lineitem").selectExpr("concat('l:', l_orderkey, '#', l_linenumber) as s", "concat('o:', l_orderkey) as o", "cast(l_shipdate as date) as d")
    facts = line.select("s", F.lit("ships").alias("p"), "o")
    lines = line.groupBy(F.col("s").alias("id")).agg(F.min("d").alias("d"))
    orders = table(spark, sf_dir, "orders").selectExpr("concat('o:', o_orderkey) as id", "cast(o_orderdate as date) as d")
    nodes = lines.unionByName(orders).select("id", F.date_format("d", "yyyy-MM-dd").alias("date_document"), F.lit("ok").alias("date_document_status"))
    return facts, nodes


def registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(facts supplies, one a line, and same_name; nodes) with parts and suppliers as entities and officers."""
    line = table(spark, sf_dir, "lineitem")
    supplies = line.selectExpr("concat('s:', l_suppkey) as s", "'supplies' as p", "concat('p:', l_partkey) as o")
    part = table(spark, sf_dir, "part")
    first = part.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("_k"))
    same = part.join(first, ["p_brand", "p_size"]).where("p_partkey <> _k").selectExpr("concat('p:', p_partkey) as s", "'same_name' as p", "concat('p:', _k) as o")
    parts = part.selectExpr("concat('p:', p_partkey) as id", "array(case when p_size % 5 = 0 then 'Other' else 'Entity' end, '_internal') as labels", "case when p_partkey % 11 = 0 then '' else p_name end as name", "case when p_size % 2 = 0 then 'Active' else 'Closed' end as status", "case when p_partkey % 3 = 0 then concat(2020 + p_size % 10, '-06-30T00:00') when p_partkey % 3 = 1 then 'unknown' end as inactivation_date")
    suppliers = table(spark, sf_dir, "supplier").selectExpr("concat('s:', s_suppkey) as id", "array('Officer') as labels", "s_name as name", "'Active' as status", "cast(null as string) as inactivation_date")
    return supplies.unionByName(same), parts.unionByName(suppliers)


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier nation -> customer nation, where the quantity of all lines between them is above 1.05 times the supplier nation's mean over its customer nations."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust, supp = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    flow = rows.groupBy("s_nationkey", "c_nationkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    mean = flow.groupBy("s_nationkey").agg(F.sum("q").alias("total"), F.count(F.lit(1)).alias("n"))
    return flow.join(mean, "s_nationkey").where("q * n * 100 > total * 105").selectExpr("concat('n:', s_nationkey) as s", "'trades' as p", "concat('n:', c_nationkey) as o")


def judged(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A truth, its world, gaps, faults and a candidate that misses, repeats, invents, abstains and deletes by hash."""
    truth = cut(numbered(act_facts(spark, sf_dir)), "truth")  # read by every branch of the judge
    h = lambda a, b: F.conv(F.substring(F.sha2(F.concat(F.lit(f"{a}|"), F.concat_ws("|", "s", "p", "o")), 256), 1, 4), 16, 10).cast("int") % b
    kept = truth.where(h("keep", 10) != 0).select("s", "p", "o")
    twice = truth.where(h("twice", 15) == 0).select("s", "p", "o")
    false = truth.where(h("false", 12) == 0).select("s", "p", F.concat("s", F.lit("")).alias("o"))
    lost = truth.where(h("lost", 40) == 0).select("s", "p", F.concat("o", F.lit("?")).alias("o"))
    alien = truth.where(h("alien", 60) == 0).select("s", F.lit("cites").alias("p"), "o")
    candidate = kept.unionByName(twice).unionByName(false).unionByName(lost).unionByName(alien)
    none = F.lit(None).cast("string")
    faults = truth.where(h("fault", 25) == 0).select(F.col("id").alias("fact"), none.alias("node"), F.when(h("kind", 2) == 0, "law_violation").otherwise("empty_target").alias("kind"), F.lit(1).alias("seq"))
    world = spark.sql("select * from values ('repeals', true), ('amends', true), ('based_on', false), ('unused', true) as w(p, closed)")
    nodes = acts(spark, sf_dir)
    return {"truth": truth, "candidate": candidate, "faults": faults, "world": world, "nodes": nodes, "gaps": nodes.where("gap").select(F.col("id").alias("node")), "abstained": truth.where(h("silent", 8) == 0).select("s", "p", "o"), "deleted": nodes.where("cast(substring(id, 3) as bigint) % 33 = 0").select("id")}
