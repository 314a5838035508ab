"""Searches by index give the rows of full scans, and read less."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import indexes, lookups


@pytest.fixture(scope="module")
def names(spark, tmp_path_factory):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choices("abAB_é:9", k=rnd.randint(0, 9)))) for i in range(3000)] + [(9001, None), (9002, "Lib::Price"), (9003, "lib::price"), (9004, "\U0010ffffz"), (9005, "\U0010ffff"), (9006, "z퟿q")]
    table = spark.createDataFrame(rows, "id int, name string").repartition(3)
    path = str(tmp_path_factory.mktemp("index"))
    indexes.build(table, path)
    return table, path


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("query", ["", "a", "é", "ab", "b_", "aba", "LIB", "lib::price", "a.b", "nothing here", "zz", "\U0010ffff"])
def test_searches(spark, names, query):
    table, path = names
    assert ids(indexes.search(spark, path, table, query, "name")) == ids(lookups.search(table.filter("name is not null"), query, "name"))
    ranked = lambda df: [(r["id"], r["tier"]) for r in df.collect()]
    assert ranked(indexes.ranked_search(spark, path, table, query, "name", ["id"], 50)) == ranked(lookups.ranked_search(table, query, "name", ["id"], 50))


@pytest.mark.parametrize("prefix", ["", "a", "Lib::", "é", "z퟿", "\U0010ffff", "none"])
def test_prefixes(spark, names, prefix):
    table, path = names
    assert ids(indexes.completions(spark, path, table, prefix, "name")) == ids(table.filter(F.startswith("name", F.lit(prefix))))


def scan_metrics(df):
    """Files and rows that the scans of a plan have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size())), plan.toString()


def test_few_files_are_read(spark, names):
    _, path = names
    every, _ = scan_metrics(indexes.postings(spark, path).select("number"))
    one, plan = scan_metrics(indexes.postings(spark, path).filter((F.col("folder") == indexes._hashes(spark, ["pri"])["pri"]) & (F.col("gram") == "pri")).select("number"))
    assert one * 8 < every and "EqualTo(gram,pri)" in plan
    _, plan = scan_metrics(indexes.prefixed(spark, path, "Lib"))
    assert "GreaterThanOrEqual(name,Lib)" in plan and "LessThan(name,Lic)" in plan


def test_empty(spark, tmp_path):
    table = spark.createDataFrame([], "id int, name string")
    indexes.build(table, f"{tmp_path}/e")
    assert indexes.search(spark, f"{tmp_path}/e", table, "a", "name").count() == 0
