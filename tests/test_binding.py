"""How the given tables are read as a sales audit."""

from checks import binding


def test_lines_are_moved_once(spark, tmp_path):
    tables = {
        "lineitem": ([("1999-02-03", 10.0, 0.1, 1, 5, 2.0), ("2000-11-03", 20.0, 0.0, 1, 6, 4.0), ("2000-11-03", 7.0, 0.0, None, 6, 1.0)],
                     "l_shipdate string, l_extendedprice double, l_discount double, l_partkey long, l_suppkey long, l_quantity double"),
        "supplier": ([(5, 0), (6, 1)], "s_suppkey long, s_nationkey int"),
        "part": ([(1, "a b", "T", "Brand#1", 12)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int"),
        "nation": ([(0, "N0", 0), (1, "N1", 1)], "n_nationkey int, n_name string, n_regionkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    facts = binding.facts(spark, str(tmp_path))
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_partkey") == 1
    rows = {r["row_id"]: r for r in facts.collect()}
    assert set(rows) == {100, 101}
    assert float(rows[100]["value_t1"]) == 9.0 and float(rows[101]["month_2"]) == 20.0
    # 4 units at the part's price of the year before, 9 / 2.
    assert float(rows[101]["cp_t2"]) == 18.0
