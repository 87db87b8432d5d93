"""Programs over arrays whose products leave the range, and over arrays that occur often."""

from math import prod

from sparkloom.plans.registry import QUERIES


def test_products_out_of_range_and_repeated_arrays(spark, tmp_path):
    orders = {1: [50] * 30, 2: [20, 30], 3: [20, 30], 4: [25, 1]}
    lines = [(k, i, float(q)) for k, qs in orders.items() for i, q in enumerate(qs)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = {r["program"]: (r["n"], r["total"]) for r in QUERIES["array_grammar_v4"](spark, str(tmp_path)).collect()}
    assert len(rows) == 300
    moved = [[q - 25 for q in qs] for qs in orders.values()]
    assert rows["pos_id_prod"] == (4, None)  # 25 ** 30 is no BIGINT; the order still counts
    assert rows["negative_id_prod"] == (4, sum(prod(x for x in xs if x < 0) for xs in moved))
    assert rows["pos_id_sum"] == (4, sum(sum(x for x in xs if x > 0) for xs in moved))
    assert rows["zero_id_max"] == (1, 0)
    assert rows["pos_id_first"] == (3, 35)


def test_totals_are_exact_where_sums_leave_the_range_on_the_way(spark, tmp_path):
    big = 25**13  # 1.5e18: ten of them are no BIGINT, with ten of opposite sign they are 0
    lines = [(k, i, 50.0 if i or k < 10 else 0.0) for k in range(20) for i in range(13)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = {r["program"]: (r["n"], r["total"]) for r in QUERIES["array_grammar_v4"](spark, str(tmp_path)).collect()}
    assert 10 * big > 2**63 and rows["nonzero_id_prod"] == (20, 0)
    assert rows["nonzero_abs_prod"] == (20, None)


def test_words_of_repeated_names(spark, tmp_path):
    names = ["Red big box", "Red big box", "a", None]
    spark.createDataFrame([(n,) for n in names], "p_name string").write.parquet(str(tmp_path / "part.parquet"))
    rows = {r["program"]: tuple(r)[1:] for r in QUERIES["word_grammar"](spark, str(tmp_path)).collect()}
    assert len(rows) == 210
    assert rows["all_id_first"] == (3, "Red", "a", 7)
    assert rows["cap_upper_join"] == (3, "", "RED", 6)
