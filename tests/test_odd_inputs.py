"""Queries against their SQL on small tables made to be awkward: halves, nulls, names said twice."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from foliolens.plans import catalog


def both(spark, folder, name, **tables):
    """The rows of Spark and of SQL, sorted."""
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = catalog.QUERIES[name](spark, str(folder)).select(*columns).collect()
    return sorted(map(tuple, got), key=repr), sorted(want.fetchall(), key=repr)


def test_close_pairs_take_halves_as_sql_does(spark, tmp_path):
    worth = [2500.0, 1500.0, 2000.0, 3500.0, -500.0, 500.0, 0.0, -1500.0, None, 2400.0, 2600.0, 3000.0]
    keys, nations = pa.array(range(12), pa.int64()), pa.array([1, 2, 1, 2, 1, 2, 1, 2, 1, 2, None, 1], pa.int32())
    got, want = both(spark, tmp_path, "close_pairs", supplier={"s_suppkey": keys, "s_nationkey": nations, "s_acctbal": worth})
    assert got == want and got


def test_close_pairs_of_keys_said_twice(spark, tmp_path):
    keys, nations = pa.array([1, 1, 2, 3, 3, None, 4], pa.int64()), pa.array([1, 1, 1, 2, 1, 1, 2], pa.int32())
    got, want = both(spark, tmp_path, "close_pairs", supplier={"s_suppkey": keys, "s_nationkey": nations, "s_acctbal": [0.0, 10.0, 0.0, 0.0, 3000.0, 0.0, 0.0]})
    assert got == want and len(set(got)) < len(got)


def test_stage_table_takes_halves_as_sql_does(spark, tmp_path):
    parts = {"p_partkey": pa.array(range(5), pa.int64()), "p_retailprice": [900.12, 900.13, 900.14, 899.88, 900.12], "p_size": pa.array([10] * 5, pa.int32()), "p_brand": ["a", "b", None, "d", "e"]}
    money = [1.15, 1.25, 1.35, 1.45, -1.15, -1.25, -1.35, 0.05, None, 9.0]
    got, want = both(spark, tmp_path, "stage_table", part=parts, customer={"c_custkey": pa.array(range(10), pa.int64()), "c_acctbal": money})
    assert got == want and len({x[1] for x in got}) > 2


def test_sections_split_each_text_once(spark):
    from foliolens.operators import segments

    docs = spark.createDataFrame([("f", "a\n# b\nx\n# b\n# b (2)\n"), ("g", None), ("h", "none")], "name string, text string")
    found = segments.sections(docs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted((x.file, x.pos, x.title) for x in found.collect()) == [("f", 0, "b"), ("f", 1, "b (2)"), ("f", 2, "b (2) (2)"), ("g", 0, segments.WHOLE), ("h", 0, segments.WHOLE)]


def test_titles_of_many_groups_are_walked_in_one_pass(spark):
    from foliolens.operators import segments

    rows = spark.range(3000).selectExpr("id % 1000 as g", "if(id < 2000, 'a', 'a (2)') as title", "id as pos")
    found = segments.number_repeats(rows, ["g"], "title", "pos")
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(x.title for x in found.filter("g = 7").collect()) == ["a", "a (2)", "a (2) (2)"] and found.distinct().count() == 3000


def test_promoted_runs_with_few_in_play(spark, monkeypatch):
    from foliolens.operators import promotion

    texts = ["one two three four x", "one two three four y la la la la la la", "two three four one two"] * 3 + ["p q r s"] * 5 + ["la la la la la b", "c la la la"] * 4
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = promotion._chosen_of_all(docs, "text", 1, 4, 6, 4)
    held = []
    monkeypatch.setattr(promotion, "heads", lambda places, true=promotion.heads: held.append(1) or true(places))
    for promising in ((1000,), (1, 4), (1,)):
        monkeypatch.setattr(promotion, "PROMISING", promising)
        held.clear()
        assert [tuple(x) for x in promotion.promoted(docs, most=4).orderBy("nth").collect()] == want and len(want) > 2
        assert promising != (1,) or held


def test_too_close_is_the_same_in_pieces_and_ways(spark, monkeypatch):
    import random
    from itertools import combinations

    from foliolens.operators import rules

    r = random.Random(4)
    data = [(i, r.choice([1, 2, 3, None]), r.choice("ab"), r.choice([0.5, None]), r.randrange(4)) for i in range(150)]
    rows = spark.createDataFrame(data, "w int, a int, k string, x double, d int")  # columns named as those within
    for piece, join in ((1024, "10MB"), (7, "-1")):
        monkeypatch.setattr(rules, "PIECE", piece)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", join)
        for least in (1, 2, 3):
            want = sorted((p[0], q[0], n) for p, q in combinations(data, 2) if (n := sum(s != t for s, t in zip(p[1:], q[1:]))) < least)
            assert sorted(map(tuple, rules.too_close(rows, "w", ["a", "k", "x", "d"], least).collect())) == want and want
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_of_a_large_cell_are_made_evenly_and_only_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from foliolens.operators import rules

    monkeypatch.setattr(rules, "PIECE", 50)
    found = rules.too_close(spark.range(1500).selectExpr("id as k", "1 as a", "id % 2 as b"), "k", ["a", "b"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")] and "Repartition" not in plan[: plan.index("Join")]  # nothing is done to pairs once they are made
    made = [x["count"] for x in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 1500 * 1499 // 2 and len(made) == 4 and max(made) < 1.5 * min(made)
