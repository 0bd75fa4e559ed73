import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from shelfcast import schemas
from shelfcast.operators import aggregates, cleaning, combine, features
from shelfcast.plans.prepare import prepare_fact
from shelfcast.sources import memo, readers, sinks
from shelfcast.sources.warehouse import first_monday


@pytest.fixture
def raw(tmp_path):
    (tmp_path / "train.csv").write_text(
        "Store,Dept,Date,Weekly_Sales,IsHoliday\n"
        "1,1,2010-12-31,100.5,True\n1,1,2011-01-07,-5,False\n1,1,2011-01-14,,False\n1,1,2011-01-21,80,False\n"
    )
    (tmp_path / "features.csv").write_text(
        "Store,Date,Temperature,Fuel_Price,MarkDown1,MarkDown2,MarkDown3,MarkDown4,MarkDown5,CPI,Unemployment,IsHoliday\n"
        "1,2010-12-31,40,3,NaN,,1,2,3,200,8,True\n1,2011-01-21,41,3.1,5,,1,2,3,201,8,False\n"
    )
    (tmp_path / "stores.csv").write_text("Store,Type,Size\n1,A,1000\n")
    (tmp_path / "search.csv").write_text(
        "date,term,value\n" + "".join(
            f"{dt.date(2010, 11, 1) + dt.timedelta(days=i)},{t},{i + k}\n"
            for i in range(90) for k, t in enumerate(("toys", "sports"))
        )
    )
    return str(tmp_path)


def test_csv_numbers_that_are_missing_become_null(spark, raw):
    f = readers.load_raw(spark, raw)["features"].where("Date = '2010-12-31'").first()
    assert f.MarkDown1 is None and f.MarkDown2 is None and f.MarkDown3 == 1.0
    assert f.IsHoliday is True


def test_other_date_layout(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("Store,Dept,Date,Weekly_Sales,IsHoliday\n1,1,31/12/2010,1,False\n")
    assert readers.read_csv(spark, str(p), schemas.SALES, "dd/MM/yyyy").first().Date == dt.date(2010, 12, 31)


def test_optional_source(spark, tmp_path):
    assert readers.read_optional(readers.read_parquet, spark, str(tmp_path / "nowhere")) is None


def test_prepare_fact_cleans_joins_and_adds_trends(spark, raw, tmp_path):
    fact = prepare_fact(spark, raw, str(tmp_path / "out"), f"{raw}/search.csv", ("toys", "sports"))
    rows = {r.Date: r for r in fact.collect()}
    assert sorted(rows) == [dt.date(2010, 12, 31), dt.date(2011, 1, 21)]  # negative and missing weeks are gone
    first = rows[dt.date(2010, 12, 31)]
    assert first.MarkDown1 == 0.0 and first.IsHoliday == 1 and first.YearWeek == "2010-52"
    assert first.Type == "A" and first.GoogleTrends_toys is not None
    assert first.GoogleTrends_toys_lag1 == pytest.approx(first.GoogleTrends_toys - 7)


def test_trends_do_not_duplicate_weeks_around_new_year(spark):
    days = [(dt.date(2010, 11, 20) + dt.timedelta(days=i), float(i)) for i in range(80)]
    wide = spark.createDataFrame(days, "date date, toys double")
    weekly = features.weekly_trends(wide, ["toys"], lags=(1,))
    assert weekly.count() == weekly.select("Date").distinct().count()
    sales = spark.createDataFrame([(1, 1, dt.date(2011, 1, 1), 5.0)], "Store int, Dept int, Date date, Weekly_Sales double")
    assert combine.join_trends(sales, weekly).count() == 1


def test_missing_search_files_leave_no_trend_columns(spark, raw, tmp_path):
    fact = prepare_fact(spark, raw, str(tmp_path / "out"), f"{raw}/none.csv", ("toys",))
    assert not combine.columns_containing(fact, "GoogleTrends")


def test_sinks_round_trip(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") * 1.5)
    sinks.write_table(df, str(tmp_path / "t"), partition_by=("id",))
    assert readers.read_parquet(spark, str(tmp_path / "t")).count() == 10
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id", "x"]
    sinks.export_csv(df.repartition(4), str(tmp_path / "one"), single_file=True)
    assert len([f for f in os.listdir(tmp_path / "one") if f.endswith(".csv")]) == 1
    sinks.export_csv(df.repartition(4), str(tmp_path / "many"))
    assert len([f for f in os.listdir(tmp_path / "many") if f.endswith(".csv")]) > 1
    assert spark.read.option("header", True).csv(str(tmp_path / "many")).count() == 10


def test_bundle_loads_registers_and_caches(spark, tmp_path):
    base = str(tmp_path)
    for name in ("fact", "results", "profile"):
        sinks.write_table(spark.range(3), f"{base}/{name}")
    bundle = readers.load_bundle(spark, base)
    assert bundle.importance is None
    assert bundle.register("b_") == ["b_fact", "b_results", "b_profile"]
    assert spark.sql("select count(*) c from b_fact").first().c == 3
    assert bundle.persist().fact.is_cached
    bundle.unpersist()
    assert not bundle.fact.is_cached


def test_forward_fill_stays_inside_a_series(spark):
    rows = [(1, 1, "2010-01-01", 1.0), (1, 1, "2010-01-08", None), (1, 2, "2010-01-01", None), (1, 2, "2010-01-08", 4.0)]
    df = spark.createDataFrame(rows, "Store int, Dept int, Date string, v double")
    got = [(r.Dept, r.v) for r in cleaning.forward_fill(df, ["v"]).orderBy("Dept", "Date").collect()]
    assert got == [(1, 1.0), (1, 1.0), (2, None), (2, 4.0)]


def test_missing_report_lists_only_columns_with_gaps(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None)], "x int, y double, z string")
    assert [(r.column, r.missing, r.percent) for r in cleaning.missing_report(df).collect()] == [("y", 2, 100.0), ("z", 1, 50.0)]


def test_duplicate_flags(spark):
    df = spark.createDataFrame([(True, True, 1.0), (False, None, 2.0)], "IsHoliday_x boolean, IsHoliday_y boolean, Weekly_Sales double")
    assert cleaning.columns_agree(df, [("IsHoliday_x", "IsHoliday_y")]).first().equal is False
    assert cleaning.clean_sales(df).columns == ["Weekly_Sales", "IsHoliday"]


def test_listed_and_complement_partition_the_rows(spark):
    df = spark.createDataFrame([(s, d) for s in (1, 2, 3, None) for d in (1, 2)], "Store int, Dept int")
    listed = spark.createDataFrame([(1, 1), (2, 2), (2, 2)], "Store int, Dept int")
    for pairwise in (True, False):
        a = combine.keep_listed(df, listed, pairwise=pairwise).count()
        b = combine.drop_listed(df, listed, pairwise=pairwise).count()
        assert a + b == df.count()
    assert combine.keep_listed(df, listed).count() == 2
    assert combine.keep_listed(df, listed, pairwise=False).count() == 4


def test_splits_cover_every_row_once(spark):
    df = spark.createDataFrame([(i, dt.date(2010, 1, 1) + dt.timedelta(days=7 * i)) for i in range(150)], "id int, Date date")
    parts = features.label_split(df, "2011-06-01", "2012-01-01").groupBy("split").count().collect()
    assert sum(r["count"] for r in parts) == 150
    shares = {r.split: r["count"] for r in features.hash_split(df, ("id",)).groupBy("split").count().collect()}
    assert sum(shares.values()) == 150 and 100 < shares["train"] < 140
    q = features.quantile_date_split(df, 0.8).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in q} == {"train": 120, "test": 30}


def test_sample_is_repeatable_whatever_the_partitioning(spark):
    df = spark.range(1000)
    a = [r.id for r in combine.fixed_sample(df, 20, ("id",)).collect()]
    b = [r.id for r in combine.fixed_sample(df.repartition(13), 20, ("id",)).collect()]
    assert a == b and len(set(a)) == 20


def test_standardise_uses_training_rows(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    test = spark.createDataFrame([(5.0, 6.0)], "a double, b double")
    row = features.standardise(test, ["a", "b"], fit_on=train).first()
    assert (row.a, row.b) == (3.0, 1.0)


def test_labels_get_their_alphabetical_place(spark):
    labels = ["b", "a", None, "ab", "é", "", "B", "b"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, label string")
    encoded, codes = cleaning.label_encode(df, "label", "code")
    order = sorted({x for x in labels if x is not None}, key=lambda x: x.encode())
    assert {r.label: r.code for r in codes.collect()} == {x: k for k, x in enumerate(order)}
    got = {r.i: r.code for r in encoded.collect()}
    assert got == {i: order.index(x) if x is not None else len(order) for i, x in enumerate(labels)}
    later = spark.createDataFrame([("a",), ("new",)], "label string")
    assert {r.label: r.code for r in cleaning.label_encode(later, "label", "code", codes)[0].collect()} == {"a": order.index("a"), "new": len(order)}


def test_label_codes_of_many_labels_that_share_their_beginning(spark):
    """All labels begin alike; they are still ordered in many slices, none of which holds much of the whole."""
    n = 30_000
    df = spark.range(n).select(F.format_string("same/%05d", (F.col("id") * 7919) % n).alias("label")).union(spark.sql("SELECT cast(null as string)"))
    codes = cleaning.label_codes(df, "label", "code")
    wrong = codes.where(F.col("code") != F.substring("label", 6, 5).cast("int"))
    assert codes.count() == n and wrong.count() == 0
    plan = codes._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan and "substring" not in plan
    assert cleaning.label_codes(df.limit(0), "label", "code").count() == 0


def test_rows_are_numbered_by_position(spark, tmp_path):
    """Several files, several tasks a file, repeated rows; numbers are consecutive in the order of files and rows."""
    path = str(tmp_path / "rows")
    spark.range(10_000).select((F.col("id") % 3).alias("a"), F.col("id").alias("place")).coalesce(1).write.option("maxRecordsPerFile", 1_700).parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = readers.read_numbered(spark, path, "n")
        assert rows.columns == ["n", "a", "place"] and rows.where("n <> place").count() == 0 and rows.count() == 10_000
        assert len(spark.read.parquet(path).inputFiles()) == 6 and rows.rdd.getNumPartitions() > 6
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Sort" not in plan.split("Window")[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(ValueError, match="place"):
        readers.read_numbered(spark, path, "place")
    short = readers.read_numbered(spark, path, "n").where("n < 4").select("n", F.col("a").alias("b"))
    both = combine.side_by_side(rows.where("n < 6").drop("place"), short, "n").orderBy("n").collect()
    assert [(r.n, r.a, r.b) for r in both] == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 0, 0), (4, 1, None), (5, 2, None)]
    with pytest.raises(ValueError, match="both tables"):
        combine.side_by_side(rows, rows, "n")


def test_counts_of_two_tables_stand_side_by_side(spark):
    from types import SimpleNamespace

    from workload.registry import QUERIES

    schema = "Store int, Dept int, Weekly_Sales double"
    gross = spark.createDataFrame([(1, 1, 5.0), (1, 1, 5.0), (1, 2, 1.0), (2, 1, 1.0), (None, 1, 1.0)], schema)
    net = spark.createDataFrame([(1, 1, 5.0), (1, 1, -5.0), (1, 2, 0.0), (2, 1, -1.0), (None, 1, 1.0), (3, 3, 1.0)], schema)
    both = QUERIES["side_by_side_counts"].build(SimpleNamespace(sales=gross, sales_net=net))
    assert both.columns == ["Store", "Dept", "Weeks_Gross", "Weeks_Net"]
    assert sorted(tuple(r) for r in both.collect()) == [(1, 1, 2, 1), (1, 2, 1, 1)]


def test_profile_counts_distinct_values_exactly(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "x", 2.0), (2, "y", 3.0)], "a int, b string, v double")
    got = {(r.metric, r.column): r.value for r in aggregates.profile_table(df, ["v"], date=None).collect()}
    assert (got["distinct", "a"], got["distinct", "b"], got["missing", "b"]) == ("2", "2", "1")


@pytest.mark.parametrize(("day", "first", "later"), [("2024-01-01", "2024-01-01", "2024-01-08"), ("2024-01-02", "2024-01-08", "2024-01-08"), ("2024-01-07", "2024-01-08", "2024-01-08")])
def test_bounds_of_weeks(day, first, later):
    assert first_monday(day).isoformat() == first
    assert first_monday(day, after=True).isoformat() == later


def test_checkpoints_need_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from shelfcast.session import ensure_checkpoint_dir

    conf = SimpleNamespace(get=lambda *a: None)
    for master, fine in (("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("spark://x:7077", False)):
        made = []
        context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master=master, setCheckpointDir=made.append)
        fake = SimpleNamespace(sparkContext=context, conf=conf)
        if fine:
            ensure_checkpoint_dir(fake)
            assert made
        else:
            with pytest.raises(ValueError, match="spark.checkpoint.dir"):
                ensure_checkpoint_dir(fake)


def test_a_changed_file_gives_a_new_result(spark, tmp_path):
    source, folder, made = str(tmp_path / "in"), str(tmp_path / "memo"), []

    def ask(parameters=()):
        def make():
            made.append(1)
            return spark.read.parquet(source).groupBy().sum("id")

        return memo.remembered(spark, folder, "total", [source], make, parameters).first()[0]

    spark.range(10).write.parquet(source)
    assert (ask(), ask(), len(made)) == (45, 45, 1)
    assert (ask({"k": 2}), len(made)) == (45, 2)
    spark.range(10, 12).write.mode("append").parquet(source)
    assert (ask(), ask(), len(made)) == (66, 66, 3)
    spark.range(3).write.mode("overwrite").parquet(source)
    assert (ask(), len(made)) == (3, 4)
    there, absent = memo.content_key(spark, [source]), memo.content_key(spark, [source, str(tmp_path / "no")])
    assert there != absent == memo.content_key(spark, [source, str(tmp_path / "no")])
    os.remove(next(p for p in (tmp_path / "memo").glob(f"total-{memo.content_key(spark, [source])}/_SUCCESS")))  # as if the write had died
    assert (ask(), len(made)) == (3, 5)
