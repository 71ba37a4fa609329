import datetime as dt

from pyspark.sql import functions as F

from signalbox.operators.trailing import daily_counts, trailing_totals


def run(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, name string, day date, entity string")
    return trailing_totals(daily_counts(df, F.lower(F.trim("name")), F.col("day")), "2024-01-01", "2024-02-15")


def test_totals_against_brute_force(spark):
    days = [1, 1, 2, 9, 40, 41]
    rows = [(i, " A" if i % 2 else "a", dt.date(2024, 1, 1) + dt.timedelta(d - 1), "clash") for i, d in enumerate(days)]
    rows += [rows[0], (90, None, dt.date(2024, 1, 3), "x"), (91, "  ", dt.date(2024, 1, 3), "x"), (92, "b", None, "x"), (93, "c", dt.date(2023, 12, 31), "x")]
    out = run(spark, rows).orderBy("day").collect()
    assert len(out) == 46 and {r.entity for r in out} == {"a"}
    for i, r in enumerate(out, 1):
        assert r.n == days.count(i)
        assert r.total_7 == sum(i - 6 <= d <= i for d in days)
        assert r.total_30 == sum(i - 29 <= d <= i for d in days)
        assert abs(r.avg_7 - r.total_7 / 7) < 1e-9


def test_null_ids_count_each_and_empty(spark):
    out = run(spark, [(None, "a", dt.date(2024, 1, 1), ""), (None, "a", dt.date(2024, 1, 1), "")])
    assert out.agg(F.sum("n")).first()[0] == 2
    assert run(spark, []).count() == 0
