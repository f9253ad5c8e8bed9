from datetime import datetime, timedelta

START = datetime(2023, 6, 5, 9)
BAR_SCHEMA = "series STRING, datetime TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE"


def linear_bars(spark, rows=120, series="bars"):
    data = [
        (series, START + timedelta(minutes=i), p - 0.25, p + 0.625, p - 0.375, p)
        for i, p in ((i, 64.0 + 0.5 * i) for i in range(rows))
    ]
    return spark.createDataFrame(data, BAR_SCHEMA)


def same_rows(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0
    assert b.exceptAll(a).count() == 0
