"""Rounding of decimal text, at any length."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

from fieldspark.operators import text


def test_rounding_equals_decimal_arithmetic(spark):
    long = "123456789" * 7
    rows = [("0.5", 1), ("0.05", 1), ("0.95", 1), ("9.999", 2), ("007.125", 2), ("1.2", 4), (long + ".44449", 4),
            (long + ".99995", 4), ("0." + "9" * 70, 60), ("0.04", 1), ("19.95", 1)]
    frame = spark.createDataFrame(rows, "d string, n int")
    out = frame.withColumn("t", text.fixed_text(frame.d, frame.n)).collect()
    c = Context(prec=200)
    for r in out:
        assert r.t == str(Decimal(r.d).quantize(Decimal(1).scaleb(-r.n), ROUND_HALF_UP, context=c))
