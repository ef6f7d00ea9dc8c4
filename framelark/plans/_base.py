"""What the queries share: rounding, and SQL for the driver tables as clips, detections and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles cut to ``places``, so that the order of a sum doesn't show."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def rounded_even(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded half to even on their binary value (``round_even(x * 1e6, 0) / 1e6`` in SQL), for values that both engines have alike to the last bit."""
    scale = 10.0**places
    return df.select(*((F.rint(F.col(c) * scale) / scale).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


META = "meta AS (SELECT o_orderkey AS entity, (360 + o_orderkey % 5 * 90)::DOUBLE AS w, 640.0::DOUBLE AS h, CASE WHEN o_orderkey % 2 = 0 THEN 16.0::DOUBLE ELSE 9.0::DOUBLE END AS tw, CASE WHEN o_orderkey % 2 = 0 THEN 9.0::DOUBLE ELSE 16.0::DOUBLE END AS th, 8 AS n_frames FROM orders)"
CROP = "crop AS (SELECT *, greatest(1, CASE WHEN w / h >= tw / th THEN least(round_even(h * (tw / th), 0), w) ELSE w END)::INT AS cw, greatest(1, CASE WHEN w / h >= tw / th THEN h ELSE least(round_even(w / (tw / th), 0), h) END)::INT AS ch FROM meta)"
DETS = "dets AS (SELECT l_suppkey AS entity, l_linenumber AS frame, l_returnflag AS cls, 1 - l_discount * 5 AS conf, l_quantity / 50 AS area, (l_partkey % 1000) / 1000.0::DOUBLE AS c, l_orderkey, l_extendedprice FROM lineitem)"
SIGNAL = "s AS (SELECT user_id AS entity, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value, event_type FROM events)"
