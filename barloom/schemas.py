"""Fixed schemas of the panel data model."""

from pyspark.sql import types as T

OHLC = ("open", "high", "low", "close")
OHLCV = OHLC + ("volume",)
MACRO_NAMES = ("VIX", "TNX", "FVX", "IRX", "DXY", "GLD", "TLT")

BARS = T.StructType(
    [T.StructField("series_id", T.StringType()), T.StructField("bar_date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in OHLCV]
)
MACRO = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("obs_date", T.DateType()),
        T.StructField("value", T.DoubleType()),
    ]
)
NEWS = T.StructType(
    [T.StructField("date", T.TimestampType())]
    + [T.StructField(c, T.StringType()) for c in ("title", "description", "source", "url")]
)
_NULLABLE_DOUBLES = T.ArrayType(T.DoubleType(), True)
CHART_PAYLOAD = T.StructType(
    [
        T.StructField("timestamp", T.ArrayType(T.LongType())),
        T.StructField("meta", T.StructType([T.StructField("gmtoffset", T.LongType())])),
        T.StructField(
            "indicators",
            T.StructType(
                [
                    T.StructField(
                        "quote",
                        T.ArrayType(T.StructType([T.StructField(c, _NULLABLE_DOUBLES) for c in OHLCV])),
                    )
                ]
            ),
        ),
    ]
)
ARTICLE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("publishedAt", "title", "description", "url")]
    + [T.StructField("source", T.StructType([T.StructField("name", T.StringType())]))]
)
