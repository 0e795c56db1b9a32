"""Width and height out of a PNG's header, as expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def png_dimensions(data_url: Column) -> Column:
    """struct<width, height> of a base64 PNG with or without a data header; null if it is none."""
    raw = F.try_to_binary(F.regexp_replace(data_url, "^data:[^,]*,", ""), F.lit("base64"))
    number = lambda at: F.conv(F.hex(F.substring(raw, at, 4)), 16, 10).cast("int")
    good = (F.length(raw) >= 24) & (F.hex(F.substring(raw, 1, 8)) == "89504E470D0A1A0A")
    return F.when(good, F.struct(number(17).alias("width"), number(21).alias("height")))
