"""Rasters as long tables: label pixels `(region, y, x, label)` and image samples `(image, scale, channel, value)`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: largest number of spatial samples a histogram takes by default.
AUTO_SCALE_SAMPLES = 4096 * 4096

INTEGER_NAMES = {T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64"}
INTEGER_LIMITS = {"int8": 2**7 - 1, "int16": 2**15 - 1, "int32": 2**31 - 1, "int64": 2**63 - 1}


def label_dtype(df: DataFrame, label: str = "label") -> str:
    name = INTEGER_NAMES.get(type(df.schema[label].dataType))
    if name is None:
        raise ValueError(f"Labels in {label} must be integers.")
    return name


def scan_labels_pixels(df: DataFrame, label: str = "label") -> DataFrame:
    """Foreground pixels; needs integer labels and the two axes y and x."""
    label_dtype(df, label)
    absent = [axis for axis in ("y", "x") if axis not in df.columns]
    if absent:
        raise ValueError(f"A labels raster needs the axes y and x; missing {', '.join(absent)}.")
    return df.where(F.col(label) > 0)


def source_signature(pixels: DataFrame, region: str = "region", label: str = "label") -> DataFrame:
    """Structural identity of each labels element: dims, shape and integer type."""
    return pixels.groupBy(F.col(region).alias("region")).agg(
        F.lit("scale0").alias("scale"), F.lit("y,x").alias("dims"),
        (F.max("y") + 1).cast("long").alias("height"), (F.max("x") + 1).cast("long").alias("width"),
        F.lit(label_dtype(pixels, label)).alias("dtype"),
    )


def scan_image_channel(df: DataFrame, image: str, channel: str, scale: str | None = None) -> DataFrame:
    """Values of one channel at one scale. Stored partitioned by image, scale and channel, this reads one folder."""
    return df.where(
        (F.col("image") == image) & (F.col("scale") == (scale or "scale0")) & (F.col("channel") == channel)
    ).select("value")


def require_channel(channels: DataFrame, image: str, channel: str, scale: str | None = None) -> None:
    """`channels` holds one row per declared (image, scale, channel): reject unknown scales and channels and doubles."""
    found = channels.where(F.col("image") == image).agg(
        F.count_if(F.col("scale") == (scale or "scale0")).alias("scale"),
        F.count_if((F.col("scale") == (scale or "scale0")) & (F.col("channel") == channel)).alias("channel"),
    ).first()
    if not found["scale"]:
        raise ValueError(f"Scale {scale or 'scale0'} is not available for image {image}.")
    if found["channel"] == 0:
        raise ValueError(f"Channel {channel} is not available in image {image}.")
    if found["channel"] > 1:
        raise ValueError(f"Image {image} has several channels named {channel}.")


def samples(z: Column, y: Column, x: Column) -> Column:
    return F.coalesce(z, F.lit(1)).cast("long") * y.cast("long") * x.cast("long")


def default_scale(scales: DataFrame, limit: int = AUTO_SCALE_SAMPLES) -> DataFrame:
    """Per image the largest scale within `limit` spatial samples, else the smallest scale; ties go to the first.

    `scales` has `image, scale, pos` and the sizes `z, y, x` (z may be null). Metadata only.
    """
    sized = scales.withColumn("n", samples(F.col("z"), F.col("y"), F.col("x")))
    fits = F.col("n") <= limit
    return sized.groupBy("image").agg(
        F.coalesce(
            F.max_by("scale", F.when(fits, F.struct("n", -F.col("pos")))),
            F.min_by("scale", F.struct("n", "pos")),
        ).alias("scale")
    )


def select_channels(channels: DataFrame, requested: DataFrame) -> DataFrame:
    """Resolve requests by name or index against one image's channels, keeping request order.

    `channels` is `(position, channel)`, `requested` is `(request_pos, request)` with text requests; digits mean an
    index when no channel has that name. `problem` flags requests that are unknown or repeat a channel.
    """
    by_name = requested.join(channels, F.col("request") == F.col("channel"), "left")
    named = by_name.select("request_pos", "request", F.col("position").alias("by_name"))
    by_index = channels.select(F.col("position").alias("by_index"))
    resolved = named.join(
        by_index, named.by_name.isNull() & (named.request.try_cast("long") == by_index.by_index), "left"
    ).select("request_pos", "request", F.coalesce("by_name", "by_index").alias("position"))
    repeats = resolved.where("position is not null").groupBy("position").agg(F.min("request_pos").alias("first_pos"))
    return (
        resolved.join(repeats, "position", "left").join(channels, "position", "left")
        .withColumn(
            "problem",
            F.when(F.col("position").isNull(), F.lit("unknown")).when(
                F.col("request_pos") != F.col("first_pos"), F.lit("duplicate")
            ),
        )
        .select("request_pos", "request", "position", "channel", "problem")
    )
