"""Figures of a page: which can be kept, and why others cannot."""

from __future__ import annotations

import base64
import binascii
import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MOST_EACH, MOST_ALL, MOST_FILES = 8 << 20, 128 << 20, 1000
_FIGURE = T.StructType([T.StructField("bytes", T.LongType()), T.StructField("sha256", T.StringType()), T.StructField("gap", T.StringType())])


@F.pandas_udf(_FIGURE)
def inline_image(src: pd.Series) -> pd.DataFrame:
    """Size and hash of a data: image, or what keeps it from being staged."""

    def one(s: str | None) -> tuple:
        if not s:
            return None, None, "no source"
        if not s.startswith("data:image/"):
            return None, None, "remote image" if "://" in s or s.startswith("//") else "local file not supplied"
        head, _, body = s.partition(",")
        try:
            content = base64.b64decode(body, validate=True) if head.endswith(";base64") else body.encode()
        except binascii.Error:
            return None, None, "undecodable image"
        if len(content) > MOST_EACH:
            return len(content), None, "image too large"
        return len(content), hashlib.sha256(content).hexdigest(), None

    return pd.DataFrame([one(s) for s in src], columns=["bytes", "sha256", "gap"])


def stage(images: DataFrame, page: str, order: str, src: str, *, most_files: int = MOST_FILES, most_bytes: int = MOST_ALL) -> DataFrame:
    """``images`` with bytes, sha256 and gap; what goes over a page's number or total of bytes becomes a gap, not an error."""
    w = Window.partitionBy(page).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    looked = images.withColumn("f", inline_image(F.col(src))).select(*images.columns, "f.*")
    kept = F.col("gap").isNull()
    counted = looked.withColumns({"_n": F.sum(kept.cast("int")).over(w), "_total": F.sum(F.when(kept, F.col("bytes")).otherwise(0)).over(w)})
    over = F.when(F.col("_n") > most_files, "too many images").when(F.col("_total") > most_bytes, "images too large together")
    return counted.withColumn("gap", F.coalesce("gap", over)).withColumn("sha256", F.when(F.col("gap").isNull(), F.col("sha256"))).drop("_n", "_total")
