"""WebVTT captions as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import seconds


def parse(files: DataFrame) -> DataFrame:
    """Captions of ``files`` (doc_id, text): doc_id, idx, start_s, end_s, speaker, text. Without the ``WEBVTT`` header a text has none."""
    body = F.regexp_replace("text", "\r\n?", "\n")
    rows = files.select("doc_id", body.alias("body")).where("startswith(body, 'WEBVTT')").select("doc_id", F.posexplode(F.split("body", "\n\n+")).alias("block", "cue"))
    times = r"([0-9:.]+) --> ([0-9:.]+)[^\n]*\n?"
    said = F.trim(F.regexp_replace("cue", r"(?s)^.*?-->[^\n]*\n?", ""))
    speaker = F.nullif(F.regexp_extract(said, r"^([^:\n]{1,60}): ", 1), F.lit(""))
    rows = rows.where("contains(cue, '-->')")
    return rows.select("doc_id", F.row_number().over(order_of_blocks()).alias("idx"), seconds(F.regexp_extract("cue", times, 1)).alias("start_s"), seconds(F.regexp_extract("cue", times, 2)).alias("end_s"), speaker.alias("speaker"), F.regexp_replace(said, r"^[^:\n]{1,60}: ", "").alias("text"))


def order_of_blocks():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("block")
