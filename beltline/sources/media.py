"""Camera frame names and WAV recordings."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: recorder frame names end in _f<frame no>_<host µs>.jpg.
FRAME_NAME = r"_f(\d+)_(\d+)\.jpg$"


def frame_index(names: DataFrame, name: str = "name") -> DataFrame:
    """Frame number and host clock from file names; other names are skipped."""
    return names.filter(F.col(name).rlike(FRAME_NAME)).withColumns({
        "frame_no": F.regexp_extract(name, FRAME_NAME, 1).cast("bigint"),
        "host_us": F.regexp_extract(name, FRAME_NAME, 2).cast("bigint")})


def list_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame index of a folder of JPEG files; only the listing is read, not the images."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").option("recursiveFileLookup", "true").load(path)
    return frame_index(files.select(F.col("path").alias("name")))


def scan_wav(spark: SparkSession, path: str, chunk: int = 1 << 16, full_scale: float | None = None) -> DataFrame:
    """The WAV files of a folder through ``decode_wav``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")
    return decode_wav(files, chunk, full_scale)


def decode_wav(files: DataFrame, chunk: int = 1 << 16, full_scale: float | None = None) -> DataFrame:
    """Mono samples in [-1, 1] as ``(session, chunk_id, fs, samples)`` of (path, content); stereo is averaged.

    ``full_scale`` overrides the divisor (the largest value of the sample type by default).
    """
    widths = {1: "<i1", 2: "<i2", 4: "<i4"}

    def decode(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                with wave.open(io.BytesIO(content), "rb") as w:
                    fs, ch, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
                    if width not in widths:
                        raise ValueError(f"unsupported PCM sample width: {width} bytes")
                    top = full_scale or float(np.iinfo(np.dtype(widths[width])).max)
                    i = 0
                    while raw := w.readframes(chunk):
                        x = np.frombuffer(raw, widths[width]).astype(np.float64)
                        x = x.reshape(-1, ch).mean(axis=1) / top
                        yield pd.DataFrame({"session": [name], "chunk_id": [i], "fs": [fs], "samples": [x.astype(np.float32)]})
                        i += 1

    return files.select("path", "content").mapInPandas(decode, "session string, chunk_id bigint, fs int, samples array<float>")
