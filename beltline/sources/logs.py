"""Binary record logs: unpacking, typed tables, merging, audio and captured windows."""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Window_
from pyspark.sql import functions as F

from ..kernels.ordered import Fill, Lag, Seq, ordered
from ..operators.messages import parse_cfg
from ..session import cut_lineage

# Record layout (little-endian) and type tags.
MAGIC = b"IMULOG01"
FILE_HEADER, RECORD_HEADER = 20, 11
META, CMD, IMU, STATUS, CAMERA, AUDIO = 0x01, 0x02, 0x10, 0x20, 0x30, 0x40
IMU_LEN, IMU_LEGACY = 24, 18
ACC_RANGE, GYR_RANGE = 4, 2000
RECORD = "rec_type int, t_host_us bigint, payload binary"


def decode_int8_b64(df: DataFrame, col: str = "features_b64", out: str = "q") -> DataFrame:
    """base64 int8 tensors to integer arrays, one Arrow batch at a time."""

    @F.pandas_udf("array<int>")
    def unpack(b: pd.Series) -> pd.Series:
        return b.map(lambda v: None if v is None else np.frombuffer(v, np.int8).astype(np.int32))

    return df.withColumn(out, unpack(F.unbase64(col)))


def _walk(data: bytes):
    """Offsets of whole records; stops cleanly at a truncated tail."""
    at = FILE_HEADER
    while at + RECORD_HEADER <= len(data):
        size = int.from_bytes(data[at + 9:at + 11], "little")
        body = at + RECORD_HEADER
        if body + size > len(data):
            return
        yield data[at], int.from_bytes(data[at + 1:at + 9], "little"), data[body:body + size]
        at = body + size


def explode_logs(files: DataFrame, name="path", content="content", batch=20_000) -> DataFrame:
    """``(file, ord, t_start_us, baud, rec_type, t_host_us, payload)`` from whole log files.

    A file is one recording of one device and is streamed out in batches; unreadable headers give no rows.
    """

    def run(batches):
        rows = []
        for pdf in batches:
            for f, data in zip(pdf[name], pdf[content]):
                if len(data) < FILE_HEADER or data[:8] != MAGIC:
                    continue
                start, baud = int.from_bytes(data[8:16], "little"), int.from_bytes(data[16:20], "little")
                for i, (typ, t, body) in enumerate(_walk(data)):
                    rows.append((f, i, start, baud, typ, t, body))
                    if len(rows) == batch:
                        yield pd.DataFrame(rows, columns=cols)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=cols)

    cols = ["file", "ord", "t_start_us", "baud", "rec_type", "t_host_us", "payload"]
    return files.select(name, content).mapInPandas(run, f"file string, ord bigint, t_start_us bigint, baud bigint, {RECORD}")


#: The record types a walk may meet; records that have to follow one another to accept a place as a start.
TYPES = frozenset((META, CMD, IMU, STATUS, CAMERA, AUDIO))
IN_A_ROW = 32


def opened(path: str):
    """A seekable stream over a file of any store that Arrow or the machine itself can open."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def saved(path: str, data: bytes) -> None:
    """Write a file, and its folder, in whatever store ``path`` names; a repeated task writes the same again."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        try:
            out = open(path, "wb")
        except FileNotFoundError:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            out = open(path, "wb")
        with out:
            out.write(data)
    else:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        with store.open_output_stream(name) as out:
            out.write(data)


def entries(folder: str):
    """(name, size) of the files in a folder of any store that Arrow or the machine itself can open."""
    if folder.startswith("file:") or "://" not in folder:
        with os.scandir("/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder) as found:
            # checksum files are Hadoop's own, which its listing leaves out as well
            yield from ((x.name, x.stat().st_size) for x in found if x.is_file() and not (x.name[0] == "." and x.name.endswith(".crc")))
    else:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(folder)
        yield from ((x.base_name, x.size) for x in store.get_file_info(fs.FileSelector(name)) if x.is_file)


class Window:
    """Bytes of a file from ``at`` on, read ahead in blocks as a walk asks for them."""

    def __init__(self, stream, size: int, block: int = 1 << 20):
        self.stream, self.size, self.block, self.start, self.data = stream, size, block, 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        """``n`` bytes at ``at``, fewer at the end of the file."""
        if at < self.start or at + n > self.start + len(self.data):
            self.stream.seek(at)
            self.start, self.data = at, self.stream.read(min(max(n, self.block), max(0, self.size - at)))
        return self.data[at - self.start : at - self.start + n]

    def head(self, at: int) -> tuple[int, int] | None:
        """(type, place of the next record) of the record at ``at``; None if it is cut off."""
        h = self.bytes(at, RECORD_HEADER)
        if len(h) < RECORD_HEADER:
            return None
        after = at + RECORD_HEADER + int.from_bytes(h[9:11], "little")
        return None if after > self.size else (h[0], after)


def resynchronised(w: Window, low: int, high: int) -> int:
    """The first place in [low, high) from which records follow one another, known types all, ``IN_A_ROW`` times or to the end; -1."""
    for at in range(low, high):
        place, n = at, 0
        while n < IN_A_ROW and (h := w.head(place)) is not None and h[0] in TYPES:
            place, n = h[1], n + 1
        if n == IN_A_ROW or n and h is None:
            return at
    return -1


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """file, size of all files that the pattern ``path`` names. The driver only looks up folders; tasks list what is in them."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folders, alone = [], []
    patterns = list(hadoop.GlobExpander.expand(path))
    for one in patterns:
        where = hadoop.Path(one)
        store, last = where.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.GlobPattern(where.getName())
        if last.hasWildcard():
            folders += [(x.getPath().toString(), last.compiled().pattern()) for x in store.globStatus(where.getParent()) or [] if x.isDirectory()]
        else:
            alone += [(x.getPath().toString(), x.getLen()) for x in store.globStatus(where) or [] if x.isFile()]

    def listed(batches):
        for pdf in batches:
            rows = []
            for folder, pattern in zip(pdf["folder"], pdf["pattern"]):
                fits = re.compile(pattern, re.DOTALL).fullmatch
                for name, size in entries(folder):
                    if fits(name):
                        rows.append((f"{folder.rstrip('/')}/{name}", size))
                    if len(rows) == 20_000:
                        yield pd.DataFrame(rows, columns=["file", "size"])
                        rows = []
            yield pd.DataFrame(rows, columns=["file", "size"])

    files = "file string, size bigint"
    # a task for each of many small folders would cost more than listing them
    tasks = min(len(folders), 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    inside = spark.createDataFrame(folders, "folder string, pattern string").repartition(max(1, tasks)).mapInPandas(listed, files)
    found = inside.unionByName(spark.createDataFrame(alone, files)) if alone else inside
    return found.distinct() if len(patterns) > 1 else found


def log_ranges(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """file, size, low, high of the byte ranges of all log files under ``path``; one row for each range, none of file content."""
    return log_files(spark, path).select("file", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.col("size") - 1), F.lit(range_bytes))).alias("low")) \
        .withColumn("high", F.least(F.col("low") + range_bytes, F.col("size")))


def _ahead(low: int, high: int) -> int:
    """Bytes that a walk through a range reads ahead: no more than the range has, at most a megabyte."""
    return min(1 << 20, max(1 << 12, int(high) - int(low)))


def _dealt(ranges: DataFrame) -> DataFrame:
    """``ranges`` over as many tasks as the session shuffles to, however few bytes they are: opening files is the work, not the rows."""
    return ranges.repartition(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "low")


def _range_starts(ranges: DataFrame) -> DataFrame:
    """``ranges`` with start, the place of the first record (given, or else guessed), leave, where the walk from it leaves the range, and n, its records.

    The first range of a file starts behind the file's header, if that is one. A range without a start, in the midst of a long
    record, has -1 for both.
    """
    def run(batches):
        for pdf in batches:
            starts, leaves, counts = [], [], []
            for file, size, low, high, given in zip(pdf["file"], pdf["size"], pdf["low"], pdf["high"], pdf["given"]):
                with opened(file) as stream:
                    w = Window(stream, int(size), _ahead(low, high))
                    if given >= -1:
                        at = int(given)
                    elif low == 0:
                        at = FILE_HEADER if w.bytes(0, 8) == MAGIC and size >= FILE_HEADER else -1
                    else:
                        at = resynchronised(w, int(low), int(high))
                    starts.append(at)
                    n = 0
                    while 0 <= at < high and (h := w.head(at)) is not None:
                        at, n = h[1], n + 1
                    leaves.append(at)
                    counts.append(n)
            yield pdf.assign(start=starts, leave=leaves, n=counts)

    return ranges.mapInPandas(run, "file string, size bigint, low bigint, high bigint, given bigint, start bigint, leave bigint, n bigint")


def scan_logs(spark: SparkSession, path: str, range_bytes: int = 64 << 20, batch: int = 20_000) -> DataFrame:
    """``(file, ord, t_start_us, baud, rec_type, t_host_us, payload)`` of all whole records, read in byte ranges.

    A range guesses its first record by a chain of lengths and walks on; its neighbours confirm the guess, as a walk must
    arrive where the next one starts. Ranges that were guessed wrong (a payload may look like records) are walked
    again from where their neighbour arrived, until all agree, so the records are those of one walk over the
    file. ``at`` is the record's place in it. A cut-off tail ends a file; unreadable headers give no rows. A file of one
    range starts behind its header and is walked once.
    """
    order = Window_.partitionBy("file").orderBy("low")
    ranges = cut_lineage(log_ranges(spark, path, range_bytes))
    alone = (F.col("low") == 0) & (F.col("high") == F.col("size"))
    known = cut_lineage(_range_starts(_dealt(ranges.where(~alone).withColumn("given", F.lit(-2).cast("bigint")))))
    while True:
        # where the walk before arrives: at a start in this range, or beyond it, where it has none; a stop before it (cut-off tail) leaves none either
        came = F.lag("leave").over(order)
        want = F.when(F.col("low") == 0, F.col("start")).when((came >= F.col("low")) & (came < F.col("high")), came).otherwise(-1)
        passed = F.when((came >= F.col("high")), came).otherwise(-1)
        checked = known.withColumns({"want": want, "passed": passed})
        wrong = cut_lineage(checked.where("start <> want OR (want = -1 AND low > 0 AND leave <> passed)"))
        if wrong.isEmpty():
            break
        again = _range_starts(_dealt(wrong.select("file", "size", "low", "high", F.col("want").alias("given"))))
        again = again.join(wrong.select("file", "low", "want", "passed"), ["file", "low"]).withColumn("leave", F.when(F.col("want") == -1, F.col("passed")).otherwise(F.col("leave")))
        rest = known.join(wrong.select("file", "low"), ["file", "low"], "left_anti")
        known = cut_lineage(rest.unionByName(again.select(*known.columns)))

    kinds = [("file", pa.string()), ("ord", pa.int64()), ("t_start_us", pa.int64()), ("baud", pa.int64()), ("rec_type", pa.int32()), ("t_host_us", pa.int64()), ("payload", pa.binary())]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, (_, kind) in zip(zip(*rows), kinds)], [name for name, _ in kinds])

    def read(parts):
        rows = []  # of many small files together
        for part in parts:
            for file, size, low, high, at, number in zip(*part.to_pydict().values()):
                with opened(file) as stream:
                    w = Window(stream, size, _ahead(low, high))
                    head = w.bytes(0, FILE_HEADER)
                    if head[:8] != MAGIC:
                        continue
                    start, baud = int.from_bytes(head[8:16], "little"), int.from_bytes(head[16:20], "little")
                    while at < high and (h := w.head(at)) is not None:
                        data = w.bytes(at, h[1] - at)
                        rows.append((file, number, start, baud, h[0], int.from_bytes(data[1:9], "little"), data[RECORD_HEADER:]))
                        at, number = h[1], number + 1
                        if len(rows) == batch:
                            yield table(rows)
                            rows = []
        if rows:
            yield table(rows)

    first = F.coalesce(F.sum("n").over(order.rowsBetween(Window_.unboundedPreceding, -1)), F.lit(0))
    starts = known.withColumn("first", first).where("n > 0").select("file", "size", "low", "high", "start", "first")
    whole = ranges.where(alone).select("file", "size", "low", "high", F.lit(FILE_HEADER).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("first"))
    return _dealt(starts.unionByName(whole)).mapInArrow(read, f"file string, ord bigint, t_start_us bigint, baud bigint, {RECORD}")


# Payload layouts.
RECORD_DT = np.dtype([("rec_type", "u1"), ("t_host_us", "<u8"), ("len", "<u2")])
IMU_DT = np.dtype([("t_us", "<i4"), ("ax_raw", "<i2"), ("ay_raw", "<i2"), ("az_raw", "<i2"), ("gx_raw", "<i2"), ("gy_raw", "<i2"),
                   ("gz_raw", "<i2"), ("temp_raw", "<i2"), ("mx_raw", "<i2"), ("my_raw", "<i2"), ("mz_raw", "<i2")])
CAMERA_DT = np.dtype([("frame_id", "<u4"), ("width", "<u2"), ("height", "<u2")])
AUDIO_DT = np.dtype([("seq", "<u4"), ("rate", "<u2"), ("channels", "u1"), ("bits", "u1")])


def unpack(layout: np.dtype, b: Column) -> dict[str, Column]:
    """The fields of the fixed-layout, little-endian head of a binary column as whole numbers; missing bytes are zeros.

    Expressions of Spark's own, of which only those in use are computed: a chain of parsing steps needs no Python worker for each.
    """
    size = layout.itemsize
    digits = F.rpad(F.coalesce(F.hex(F.substring(b, 1, size)), F.lit("")), 2 * size, "0")

    def field(kind, at):
        number = F.conv(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(at, at + kind.itemsize))]), 16, -10).cast("bigint")
        spare = 64 - 8 * kind.itemsize
        return F.shiftright(F.shiftleft(number, spare), spare) if kind.kind == "i" else number

    return {n: field(*layout.fields[n][:2]).alias(n) for n in layout.names}


def parse_records(df: DataFrame, data: str = "data", keep=()) -> DataFrame:
    """One framed record per message (header + payload); short or truncated ones are dropped."""
    b = F.col(data)
    head = unpack(RECORD_DT, b)
    rows = df.filter(F.octet_length(b) >= RECORD_HEADER).withColumns({"_type": head["rec_type"].cast("int"), "_t": head["t_host_us"], "_len": head["len"].cast("int")})
    rows = rows.withColumn("payload", F.substring(b, F.lit(RECORD_HEADER + 1), F.col("_len")))
    return rows.filter(F.octet_length("payload") == F.col("_len")).select(*keep, F.col("_type").alias("rec_type"), F.col("_t").alias("t_host_us"), "payload")


def decode_imu(records: DataFrame, mag_default=None) -> DataFrame:
    """Raw counts of IMU records; legacy frames without magnetometer give ``mag_default``."""
    n = F.octet_length("payload")
    field = unpack(IMU_DT, F.col("payload"))
    mag = [c for c in IMU_DT.names if c.startswith("m")]
    return records.filter((F.col("rec_type") == IMU) & (n >= IMU_LEGACY)).select(
        *records.columns, *[x for c, x in field.items() if c not in mag], *[F.when(n >= IMU_LEN, field[c]).otherwise(F.lit(mag_default)).alias(c) for c in mag])


def scale_imu(df: DataFrame, acc_range="acc_range", gyr_range="gyr_range") -> DataFrame:
    """Counts to g, degrees per second, degrees Celsius and µT."""
    return df.withColumns({
        **{f"acc_{a}_g": F.col(f"a{a}_raw") / 32768 * F.col(acc_range) for a in "xyz"},
        **{f"gyr_{a}_dps": F.col(f"g{a}_raw") / 32768 * F.col(gyr_range) for a in "xyz"},
        **{f"mag_{a}_ut": F.col(f"m{a}_raw") / 256.0 for a in "xyz"},
        "temp_c": 23.0 + F.col("temp_raw") / 512.0})


def with_ranges(records: DataFrame, keys, order, keep_previous: bool) -> DataFrame:
    """Sensor ranges in force at every record, from the latest CFG command or META record.

    A META record that names only one range leaves the other at its default (stream rule) or at its
    previous value (``keep_previous``, log rule).
    """
    text = F.decode("payload", "utf-8")
    cmd = F.when(F.col("rec_type") == CMD, parse_cfg(text))
    meta = F.when(F.col("rec_type") == META, F.from_json(text, "cfg struct<acc_range:int,gyr_range:int>"))
    hit = meta["cfg"]["acc_range"].isNotNull() | meta["cfg"]["gyr_range"].isNotNull()

    def value(name, default):
        other = meta["cfg"][name]
        return F.coalesce(cmd[name], F.when(hit, other if keep_previous else F.coalesce(other, F.lit(default))))

    t, *ties = order
    rows = records.withColumns({"_a": value("acc_range", ACC_RANGE), "_g": value("gyr_range", GYR_RANGE)})
    out = ordered(rows, Seq.by_time(keys, t, ties, 600_000_000), Fill("acc_range", "_a"), Fill("gyr_range", "_g"))
    return out.withColumns({"acc_range": F.coalesce("acc_range", F.lit(ACC_RANGE)), "gyr_range": F.coalesce("gyr_range", F.lit(GYR_RANGE))}).drop("_a", "_g", "_chunk")


def log_to_table(records: DataFrame) -> DataFrame:
    """Typed samples with engineering units, raw counts and time since the log started."""
    imu = decode_imu(with_ranges(records, ["file"], ["t_host_us", "ord"], True), mag_default=0)
    return scale_imu(imu).withColumn("t_rel_s", (F.col("t_host_us") - F.col("t_start_us")) / 1e6).drop("payload", "rec_type")


def log_info(records: DataFrame) -> DataFrame:
    """Records per type, duration and sample rate of each log."""
    dur = (F.max("t_host_us") - F.min("t_host_us")) / 1e6
    return records.groupBy("file", "rec_type").agg(
        F.count(F.lit(1)).alias("n"), dur.alias("duration_s"), F.when(dur > 0, (F.count(F.lit(1)) - 1) / dur).alias("per_s"))


def merge_logs(records: DataFrame, file_order: str = "file", parts: int | None = None) -> DataFrame:
    """All records in one order ``(host time, file, position)``, range-partitioned, with the merged header."""
    head = records.agg(F.min("t_start_us").alias("s"), F.min_by("baud", F.when(F.col("baud") > 0, F.struct(file_order))).alias("b"))
    start, baud = head.select("s").scalar(), F.coalesce(head.select("b").scalar(), F.lit(0).cast("bigint"))
    key = ["t_host_us", file_order, "ord"]
    ranged = records.repartitionByRange(parts, *key) if parts else records.repartitionByRange(*key)
    return ranged.sortWithinPartitions(*key).withColumns({"t_start_us": start, "baud": baud})


def audio_chunks(records: DataFrame) -> DataFrame:
    """Header fields and PCM bytes of audio records; header-only payloads carry no sound and are dropped."""
    n = F.octet_length("payload")
    head = unpack(AUDIO_DT, F.col("payload"))
    return records.filter((F.col("rec_type") == AUDIO) & (n > 8)).select("file", "ord", "t_host_us", *head.values(), F.substring("payload", F.lit(9), n).alias("pcm"))


def audio_chunk_stitch(chunks: DataFrame, bucket: int = 256) -> DataFrame:
    """PCM in file order as bounded pieces of ``bucket`` chunks, with the number of sequence gaps in each."""
    seq = Seq(("file",), ("ord",), "ord div 100000")
    rows = ordered(chunks, seq, Lag("_p", "seq")).withColumns({
        "gap": (F.col("_p").isNotNull() & (F.col("seq") != F.col("_p") + 1)).cast("int"), "piece": F.expr(f"ord div {bucket}")})
    parts = F.sort_array(F.collect_list(F.struct("ord", "pcm")))
    joined = F.unhex(F.array_join(F.transform(parts, lambda r: F.hex(r["pcm"])), ""))
    return rows.groupBy("file", "piece").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("gap").alias("gaps"), F.min("rate").alias("rate"), joined.alias("pcm"))


def camera_rows(records: DataFrame) -> DataFrame:
    """Frame header and base64 image; header-only payloads carry no image and are dropped."""
    n = F.octet_length("payload")
    head = unpack(CAMERA_DT, F.col("payload"))
    rows = records.filter((F.col("rec_type") == CAMERA) & (n > 8))
    keep = [c for c in records.columns if c not in ("payload", "rec_type")]
    return rows.select(*keep, head["frame_id"], head["width"].cast("int").alias("width"), head["height"].cast("int").alias("height"),
                       F.lit("jpeg").alias("format"), F.lit("base64").alias("encoding"), head["frame_id"].alias("t_us"),
                       F.base64(F.substring("payload", F.lit(9), n)).alias("data"))


def route_by_type(records: DataFrame) -> dict[str, DataFrame]:
    """The derived topics of a raw stream; STATUS and AUDIO have none."""
    return {"imu": decode_imu(records), "mag": decode_imu(records).filter("mx_raw IS NOT NULL"), "camera": camera_rows(records)}
