"""Decoding, validating and addressing telemetry messages (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def ts_to_unix_us(ts: Column) -> Column:
    """ISO-8601 text (``Z``, offset, or naive meaning UTC) to unix µs; null if unparseable."""
    return F.unix_micros(F.try_to_timestamp(ts))


def _parse(raw: Column, schema, required, numeric=()):
    """Lenient JSON: keep the object as text fields, then cast, so one bad field loses one row only."""
    ddl = ", ".join(f"`{f.name}` string" for f in schema.fields)
    obj = F.from_json(raw, ddl)
    present = F.coalesce(F.json_object_keys(raw), F.array())
    ok = F.size(F.array_intersect(present, F.array(*[F.lit(r) for r in required]))) == len(required)
    for n in numeric:
        ok = ok & obj[n].try_cast("double").isNotNull()
    return obj, ok


def parse_messages(df: DataFrame, raw: str, schema, required, numeric=(), has_ts=True, keep=()):
    """``(valid, quarantined)``: typed rows with every required field, and the rest untouched."""
    obj, ok = _parse(F.col(raw), schema, required, numeric)
    if has_ts:
        bad_ts = ts_to_unix_us(obj["ts"]).isNull()
        ok = ok & ~(bad_ts if "ts" in required else (obj["ts"].isNotNull() & bad_ts))
    tagged = df.withColumn("_obj", obj).withColumn("_ok", F.coalesce(ok, F.lit(False)))
    fields = [F.col("_obj")[f.name].try_cast(f.dataType).alias(f.name) for f in schema.fields]
    if has_ts:
        fields.append(ts_to_unix_us(F.col("_obj.ts")).alias("ts_us"))
    valid = tagged.filter("_ok").select(*keep, *fields)
    return valid, tagged.filter("NOT _ok").drop("_obj", "_ok")


def parse_inference(df, raw="value", keep=()):
    return parse_messages(df, raw, S.ANOMALY, ("ts", "anomaly_score"), ("anomaly_score",), keep=keep)


def parse_label(df, raw="value", keep=()):
    return parse_messages(df, raw, S.LABEL, ("ts", "container_id", "label"), keep=keep)


def parse_deploy(df, raw="value", keep=()):
    return parse_messages(df, raw, S.DEPLOY, ("model_version",), keep=keep)


def parse_capture(df, raw="value", keep=()):
    return parse_messages(df, raw, S.CAPTURE, ("features_b64",), has_ts=False, keep=keep)


def parse_device_line(df: DataFrame, raw: str = "raw", keep=()) -> DataFrame:
    """Serial lines (bytes) to boundary-ready messages; noise of any kind is skipped."""
    text = F.trim(F.try_validate_utf8(F.col(raw).cast("string")))
    valid, _ = parse_messages(
        df.withColumn("_line", text).filter("_line <> ''").withColumn("wire_bytes", F.octet_length("_line")),
        "_line", S.ANOMALY, ("container_id", "anomaly_score"), ("anomaly_score",), has_ts=False,
        keep=(*keep, "wire_bytes"))
    return valid.withColumns({
        "data_classification": F.lit("inference"), "bytes": F.col("wire_bytes").cast("bigint"),
    }).drop("wire_bytes")


def parse_subject(df: DataFrame, subject: str = "subject") -> DataFrame:
    """``edge.<kind>.<line>.<container>`` and the 3-token ``edge.<line>.<container>`` (kind = anomaly)."""
    parts = F.split(F.col(subject), r"\.", 4)
    four = F.size(parts) >= 4
    return df.withColumns({
        "kind": F.when(four, parts[1]).otherwise(F.lit("anomaly")),
        "line": F.when(four, parts[2]).when(F.size(parts) == 3, parts[1]),
        "container_id": F.when(four, F.get(parts, F.lit(3))).when(F.size(parts) == 3, parts[2]),
    })


def edge_subject(line, container, kind=None):
    return F.concat_ws(".", F.lit("edge"), *([kind] if kind is not None else []), line, container)


def label_subject(line, container):
    return F.concat_ws(".", F.lit("labels"), line, container)


def deploy_subject(line):
    return F.concat_ws(".", F.lit("models"), line, F.lit("deploy"))


def capture_subject(line, container):
    return F.concat_ws(".", F.lit("capture"), line, container, F.lit("cmd"))


def subject_regex(pattern: Column) -> Column:
    """Wildcard subject to regex: ``*`` is one token, a trailing ``>`` is one or more tokens."""
    escaped = F.regexp_replace(pattern, r"([.$])", r"\\$1")
    stars = F.regexp_replace(escaped, r"\*", "[^.]+")
    return F.concat(F.lit("^"), F.regexp_replace(stars, ">$", ".+"), F.lit("$"))


def parse_cfg(cmd: Column) -> Column:
    """``CFG,odr,acc,odr,gyr[,power]`` to a struct; null when it is no valid CFG command."""
    p = F.split(F.trim(cmd), ",")
    num = [F.trim(F.get(p, F.lit(i))).try_cast("int") for i in range(1, 5)]
    ok = (F.size(p) >= 5) & (F.upper(F.get(p, F.lit(0))) == "CFG")
    for n in num:
        ok = ok & n.isNotNull()
    return F.when(ok, F.struct(
        num[0].alias("acc_odr"), num[1].alias("acc_range"), num[2].alias("gyr_odr"), num[3].alias("gyr_range"),
        F.coalesce(F.get(p, F.lit(5)), F.lit("normal")).alias("power")))


def boundary_policy(df: DataFrame, class_present: str | None = None) -> DataFrame:
    """Fail-closed class policy.  A missing class becomes ``unknown``; an explicit null stays null."""
    cls = F.col("data_classification")
    missing = cls.isNull() if class_present is None else ~F.col(class_present)
    cls = F.when(missing, F.lit("unknown")).otherwise(cls)
    return df.withColumns({
        "data_classification": cls,
        "bytes": F.coalesce(F.col("bytes").try_cast("bigint"), F.lit(0)),
        "disposition": F.when(cls == "inference", "egressed").otherwise("blocked"),
    })


def boundary_forward(policed: DataFrame) -> DataFrame:
    """What leaves the site: egressed events without gateway-internal fields."""
    return policed.filter("disposition = 'egressed'").drop(
        "data_classification", "bytes", "disposition", "subject")


def annotation_fanout(df: DataFrame, default_device: str = "cnc-7") -> DataFrame:
    """One annotation becomes a label message and, unless dismissed, a capture command."""
    line = F.coalesce("line", F.lit("line1"))
    note = F.coalesce(F.nullif("note", F.lit("")), F.concat(F.lit("track:"), F.col("location")))
    label = F.struct(
        label_subject(line, F.col("location")).alias("subject"), F.lit("label").alias("message"),
        F.col("location"), F.col("fault").alias("label"), note.alias("note"), F.lit(None).cast("string").alias("request_id"))
    device = F.coalesce("container_id", F.lit(default_device))
    capture = F.struct(
        capture_subject(line, device).alias("subject"), F.lit("capture").alias("message"), F.col("location"),
        F.col("fault").alias("label"), F.lit(None).cast("string").alias("note"),
        F.concat(F.lit("cap-annotate-"), F.col("location")).alias("request_id"))
    return (
        df.filter(F.col("fault").isin(*S.TRACK_FAULTS) & (F.col("location") != ""))
        .withColumn("m", F.explode(F.when(F.col("fault") != "dismiss", F.array(label, capture)).otherwise(F.array(label))))
        .select(*[c for c in df.columns if c in ("event_id", "ts_us")], "m.*")
    )


def json_size_fixpoint(base: Column) -> Column:
    """Smallest b with ``b = base + digits(b)``: the size of a message that states its own size."""
    out = F.lit(None).cast("bigint")
    for digits in range(12, 0, -1):
        n = base + digits
        out = F.when(F.length(n.cast("string")) == digits, n).otherwise(out)
    return out


def localize_project(df: DataFrame) -> DataFrame:
    """Stamp ``fix`` (struct of segment,x,y,t_host_us, or null) onto an anomaly and size the message."""
    out = df.withColumns({
        "segment": F.col("fix.segment"), "x": F.col("fix.x"), "y": F.col("fix.y"),
        "pos_t_host_us": F.col("fix.t_host_us"),
        "pos_age_ms": F.expr("(ts_us - fix.t_host_us) div 1000"),
        "data_classification": F.lit("inference"),
    }).drop("fix", "bytes")
    fields = [c for c in out.columns if not c.startswith("_")]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    base = F.octet_length(body).cast("bigint") + F.lit(len(',"bytes":'))
    return out.withColumn("bytes", json_size_fixpoint(base))


def permissions(fleet: DataFrame) -> DataFrame:
    """Least-privilege publish/subscribe lists per identity ``(id, role, line)``."""
    line, cid = F.col("line"), F.col("id")

    def subjects(*patterns):
        return F.array(*[F.format_string(p.replace("{l}", "%1$s").replace("{c}", "%2$s"), line, cid)
                         for p in patterns]) if patterns else F.array().cast("array<string>")

    role = F.col("role")
    # Subject allow-lists by role.
    pub = (F.when(role == "device", subjects("edge.{l}.{c}", "capture.{l}.{c}.data"))
           .when(role == "vector", subjects("inference.>"))
           .when(role == "bridge", subjects("labels.>", "models.>", "control.>", "$JS.API.>", "$JS.ACK.>"))
           .when(role == "fakegen", subjects("edge.{l}.>"))
           .when(role == "pipeline", subjects("models.>")))
    sub = (F.when(role == "device", subjects("models.{l}.deploy", "models.{l}.artifact", "control.{l}",
                                             "capture.{l}.{c}.cmd"))
           .when(role == "vector", subjects("edge.>"))
           .when(role == "bridge", subjects("inference.>", "labels.>", "models.>", "_INBOX.>", "$JS.API.>"))
           .when(role == "fakegen", subjects("control.{l}"))
           .when(role == "pipeline", subjects()))
    return fleet.select("id", "role", "line", pub.alias("publish"), sub.alias("subscribe"))


def acl_violations(published: DataFrame, acl: DataFrame) -> DataFrame:
    """Published subjects no pattern of the sender's allow-list covers.

    Subjects are made distinct per sender before the join, so a chatty sender costs one row.
    """
    rules = acl.select(F.col("id").alias("_id"), F.transform("publish", subject_regex).alias("_rx"))
    seen = published.groupBy("id", "subject").agg(F.count(F.lit(1)).alias("n_messages"))
    allowed = F.exists("_rx", lambda rx: F.rlike(F.col("subject"), rx))
    return seen.join(rules, seen["id"] == rules["_id"], "left").filter(
        ~F.coalesce(allowed, F.lit(False))).select("id", "subject", "n_messages")


def gate_model(profiles: DataFrame) -> DataFrame:
    """Deployability checks, one row per (model, check) plus the overall verdict."""
    ops = F.col("cpu_operators") + F.col("npu_operators")
    ratio = F.when(ops != 0, F.col("cpu_operators") / ops).otherwise(0.0)
    size = F.col("artifact_bytes") / 1024
    # The deployability budget.
    checks = F.array(
        F.struct(F.lit("SRAM working set").alias("check"), F.col("total_sram_used").alias("measured"), F.lit(3500.0).alias("budget")),
        F.struct(F.lit("Inference latency").alias("check"), F.col("batch_inference_time").alias("measured"), F.lit(50.0).alias("budget")),
        F.struct(F.lit("CPU-fallback ratio").alias("check"), ratio.alias("measured"), F.lit(0.10).alias("budget")),
        F.struct(F.lit("Flatbuffer size").alias("check"), size.alias("measured"), F.lit(1024.0).alias("budget")))
    measured = F.filter(checks, lambda c: c["measured"].isNotNull())
    return (
        profiles.withColumn("_checks", measured)
        .withColumn("passed", F.forall("_checks", lambda c: c["measured"] <= c["budget"]))
        .select("network", "passed", F.explode("_checks").alias("c"))
        .select("network", F.col("c.check").alias("check_name"), F.col("c.measured").alias("measured"),
                F.col("c.budget").alias("budget"), (F.col("c.measured") <= F.col("c.budget")).alias("ok"), "passed")
    )


def normalize_profile(df: DataFrame) -> DataFrame:
    """Compiler report rows to gate columns: seconds to ms, operator counts out of the text summary."""
    def ops(unit):
        return F.regexp_extract("stdout", rf"{unit} operators\s*=\s*(\d+)", 1).try_cast("int")

    return df.select(
        "network", F.round("sram_memory_used", 3).alias("total_sram_used"),
        F.round("off_chip_flash_memory_used", 3).alias("total_off_chip_flash_used"),
        ops("CPU").alias("cpu_operators"), ops("NPU").alias("npu_operators"),
        F.round(F.col("inference_time") * 1000.0, 4).alias("batch_inference_time"))
