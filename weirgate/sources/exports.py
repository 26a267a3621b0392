"""Sinks' line formats: OTLP log records and RFC 5424 syslog lines."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Severity numbers and names of records that warn and of all others.
WARN, INFO = (13, "WARN"), (9, "INFO")


def otlp_record(at_ms: Column, event: Column, body: Column, attributes: dict[str, Column], warns: Column | None = None, numbers: tuple[str, ...] = (), trace: Column | None = None, span: Column | None = None) -> Column:
    """One log record as JSON: time, severity, event name, body, attributes, and hex trace and span ids if there are any.

    Attributes are strings but for those named in ``numbers``; null ones are left out.
    """
    warns = F.coalesce(warns, F.lit(False)) if warns is not None else F.lit(False)

    def attribute(k: str, v: Column) -> Column:
        text, whole = (F.lit(None), v.cast("long")) if k in numbers else (v.cast("string"), F.lit(None))
        return F.struct(F.lit(k).alias("key"), F.struct(text.cast("string").alias("stringValue"), whole.cast("long").alias("intValue")).alias("value"))

    values = F.array(*[attribute(k, v) for k, v in attributes.items()])
    kept = F.filter(values, lambda a: a["value"]["stringValue"].isNotNull() | a["value"]["intValue"].isNotNull())
    severity = F.when(warns, F.lit(WARN[0])).otherwise(INFO[0]).alias("severityNumber"), F.when(warns, F.lit(WARN[1])).otherwise(INFO[1]).alias("severityText")
    ids = [] if trace is None or span is None else [F.when(span.isNotNull(), trace).alias("traceId"), F.when(trace.isNotNull(), span).alias("spanId")]
    return F.to_json(F.struct((at_ms * 1_000_000).cast("string").alias("timeUnixNano"), *severity, event.alias("eventName"), F.struct(body.alias("stringValue")).alias("body"), kept.alias("attributes"), *ids))


def otlp_payload(records: DataFrame, record: str, batch: str, service: str = "weirgate") -> DataFrame:
    """(batch, payload): the records of each batch wrapped for export, with the service as resource and the engine as scope.

    A batch is one row and one request, so its number of records is to be bounded by whoever numbers the batches.
    """
    joined = F.concat_ws(",", F.array_sort(F.collect_list(record)))
    named = f'{{"resourceLogs":[{{"resource":{{"attributes":[{{"key":"service.name","value":{{"stringValue":{json.dumps(service)}}}}}]}},"scopeLogs":[{{"scope":{{"name":"weirgate"}},"logRecords":['
    return records.groupBy(batch).agg(F.concat(F.lit(named), joined, F.lit("]}]}]}")).alias("payload"))


def syslog_line(priority: int, app: Column, at_ms: Column, message: Column, most_bytes: int = 2048) -> Column:
    """An RFC 5424 line without structured data, cut to ``most_bytes`` of UTF-8 at a character."""
    stamp = F.date_format(F.timestamp_millis(at_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    clean = F.regexp_replace(message, r"[\r\n\t]+", " ")
    line = F.concat(F.lit(f"<{priority}>1 "), stamp, F.lit(" - "), app, F.lit(" - - - "), clean)
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(line, "UTF-8"), 1, most_bytes).cast("string")), "�+$", "")
    return F.when(F.octet_length(line) <= most_bytes, line).otherwise(cut)
