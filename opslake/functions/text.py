"""Text functions of log messages, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that must match what existing users' data was labelled with.
ERROR_WORDS = r"(?i)\b(error|exception|fatal|panic|timeout|timed\s+out|refused|failed|failure)\b"
INSTRUMENTATION = r"(?i)\bchaos(?:blade|mesh|_|\b)|fault[_ -]injection"
LIFECYCLE_LINE = r"^\S+ (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+) \d+ (DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL) (\S+) (.*)"
INSTANCE = r"\[instance: ([0-9a-f-]{36})\]"
UUID = r"(?i)\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b"
OPERATIONS = (
    "spawn the instance on the hypervisor",
    "build instance",
    "destroy the instance on the hypervisor",
    "deallocate network for instance",
)
DURATION = r"Took (\d+(?:\.\d+)?) seconds to (" + "|".join(OPERATIONS) + r")\."
TEMPLATE_LIMIT = 2000
LEADING_BRACKET = r"^\[[^\]]+\]\s*"
HEX_RUN = r"\b[0-9a-fA-F]{12,}\b"
SIGNED_NUMBER = r"(?<![A-Za-z])[-+]?\d+(?:\.\d+)?"
PLAIN_NUMBER = r"\b\d+(?:\.\d+)?\b"
HEX_VALUE = r"0x[0-9a-fA-F]+"
CAPITAL_INSIDE = r"(?<!^)(?=[A-Z])"
SERVICE_EXCEPTION = ("NginxThrift", "nginx-thrift")
BRACKET_STAMP = r"^\[(\d{4}-[A-Za-z]{3}-\d{2} \d{2}:\d{2}:\d{2}\.\d{6})\]"
RUN_STAMP = r"(\d{8})[T_](\d{6})"
RUN_SEPARATOR = "_metrics_"
REQUEST_PREFIX = r"^\[req-[^\]]+\]\s*"


def log_template(message: Column, limit: int = TEMPLATE_LIMIT) -> Column:
    """The message without its leading bracket, ids and numbers masked, blanks folded, lower case, at most limit characters."""
    out = F.regexp_replace(F.regexp_replace(message, r"^\s+|\s+$", ""), LEADING_BRACKET, "")
    out = F.regexp_replace(out, HEX_RUN, "<id>")
    out = F.regexp_replace(out, SIGNED_NUMBER, "<num>")
    return F.substring(F.lower(F.regexp_replace(out, r"\s+", " ")), 1, limit)


def mask_numbers(message: Column) -> Column:
    return F.regexp_replace(message, PLAIN_NUMBER, "<NUM>")


def severity_text(severity: Column, message: Column) -> Column:
    """Severity and message, hexadecimal values and numbers masked."""
    masked = F.regexp_replace(F.regexp_replace(message, HEX_VALUE, "HEX"), PLAIN_NUMBER, "NUM")
    return F.concat_ws(" ", severity, masked)


def has_error_word(message: Column) -> Column:
    return message.rlike(ERROR_WORDS)


def is_instrumentation(message: Column) -> Column:
    return message.rlike(INSTRUMENTATION)


def kebab_service(name: Column) -> Column:
    """``UserMentionService_`` to ``user-mention-service``; one name that does not follow the rule is fixed."""
    bare = F.regexp_replace(name, "_$", "")
    return F.when(bare == SERVICE_EXCEPTION[0], SERVICE_EXCEPTION[1]).otherwise(F.lower(F.regexp_replace(bare, CAPITAL_INSIDE, "-")))


def bracket_epoch(line: Column) -> Column:
    """Epoch seconds of a leading ``[2025-Nov-03 22:03:07.084255]`` (UTC), null where there is none."""
    stamp = F.regexp_extract(line, BRACKET_STAMP, 1)
    return F.unix_micros(F.try_to_timestamp(stamp, F.lit("yyyy-MMM-dd HH:mm:ss.SSSSSS"))) / 1e6


def lifecycle_fields(line: Column) -> dict[str, Column]:
    """Level, logger, instance and body text of a lifecycle log line; null where the line does not parse."""
    ok = line.rlike(LIFECYCLE_LINE)
    part = lambda i: F.when(ok, F.regexp_extract(line, LIFECYCLE_LINE, i))
    body = F.regexp_replace(part(4), REQUEST_PREFIX, "")
    instance = F.regexp_extract(part(4), INSTANCE, 1)
    return {
        "observed": part(1),
        "level": part(2),
        "logger": part(3),
        "instance": F.when(instance != "", instance),
        "template": log_template(F.regexp_replace(body, UUID, "<id>")),
    }


def duration_fields(line: Column) -> dict[str, Column]:
    """Operation and seconds of a ``Took N seconds to ...`` line that also names an instance."""
    ok = line.rlike(LIFECYCLE_LINE) & line.rlike(INSTANCE) & line.rlike(DURATION)
    return {
        "instance": F.when(ok, F.regexp_extract(line, INSTANCE, 1)),
        "operation": F.when(ok, F.regexp_extract(line, DURATION, 2)),
        "duration_seconds": F.when(ok, F.regexp_extract(line, DURATION, 1).try_cast("double")),
    }


def severity_line(line: Column) -> dict[str, Column]:
    """Label (field 0), node (3), severity (8) and message (9) of a ten-field log line; null for fewer fields."""
    fields = F.split(line, r"\s+", 10)
    ok = F.size(fields) == 10
    pick = lambda i: F.when(ok, F.get(fields, i))
    return {"label": F.when(ok, (F.get(fields, 0) != "-").cast("int")), "node": pick(3), "severity": pick(8), "message": pick(9)}


def run_stamp(name: Column) -> Column:
    """The ``yyyyMMdd_HHmmss`` (or with T) stamp in a run's name as a timestamp."""
    stamp = F.regexp_extract(name, RUN_STAMP, 0)
    return F.try_to_timestamp(F.translate(stamp, "T_", ""), F.lit("yyyyMMddHHmmss"))


def run_key(name: Column) -> Column:
    """A run's name up to its stamp, null where it has none."""
    return F.when(name.rlike(RUN_STAMP), F.substring_index(name, RUN_SEPARATOR, 1))


def evidence_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 20)
