"""Scalar rules as Spark columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from filelake.functions.fixed import CORRUPTION_MARKERS, IMAGE_EXTENSIONS, MIME_GROUPS, REPORT_FOLDERS, VIDEO_EXTENSIONS


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Lower-case text after the last dot; empty without one."""
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def normalise_extension(x: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(F.lower(F.trim(x)), r"^\*?\.?", "")), F.lit(""))


def media_type(ext: Column) -> Column:
    return F.when(ext.isin(IMAGE_EXTENSIONS), "IMAGE").when(ext.isin(VIDEO_EXTENSIONS), "VIDEO")


def glob_regex(pattern: str) -> str:
    """A file-name glob (``* ? [] {}``) as a regular expression; ValueError if malformed."""
    out, depth, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while pattern[i + 1 : i + 2] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed [ in {pattern!r}")
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("&&", "\\&\\&").replace("[", "\\[")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            if c == "\\" and i + 1 < len(pattern):
                i += 1
                c = pattern[i]
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed {{ in {pattern!r}")
    return "^" + "".join(out) + "$"


def ignored(name: Column, patterns: list[str]) -> Column:
    """Does any glob match the file name? Malformed patterns are dropped."""
    usable = []
    for p in patterns:
        try:
            usable.append(glob_regex(p))
        except ValueError:
            continue
    return F.coalesce(name.rlike("|".join(usable)), F.lit(False)) if usable else F.lit(False)


def corrupted(warning: Column) -> Column:
    return F.lower(warning).rlike("|".join(CORRUPTION_MARKERS))


def mime_base(mime: Column) -> Column:
    return F.trim(F.substring_index(F.lower(mime), ";", 1))


def mime_group(mime: Column) -> Column:
    """First group whose prefix or exact type matches; OTHER for anything else, null included."""
    m, rules = mime_base(mime), None
    for group, _, _, prefixes, exact in MIME_GROUPS[:-1]:
        tests = [m.startswith(p) for p in prefixes] + ([m.isin(exact)] if exact else [])
        test = reduce(lambda a, b: a | b, tests)
        rules = F.when(test, group) if rules is None else rules.when(test, group)
    return rules.otherwise("OTHER")


def deletable(group: Column) -> Column:
    return group.isin([g for g, _, ok, _, _ in MIME_GROUPS if ok])


def is_report_artifact(relative: Column) -> Column:
    return relative.rlike("(^|/)(" + "|".join(REPORT_FOLDERS) + ")(/|$)")


def csv_escape(x: Column) -> Column:
    x = F.coalesce(x, F.lit(""))
    return F.when(x.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def suffix_of(name: Column) -> Column:
    return F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)


def numbered(name: Column, n: Column, form: str = "({})") -> Column:
    """``name`` with a number put before its extension."""
    before, after = form.split("{}")
    return F.concat(stem(name), F.lit(before), n.cast("string"), F.lit(after), suffix_of(name))


def duration(start: Column, end: Column) -> Column:
    s = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return F.coalesce(F.format_string("%d:%02d:%02d", F.expr("0") + F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60), F.lit(""))


def human_bytes(n: Column) -> Column:
    kb = 1024.0
    return (
        F.when(n < kb, F.concat(n.cast("string"), F.lit(" B"))).when(n < kb**2, F.format_string("%.1f KB", n / kb)).when(n < kb**3, F.format_string("%.1f MB", n / kb**2))
        .when(n < kb**4, F.format_string("%.2f GB", n / kb**3)).otherwise(F.format_string("%.2f TB", n / kb**4))
    )


def human_rate(mb: Column) -> Column:
    return F.when(mb >= 1024.0, F.format_string("%.2f GB/s", mb / 1024.0)).when(mb >= 1.0, F.format_string("%.1f MB/s", mb)).otherwise(F.format_string("%.1f KB/s", mb * 1024.0))


def clock(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def elapsed_short(seconds: Column) -> Column:
    """``5s``, ``3m 05s``, ``1h 02m``."""
    s = F.floor(seconds)
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.format_string("%dm %02ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
    )


def minutes_long(millis: Column) -> Column:
    """``5s``, ``3 min 05 s``."""
    s = F.floor(millis / 1000)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).otherwise(F.format_string("%d min %02d s", F.floor(s / 60), s % 60))


def run_id(kind: str, when: Column, number: Column | None = None) -> Column:
    """``JOB-20240301-100000-001``; runs of other kinds have no number."""
    stamp = F.concat(F.lit(f"{kind}-"), F.date_format(when, "yyyyMMdd-HHmmss"))
    return stamp if number is None else F.concat(stamp, F.format_string("-%03d", number))


def parse_instant(text: Column) -> Column:
    """An ISO instant, shifted to the session's zone, else an ISO local date and time, else null (``timestamp_ntz``)."""
    iso = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
    short = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    zoned = F.when(text.rlike(iso + "Z$"), short.try_cast("timestamp").cast("timestamp_ntz"))
    return F.coalesce(zoned, F.when(text.rlike(iso + "$"), short.try_cast("timestamp_ntz")))


def creation_time(probed: Column) -> Column:
    """The container's creation time in the JSON of a media probe: that of the format, else of its first stream; null if neither is a time."""
    return F.coalesce(*[parse_instant(F.get_json_object(probed, f"$.{place}.tags.creation_time")) for place in ("format", "streams[0]")])


def first_line(text: Column) -> Column:
    return F.element_at(F.split(text, r"\r\n|\r|\n"), 1)


def describe_failure(kind: Column, message: Column) -> Column:
    """``Type: message``; the type alone without a message."""
    return F.concat_ws(": ", kind, F.nullif(message, F.lit("")))


def fraction_done(total: Column, processed: Column) -> Column:
    return F.when(total > 0, processed / total)


def remaining(total: Column, processed: Column) -> Column:
    return F.greatest(F.lit(0), total - processed)


def digests(content: Column, head: int) -> tuple[Column, Column]:
    """(SHA-256 of the content, SHA-256 of its first ``head`` characters or bytes)."""
    return F.sha2(content, 256), F.sha2(F.substring(content, 1, head), 256)


def capture_date(embedded: Column, created: Column, modified: Column) -> tuple[Column, Column]:
    """(date, source): embedded, else creation, else modification; the epoch counts as absent."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    e, c, m = embedded.cast("timestamp_ntz"), F.nullif(created.cast("timestamp_ntz"), epoch), F.nullif(modified.cast("timestamp_ntz"), epoch)
    source = F.when(e.isNotNull(), "EMBEDDED_CAPTURE").when(c.isNotNull(), "FILE_CREATION").when(m.isNotNull(), "FILE_MODIFIED")
    return F.coalesce(e, c, m), source
