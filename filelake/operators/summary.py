"""Job summaries: an ordered map of display fields, written as JSON, CSV or HTML with an inline chart.

The fields are string columns computed in Spark, so all three formats say the same. A column
that the statistics lack, or that is null, counts as zero (numbers) or empty text (the rest).
Charts take samples that were reduced before (``series.bucket_average`` or ``envelope``).
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelake.functions import columns as C

# The labels of a summary in display order, how each is formatted, and its column.
FIELDS = [
    ("Job ID", "text", "job_id"), ("Status", "text", "status"), ("Start time", "time", "start_time"), ("End time", "time", "end_time"), ("Duration", "duration", ""),
    ("Files processed", "count", "files_processed"), ("Files copied", "count", "files_copied"), ("Files moved", "count", "files_moved"), ("Files skipped", "count", "files_skipped"),
    ("Files failed", "count", "files_failed"), ("Duplicates found", "count", "duplicates_found"), ("Empty files", "count", "empty_files"), ("Small files", "count", "small_files"),
    ("Corrupt files", "count", "corrupt_files"), ("Folders created", "count", "folders_created"),
    ("Data processed", "bytes", "bytes_processed"), ("Data copied", "bytes", "bytes_copied"), ("Data moved", "bytes", "bytes_moved"), ("Data skipped", "bytes", "bytes_skipped"),
    ("Duplicate data saved", "bytes", "bytes_saved"),
    ("Average files/sec", "decimal", "avg_files_per_sec"), ("Peak files/sec", "decimal", "peak_files_per_sec"), ("Average MB/sec", "decimal", "avg_mb_per_sec"),
    ("Peak MB/sec", "decimal", "peak_mb_per_sec"), ("Average GB/sec", "gigas", "avg_mb_per_sec"), ("Peak GB/sec", "gigas", "peak_mb_per_sec"),
    ("Average CPU %", "decimal", "avg_cpu_percent"), ("Peak CPU %", "decimal", "peak_cpu_percent"), ("Average memory GB", "decimal", "avg_memory_gb"), ("Peak memory GB", "decimal", "peak_memory_gb"),
]

CHART = (960, 280, 40)


def iso(ts: Column) -> Column:
    """Local ISO time; the fraction loses its trailing zeros."""
    full = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.coalesce(F.regexp_replace(full, r"\.?0*$", ""), F.lit(""))


def summary_fields(stats: DataFrame) -> DataFrame:
    """One string column for each field, named by its label, in display order."""
    there = set(stats.columns)

    def number(name: str, kind: str) -> Column:
        return F.coalesce(F.col(name).cast(kind), F.lit(0).cast(kind)) if name in there else F.lit(0).cast(kind)

    def shown(how: str, name: str) -> Column:
        if how == "duration":
            return C.duration(F.col("start_time"), F.col("end_time")) if {"start_time", "end_time"} <= there else F.lit("")
        if how == "time":
            return iso(F.col(name)) if name in there else F.lit("")
        if how == "text":
            return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in there else F.lit("")
        if how == "count":
            return number(name, "long").cast("string")
        if how == "bytes":
            return C.human_bytes(number(name, "long"))
        return F.format_string("%.2f", number(name, "double") / F.lit(1024.0 if how == "gigas" else 1.0))

    return stats.select(*[shown(how, name).alias(label) for label, how, name in FIELDS])


def long_form(fields: DataFrame) -> DataFrame:
    """``job_id, pos, field, value``: one row for each field of each job."""
    each = [F.struct(F.lit(k).alias("pos"), F.lit(label).alias("field"), F.col(f"`{label}`").alias("value")) for k, (label, _, _) in enumerate(FIELDS)]
    return fields.select(F.col("`Job ID`").alias("job_id"), F.inline(F.array(*each)))


def csv_rows(fields: DataFrame) -> DataFrame:
    """One escaped CSV line for each job, column ``line``."""
    return fields.select(F.concat_ws(",", *[C.csv_escape(F.col(f"`{label}`")) for label, _, _ in FIELDS]).alias("line"))


def _escaped(text: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = text.replace(a, b)
    return text


def chart(samples: list[tuple[float, float, float]]) -> str:
    """An SVG with one line for files and one for MB a second over (elapsed, files, mb); a note below two samples."""
    if len(samples) < 2:
        return "<p>No throughput history recorded for this job.</p>"
    wide, high, pad = CHART
    most = [m if (m := max(s[k] for s in samples)) > 0 else 1 for k in range(3)]
    x = lambda s: pad + (wide - 2 * pad) * s[0] / most[0]
    y = lambda s, k: high - pad - (high - 2 * pad) * s[k] / most[k]
    parts = [f'<svg viewBox="0 0 {wide} {high}" role="img" aria-label="Throughput">', f'<path d="M{pad} {pad}V{high - pad}H{wide - pad}" fill="none" stroke="gray"/>']
    for k, colour, name in ((1, "steelblue", "files/sec"), (2, "chocolate", "MB/sec")):
        points = " ".join(f"{x(s):.1f},{y(s, k):.1f}" for s in samples)
        parts += [f'<polyline points="{points}" fill="none" stroke="{colour}"/>', f'<text x="{pad + 240 * (k - 1)}" y="{pad // 2}" fill="{colour}">{name}, peak {most[k]:.2f}</text>']
    return "\n".join([*parts, f'<text x="{wide - pad}" y="{high - pad // 3}" text-anchor="end">{most[0]:.0f} s</text>', "</svg>"])


def export_summary(stats: DataFrame, path: str, form: str, samples: DataFrame | None = None) -> str:
    """Write the summary of the one job in ``stats``; ``samples``: reduced (elapsed, files_per_sec, mb_per_sec) rows for HTML."""
    fields = summary_fields(stats)
    found = fields.take(2)
    if len(found) != 1:
        raise ValueError("a summary is of exactly one job")
    values = found[0].asDict()
    if form == "json":
        text = json.dumps(values, ensure_ascii=False, indent=2) + "\n"
    elif form == "csv":
        text = ",".join(label for label, _, _ in FIELDS) + "\n" + csv_rows(fields).first().line + "\n"
    elif form == "html":
        rows = "\n".join(f"<tr><th>{_escaped(k)}</th><td>{_escaped(v)}</td></tr>" for k, v in values.items())
        points = [] if samples is None else [tuple(r) for r in samples.select("elapsed", "files_per_sec", "mb_per_sec").orderBy("elapsed").toLocalIterator()]
        title = _escaped(f"Job summary {values['Job ID']}")
        text = f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{title}</title></head>\n<body><h1>{title}</h1>\n<table>\n{rows}\n</table>\n{chart(points)}\n</body></html>\n'
    else:
        raise ValueError(f"unknown form {form!r}")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path
