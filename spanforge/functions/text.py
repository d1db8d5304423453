"""Scalar text functions of ingestion and export as Column expressions (one Arrow UDF: NFC, for which there is no builtin)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions import patterns as P

CONTROL = r"[\x00-\x08\x0B-\x1F\x7F-\x9F]"
ENDS = r"(?U)^\s+|\s+$"


def nfc(text: Column) -> Column:
    """Unicode normalisation form C; plain ASCII never leaves the JVM."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.when(text.rlike(r"[^\x00-\x7F]"), compose(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, ENDS, "")


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def sanitized(text: Column, composed: bool = True) -> Column:
    """Canonical report text: LF, NFC, no control characters, no blanks at line ends, none around."""
    out = unix_lines(text)
    out = F.regexp_replace(nfc(out) if composed else out, CONTROL, "")
    return stripped(F.regexp_replace(out, r"(?Umd)[\s&&[^\n]]+$", ""))


def length_error(text: Column) -> Column:
    """Why a sanitized text may not be loaded; null if it may."""
    return F.when(text.isNull(), "Report text must be plain text.").when(F.length(text) < P.REPORT_LEAST, f"Report text must contain at least {P.REPORT_LEAST} characters.").when(
        F.length(text) > P.REPORT_MOST, f"Report text exceeds the {P.REPORT_MOST:,}-character local limit."
    )


def identifier_labels(text: Column) -> Column:
    """Labels of direct identifiers whose value is not redacted, in a fixed order."""
    open_ = lambda v: ~F.lower(F.trim(v)).isin(*P.REDACTED)
    return F.filter(
        F.array(*[F.when(F.exists(F.regexp_extract_all(text, F.lit(P.IM + p), F.lit(1)), open_), F.lit(label)) for label, p in P.IDENTIFIERS]),
        lambda x: x.isNotNull(),
    )


def ocr_normalized(text: Column, composed: bool = True) -> tuple[Column, Column]:
    """(normalised text, steps that changed something with their counts)."""
    a = unix_lines(nfc(text) if composed else text)
    control, trailing, blank = CONTROL, r"[ \t]+(?=\n|\z)", r"\n{4,}"
    b = F.regexp_replace(a, control, "")
    c = F.regexp_replace(b, trailing, "")
    steps = F.array(*[
        F.struct(F.lit(n).alias("transformation"), F.regexp_count(x, F.lit(p)).cast("long").alias("count"))
        for n, x, p in (("remove_control_characters", a, control), ("trim_trailing_whitespace", b, trailing), ("collapse_excess_blank_lines", c, blank))
    ])
    return stripped(F.regexp_replace(c, blank, "\n\n\n")), F.filter(steps, lambda s: s["count"] > 0)


def _once(value: Column, then) -> Column:
    """then(value) with value computed once per row: a lambda variable is not copied into every use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def quality(text: Column) -> Column:
    """struct(label, score (unrounded), reasons) of an extracted page."""

    def counted(t: Column) -> Column:
        return F.struct(
            t.alias("t"),
            F.length(F.regexp_replace(t, r"(?U)\s+", "")).alias("visible"),
            F.regexp_count(t, F.lit(r"[\p{L}\p{N}]")).alias("alnum"),
            F.regexp_count(t, F.lit("\ufffd")).alias("unreadable"),
        )

    def measured(m: Column) -> Column:
        t, ratio, unreadable = m["t"], m["alnum"] / F.greatest(m["visible"], F.lit(1)), m["unreadable"]
        reasons = F.filter(
            F.array(
                F.when(F.length(t) < 40, F.lit("Very little text was extracted.")),
                F.when(ratio < 0.55, F.lit("The text contains a high proportion of non-alphanumeric symbols.")),
                F.when(unreadable > 0, F.lit("Unreadable replacement characters were detected.")),
                F.when(t.rlike(P.I + P.SYNOPTIC) & t.rlike(P.I + P.TRUNCATED), F.lit("Synoptic text ends at a staging label; verify that the continuation was captured.")),
            ),
            lambda x: x.isNotNull(),
        )
        base = F.least(F.lit(1.0), F.length(t) / 200.0) * F.least(F.lit(1.0), ratio / 0.8)
        score = F.greatest(F.lit(0.0), base - F.least(F.lit(0.4), unreadable * 0.05))
        return F.struct((t == "").alias("empty"), score.alias("score"), reasons.alias("reasons"))

    def judged(m: Column) -> Column:
        none = F.size(m["reasons"]) == 0
        label = F.when(none & (m["score"] >= 0.75), "Good").when(m["score"] >= 0.35, "Review recommended").otherwise("Poor")
        told = F.when(none & (m["score"] >= 0.35) & (m["score"] < 0.75), F.array(F.lit("Extracted text is readable but should be checked against the page."))).otherwise(m["reasons"])
        return F.when(m["empty"], F.struct(F.lit("Poor").alias("label"), F.lit(0.0).alias("score"), F.array(F.lit("No text was extracted.")).alias("reasons"))).otherwise(
            F.struct(label.alias("label"), m["score"].alias("score"), told.alias("reasons"))
        )

    return _once(_once(_once(stripped(F.coalesce(text, F.lit(""))), counted), measured), judged)


def spreadsheet_safe(value: Column) -> Column:
    """Strings that a spreadsheet would take for a formula get an apostrophe."""
    return F.when(value.rlike(r"(?U)^\s*[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def safe_filename(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.substring(F.when(F.coalesce(bare, F.lit("")) == "", F.lit("report")).otherwise(bare), 1, 80)


def duration(seconds: Column) -> Column:
    """Whole seconds, halves to even, as minutes and seconds; below a minute seconds only; null: N/A."""
    s = F.rint(seconds).cast("long")
    m = F.floor(s / 60)
    text = F.when(m != 0, F.format_string("%dm %02ds", m, F.pmod(s, F.lit(60)))).otherwise(F.concat(s.cast("string"), F.lit("s")))
    return F.when(seconds.isNull(), "N/A").otherwise(text)


def file_size(size: Column) -> Column:
    """Bytes as KB, from 1,048,576 on as MB, with one decimal, halves to even."""
    one = lambda x, unit: F.format_string(f"%.1f {unit}", F.bround(x, 1))
    return F.when(size >= 1 << 20, one(size / (1 << 20), "MB")).otherwise(one(size / 1024, "KB"))


def digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def local_id(text: Column) -> Column:
    return F.concat(F.lit("LOCAL-"), F.upper(F.substring(F.sha2(text, 256), 1, 10)))


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
