"""Reports as HTML with their evidence marked: a sweep over the borders of spans.

Spans are cut loose from the text first: a border is a row with what opens and closes there for each variable, a running sum in
the order of places tells which variables cover the stretch that follows, and texts are joined once, to be cut at the borders. The work
is linear in the spans of a report (and n log n to sort them), wherever they lie and however they overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import patterns as P
from spanforge.functions import text as T
from spanforge.operators.triage import variable_label


def valid_spans(reports: DataFrame, fields: DataFrame) -> DataFrame:
    """(report_id, variable_order, variable_name, start, stop) of evidence that stands at its offsets; no texts."""
    each = fields.select("report_id", "variable_name", F.explode("evidence").alias("e"))
    spans = each.select("report_id", "variable_name", F.col("e.text").alias("said"), F.col("e.start_offset").alias("start"), F.col("e.end_offset").alias("stop"))
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("stop")) & (F.col("stop") <= F.length("text"))
    there = F.substring(F.col("text"), F.col("start") + 1, F.col("stop") - F.col("start")) == F.col("said")
    order = F.array_position(F.array(*map(F.lit, P.VARIABLES)), F.col("variable_name")).cast("int")
    return spans.join(reports.select("report_id", "text").hint("merge"), "report_id").where(inside & there).select("report_id", order.alias("variable_order"), "variable_name", "start", "stop")


def stretches(spans: DataFrame) -> DataFrame:
    """(report_id, start, covering, anchors) of every border: the variables that cover what follows it, and those whose first
    span begins there, in the order of variables."""
    by_var = Window.partitionBy("report_id", "variable_name")
    seen = spans.withColumn("first", F.min("start").over(by_var))
    edge = lambda at, d, anchor: F.struct(F.col(at).alias("at"), F.lit(d).alias("d"), anchor.alias("anchor"))
    edges = seen.select("report_id", "variable_order", F.explode(F.array(edge("start", 1, F.col("start") == F.col("first")), edge("stop", -1, F.lit(False)))).alias("x"))
    n = range(1, len(P.VARIABLES) + 1)
    here = F.col("variable_order")
    borders = edges.groupBy("report_id", F.col("x.at").alias("start")).agg(
        *[F.sum(F.when(here == v, F.col("x.d")).otherwise(0)).alias(f"d{v}") for v in n],
        F.array_sort(F.collect_set(F.when(F.col("x.anchor"), here))).alias("anchors"),
    )
    running = Window.partitionBy("report_id").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = F.array(*[F.when(F.sum(f"d{v}").over(running) > 0, F.lit(v)) for v in n])
    return borders.select("report_id", "start", F.filter(open_, lambda v: v.isNotNull()).alias("covering"), "anchors")


def highlighted(reports: DataFrame, fields: DataFrame, focused: str | None = None) -> DataFrame:
    """reports (report_id, text, ...) with html: escaped, stretches under evidence marked and titled with their variables, an
    anchor where each variable's evidence begins, and a class for those of the focused one.

    Reports without valid evidence are escaped only; null text gives null. Fields of other reports, evidence that is not at its offsets and variables
    that are none are left out."""
    names = F.array(*map(F.lit, P.VARIABLES))
    labels = F.array(*[variable_label(F.lit(v)) for v in P.VARIABLES])
    name = lambda v: F.element_at(names, v)
    per = stretches(valid_spans(reports, fields).where("variable_order > 0"))
    gathered = per.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("start", "covering", "anchors"))).alias("__b"))
    rows = reports.join(gathered.hint("merge"), "report_id", "left")
    text, borders = F.col("text"), F.col("__b")

    def piece(b, i):
        stop = F.coalesce(F.get(borders, i + 1)["start"], F.length(text))
        said = T.html_escaped(F.substring(text, b["start"] + 1, stop - b["start"]))
        anchors = F.array_join(F.transform(b["anchors"], lambda v: F.concat(F.lit('<span class="evidence-anchor" id="evidence-'), F.replace(name(v), F.lit("_"), F.lit("-")), F.lit('"></span>'))), "")
        title = F.array_join(F.transform(F.array_sort(F.transform(b["covering"], lambda v: F.struct(name(v).alias("n"), F.element_at(labels, v).alias("l")))), lambda x: x["l"]), ", ")
        extra = F.when(F.exists(b["covering"], lambda v: name(v) == F.lit(focused)), " evidence-mark--focused").otherwise("") if focused else F.lit("")
        mark = F.concat(F.lit('<mark class="evidence-mark'), extra, F.lit('" title="Evidence for '), T.html_escaped(title), F.lit('">'), said, F.lit("</mark>"))
        return F.concat(anchors, F.when((F.size(b["covering"]) > 0) & (said != ""), mark).otherwise(said))

    head = T.html_escaped(F.substring(text, F.lit(1), F.get(borders, F.lit(0))["start"]))
    html = F.concat(head, F.array_join(F.transform(borders, piece), ""))
    return rows.withColumn("html", F.when(borders.isNull(), T.html_escaped(text)).otherwise(html)).drop("__b")
