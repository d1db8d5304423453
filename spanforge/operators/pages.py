"""Pages of documents: assembly into one text, lookups, routing, review transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators.extract import issue, some

GAP = 2  # characters between pages: a blank line


def ranges(pages: DataFrame) -> DataFrame:
    """pages (document_id, page_number, text, excluded_as_blank) -> page, start, stop of each page in the assembled text."""
    w = Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    kept = pages.where(~F.col("excluded_as_blank"))
    start = F.coalesce(F.sum(F.length("text") + GAP).over(w), F.lit(0))
    return kept.select("document_id", "page_number", start.cast("int").alias("start"), (start + F.length("text")).cast("int").alias("stop"))


def assembled(pages: DataFrame) -> DataFrame:
    """document_id, text (pages joined by a blank line), page_ranges, error (null if every page is accepted and has text).

    Places come from a running sum over the pages, in the shuffle that also gathers them: a document of p pages costs p."""
    w = Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    size = F.when(~F.col("excluded_as_blank"), F.length("text") + GAP).otherwise(0)
    placed = pages.withColumn("__at", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("int"))
    kept = F.struct("page_number", "text", F.col("__at").alias("start"), (F.col("__at") + F.length("text")).alias("stop"))
    grouped = placed.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("excluded_as_blank"), kept))).alias("p"), F.bool_and("accepted").alias("all_accepted"),
        F.count_if(~F.col("excluded_as_blank") & (F.length(F.trim("text")) == 0)).alias("empty"),
    )
    spans = F.transform("p", lambda x: F.struct(x["page_number"].alias("page_number"), x["start"].alias("start"), x["stop"].alias("stop")))
    error = F.when(~F.col("all_accepted"), "every page must be accepted").when(F.col("empty") > 0, "an accepted page is empty").when(F.size("p") == 0, "no page has text")
    return grouped.select("document_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), spans.alias("page_ranges"), error.alias("error"))


def page_for(page_ranges: Column, offset: Column) -> Column:
    """The page that holds an offset; null between pages."""
    return F.get(F.filter(page_ranges, lambda r: (r["start"] <= offset) & (offset < r["stop"])), F.lit(0))["page_number"]


#: Characters of a document that one group of the sweep covers.
BIN = 1 << 20


def located(offsets: DataFrame, page_spans: DataFrame, bin_chars: int = BIN) -> DataFrame:
    """offsets (document_id, offset, ...) with page_number, the page that holds each; null in gaps, outside, and for null offsets.

    A sweep instead of a join on ranges: page starts and offsets are sorted together by position, and each offset takes the last
    start before it, if its page reaches that far. A document of p pages and o offsets costs p + o. Long documents are cut into
    bins; a page that reaches into a bin starts there anew. Pages of a document must not overlap (empty ones hold nothing)."""
    size = F.lit(bin_chars).cast("long")
    home = lambda c: F.floor(F.col(c).cast("long") / size)
    pieces = F.sequence(home("start"), F.floor((F.col("stop").cast("long") - 1) / size))
    page = F.struct("page_number", "start", "stop")
    starts = page_spans.where("start < stop").select(F.col("document_id").alias("__doc"), page.alias("__page"), F.explode(pieces).alias("__bin"))
    starts = starts.select("__doc", "__bin", F.greatest(F.col("__page.start").cast("long"), F.col("__bin") * size).alias("__at"), F.lit(0).alias("__kind"), "__page")
    rows = offsets.select(F.col("document_id").alias("__doc"), home("offset").alias("__bin"), F.col("offset").cast("long").alias("__at"), F.lit(1).alias("__kind"), F.struct(*offsets.columns).alias("__row"))
    both = rows.unionByName(starts, allowMissingColumns=True)
    sweep = Window.partitionBy("__doc", "__bin").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("__last", F.last("__page", ignorenulls=True).over(sweep)).where("__kind = 1")
    return met.select("__row.*", F.when(F.col("__at") < F.col("__last.stop"), F.col("__last.page_number")).alias("page_number"))


def routed(pages: DataFrame, force: bool = False) -> DataFrame:
    """pages (native_text, ...) with quality and the route: pages whose native text is poor go to OCR."""
    q = T.quality(F.col("native_text"))
    return pages.withColumn("quality", q).withColumn("extraction_method", F.when(F.lit(force) | (F.col("quality.label") == "Poor"), "ocr").otherwise("native_text"))


def counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(
        F.count("*").alias("page_count"), F.count_if(F.col("extraction_method") == "native_text").alias("native_pages"),
        F.count_if(F.col("extraction_method") == "ocr").alias("ocr_pages"),
    )


def next_page(pages: DataFrame, current: Column) -> DataFrame:
    """The next unaccepted page after the current one, else the first; null if all are accepted."""
    free = F.when(~F.col("accepted"), F.col("page_number"))
    after = F.min(F.when(F.col("page_number") > current, free))
    return pages.groupBy("document_id").agg(F.coalesce(after, F.min(free)).alias("next_page"))


def first_page(pages: DataFrame) -> DataFrame:
    """The page to look at first: poor quality, then to be reviewed, then unaccepted, else 1."""
    rank = F.when(F.col("label") == "Poor", 0).when(F.col("label") == "Review recommended", 1).when(~F.col("accepted"), 2)
    return pages.groupBy("document_id").agg(F.coalesce(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("page_number").alias("p"))))["p"], F.lit(1)).alias("first_page"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages after a re-extraction: corrections stay, blank pages stay accepted, the others must be accepted again."""
    n = new.select("document_id", "page_number", F.col("text").alias("new_text"), F.lit(True).alias("fresh"))
    both = old.join(n.hint("merge"), ["document_id", "page_number"], "left")
    fresh = F.coalesce("fresh", F.lit(False))
    return both.select(
        "document_id", "page_number", F.coalesce("new_text", "text").alias("text"), "corrected_text", "excluded_as_blank",
        F.when(fresh, F.col("excluded_as_blank")).otherwise(F.col("accepted")).alias("accepted"),
    )


def approved(documents: DataFrame, approvals: DataFrame) -> DataFrame:
    """documents (document_id, text, ...) with approved: one of the approvals (document_id, approved_digest) is of this very text.
    An edit changes the digest and so revokes the approval. Only digests are joined, not texts twice."""
    marks = approvals.select("document_id", F.col("approved_digest").alias("__digest"), F.lit(True).alias("__ok")).distinct()
    rows = documents.withColumn("__digest", T.digest(F.col("text"))).join(marks.hint("merge"), ["document_id", "__digest"], "left")
    return rows.select(*documents.columns, F.coalesce("__ok", F.lit(False)).alias("approved"))


def folded(events: DataFrame) -> DataFrame:
    """events (document_id, page_number, seq, event: accept|blank|rotate|reset, text) -> state of each page after the last."""
    w = Window.partitionBy("document_id", "page_number").orderBy("seq")
    e = F.col("event")
    blank_at = F.last(F.when(e == "blank", True).when(e.isin("reset", "accept"), False), ignorenulls=True).over(w)
    rows = events.withColumn("blank", F.coalesce(blank_at, F.lit(False)))
    fixed = F.last(F.when(e == "accept", F.struct(F.col("text"))).when(e.isin("blank", "reset"), F.struct(F.lit(None).cast("string").alias("text"))), ignorenulls=True).over(w)
    accepted = F.last(F.when(e.isin("accept", "blank"), True).when(e == "reset", False).when((e == "rotate") & ~F.col("blank"), False), ignorenulls=True).over(w)
    last = F.row_number().over(Window.partitionBy("document_id", "page_number").orderBy(F.desc("seq")))
    rows = rows.withColumn("corrected_text", fixed["text"]).withColumn("accepted", F.coalesce(accepted, F.lit(False))).withColumn("n", last)
    return rows.where("n = 1").select("document_id", "page_number", "corrected_text", "accepted", F.col("blank").alias("excluded_as_blank"))


def document_issues(pages: DataFrame) -> DataFrame:
    """document_issues of each document from the quality labels of its pages that are not blank."""
    of = lambda label: F.array_join(F.array_sort(F.collect_list(F.when(~F.col("excluded_as_blank") & (F.col("label") == label), F.col("page_number")))), ", ")
    got = pages.groupBy("document_id").agg(of("Poor").alias("poor"), of("Review recommended").alias("review"))
    none = F.lit(None).cast("string")
    found = some(
        F.when(F.col("poor") != "", issue("ocr_quality", none, F.concat(F.lit("Poor text extraction quality on page(s): "), F.col("poor"), F.lit(".")), "high", F.lit(None), "Compare the accepted text against each page image before reviewing fields."))
        .when(F.col("review") != "", issue("ocr_quality", none, F.concat(F.lit("Text extraction should be checked on page(s): "), F.col("review"), F.lit(".")), "medium", F.lit(None), "Verify the accepted text against the source page."))
    )
    return got.select("document_id", found.alias("document_issues"))
