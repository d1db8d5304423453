"""From reports to fields: candidates, sections, supersession, conflicts, status.

A report becomes four rows, one for each variable, and everything about a field is computed on its row with native
expressions; nothing is shuffled. `method` 'baseline' takes all candidates at face value, 'evidence_first' resolves explicit
revisions first. Both can be asked for at once: then the patterns run once, and a field has a row for each method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import patterns as P
from spanforge.functions import spans
from spanforge.operators import support

EVIDENCE = "array<struct<text:string,start_offset:int,end_offset:int>>"
ISSUE = f"struct<issue_type:string,variable_name:string,description:string,severity:string,evidence:{EVIDENCE},suggestion:string>"
ISSUES = f"array<{ISSUE}>"


def issue(kind: str, variable: Column, description: Column, severity, evidence: Column, suggestion) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(kind).alias("issue_type"), variable.alias("variable_name"), description.alias("description"), lit(severity).alias("severity"),
        evidence.cast(EVIDENCE).alias("evidence"), lit(suggestion).cast("string").alias("suggestion"),
    ).cast(ISSUE)


def some(*issues: Column) -> Column:
    """The issues that are not null."""
    return F.filter(F.array(*issues), lambda i: i.isNotNull()).cast(ISSUES)


def sections(text: Column) -> Column:
    """Headings with their sections: array of (kind, start, stop, section_end), in order."""
    return F.array_sort(spans.located(spans.found(spans.clear(text), P.IM + P.HEADING), F.lit(0)))


def with_sections(df: DataFrame) -> DataFrame:
    heads = F.col("__heads")
    kind = lambda t: F.coalesce(*[F.when(t.rlike(P.I + r"^[ \t]*" + p), F.lit(k)) for k, p in P.HEADINGS])
    after = lambda i: F.coalesce(F.get(heads, i + 1)["start"], F.length("text"))
    return df.withColumn("__heads", sections(F.col("text"))).withColumn(
        "sections",
        F.transform(heads, lambda h, i: F.struct(kind(h["text"]).alias("kind"), h["start"].alias("start"), h["stop"].alias("stop"), after(i).cast("int").alias("section_end"), h["text"].alias("text"))),
    ).drop("__heads")


def normalized(variable: Column, value: Column) -> Column:
    """The canonical form of a captured value."""
    first_up = lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))

    def size(v: Column) -> Column:
        bare = F.when(v.rlike(r"^\d+(?:\.\d+)?$"), F.concat(v, F.lit(" cm"))).otherwise(v)
        return spans.let(F.regexp_extract(v, r"(?iU)(\d+(?:\.\d+)?)\s*cm", 1), lambda n: F.when(n != "", F.concat(n, F.lit(" cm"))).otherwise(bare))

    def category(letter: str, suffix: str, v: Column) -> Column:
        named = lambda s: F.when(s == "", v).otherwise(F.concat(F.lit(f"p{letter}"), F.when(s == "x", F.lit("X")).otherwise(s)))
        return spans.let(F.lower(F.regexp_extract(v, rf"(?iU)p{letter}({suffix})\b", 1)), named)

    def of(v: Column) -> Column:
        shouted = (F.upper(v) == v) & (F.lower(v) != v)
        histology = spans.let(F.when(shouted, F.lower(v)).otherwise(v), first_up)
        return F.when(variable == P.SIZE, size(v)).when(variable == P.PT, category("T", P.PT_SUFFIX, v)).when(variable == P.PN, category("N", P.PN_SUFFIX, v)).otherwise(histology)

    return spans.let(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")), of)


def conflict_key(variable: Column, norm: Column) -> Column:
    """What two normalized values must share so as not to conflict."""

    def family(low: Column) -> Column:
        out = low
        for name in reversed(P.FAMILIES):
            out = F.when(low.contains(name), F.lit(name)).otherwise(out)
        return F.when(variable == P.HISTOLOGY, out).otherwise(low)

    return spans.let(F.lower(norm), family)


SMALL_BYTES = 64 << 20
TASK_BYTES = 64 << 10
WAVES = 50


def spread(reports: DataFrame, *keys: str) -> DataFrame:
    """reports over all cores if the table is small (by Catalyst's estimate, SMALL_BYTES a core): extraction is all arithmetic, and
    a small file would else keep one core busy. Larger tables, which many tasks read anyway, and streams stay where they are.

    A compressed file may hold many more rows than its bytes tell, so there is a part for each TASK_BYTES (up to WAVES a core), and
    what a task holds of them does not grow with the table. keys: where the rows go; without any they are dealt in turn."""
    if reports.isStreaming:
        return reports
    cores = reports.sparkSession.sparkContext.defaultParallelism
    known = int(str(reports._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(cores, min(known // TASK_BYTES, cores * WAVES))
    return reports.repartition(parts, *keys) if known < cores * SMALL_BYTES else reports


def candidates(reports: DataFrame, dealt: bool = False) -> DataFrame:
    """reports (report_id, text, ...) -> a row for each variable, with sections and matches: array of (start, stop, text, value,
    norm, key, historical, section). dealt: the reports have been spread."""
    order = [(n, i, p, P.CORES[v][i]) for n, v in enumerate(P.VARIABLES) for i, p in enumerate(P.VALUES[v])]
    rows = with_sections(reports if dealt else spread(reports)).withColumn("__t", spans.clear(F.col("text")))
    rows = rows.withColumn("__hits", F.array(*[spans.found(F.col("__t"), P.IM + p, core) for _, _, p, core in order]))
    # (variable, matches) from here on; the ordinal counts within the variable
    place = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("i")) for n, i, _, _ in order])
    each = F.zip_with("__hits", place, lambda hit, at: F.struct(at["n"].alias("n"), spans.located(hit, at["i"]).alias("m")))
    rows = rows.withColumn("__m", each).drop("__t", "__hits")
    rows = rows.withColumn("__v", F.explode(F.array(*[F.struct(F.lit(v).alias("variable_name"), F.lit(n).alias("variable_order")) for n, v in enumerate(P.VARIABLES)])))
    rows = rows.select("*", "__v.variable_name", "__v.variable_order").drop("__v")
    own = F.flatten(F.transform(F.filter("__m", lambda x: x["n"] == F.col("variable_order")), lambda x: x["m"]))
    rows = rows.withColumn("__m", spans.in_order(own))
    text, variable = F.col("text"), F.col("variable_name")

    def full(m: Column, i: Column) -> Column:
        before = spans.slice_of(text, F.greatest(m["start"] - 60, F.lit(0)), m["start"])
        after = F.substring(text, m["stop"] + 1, F.lit(60))
        home = F.filter(F.col("sections"), lambda s: (s["start"] <= m["start"]) & (m["start"] < s["section_end"]))
        made = lambda norm: F.struct(
            m["start"].alias("start"), m["stop"].alias("stop"), m["text"].alias("text"), m["value"].alias("value"), i.alias("ord"),
            norm.alias("norm"), conflict_key(variable, norm).alias("key"),
            (before.rlike(P.I + P.OLD_BEFORE) | after.rlike(P.I + P.OLD_AFTER)).alias("historical"), F.get(home, F.lit(0))["start"].alias("section"),
        )
        return spans.let(normalized(variable, m["value"]), made)

    return rows.withColumn("matches", F.transform("__m", full)).drop("__m")


def resolved(rows: DataFrame, chronology: Column) -> DataFrame:
    """rows with active and superseded matches. Without chronology all matches are active."""
    parts = F.col("sections")
    rows = rows.withColumn("__ok", F.filter("matches", lambda m: ~m["historical"])).withColumn("__old", F.filter("matches", lambda m: m["historical"]))
    preliminary = F.transform(F.filter(parts, lambda s: s["kind"] == "preliminary"), lambda s: s["start"])

    def current(s: Column) -> Column:
        body = spans.slice_of(F.col("text"), s["start"], s["section_end"])
        says = s["kind"].isin("revised", "amended") | ((s["kind"] == "addendum") & body.rlike(P.I + P.UPDATE)) | ((s["kind"] == "final") & F.exists(preliminary, lambda p: p < s["start"]))
        return says & F.exists(F.col("__ok"), lambda m: m["section"] == s["start"])

    rows = rows.withColumn("__from", F.array_max(F.transform(F.filter(parts, current), lambda s: s["start"])))
    in_force = lambda m: (m["start"] >= F.col("__from")) & ~F.array_contains(F.transform(F.filter(parts, lambda s: s["kind"] == "preliminary"), lambda s: s["start"]), m["section"])
    rows = rows.withColumn("__now", F.when(F.col("__from").isNotNull(), F.filter("__ok", lambda m: F.coalesce(in_force(m), F.lit(False)))))
    use = F.coalesce(F.size("__now"), F.lit(0)) > 0
    late = F.filter("__ok", lambda m: ~F.coalesce(in_force(m), F.lit(False)))
    return rows.withColumns({
        "active": F.when(~chronology, F.col("matches")).when(use, F.col("__now")).otherwise(F.col("__ok")),
        "superseded": F.when(~chronology, F.filter("matches", lambda m: F.lit(False))).when(use, F.concat(late, F.col("__old"))).otherwise(F.col("__old")),
    }).drop("__ok", "__old", "__from", "__now")


def best(matches: Column, variable: Column) -> Column:
    """The match that names the field most explicitly, then the longest, then the last; of equals the first."""
    low = lambda m: F.lower(m["text"])
    explicit = lambda m: (low(m).contains("pathological") | low(m).contains("final diagnosis") | (variable == P.HISTOLOGY)).cast("int")
    scored = F.transform(matches, lambda m, i: F.struct(explicit(m).alias("e"), F.length(m["text"]).alias("n"), m["start"].alias("s"), (-i).alias("i"), m.alias("m")))
    return F.array_max(F.transform(scored, lambda x: F.struct(x["e"], x["n"], x["s"], x["i"], x["m"]["stop"].alias("stop"), x["m"]["text"].alias("text"), x["m"]["value"].alias("value"), x["m"]["norm"].alias("norm"), x["m"]["key"].alias("key"), x["m"]["start"].alias("start"))))


def span_of(m: Column) -> Column:
    return F.struct(m["text"].alias("text"), m["start"].alias("start_offset"), m["stop"].alias("end_offset"))


def _title(variable: Column) -> Column:
    return F.initcap(F.replace(variable, F.lit("_"), F.lit(" ")))


def negation(text: Column, variable: Column, value: Column, start: Column, stop: Column) -> Column:
    """The first negation within 100 characters of a candidate, as a span."""
    left = F.greatest(start - 100, F.lit(0))

    def first(around: Column) -> Column:
        q = support.quoted(value)
        near = spans.first_of(around, [P.I + p for p in P.NEGATED_NEAR], q)
        ruled_out = F.when(variable == P.HISTOLOGY, spans.first_of(around, [P.I + P.NEGATED_CONCERN], q))
        return F.when(around.rlike(P.I + r"\b(?:no|negative|absence|without|not|rule[sd]?|concern)\b"), F.coalesce(near, ruled_out))

    return spans.shifted(spans.let(spans.slice_of(text, left, F.least(stop + 100, F.length(text))), first), left)


def no_value(rows: DataFrame) -> DataFrame:
    """rows with __none: (status, span, note) that explicit no-value language gives where there is no active match."""
    text, variable, title = F.col("text"), F.col("variable_name"), _title(F.col("variable_name"))
    label = F.lit(P.LABELS[P.PN])
    for v in P.VARIABLES[:-1]:
        label = F.when(variable == v, F.lit(P.LABELS[v])).otherwise(label)
    by_label = lambda ps: spans.first_of(text, [P.IM + p.replace("LABEL", "VALUE") for p in ps], label)
    first = lambda ps: spans.first_of(text, [P.IM + p for p in ps], F.lit(""))
    says = lambda core, span: F.when((F.size("active") == 0) & F.lower(text).contains(core), span)
    rows = (
        rows.withColumn("__nd", says("documented", by_label([P.NOT_DOCUMENTED]))).withColumn("__ca", says("cannot", by_label(P.CANNOT_ASSIGN)))
        .withColumn("__nt", F.when(variable == P.SIZE, says("for", first(P.NO_TUMOR)))).withColumn("__nn", F.when(variable == P.PN, says("node", first(P.NO_NODES))))
    )
    out = lambda status, span, note: F.struct(F.lit(status).alias("status"), span.cast(spans.SPAN).alias("span"), note.alias("note"))
    return rows.withColumn(
        "__none",
        F.when(F.col("__nd").isNotNull(), out("not_documented", F.col("__nd"), F.concat(title, F.lit(" is explicitly recorded as not documented."))))
        .when(F.col("__ca").isNotNull(), out("cannot_be_assigned", F.col("__ca"), F.concat(title, F.lit(" is explicitly documented as not assignable."))))
        .when(F.col("__nt").isNotNull(), out("negated", F.col("__nt"), F.lit("No invasive tumor is identified for measurement.")))
        .when(F.col("__nn").isNotNull(), out("cannot_be_assigned", F.col("__nn"), F.lit("Regional lymph nodes were not assessed; no pN category was inferred.")))
        .otherwise(out("not_documented", F.lit(None), F.concat(title, F.lit(" is not explicitly documented.")))),
    ).drop("__nd", "__ca", "__nt", "__nn")


def fields(reports: DataFrame, *methods: str, dealt: bool = False) -> DataFrame:
    """reports (report_id, text, ...) -> one row for each field and method: extracted_value, documentation_status, evidence,
    alternatives, notes and the issues met (extract_issues). One pass over the reports for all methods."""
    methods = methods or ("evidence_first",)
    each = F.explode(F.array(*map(F.lit, methods))) if len(methods) > 1 else F.lit(methods[0])
    first = F.col("method") == "baseline"
    rows = no_value(resolved(candidates(reports, dealt).withColumn("method", each), chronology=~first))
    text, variable = F.col("text"), F.col("variable_name")
    keys = F.array_distinct(F.transform("active", lambda m: m["key"]))
    group = lambda k: F.filter("active", lambda m: m["key"] == k)
    pick = lambda k: spans.let(group(k), lambda g: best(F.when(first, F.slice(g, 1, 1)).otherwise(g), variable))
    chosen = F.transform(F.col("__keys"), lambda k: pick(k))
    ordered = F.array_sort(F.transform(F.col("__alts"), lambda b: F.struct(b["start"].alias("start"), b["stop"].alias("stop"), b["text"].alias("text"), b["norm"].alias("norm"))))
    rows = (
        rows.withColumn("__keys", keys).withColumn("__n", F.size("__keys"))
        .withColumn("__alts", F.when(F.col("__n") > 1, chosen)).withColumn("__alts", F.when(F.col("__n") > 1, ordered))
        .withColumn("__best", F.when(F.col("__n") == 1, best(F.col("active"), variable)))
    )
    b = F.col("__best")
    rows = rows.withColumn("__neg", F.when(b.isNotNull(), negation(text, variable, b["norm"], b["start"], b["stop"])))
    rows = rows.withColumn("__unsure", F.coalesce(spans.nearby(text, b["start"], b["stop"]).rlike(P.I + P.UNCERTAINTY), F.lit(False)))
    explicit_x = ((variable == P.PN) & (b["norm"] == "pNX")) | ((variable == P.PT) & (b["norm"] == "pTX"))
    status = (
        F.when(F.col("__n") == 0, F.col("__none.status")).when(F.col("__n") > 1, F.lit("conflicting")).when(F.col("__neg").isNotNull(), F.lit("negated"))
        .when(explicit_x, F.lit("cannot_be_assigned")).when(F.col("__unsure"), F.lit("uncertain")).otherwise(F.lit("supported"))
    )
    rows = rows.withColumn("documentation_status", status)
    state, none = F.col("documentation_status"), F.array().cast(EVIDENCE)
    one = lambda s: F.array(s).cast(EVIDENCE)
    evidence = (
        F.when(F.col("__n") == 0, F.when(F.col("__none.span").isNotNull(), one(F.col("__none.span"))).otherwise(none))
        .when(F.col("__n") > 1, F.transform("__alts", span_of).cast(EVIDENCE)).when(state == "negated", one(F.col("__neg"))).otherwise(one(span_of(b)))
    )
    values = F.array_join(F.transform("__alts", lambda a: a["norm"]), ", ")
    x_note = F.when(b["norm"] == "pNX", F.lit("Explicit pNX documented; it is distinct from pN0 and from an undocumented pN.")).otherwise(F.lit("Explicit pTX documented; no pathological T category was inferred."))
    notes = (
        F.when(F.col("__n") == 0, F.col("__none.note")).when(state == "conflicting", F.concat(F.lit("Conflicting explicit values: "), values))
        .when(state == "negated", F.lit("The candidate is explicitly negated in the report.")).when(state == "cannot_be_assigned", x_note)
        .when(state == "uncertain", F.lit("Uncertainty language occurs in the same local statement.")).otherwise(F.lit("Candidate is anchored to exact report evidence."))
    )
    rows = rows.select(
        "*", F.when((F.col("__n") == 1) & (state != "negated"), b["norm"]).alias("extracted_value"), evidence.alias("evidence"),
        F.coalesce(F.transform("__alts", lambda a: a["norm"]), F.array().cast("array<string>")).alias("alternatives"), notes.alias("notes"),
    )
    ev, words = F.col("evidence"), F.replace(variable, F.lit("_"), F.lit(" "))
    high = F.when(variable.isin(P.HISTOLOGY, P.PN), F.lit("high")).otherwise(F.lit("medium"))
    prior = best(F.filter("superseded", lambda m: m["key"] != b["key"]), variable)
    rows = rows.withColumn("__prior", F.when(F.col("__n") == 1, prior))
    confirm = "Confirm the documentation manually; do not infer a category."
    raised = some(
        F.when((F.col("__n") == 0) & (state == "negated"), issue("negated", variable, F.col("notes"), high, ev, confirm)),
        F.when((F.col("__n") == 0) & (state != "negated"), issue("missing", variable, F.col("notes"), high, ev, confirm)),
        F.when(state == "conflicting", issue("conflicting", variable, F.concat(F.lit("Conflicting explicit values detected: "), values, F.lit(".")), "high", ev, "Resolve the alternatives manually; no value was selected.")),
        F.when((F.col("__n") == 1) & (state == "negated"), issue("negated", variable, F.col("notes"), F.when(variable == P.HISTOLOGY, "high").otherwise("medium"), ev, "Confirm the negated finding during review.")),
        F.when((F.col("__n") == 1) & (state == "cannot_be_assigned"), issue("manual_review_required", variable, F.col("notes"), "medium", ev, F.when(b["norm"] == "pNX", "Retain pNX as explicitly documented; do not convert it to pN0.").otherwise("Retain pTX as explicitly documented; do not infer pT from size."))),
        F.when(state == "uncertain", issue("uncertain", variable, F.concat(F.lit("Uncertainty language qualifies the proposed "), words, F.lit(".")), "medium", ev, "Review the candidate before acceptance.")),
        F.when(F.col("__prior").isNotNull(), issue("superseded", variable, F.concat(F.lit("An explicit final/amended relationship replaces "), F.col("__prior.norm"), F.lit(" with "), b["norm"], F.lit(".")), "high",
               F.array(span_of(F.col("__prior")), span_of(b)).cast(EVIDENCE), "Use the current value and retain the older span in the audit trail.")),
    )
    return rows.withColumn("extract_issues", raised).drop("__keys", "__n", "__alts", "__best", "__neg", "__unsure", "__none", "__prior", "matches", "active", "superseded")
