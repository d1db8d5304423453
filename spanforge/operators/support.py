"""Does a span state a value, and does it carry a status? Boolean Column expressions over a row's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions import patterns as P
from spanforge.functions import spans


def either(patterns) -> str:
    """One pattern for several: each row compiles it once."""
    return "|".join(f"(?:{p})" for p in patterns)


#: Stands for a value in a marked text. A letter, so that words end at it as they do at the value.
SIGN = "\ua66e"


def signed(text: Column, pattern: Column) -> Column:
    """The text, lower-cased, with SIGN for every match of a row's own pattern: what follows can use fixed patterns."""
    return F.call_function("regexp_replace", F.translate(F.lower(text), SIGN, "\ufffd"), F.concat(F.lit(P.I), pattern), F.lit(SIGN))


def has(marked: Column, pattern: str) -> Column:
    """Whether a marked text matches a pattern with VALUE in it."""
    return F.coalesce(marked.rlike(P.I + pattern.replace("VALUE", SIGN)), F.lit(False))


def quoted(value: Column) -> Column:
    return F.concat(F.lit("\\Q"), value, F.lit("\\E"))


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))


def _meaningful(lowered: Column) -> Column:
    return F.array_except(F.array_distinct(_tokens(lowered)), F.array(*map(F.lit, P.COMMON_TOKENS)))


def canonical(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"(?U)\s+", " "))


def value_pattern(variable: Column, value: Column) -> Column:
    """A pattern that finds one canonical value at its boundaries; null if there is none.

    Of the telling words of a histology the longest counts, of equally long ones the first by alphabet."""
    word = lambda x: F.concat(F.lit(r"\b"), quoted(x), F.lit(r"\b"))
    after = F.lit(r"(?:\s*cm\b|(?:\s*[x×]\s*\d+(?:\.\d+)?){1,2}\s*cm\b)")
    sized = lambda number: F.when(number != "", F.concat(F.lit(r"(?<![\d.])"), F.replace(number, F.lit("."), F.lit("\\.")), after))

    def telling(low: Column) -> Column:
        longest = F.element_at(F.array_sort(F.transform(_meaningful(low), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), 1)["t"]
        return spans.let(F.when(low != "", F.coalesce(F.when(F.size(_meaningful(low)) > 0, longest), low)), lambda t: F.when(t != "", word(t)))

    def of(low: Column) -> Column:
        size = spans.let(F.regexp_extract(low, r"\d+(?:\.\d+)?", 0), sized)
        return F.when(variable == P.SIZE, size).when(variable.isin(P.PT, P.PN), word(low)).otherwise(telling(low))

    return spans.let(canonical(value), of)


def states_value(variable: Column, value: Column, pattern: Column, evidence: Column) -> Column:
    """The words of the value stand in the evidence."""

    def words(low: Column) -> Column:
        want = canonical(value)
        missing = lambda tokens: (F.size(tokens) > 0) & (F.size(F.array_except(tokens, _tokens(low))) == 0)
        return low.contains(want) | spans.let(_meaningful(want), missing)

    found = F.call_function("rlike", F.lower(evidence), F.concat(F.lit(P.I), pattern))
    return F.coalesce(pattern.isNotNull() & F.when(variable == P.HISTOLOGY, spans.let(F.lower(evidence), words)).otherwise(found), F.lit(False))


def supports_value(variable: Column, value: Column, pattern: Column, evidence: Column, context: Column) -> Column:
    """The evidence states the value, as a measurement if it is a size, and is neither negated nor outdated there."""

    def around(c: Column) -> Column:
        low = F.lower(c)
        margin = low.contains("margin") & ~low.contains("tumor size")
        marks = lambda m: ((variable != P.SIZE) | (~margin & has(m, either(P.MEASURED)))) & ~has(m, either(P.WRONG_CONTEXT))
        return spans.let(signed(c, pattern), marks)

    told = F.when(context == "", evidence).otherwise(F.coalesce(context, evidence))
    return F.coalesce(states_value(variable, value, pattern, evidence) & spans.let(told, around), F.lit(False))


def supersedes(variable: Column, value: Column, pattern: Column, evidence: Column, context: Column) -> Column:
    """The value is the outdated side of a revision."""
    revised = context.rlike(P.I + P.REVISING)
    return F.coalesce(revised & states_value(variable, value, pattern, evidence) & has(signed(context, pattern), either(P.SUPERSEDING)), F.lit(False))


def target(variable: Column, pattern: Column) -> Column:
    """What a status cue must stand next to: the value if there is one, else the field's own words."""
    own = F.lit(P.TARGETS[P.PN])
    for v in P.VARIABLES[:-1]:
        own = F.when(variable == v, F.lit(P.TARGETS[v])).otherwise(own)
    return F.coalesce(pattern, own)


def tied(context: Column, goal: Column, cue: str, within: int = 70) -> Column:
    gap = f"[^.\\n]{{0,{within}}}"
    return context.rlike(P.I + cue) & has(signed(context, goal), f"(?:VALUE){gap}(?:{cue})|(?:{cue}){gap}(?:VALUE)")


def supports_status(variable: Column, status: Column, value: Column, pattern: Column, evidence: Column, contexts: Column, alternatives: Column, stated: Column | None = None) -> Column:
    """The evidence (array of texts) with its contexts carries the meaning of the status. stated: any of it supports the value, if that is known."""
    goal = target(variable, pattern)
    each = lambda f: F.exists(contexts, f)
    both = lambda f: F.exists(F.zip_with(evidence, contexts, f), lambda x: x)
    lowered = F.lower(F.array_join(contexts, "\n"))
    value_ok = value.isNotNull() & (both(lambda e, c: supports_value(variable, value, pattern, e, c)) if stated is None else stated)
    unsure = each(lambda c: tied(c, goal, P.CUES["uncertain"]))
    outdated = value.isNotNull() & both(lambda e, c: supersedes(variable, value, pattern, e, c))
    # the cue and its reach follow from the status, so one expression serves the four statuses that only need them
    cues = {"cannot_be_assigned": 70, "not_documented": 55, "unsupported": 70, "manual_review_required": 70}
    near = lambda s, within: lambda c: tied(c, goal, P.CUES[s], within)
    cued = F.lit(False)
    for s, within in cues.items():
        cued = F.when(status == s, each(near(s, within))).otherwise(cued)
    cannot = ((value == "pNX") & lowered.contains("pnx")) | ((value == "pTX") & lowered.contains("ptx"))
    cannot = F.coalesce(cannot, F.lit(False)) | cued | ((variable == P.PN) & lowered.rlike(P.I + P.NO_NODES_STATUS))
    denied = lambda c: c.rlike(P.I + P.DENYING) & has(signed(c, goal), P.NEGATED_TARGET)
    some = F.array_distinct(F.transform(F.regexp_extract_all(lowered, _candidates(variable), F.lit(0)), F.lower))
    paired = F.zip_with(alternatives, F.zip_with(evidence, contexts, lambda e, c: F.struct(e.alias("e"), c.alias("c"))), lambda a, x: spans.let(value_pattern(variable, a), lambda p: supports_value(variable, a, p, x["e"], x["c"])))
    listed = (
        (F.size(alternatives) >= 2) & (F.size(alternatives) == F.size(evidence))
        & (F.size(F.array_distinct(F.transform(alternatives, lambda a: F.lower(F.trim(a))))) == F.size(alternatives)) & F.forall(paired, lambda x: x)
    )
    conflict = F.when(F.size(alternatives) > 0, listed).otherwise((F.size(some) >= 2) & ((F.size(evidence) >= 2) | lowered.rlike(P.I + P.DISCREPANT)))
    return F.coalesce(
        F.when(status == "supported", value_ok & ~unsure & ~outdated)
        .when(status == "uncertain", value_ok & unsure)
        .when(status == "superseded", outdated)
        .when(status == "negated", each(denied))
        .when(status == "cannot_be_assigned", cannot)
        .when(status == "conflicting", conflict)
        .when(status.isin("not_documented", "unsupported", "manual_review_required"), (F.size(evidence) == 0) | cued),
        F.lit(False),
    )


def _candidates(variable: Column) -> Column:
    out = F.lit(P.I + P.CANDIDATES[P.PN])
    for v in P.VARIABLES[:-1]:
        out = F.when(variable == v, F.lit(P.I + P.CANDIDATES[v])).otherwise(out)
    return out


def contexts_of(text: Column, evidence: Column) -> Column:
    return F.transform(evidence, lambda e: spans.statement(text, e["start_offset"], e["end_offset"]))


def texts_of(evidence: Column) -> Column:
    return F.transform(evidence, lambda e: e["text"])
