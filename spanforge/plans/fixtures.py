"""Report texts made from the base tables by plain SQL that Spark and DuckDB read alike, so that every branch of the
extraction has rows and the oracle is an implementation of its own."""

from __future__ import annotations

#: Scenario number = part key modulo 12; what a report of that scenario says.
SCENARIOS = (
    "complete", "no_nodes", "pn_not_documented", "pnx", "amended", "conflicting", "uncertain", "negated", "margin_only", "synoptic_gap", "ptx", "inline_revision",
)
CM = "concat(cast(p_size as varchar(10)), '.', cast(p_partkey % 10 as varchar(10)), ' cm')"
OLD_CM = "concat(cast(p_size + 60 as varchar(10)), '.', cast(p_partkey % 10 as varchar(10)), ' cm')"
STAGE = "case p_partkey % 5 when 0 then 'pT1a' when 1 then 'pT1c' when 2 then 'pT2a' when 3 then 'pT3' else 'pT4' end"
OLD_STAGE = "case p_partkey % 5 when 0 then 'pT1b' when 1 then 'pT2b' when 2 then 'pT1mi' when 3 then 'pT2' else 'pT0' end"
NODES = "case p_partkey % 3 when 0 then 'pN0' when 1 then 'pN1' else 'pN2' end"
HISTOLOGY = "case p_partkey % 4 when 0 then 'Invasive adenocarcinoma' when 1 then 'Squamous cell carcinoma' when 2 then 'Large cell carcinoma' else 'Poorly differentiated carcinoma' end"

_TOP = "concat('CASE ', cast(p_partkey as varchar(20)), chr(10), 'FINAL DIAGNOSIS:', chr(10), '- ', {h}, '.', chr(10))"
_SIZE = "concat('- Tumor size: ', {s}, ' in greatest dimension.', chr(10))"
_T = "concat('- Pathological T category: ', {t}, '.', chr(10))"
_N = "concat('- Pathological N category: ', {n}, '.', chr(10))"


def _body(scenario: str) -> str:
    top, size, t, n = (x.format(h="h", s="cm", t="stage", n="nodes") for x in (_TOP, _SIZE, _T, _N))
    old_size, old_t = _SIZE.format(s="old_cm"), _T.format(t="old_stage")
    return {
        "complete": f"concat({top}, {size}, {t}, {n})",
        "no_nodes": f"concat({top}, {size}, {t}, '- No regional lymph nodes were submitted for evaluation.')",
        "pn_not_documented": f"concat({top}, {size}, {t}, '- Pathological N category: not documented.')",
        "pnx": f"concat({top}, {size}, {t}, '- Pathological N category: pNX.')",
        "amended": f"concat('PRELIMINARY DIAGNOSIS:', chr(10), '- ', h, '.', chr(10), {old_size}, {old_t}, {n}, chr(10), 'REVISED FINAL DIAGNOSIS:', chr(10), '- ', h, '.', chr(10), {size}, {t}, {n})",
        "conflicting": f"concat({top}, {size}, {t}, {n}, 'COMMENT', chr(10), {old_size}, {old_t})",
        "uncertain": f"concat({top}, '- Tumor size: approximately ', cm, ' by estimate.', chr(10), '- Pathological T category: ', stage, ' (provisional).', chr(10), {n})",
        "negated": "concat('FINAL DIAGNOSIS:', chr(10), '- No evidence of ', lower(h), ' is identified.', chr(10), '- No invasive tumor is identified for measurement.', chr(10), '- Pathological T category cannot be assigned.', chr(10), '- Pathological N category: not documented.')",
        "margin_only": f"concat({top}, '- The closest margin is ', cm, ' away.', chr(10), {t}, {n})",
        "synoptic_gap": f"concat('SYNOPTIC REPORT', chr(10), {top}, {size}, 'Lymph node involvement:')",
        "ptx": f"concat({top}, {size}, '- Pathological T category: pTX.', chr(10), {n})",
        "inline_revision": f"concat({top}, {size}, '- Pathological T category: ', stage, ' (amended from ', old_stage, ').', chr(10), {n})",
    }[scenario]


def reports_sql() -> str:
    """(report_id, scenario, text, h, cm, old_cm, stage, old_stage, nodes) for each part."""
    base = f"select p_partkey, {HISTOLOGY} as h, {CM} as cm, {OLD_CM} as old_cm, {STAGE} as stage, {OLD_STAGE} as old_stage, {NODES} as nodes, p_partkey % {len(SCENARIOS)} as s from part"
    case = lambda f: "case s " + " ".join(f"when {i} then {f(x)}" for i, x in enumerate(SCENARIOS)) + " end"
    return (
        f"select concat('R', cast(p_partkey as varchar(20))) as report_id, p_partkey, h, cm, old_cm, stage, old_stage, nodes, "
        f"{case(lambda x: chr(39) + x + chr(39))} as scenario, {case(_body)} as text from ({base}) b"
    )


def expected_sql(method: str) -> str:
    """(report_id, variable_name, documentation_status, extracted_value) that follow from the scenario, by hand."""
    first = method == "evidence_first"
    size = "case scenario when 'amended' then {a} when 'conflicting' then {c} when 'uncertain' then {u} when 'negated' then {n} when 'margin_only' then {m} else {d} end"
    lit = lambda x: f"'{x}'"
    rows = {
        "histologic_diagnosis": ("case scenario when 'negated' then 'negated' else 'supported' end", "case scenario when 'negated' then null else h end"),
        "tumor_size": (
            size.format(a=lit("supported" if first else "conflicting"), c=lit("conflicting"), u=lit("uncertain"), n=lit("negated"), m=lit("not_documented"), d=lit("supported")),
            size.format(a="cm" if first else "null", c="null", u="cm", n="null", m="null", d="cm"),
        ),
        "pathological_t_category": (
            f"case scenario when 'amended' then '{'supported' if first else 'conflicting'}' when 'inline_revision' then '{'supported' if first else 'unsupported'}' when 'conflicting' then 'conflicting' when 'uncertain' then 'uncertain' when 'negated' then 'cannot_be_assigned' when 'ptx' then 'cannot_be_assigned' when 'synoptic_gap' then 'not_documented' else 'supported' end",
            f"case scenario when 'amended' then {'stage' if first else 'null'} when 'inline_revision' then {'stage' if first else 'null'} when 'conflicting' then null when 'negated' then null when 'ptx' then 'pTX' when 'synoptic_gap' then null else stage end",
        ),
        "pathological_n_category": (
            "case scenario when 'no_nodes' then 'cannot_be_assigned' when 'pn_not_documented' then 'not_documented' when 'pnx' then 'cannot_be_assigned' when 'negated' then 'not_documented' when 'synoptic_gap' then 'not_documented' else 'supported' end",
            "case scenario when 'no_nodes' then null when 'pn_not_documented' then null when 'pnx' then 'pNX' when 'negated' then null when 'synoptic_gap' then null else nodes end",
        ),
    }
    return " union all ".join(f"select report_id, scenario, '{v}' as variable_name, {s} as documentation_status, {x} as extracted_value from ({reports_sql()}) r" for v, (s, x) in rows.items())


#: Gold annotations of the same reports: what a careful reader would write down.
def gold_sql() -> str:
    e = expected_sql("evidence_first")
    return f"select report_id, variable_name, case when documentation_status = 'cannot_be_assigned' and extracted_value is null then null else extracted_value end as gold_value, documentation_status as gold_status, documentation_status <> 'supported' as gold_review from ({e}) e"


# --- saved reviews with planted faults ------------------------------------------------------------------------------------
def reviews_sql(side: str) -> str:
    """Reviewed fields (side 'field') or audit records (side 'audit') of one review for each part, flat: evidence is one text
    or null. What is wrong with a review follows from its key modulo 29; most are sound."""
    field = side == "field"
    value = "case v when 0 then 'Invasive adenocarcinoma' when 1 then cm when 2 then stage else nodes end"
    fixed = "case v when 0 then 'Squamous cell carcinoma' when 1 then '9.9 cm' when 2 then 'pT4' else 'pN3' end"
    action = "case (p_partkey + v) % 4 when 0 then 'accepted' when 1 then 'corrected' when 2 then 'rejected' else 'flagged_for_review' end"
    base = (
        f"select p_partkey, p_partkey % 29 as m, v, {action} as act, {value} as original_value, {fixed} as fixed, case v when 0 then 'histologic_diagnosis' when 1 then 'tumor_size' when 2 then 'pathological_t_category' else 'pathological_n_category' end as variable "
        f"from (select p_partkey, {CM} as cm, {STAGE} as stage, {NODES} as nodes from part) p cross join (select 0 as v union all select 1 union all select 2 union all select 3) vs"
    )
    made = (
        "select *, case act when 'accepted' then original_value when 'corrected' then fixed end as sound_value, "
        "case act when 'rejected' then 'unsupported' when 'flagged_for_review' then 'manual_review_required' else 'supported' end as sound_status, "
        f"case act when 'accepted' then concat('Found: ', original_value) when 'corrected' then concat('Found: ', fixed) end as sound_text from ({base}) b"
    )
    if field:
        own_action = "case when m = 2 and v = 1 then 'pending' else act end"
        own_status = "case when m = 4 and act = 'flagged_for_review' then 'unsupported' when m = 5 and act = 'accepted' then 'uncertain' else sound_status end"
        text, reason, when = "case when m = 3 and act = 'rejected' then 'kept' else sound_text end", "case when m = 1 and v = 0 then ' ' else concat('checked by ', act) end", "'2024-05-01T00:00:00Z'"
        own_value, gone, extra = "case when m = 15 and act = 'corrected' and v = 2 then 'pT9' else sound_value end", "m = 9 and v = 3", ""
        names = ("review_action", "reviewed_value", "reviewed_status", "evidence_text", "reviewed_at")
    else:
        own_action, own_status, text, reason = "act", "sound_status", "sound_text", "concat('checked by ', act)"
        when = "case when m = 11 and v = 1 then '2024-05-02T00:00:00Z' else '2024-05-01T00:00:00Z' end"
        own_value = "case when m = 12 and act = 'corrected' then original_value when m = 15 and act = 'corrected' and v = 2 then 'pT9' else sound_value end"
        gone = "m = 8 and v = 2"
        extra = ", case when m = 6 then null when m = 7 and act = 'accepted' then 'x' when act = 'corrected' then case when m = 15 and v = 2 then 'pT9' else fixed end end as corrected_value"
        names = ("reviewer_action", "resulting_value", "resulting_status", "evidence_text", "timestamp")
    out = (
        f"select concat('REV-', cast(p_partkey as varchar(20))) as review_id, concat('R', cast(p_partkey as varchar(20))) as report_id, case when m = 14 then null else 'evidence_first' end as method, "
        f"case when m = 13 and v = 0 then 'other' else variable end as variable_name, concat('AUD-', cast(p_partkey as varchar(20)), '-', cast(v as varchar(2))) as audit_id, original_value, 'supported' as original_status, concat('Found: ', original_value) as original_text, "
        f"{own_action} as {names[0]}, {own_value} as {names[1]}, {own_status} as {names[2]}, {text} as {names[3]}, {when} as {names[4]}, {reason} as review_reason, 'Reviewer A' as reviewer_identity{extra}, m, v from ({made}) x where not ({gone})"
    )
    return out if not field else f"{out} union all select * from ({out}) twice where m = 10 and v = 0"


def review_rules_sql(side: str) -> str:
    """(review_id, variable_name, rule) that the flat rows of one side break by themselves."""
    a, value, status = ("review_action", "reviewed_value", "reviewed_status") if side == "field" else ("reviewer_action", "resulting_value", "resulting_status")
    rules = {
        "still pending": f"{a} = 'pending'", "no reason": "trim(review_reason) = ''",
        "unknown variable": "variable_name not in ('histologic_diagnosis', 'tumor_size', 'pathological_t_category', 'pathological_n_category')",
        "breaks the field schema": f"({value} is not null and evidence_text is null) or ({status} in ('supported', 'uncertain') and {value} is null) or ({status} in ('unsupported', 'manual_review_required') and {value} is not null) or (variable_name = 'pathological_t_category' and {value} = 'pT9')",
        "acceptance changes the proposal": f"{a} = 'accepted' and ({value} is distinct from original_value or {status} is distinct from original_status or evidence_text is distinct from original_text)",
        "rejection keeps something": f"{a} = 'rejected' and ({value} is not null or {status} <> 'unsupported' or evidence_text is not null)",
        "flag keeps something": f"{a} = 'flagged_for_review' and ({value} is not null or {status} <> 'manual_review_required' or evidence_text is not null)",
    }
    if side == "audit":
        rules |= {
            "corrected value is not the result": f"{a} = 'corrected' and corrected_value is distinct from {value}", "corrected value without a correction": f"{a} <> 'corrected' and corrected_value is not null",
        }
    return " union all ".join(f"select review_id, variable_name, '{side}: {name}' as rule from {side}s where {test}" for name, test in rules.items())


# --- an annotated data set with planted faults ----------------------------------------------------------------------------
def demo_reports_sql() -> str:
    """Reports of a data set, one for each part, some with a fault by their key modulo 31."""
    scenario = "case p_partkey % 8 when 0 then 'complete' when 1 then 'no_nodes_cannot_be_assigned' when 2 then 'pn_not_documented' when 3 then 'explicit_pnx' when 4 then 'amended' when 5 then 'conflicting' when 6 then 'uncertain' else 'negated' end"
    row = (
        "select p_partkey, p_partkey % 31 as m, concat(case when p_partkey % 31 = 1 then 'REAL-' else 'SYN-' end, cast(p_partkey as varchar(20))) as report_id, case when p_partkey % 31 = 2 then 'SCLC' when p_partkey % 2 = 0 then 'LUAD' else 'LUSC' end as cancer_type, "
        f"p_partkey % 31 <> 3 as is_synthetic, case when p_partkey % 31 = 4 then null else {scenario} end as scenario, case when p_partkey % 31 = 5 then 'a report' else 'A Synthetic report' end as description, "
        "concat(case when p_partkey % 31 = 6 then '' else concat('SYNTHETIC DEMONSTRATION REPORT — NO REAL PATIENT DATA', chr(10)) end, case when p_partkey % 31 = 7 then 'MRN: 1' else 'Brand' end, ' ', p_name, ' of ', p_brand) as text from part"
    )
    return f"select * from ({row}) a union all select * from ({row}) b where m = 8"


def demo_gold_sql() -> str:
    """Raw annotations of these reports, four each, some with a fault by the key modulo 31."""
    start, stop = "instr(text, p_name) - 1", "instr(text, p_name) - 1 + length(p_name)"
    base = f"select r.*, p_name, {start} as s, {stop} as e from (select * from ({demo_reports_sql()}) z) r join (select p_partkey as pk, p_name from part) q on q.pk = r.p_partkey"
    one = (
        "select report_id, m, v, case when m = 9 then 'NSCLC' else cancer_type end as cancer_type, case when m = 10 and v = 0 then 'grade' else variable end as variable_name, "
        "case when v = 3 and scenario = 'complete' and m <> 11 then 'pN0' when v = 3 and scenario = 'explicit_pnx' then 'pNX' when v = 1 and scenario = 'amended' then '4.1 cm' when v = 2 and scenario = 'amended' then 'pT2b' else '' end as gold_value, "
        "case when v = 1 and m = 12 then '' when v = 3 and scenario = 'pn_not_documented' then '' else p_name end as evidence_text, "
        "case when v = 3 and scenario = 'pn_not_documented' then case when m = 13 then '3' else '' end when v = 0 and m = 14 then 'x' when v = 0 and m = 15 then '-1' when v = 0 and m = 16 then cast(s + 1 as varchar(20)) else cast(s as varchar(20)) end as evidence_start_offset, "
        "case when v = 3 and scenario = 'pn_not_documented' then '' when v = 0 and m = 17 then '99999' else cast(e as varchar(20)) end as evidence_end_offset, "
        "case when m = 18 and v = 2 then 'unclear' when v = 3 and scenario in ('no_nodes_cannot_be_assigned', 'explicit_pnx') and m <> 19 then 'cannot_be_assigned' when v = 3 and scenario = 'pn_not_documented' then 'not_documented' when v = 0 and scenario = 'negated' then 'negated' else 'supported' end as documentation_status, "
        "case when m = 20 and v = 1 then 'yes' when v = 2 then 'True' else 'False' end as manual_review_required "
        "from (select *, case v when 0 then 'histologic_diagnosis' when 1 then 'tumor_size' when 2 then 'pathological_t_category' else 'pathological_n_category' end as variable "
        f"from ({base}) b cross join (select 0 as v union all select 1 union all select 2 union all select 3) vs where not (m = 21 and v = 3) and not (m = 8)) w"
    )
    return f"select * from ({one}) x union all select * from ({one}) y where m = 22 and v = 1 union all select concat('GONE-', report_id), m, v, cancer_type, variable_name, gold_value, evidence_text, evidence_start_offset, evidence_end_offset, documentation_status, manual_review_required from ({one}) z where m = 23 and v = 0"


# --- decisions that reach every rule of a review ---------------------------------------------------------------------------
_COMPLETE = f"select p_partkey, report_id, text, cm, stage, nodes, h, cast(floor(p_partkey / 12) as bigint) % 22 as c from ({reports_sql()}) r where scenario = 'complete'"


def proposals_sql() -> str:
    """The four fields of every complete report as they are proposed: evidence is one text at its place."""
    one = lambda v, value, said: f"select report_id, text, '{v}' as variable_name, {value} as extracted_value, {said} as said, instr(text, {said}) - 1 as start from ({_COMPLETE}) a"
    return " union all ".join([
        one("histologic_diagnosis", "h", "h"), one("tumor_size", "cm", "concat('Tumor size: ', cm)"),
        one("pathological_t_category", "stage", "concat('Pathological T category: ', stage)"), one("pathological_n_category", "nodes", "concat('Pathological N category: ', nodes)"),
    ])


def decisions_sql() -> str:
    """A decision for each of these fields, flat (up to two texts and two alternatives); what the third field's says goes by the case c."""
    t = "concat('Pathological T category: ', stage)"
    case = lambda default, **by: "case " + " ".join(f"when c = {k[1:]} then {v}" for k, v in by.items()) + f" else {default} end"
    of_t = (
        "select report_id, c, text, 'pathological_t_category' as variable_name, "
        + case("'corrected'", c2="'pending'", c3="'maybe'", c17="'accepted'", c18="'rejected'", c20="'flagged_for_review'", c21="'accepted'") + " as action, "
        + case("stage", c7="cast(null as varchar(10))", c8="cast(null as varchar(10))", c9="'  '", c11="'pT2'", c15="'pT0'") + " as value, "
        + case("'supported'", c4="cast(null as varchar(10))", c7="'conflicting'", c8="'conflicting'", c10="'negated'", c11="'cannot_be_assigned'", c16="'uncertain'") + " as status, "
        + case(t, c5="repeat('long', 2501)", c12="cast(null as varchar(10))", c13="'not in the report'", c14="'category'") + " as e1, "
        + case("cast(null as varchar(10))", c6=t, c7="concat('Tumor size: ', cm)", c8="concat('Tumor size: ', cm)") + " as e2, "
        + case("cast(null as varchar(10))", c7="stage", c8="stage") + " as a1, " + case("cast(null as varchar(10))", c8="lower(stage)") + " as a2, "
        + case("'checked'", c18="'  '") + f" as reason from ({_COMPLETE}) a where c <> 0"
    )
    rest = f"select report_id, c, text, variable_name, action, value, 'supported' as status, e1, cast(null as varchar(10)) as e2, cast(null as varchar(10)) as a1, cast(null as varchar(10)) as a2, reason from (" + " union all ".join([
        f"select report_id, c, text, 'histologic_diagnosis' as variable_name, 'accepted' as action, h as value, cast(null as varchar(10)) as e1, '' as reason from ({_COMPLETE}) b",
        f"select report_id, c, text, 'tumor_size', case when c = 17 then 'corrected' else 'accepted' end, case when c = 17 then replace(cm, ' cm', '') else cm end, case when c = 17 then concat('Tumor size: ', cm) end, 'read again' from ({_COMPLETE}) d",
        f"select report_id, c, text, 'pathological_n_category', 'accepted', nodes, cast(null as varchar(10)), '' from ({_COMPLETE}) e",
        f"select report_id, c, text, 'extra', 'accepted', 'x', cast(null as varchar(10)), '' from ({_COMPLETE}) f where c = 1",
    ]) + ") o"
    return f"{of_t} union all {rest}"


def decision_rules_sql() -> str:
    """(report_id, variable_name, error) of the decisions (table d), worked out from their flat columns."""
    times = lambda e: f"(length(text) - length(replace(text, {e}, ''))) // length({e})"
    v, n = "nullif(trim(value), '')", "((e1 is not null)::int + (e2 is not null)::int)"
    once = f"(coalesce(({times('e1')} = 1)::int, 0) + coalesce(({times('e2')} = 1)::int, 0))"
    need = "case when status = 'conflicting' then 2 when status in ('supported', 'cannot_be_assigned', 'negated', 'uncertain', 'superseded') then 1 else 0 end"
    alts = "((a1 is not null)::int + (a2 is not null)::int)"
    stated = f"(case when variable_name = 'tumor_size' then contains(e1, {v}) when starts_with({v}, 'pT') then regexp_matches(lower(e1), concat('\\b', lower({v}), '\\b')) else contains(lower(e1), lower({v})) end and {times('e1')} = 1)"
    whole = f"{once} = {n} and {once} >= {need}"
    rules = {
        "choose Accept, Correct, Reject, or Flag": "action = 'pending'", "unknown action": "action not in ('pending', 'accepted', 'corrected', 'rejected', 'flagged_for_review')",
        "choose a corrected QA status": "fix and status is null", "each corrected evidence span must be 10,000 characters or fewer": "fix and length(e1) > 10000",
        "corrected evidence spans must be distinct": "fix and e1 = e2", "one distinct alternative is needed for each of at least two spans": f"fix and status = 'conflicting' and ({alts} < 2 or {alts} <> {n})",
        "conflicting alternatives must be distinct": "fix and status = 'conflicting' and lower(a1) = lower(a2)", "a corrected value is required": f"fix and status in ('supported', 'uncertain', 'superseded') and {v} is null",
        "this status requires an empty corrected value": f"fix and status in ('not_documented', 'negated', 'conflicting', 'unsupported', 'manual_review_required') and {v} is not null",
        "only explicit pNX or pTX may carry a cannot-be-assigned value": f"fix and status = 'cannot_be_assigned' and {v} is not null and {v} not in ('pTX', 'pNX')",
        "more distinct exact evidence is required for the corrected status": f"fix and {n} < {need}", "corrected evidence must be an exact report substring": "fix and not contains(text, e1)",
        "corrected evidence occurs more than once": f"fix and {times('e1')} > 1", "corrected evidence does not state the corrected value": f"fix and {v} is not null and coalesce(status, 'superseded') <> 'superseded' and {n} > 0 and not {stated}",
        # none of these reports doubts, denies or revises anything, so evidence carries only what is plainly stated
        "corrected evidence does not support the corrected status": f"fix and status is not null and {whole} and not coalesce(case when status = 'supported' then {v} is not null and {stated} when status = 'conflicting' then false else false end, false)",
        "corrected value or status violates the field schema": f"fix and {whole} and (coalesce(status not in ('supported', 'uncertain', 'superseded'), false) or {v} is not null) and ((variable_name = 'tumor_size' and {v} not like '% cm') or (status = 'negated' and {v} is not null) "
        f"or (status = 'cannot_be_assigned' and {v} is not null) or (status = 'conflicting'))",
        "explain this reviewer action": "action in ('corrected', 'rejected', 'flagged_for_review') and trim(reason) = ''",
    }
    return " union all ".join(f"select report_id, variable_name, '{name}' as error from f where {test}" for name, test in rules.items())
