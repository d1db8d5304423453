"""Vocabularies and patterns of the abstraction task. Java regular expressions."""

from __future__ import annotations

VARIABLES = ("histologic_diagnosis", "tumor_size", "pathological_t_category", "pathological_n_category")
HISTOLOGY, SIZE, PT, PN = VARIABLES
STATUSES = ("supported", "not_documented", "cannot_be_assigned", "negated", "uncertain", "conflicting", "superseded", "unsupported", "manual_review_required")
ACTIONS = ("pending", "accepted", "corrected", "rejected", "flagged_for_review")
METHODS = ("baseline", "evidence_first", "ml")

#: Case-insensitive, Unicode classes, only \n ends a line; and the same with ^ and $ at line ends.
I = "(?iUd)"  # noqa: E741
IM = "(?imUd)"

# The patterns below must equal those of the task for right results.
PT_SUFFIX = r"(?:1mi|is|X|0|1[abc]?|2[ab]?|3|4)"
PN_SUFFIX = r"(?:X|[0-3])"
CATEGORIES = {
    PT: ("pTX", "pT0", "pTis", "pT1mi", "pT1", "pT1a", "pT1b", "pT1c", "pT2", "pT2a", "pT2b", "pT3", "pT4"),
    PN: ("pNX", "pN0", "pN1", "pN2", "pN3"),
}
VALUES = {
    HISTOLOGY: (
        r"\b(minimally\s+invasive\s+adenocarcinoma)\b",
        r"\b(basaloid\s+squamous\s+cell\s+carcinoma)\b",
        r"\b(adenocarcinoma\s*,?\s*(?:acinar|papillary|micropapillary|lepidic|solid)(?:\s+predominant)?(?:\s+pattern)?)\b",
        r"\b(squamous\s+cell\s+carcinoma\s*,?\s*(?:keratinizing|non[-\s]?keratinizing))\b",
        r"\b((?:well|moderately|poorly)[-\s]+differentiated\s+(?:invasive\s+)?squamous\s+cell\s+carcinoma)\b",
        r"\b((?:invasive\s+)?squamous\s+cell\s+carcinoma)\b",
        r"\b((?:invasive\s+)?adenocarcinoma(?:\s+with\s+(?:predominant\s+)?(?:lepidic|acinar|papillary|micropapillary|solid)(?:\s+and\s+(?:lepidic|acinar|papillary|micropapillary|solid))*\s+growth\s+pattern)?)\b",
        r"\b((?:invasive\s+)?adenocarcinoma(?:,\s*(?:lepidic|acinar|papillary|micropapillary|solid)(?:\s+and\s+(?:lepidic|acinar|papillary|micropapillary|solid))*\s+growth\s+pattern)?)\b",
        r"\b(poorly\s+differentiated\s+carcinoma)\b",
        r"\b((?:invasive\s+)?large\s+cell\s+carcinoma)\b",
    ),
    SIZE: (
        r"tumou?r\s+size[^\n]{0,80}?greatest\s+dimension(?:\s+of\s+(?:the\s+)?tumou?r)?\s*(?:is|:|=)?\s*(\d+(?:\.\d+)?)\s*cm\b",
        r"greatest\s+dimension(?:\s+of\s+(?:the\s+)?tumou?r)?\s*(?:is|:|=)?\s*(\d+(?:\.\d+)?)\s*cm\b",
        r"greatest\s+diameter(?:\s+of\s+(?:the\s+)?tumou?r)?\s*(?:is|:|=)?\s*(\d+(?:\.\d+)?)\s*cm\b",
        r"(?:size|dimension)\s+of\s+(?:invasive\s+)?(?:carcinoma|tumou?r)\s*(?:is|:|=)?\s*(\d+(?:\.\d+)?)\s*cm\b",
        r"tumou?r\s+size\s*(?:is|:|=)?\s*(\d+(?:\.\d+)?)\s*[x×]\s*\d+(?:\.\d+)?(?:\s*[x×]\s*\d+(?:\.\d+)?)?\s*cm\b",
        r"\b(?:tumou?r|mass|lesion|carcinoma)\s+(?:measuring|measures?|measured)\s+(?:approximately\s+|about\s+)?(\d+(?:\.\d+)?)\s*cm\b",
        r"(\d+(?:\.\d+)?)\s*cm\s*(?:in\s*)?(?:greatest\s*)?dimension\b",
        r"tumou?r\s+sizes?\s*(?:is|:)?\s*(?:approximately\s+|about\s+)?(\d+(?:\.\d+)?)\s*cm\b",
        r"maximum\s+tumou?r\s+dimension\s*(?:is|:|measured\s+)?\s*(\d+(?:\.\d+)?)\s*cm\b",
        r"(?:gross|microscopic|synoptic|narrative)\s+(?:section\s+)?records\s+(\d+(?:\.\d+)?)\s*cm\b",
        r"(\d+(?:\.\d+)?)\s*cm\s*(?:tumou?r|mass|lesion)\b",
    ),
    PT: (
        rf"\b(pT{PT_SUFFIX})\b",
        rf"pathological\s+T\s+category\s*(?:is|:)?\s*(pT{PT_SUFFIX})\b",
        rf"consistent\s+with\s+(?:pathological\s+T\s+category\s+)?(pT{PT_SUFFIX})\b",
    ),
    PN: (
        rf"\b(pN{PN_SUFFIX})\b",
        rf"pathological\s+N\s+category\s*(?:is|:)?\s*(pN{PN_SUFFIX})\b",
        rf"consistent\s+with\s+(?:pathological\s+N\s+category\s+)?(pN{PN_SUFFIX})\b",
    ),
}
#: Letters that every match of the pattern at the same place in VALUES has, lower-cased. None is an i, k or s, which other
#: characters match too where case is ignored.
CORES = {
    HISTOLOGY: ("mally", "quamou", "adenocarc", "quamou", "quamou", "quamou", "adenocarc", "adenocarc", "poorly", "large"),
    SIZE: ("greate", "greate", "ameter", "cm", "cm", "mea", "men", "cm", "max", "record", "cm"),
    PT: ("pt", "category", "tent"),
    PN: ("pn", "category", "tent"),
}
# Fixed values.
UNCERTAINTY = (
    r"\buncertain(?:ty)?\b|\bapproximately\b|\bapprox\.?\b|\bestimated?\b|\blikely\b|\bpossible\b|\bprobable\b|\bsuspected\b|"
    r"\bequivocal\b|\bsuggestive\b|\bdiscrepancy\b|\bconflicting\b|\branging\b|\bpending\b|\bprovisional\b"
)
UPDATE = (
    r"\b(?:amended?|amendment|revised?|revision|reclassified?|reclassification|corrected?|correction|"
    r"supersed(?:e|ed|es)|updated?|changed\s+from)\b"
)
# Fixed values.
HEADINGS = (
    ("revised", r"REVISED\s+FINAL\s+DIAGNOSIS"),
    ("preliminary", r"PRELIMINARY\s+DIAGNOSIS"),
    ("amended", r"AMENDED(?:\s+FINAL)?\s+DIAGNOSIS"),
    ("final", r"FINAL\s+DIAGNOSIS"),
    ("addendum", r"ADDENDUM[^\n:]*"),
    ("staging", r"STAGING"),
)
HEADING = r"^[ \t]*(?:" + "|".join(p for _, p in HEADINGS) + r")\s*:?[^\n]*$"
OLD_BEFORE = (
    r"(?:amended|revised|changed|corrected|updated)\s+from\s*[(:]?\s*$|\b(?:previously|formerly|originally|prior)\s*[(:]?\s*$"
)
OLD_AFTER = r"^\s*(?:was\s+)?(?:amended|revised|changed|corrected|updated)\s+to\b"
#: Negations around a candidate; VALUE stands for the quoted value.
NEGATED_NEAR = (
    r"\bno\s+evidence\s+of\s+VALUE\b",
    r"\bnegative\s+for\s+VALUE\b",
    r"\babsence\s+of\s+VALUE\b",
    r"\bwithout\s+VALUE\b",
    r"\bnot\s+VALUE\b",
    r"\bVALUE\s+(?:is|was|are|were)\s+not\s+(?:identified|present|found|detected)\b",
    r"\brule[sd]?\s+out\s+VALUE\b",
)
NEGATED_CONCERN = r"\bconcern\s+for\s+VALUE.{0,60}?ruled\s+out\b"
NEGATED_LOCAL = (
    r"\bno\s+evidence\s+of\s+VALUE\b",
    r"\bnegative\s+for\s+VALUE\b",
    r"\babsence\s+of\s+VALUE\b",
    r"\bnot\s+VALUE\b",
    r"\bVALUE\s+(?:is|was|are|were)\s+not\s+(?:identified|present|found|detected)\b",
    r"\bconcern\s+for\s+VALUE.{0,60}?ruled\s+out\b",
)
# Fixed values.
LABELS = {
    HISTOLOGY: r"(?:histologic\s+diagnosis|histology)",
    SIZE: r"tumou?r\s+size",
    PT: r"(?:pathological\s+T\s+category|pT)",
    PN: r"(?:pathological\s+N\s+category|pN)",
}
NOT_DOCUMENTED = r"\bLABEL\s*(?::|is)?\s*not\s+documented\b[^\n.]*\.?"
CANNOT_ASSIGN = (
    r"\bLABEL\s*(?::|is)?\s*cannot\s+be\s+assigned\b[^\n.]*\.?",
    r"\bLABEL\s*(?::|is)?\s*cannot\s+be\s+assessed\b[^\n.]*\.?",
)
NO_TUMOR = (
    r"\bNo\s+invasive\s+tumou?r\s+is\s+identified\s+for\s+measurement\b[^\n.]*\.?",
    r"\bNo\s+tumou?r\s+is\s+identified\s+for\s+measurement\b[^\n.]*\.?",
)
NO_NODES = (
    r"\bno\s+(?:regional\s+)?lymph\s+nodes?\s+(?:were\s+)?(?:submitted|identified|assessed|evaluated)\b[^\n.]*\.?",
    r"\bregional\s+lymph\s+nodes?\s+cannot\s+be\s+assessed\b[^\n.]*\.?",
    r"\bnodes?\s+cannot\s+be\s+assessed\b[^\n.]*\.?",
)
QA_NO_NODES = (
    r"\b(?:no\s+(?:regional\s+)?lymph\s+nodes?\s+(?:were\s+)?(?:submitted|identified|assessed|evaluated)|regional\s+lymph\s+nodes?\s+cannot\s+be\s+assessed)\b[^\n.]*\.?"
)
#: Families of histologies, in the order in which they are tried.
FAMILIES = (
    "minimally invasive adenocarcinoma", "squamous cell carcinoma", "adenocarcinoma", "large cell carcinoma", "poorly differentiated carcinoma",
)
COMMON_TOKENS = ("invasive", "cell", "carcinoma")
#: A size is stated by one of these; VALUE stands for the value's pattern. All on lower-cased text.
MEASURED = (
    r"\btumou?r\s+size\b[^.\n]{0,80}VALUE",
    r"\b(?:tumou?r|mass|lesion|carcinoma)\s+(?:is\s+|measur\w*\s+)?VALUE",
    r"\b(?:amended|revised|estimated|maximum)\s+size\b[^.\n]{0,50}VALUE",
    r"\bsize\s*(?::|is)?\s*(?:approximately\s+|about\s+)?VALUE",
    r"\bgreatest\s+dimension(?:\s+of\s+(?:the\s+)?tumou?r)?\s*(?::|is|=)?\s*VALUE",
    r"\bgreatest\s+diameter(?:\s+of\s+(?:the\s+)?tumou?r)?\s*(?::|is|=)?\s*VALUE",
    r"\b(?:size|dimension)\s+of\s+(?:invasive\s+)?(?:carcinoma|tumou?r)\s*(?::|is|=)?\s*VALUE",
    r"VALUE[^.\n]{0,35}\b(?:greatest\s+dimension|tumou?r|mass|lesion)\b",
    r"\b(?:gross|microscopic|synoptic|narrative)\s+(?:section\s+)?records\s+VALUE",
)
WRONG_CONTEXT = (
    r"\b(?:no\s+evidence\s+of|negative\s+for|absence\s+of|without)\b[^.\n]{0,60}VALUE",
    r"\bno\b[^.\n]{0,25}VALUE",
    r"VALUE[^.\n]{0,45}\b(?:not\s+(?:identified|present|found|detected)|ruled\s+out|absent)\b",
    r"\b(?:prior|previous|previously|former|formerly|original|originally)\b[^.\n]{0,45}VALUE",
    r"\b(?:amended|revised|corrected|changed|updated)\s+from\s+VALUE",
    r"VALUE[^.\n]{0,45}\b(?:was\s+)?(?:amended|revised|corrected|changed|updated|superseded)\s+(?:to|by)\b",
)
SUPERSEDING = (
    r"(?:VALUE)[^.\n]{0,55}\b(?:was\s+)?(?:superseded|replaced|amended|revised|corrected|updated|changed)\s+(?:to|by)\b",
    r"\b(?:amended|revised|corrected|changed|updated)\s+from\s+(?:VALUE)",
    r"\b(?:supersedes|replaces)\s+(?:VALUE)",
)
# Fixed values.
#: Words without which SUPERSEDING, and NEGATED_TARGET, cannot match.
REVISING = r"supersed|replac|amended|revised|corrected|updated|changed"
DENYING = r"\bno|negative|absence|without|absent|ruled"
TARGETS = {
    HISTOLOGY: r"(?:adenocarcinoma|squamous\s+cell\s+carcinoma|large\s+cell\s+carcinoma|poorly\s+differentiated\s+carcinoma|carcinoma|malignan\w*|tumou?r)",
    SIZE: r"(?:tumou?r(?:\s+size)?|mass|lesion|measurement|size)",
    PT: rf"(?:pathological\s+T\s+category|pT{PT_SUFFIX})",
    PN: rf"(?:pathological\s+N\s+category|pN{PN_SUFFIX}|regional\s+lymph\s+nodes?)",
}
#: Cues that a status needs next to its target.
CUES = {
    "uncertain": r"\b(?:uncertain|approximately|approx\.?|estimated?|likely|possible|probable|suspected|equivocal|suggestive|favou?red|provisional|pending)\b",
    "cannot_be_assigned": r"\b(?:cannot\s+be\s+(?:assigned|assessed)|not\s+(?:assessed|assignable))\b",
    "not_documented": r"\b(?:not\s+documented|not\s+stated|not\s+provided)\b",
    "unsupported": r"\b(?:unsupported|not\s+supported|insufficient\s+evidence|unable\s+to\s+(?:verify|validate|support)|cannot\s+(?:confirm|verify|validate))\b",
    "manual_review_required": (
        r"\b(?:manual\s+review\s+(?:is\s+)?required|requires?\s+manual\s+review|review\s+manually|needs?\s+(?:manual\s+)?review|refer(?:red)?\s+for\s+review)\b"
    ),
}
NEGATED_TARGET = (
    r"\b(?:no\s+evidence\s+of|negative\s+for|absence\s+of|without)\b[^.\n]{0,60}(?:VALUE)|\bno(?:\s+[a-z]+){0,3}\s+(?:VALUE)\b|"
    r"(?:VALUE)[^.\n]{0,55}\b(?:not\s+(?:identified|present|found|detected|documented)|absent|ruled\s+out)\b"
)
NO_NODES_STATUS = r"\bno\s+(?:regional\s+)?lymph\s+nodes?[^.\n]{0,45}(?:submitted|identified|assessed|evaluated)\b"
DISCREPANT = r"\b(?:conflicting|conflict|discrepancy|different|versus|vs\.?|another)\b"
CANDIDATES = {
    HISTOLOGY: (
        r"\b(?:minimally\s+invasive\s+adenocarcinoma|(?:invasive\s+)?adenocarcinoma|(?:invasive\s+)?squamous\s+cell\s+carcinoma|"
        r"large\s+cell\s+carcinoma|poorly\s+differentiated\s+carcinoma)\b"
    ),
    SIZE: r"\d+(?:\.\d+)?\s*cm\b",
    PT: rf"\bpT{PT_SUFFIX}\b",
    PN: rf"\bpN{PN_SUFFIX}\b",
}
SYNOPTIC = r"\bsynoptic\s+report\b"
TRUNCATED = r"\b(?:lymph\s+node\s+involvement|pathologic(?:al)?\s+stag(?:e|ing)|pTNM)\s*:\s*$"
# Fixed values.
IDENTIFIERS = (
    ("patient name", r"^\s*patient\s+name\s*:\s*([^\n]*)$"),
    ("medical record number", r"^\s*(?:medical\s+record\s+number|mrn)\s*:\s*([^\n]*)$"),
    ("date of birth", r"^\s*(?:date\s+of\s+birth|dob)\s*:\s*([^\n]*)$"),
)
REDACTED = ("", "[redacted]", "redacted", "[removed]", "removed", "[synthetic]", "synthetic", "n/a", "none")
REPORT_BYTES, REPORT_LEAST, REPORT_MOST = 512_000, 20, 100_000
