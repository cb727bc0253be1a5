"""Patterns and column functions for checking written answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number pattern, structural constructs, citation ids, claim markers, injection
# and override patterns, scope vocabulary, intent patterns.
NUMBER = (
    r"(?<![\p{L}\p{N}_.])[-+]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?"
    r"|(?<![\p{L}\p{N}_.])[-+]?[0-9]*\.?[0-9]+"
)
STRUCTURAL = (
    r"\[S-\d+\]",
    r"\bhttps?://\S+",
    r"\b[A-Z]\d{2}[A-Z]\d{2}[A-Z]?\b",
    r"(?i)\bMAT\s+\w+'?\d{2}\b",
    r"(?i)\bFEB'\d{2}\b",
    r"\b(19|20)\d{2}\b",
    r"\b[A-Za-z][A-Za-z]+-\d+(?:\.\d+)?\b",
)
CITATION = r"\[(S-\d+)\]"
CLAIM_MARKERS = (
    "guideline", "guidance", "prevalence", "epidemiolog", "who ", "government", "policy",
    "regulat", "nlem", "nppa", "price control", "patent", "approval", "trial", "study",
    "research", "screening", "programme", "program", "air quality", "pollution", "pm2.5",
    "burden of disease", "clinical", "published", "reported by", "association", "society",
    "ministry", "survey",
)
INJECTION = (
    r"(?i)ignore (?:all |any |the )?(?:previous|prior|above|preceding) instructions",
    r"(?i)disregard (?:the |your )?(?:system prompt|instructions|rules|guardrails)",
    r"(?i)you are now (?:a|an|the)\b",
    r"(?i)new (?:system )?instructions?\s*:",
    r"(?i)<\s*/?\s*system\s*>",
    r"(?im)^\s*(?:system|assistant)\s*:",
    r"(?i)reveal (?:your |the )?(?:system prompt|instructions|api key)",
    r"(?i)do not (?:cite|mention|tell)",
    r"(?i)\b(?:override|bypass) (?:the )?(?:guardrail|safety|verification)",
)
FILTERED = "[filtered: instruction-like content]"
OVERRIDE = (
    r"(?i)ignore (?:all |your |the )?(?:previous|prior|above|earlier) instructions",
    r"(?i)disregard (?:your|the) (?:system prompt|instructions|guardrails)",
    r"(?i)you are now\b",
    r"(?i)reveal (?:your |the )?(?:system prompt|instructions)",
    r"(?i)\bdeveloper mode\b",
)
HARD_BLOCK = (
    "share price", "stock price", "market cap", "valuation", "shareholder",
    "acquisition target", "salary", "recruit", "hiring", "medical advice", "dosage for me",
    "prescribe me", "diagnose me", "legal advice", "should i take", "is it safe for me",
)
SOFT_BLOCK = (
    "respiratory", "oncology", "dermatology", "vaccine", "diabetes market", "anti-infective",
    "urology", "central nervous system",
)
IN_SCOPE = (
    "cardiac", "cardio", "hypertens", "lipid", "statin", "angina", "blood pressure", "cipla",
    "molecule", "segment", "sub-segment", "sub segment", "opportunity", "market", "share",
    "growth", "competitor", "brand", "portfolio", "prioriti", "right to win", "whitespace",
    "white space", "forecast", "mat", "sales", "telmisartan", "amlodipine", "rosuvastatin",
    "atorvastatin", "cilnidipine", "ezetimibe", "fenofibrate", "clopidogrel", "metoprolol",
    "bisoprolol", "nitrate", "nicorandil", "arb", "ccb", "ace", "diuretic", "combination", "fdc",
    "score", "rank", "signal", "trend", "hhi", "concentration", "invest", "focus", "recommend",
    "strategy", "strategic", "launch", "enter", "expand", "defend", "double down", "capability",
    "penetrat", "therapy", "space", "spaces", "audit", "dataset", "data", "volume", "value",
    "price", "erosion", "leader", "player", "franchise",
)
INTENTS = (
    ("sensitivity", r"sensitiv|robust|how confident|what if.*weight|stability|hold up"),
    ("underpenetration",
     r"underpenetrat|under-penetrat|white ?space|absent|not present|below fair share"),
    ("prioritisation",
     r"prioriti[sz]|which (?:two|three|2|3|ones?)|should cipla (?:focus|invest|back)|double down"),
    ("right_to_win",
     r"right to win|compare(?:d)? with (?:key )?competitors?|competitive (?:strength|position)"),
    ("strategic_implications",
     r"strategic implication|where should (?:the company|cipla)|build capabilit|avoid|harvest|selective"),
    ("forecast", r"forecast|project|next (?:3|5|three|five)|outperform|over the next"),
    ("top_opportunities",
     r"top \d|best opportunit|which opportunit|identify.*opportunit|\brank\b"),
    ("competitor",
     r"\b(torrent|sun|usv|glenmark|mankind|lupin|zydus|macleods|intas|aristo|micro labs|emcure"
     r"|alembic|dr\.? ?reddy|ipca|ajanta|eris|abbott|pfizer)\b"),
    ("space_detail", r"tell me about|deep dive|explain|what is happening in"),
    ("overview", r"overview|how big|market size|summar|landscape"),
)
# End of fixed values.


def numbers(c: Column) -> Column:
    """Every number written in the text, thousands separators removed, as doubles."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda t: F.regexp_replace(t, ",", "").cast("double"))


def claims(c: Column, ignore_below: float) -> Column:
    """Numbers a reader takes as facts: structural constructs blanked, small ones dropped."""
    # Without a digit there is neither a number nor a construct to blank.
    cleaned = F.when(c.rlike("[0-9]"), c).otherwise("")
    for pattern in STRUCTURAL:
        cleaned = F.regexp_replace(cleaned, pattern, " ")
    return F.filter(numbers(cleaned), lambda v: F.abs(v) >= ignore_below)


def cited_ids(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CITATION), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))


def sentences(c: Column) -> Column:
    """Split after . ! or ? before a capital, bracket or parenthesis; trimmed, blanks dropped."""
    marked = F.regexp_replace(
        F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+(?=[A-Z(\[])", "\u0001"
    )
    trimmed = F.transform(
        F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    )
    return F.filter(trimmed, lambda s: s != "")


def any_of(words) -> str:
    """One pattern that finds any of the literal words."""
    return "|".join(r"\Q" + w + r"\E" for w in words)


def _mentions(lowered: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])


def uncited_claims(c: Column) -> Column:
    """Sentences that speak of the outside world without naming a source."""
    # Most texts hold no marker at all; only the others are cut into sentences.
    marked = F.when(_mentions(F.lower(c), CLAIM_MARKERS), c)
    return F.filter(
        sentences(marked),
        lambda s: ~s.rlike(CITATION) & _mentions(F.lower(s), CLAIM_MARKERS),
    )


def injection_hits(c: Column) -> Column:
    """Numbers (from 1) of the instruction-like patterns found."""
    marks = [F.when(c.rlike(p), F.lit(i)) for i, p in enumerate(INJECTION, start=1)]
    return F.array_compact(F.array(*marks))


def sanitise(c: Column, source: str = "corpus") -> Column:
    """Replace instruction-like spans and wrap the text as retrieved data."""
    cleaned = c
    for pattern in INJECTION:
        cleaned = F.regexp_replace(cleaned, pattern, FILTERED)
    opened, closed = f"<retrieved_data source='{source}'>", "</retrieved_data>"
    empty = F.coalesce(c, F.lit("")) == ""
    return F.when(empty, opened + closed).otherwise(
        F.concat(F.lit(opened + "\n"), cleaned, F.lit("\n" + closed))
    )


def _found(lowered: Column, words) -> Column:
    return F.array_compact(F.array(*[F.when(lowered.contains(w), F.lit(w)) for w in words]))


def scope_decision(c: Column, whole_words: bool = False) -> Column:
    """struct(allowed, reason). Vocabulary matches inside words unless ``whole_words``."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    low = F.lower(text)
    hard, soft = _found(low, HARD_BLOCK), _found(low, SOFT_BLOCK)
    inside = any_of(IN_SCOPE)
    known = low.rlike(rf"\b(?:{inside})\b" if whole_words else inside)
    override = text.rlike("|".join(f"(?:{p})" for p in OVERRIDE))

    def named(prefix: str, found: Column) -> Column:
        return F.concat(F.lit(prefix), F.array_join(F.slice(found, 1, 3), ", "))

    reason = (
        F.when(text == "", "empty question")
        .when(override, "instruction override attempt")
        .when(F.size(hard) > 0, named("topic absent from the dataset: ", hard))
        .when((F.size(soft) > 0) & ~known, named("out-of-scope therapy area: ", soft))
        .when(~known, "no in-scope terminology")
        .otherwise("in scope")
    )
    return F.struct((reason == "in scope").alias("allowed"), reason.alias("reason"))


def intent(c: Column) -> Column:
    """First matching intent, else general."""
    out = F.lit("general")
    for name, pattern in reversed(INTENTS):
        out = F.when(F.coalesce(c, F.lit("")).rlike("(?i)" + pattern), name).otherwise(out)
    return out
