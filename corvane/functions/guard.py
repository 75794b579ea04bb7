"""Rails: predicates and edits of queries and answers. Each stays inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# ---------------------------------------------------------------- fixed values

INTENTS = [
    ("greeting", 0.8, r"^\s*(?:hi|hello|hey|greetings|good\s+(?:morning|afternoon|evening))\b"),
    ("farewell", 0.8, r"^\s*(?:bye|goodbye|see\s+you|farewell|thanks?,?\s*bye)\b"),
    ("administrative", 0.7, r"^\s*(?:help|what\s+can\s+you\s+do|how\s+(?:do\s+I|does\s+this))\b"),
    ("off_topic", 0.6, r"\b(?:weather|joke|game|score|music|stock\s+price|play\s+(?:a|some))\b"),
]
RAIL_INJECTION = [
    r"pretend\s+(?:you\s+are|to\s+be)\s+",
    r"act\s+as\s+(?:if|a)\s+",
    r"role\s*-?\s*play\s+as\s+",
    r"(?:no|without)\s+(?:rules|restrictions|limits)",
    r"answer\s+freely\b",
    r"bypass\s+(?:your|the)\s+(?:safety|content|filter)",
    r"(?:DAN|developer)\s+mode",
    r"(?:disregard|override)\s+(?:your|all|the)\s+",
    r"ignore\s+(?:previous|above|all)\s+(?:instructions?|prompts?)",
    r"system\s*prompt",
    r"(?:reveal|show|print)\s+(?:your|the)\s+(?:system|initial|original)\s+",
]
QUERY_INJECTION = [
    r"ignore\s+(all\s+)?(previous|above|prior)\s+(instructions|prompts)",
    r"you\s+are\s+now\s+",
    r"system\s*:\s*",
    r"<\s*/?\s*(system|prompt|instruction)",
    r"\b(ADMIN|ROOT)\s*:",
    r"do\s+not\s+follow\s+(your|the)\s+(rules|instructions)",
    r"forget\s+(everything|your\s+instructions)",
    r"\[\s*INST\s*\]",
    r"```\s*(system|instruction)",
    r"disregard.*prompt",
    r"override.*safety",
    r"(sudo|admin|root)\s+(access|mode|command)",
    r"pretend\s+(you|to)\s+(are|be)",
    r"act\s+as\s+(if|a|an)",
    r"bypass\s+(all|the|your)\s+(filters|safety|restrictions)",
    r"DAN\s+mode",
    r"jailbreak",
]
TOXIC = [r"\b(?:kill|murder|attack|bomb|shoot)\s+(?:you|them|people|everyone)\b", r"\b(?:hate|despise)\s+(?:all|every)\s+\w+\b", r"\b(?:die|death\s+to)\b"]
EXFILTRATION = [
    r"list\s+all\s+(documents|records|entries|files|data)",
    r"dump\s+(everything|all|the\s+database)",
    r"show\s+me\s+(all|every)\s+(records?|documents?|entries?)",
    r"export\s+(the\s+)?(database|data|everything)",
    r"give\s+me\s+every(thing|\s+entry|\s+record|\s+document)",
    r"download\s+all",
    r"extract\s+all",
]
ROLE_BOUNDARY = [
    r"you\s+are\s+now\s+a",
    r"ignore\s+(previous|all|your)\s+instructions",
    r"pretend\s+(you\s+are|to\s+be)",
    r"act\s+as\s+if",
    r"forget\s+(everything|your\s+rules|your\s+instructions)",
    r"disregard\s+(your|all)\s+(rules|guidelines|instructions)",
    r"you\s+have\s+no\s+restrictions",
    r"jailbreak",
    r"DAN\s+mode",
]
ESCALATION = [r"ignore\s+(previous|all|your)\s+instructions", r"you\s+are\s+now\s+a", r"pretend\s+(you\s+are|to\s+be)", r"jailbreak", r"DAN\s+mode"]
CITATIONS = [r"\[Source:.*?\]", r"\[\d+\]", r"\(Source:.*?\)", r"According to", r"Based on the document"]
SENSITIVE = [
    ("medical", ["medication", "dosage", "symptom", "diagnosis", "prescription", "treatment", "disease", "medical advice", "drug interaction"]),
    ("legal", ["legal advice", "lawsuit", "attorney", "court", "liability", "legal rights", "sue", "legal action"]),
    ("financial", ["investment advice", "stock pick", "buy or sell", "financial advice", "portfolio", "tax advice"]),
]
CLARITY_STOPWORDS = ["a", "an", "the", "it", "is", "was", "are", "to", "of", "in", "on", "and", "or", "for", "that", "this", "what"]
BACKWARD = r"\b(the above|you said|you mentioned|previously|tell me more|elaborate|based on what we discussed|regarding what you mentioned|as we discussed|from earlier|what about that)\b"
RESET = r"\b(forget about (the )?(past |previous )?(conversation|convo|chat|discussion)|ignore (the )?(previous|prior|past)|new topic|start fresh|fresh start|disregard what we discussed)\b"
PRONOUN = r"\b(it|its|that|those|this|these|them)\b"
PII = {
    "CREDIT_CARD": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "PHONE": r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "DOB": r"\b(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/(?:19|20)\d{2}\b",
    "PASSPORT": r"\b[A-Z]{1,2}\d{6,9}\b",
}

# ---------------------------------------------------------------- predicates


def any_match(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike("(?iU)" + p) for p in patterns])


def intent(c: Column) -> Column:
    """(intent, confidence) by the first kind of keyword that a query has."""
    out = lambda name, n: F.struct(F.lit(name).alias("intent"), F.lit(n).alias("confidence"))
    found = F.when(F.lit(False), out("", 0.0))
    for name, n, pattern in INTENTS:
        found = found.when(c.rlike("(?iU)" + pattern), out(name, n))
    return found.otherwise(out("rag_search", 0.85))


def query_action(c: Column, most: int = 500) -> Column:
    """(query, action) of the sanitising step."""
    q = T.strip(T.collapse(c)).substr(1, most)
    action = F.when(q == "", "ask_user").when(any_match(q, QUERY_INJECTION), "ask_user").otherwise("search")
    return F.struct(q.alias("query"), action.alias("action"))


def heuristic_confidence(c: Column) -> Column:
    n = F.size(T.words(c))
    return F.when(n == 0, 0.0).when(n <= 2, 0.4).when(n <= 5, 0.7).otherwise(0.85)


def backward_reference(c: Column, density: float = 0.15) -> Column:
    n = F.size(T.words(c))
    return c.rlike("(?iU)" + BACKWARD) | ((n > 0) & (F.regexp_count(c, F.lit("(?iU)" + PRONOUN)) / n >= density))


def context_reset(c: Column) -> Column:
    return c.rlike("(?iU)" + RESET)


def length_check(c: Column, least: int, most: int) -> Column:
    n = F.length(T.strip(c))
    return F.when(n < least, "too short").when(n > most, "too long").otherwise("")


def is_clear(c: Column) -> Column:
    w = T.words(c)
    return (F.size(w) >= 2) & (F.size(F.filter(w, lambda x: ~F.lower(x).isin(CLARITY_STOPWORDS))) > 0)


def sensitive_domain(c: Column) -> Column:
    """The first domain with a keyword in the query, or an empty string."""
    q, out = F.lower(c), F.when(F.lit(False), "")
    for domain, keys in SENSITIVE:
        out = out.when(reduce(lambda a, b: a | b, [q.contains(k) for k in keys]), domain)
    return out.otherwise("")


# ---------------------------------------------------------------- personal data


def pii_counts(c: Column) -> dict[str, Column]:
    return {name: F.regexp_count(c, F.lit(p)) for name, p in PII.items()}


def redact(c: Column) -> Column:
    """Spans replaced one kind after another, longest kinds first, so that overlapping spans can't spoil each other."""
    return reduce(lambda t, kv: F.regexp_replace(t, kv[1], f"[{kv[0]}]"), PII.items(), c)


# ---------------------------------------------------------------- answers


def filter_toxic(c: Column) -> Column:
    return F.when(any_match(c, TOXIC), "[CONTENT_FILTERED]").otherwise(c)


def sanitise_answer(c: Column, prompt: str, run: int = 40) -> Column:
    """Without lines that hold marks or template names or repeat the prompt at length; all of it if nothing is left."""
    said = " " + " ".join(prompt.lower().split()) + " "
    norm = lambda line: T.strip(T.collapse(F.lower(line)))
    leaks = lambda line: line.contains("<<<") | line.contains("{{") | ((F.length(norm(line)) >= run) & (F.instr(F.lit(said), F.concat(F.lit(" "), norm(line), F.lit(" "))) > 0))
    kept = T.strip(F.array_join(F.filter(T.lines(c), lambda line: ~leaks(line)), "\n"))
    return F.when(kept == "", c).otherwise(kept)


def merge_gate(injection: Column, toxic: Column, off_topic: Column, intent_name: Column, redacted: Column) -> Column:
    """What is done with a query: the first rail that objects decides."""
    canned = intent_name.isin("greeting", "farewell", "administrative", "off_topic")
    return F.when(injection, "reject_injection").when(toxic, "reject_toxicity").when(off_topic, "reject_off_topic").when(canned, F.concat(F.lit("canned_"), intent_name)).otherwise(F.concat(F.lit("search:"), redacted))


def hallucinated(answer: Column, context: Column) -> Column:
    """Years and long numbers of an answer that its context doesn't hold; a year counts as both."""
    absent = lambda pattern, kind: F.transform(F.filter(F.regexp_extract_all(answer, F.lit("(?U)" + pattern), F.lit(0)), lambda x: F.instr(F.lower(context), x) == 0), lambda x: F.concat(F.lit(kind), x))
    return F.concat(absent(r"\b(?:19|20)\d{2}\b", "year:"), absent(r"\b\d{3,}(?:\.\d+)?%?\b", "number:"))


def faithfulness(self_score: Column, claim_mean: Column, n_hallucinated: Column) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(self_score, claim_mean) - F.least(F.lit(0.3), 0.1 * n_hallucinated))
