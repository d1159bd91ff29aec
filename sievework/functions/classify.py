"""Classes of messages and queries: ordered rule lists turned into CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rx
from .masking import LEAK_EMAIL
from .text import LITERAL_PHRASES

# fixed values: (class, words that may occur anywhere, words that may start the text), first hit wins
MATURITY_RULES = (
    ("exploratory", ("brainstorm", "ideas", "outline", "framework", "example", "concept"), ()),
    (
        "refinement",
        ("rewrite", "revise", "enhance", "improve", "optimize", "clean this up", "polish", "refine"),
        (),
    ),
    (
        "deployable",
        (
            "finalize", "final version", "ready to send", "cut and paste", "production ready", "deployable",
            "employee ready", "customer ready", "send this", "operationalize", "complete this",
        ),
        (),
    ),
)
TYPE_RULES = (
    (
        "rewrite",
        (
            "rewrite", "restructure", "redraft", "revise", "enhance", "improve", "optimize", "tailor", "clean this up",
            "make this professional", "rework", "polish",
        ),
        (),
    ),
    ("communication", ("email", "draft a response", "respond to", "write a response", "compose"), ()),
    (
        "business_document",
        (
            "sow", "statement of work", "scope of work", "proposal", "msa", "sla", "agreement", "contract", "ltip",
        ),
        (),
    ),
    (
        "incident",
        (
            "incident", "outage", "root cause", "remediation", "sev", "severity", "operational issue", "downtime",
        ),
        (),
    ),
    (
        "candidate",
        (
            "resume", "candidate", "alignment score", "technical match", "culture fit", "submittal", "job fit",
            "role fit",
        ),
        (),
    ),
    ("summary", ("summary", "tl;dr"), ("summarize",)),
    ("analysis", ("analysis", "assess", "evaluate", "compare"), ("analyze",)),
    ("question", ("?", "explain"), ("what", "why", "when", "where")),
    ("instruction", ("help me",), ("how",)),
)
SIMPLE_RULES = (
    ("strategic", ("analyze", "optimize", "assessment", "alignment"), ()),
    ("engineering", ("build", "code", "fix", "debug"), ()),
    ("evaluation", ("grade", "evaluate", "score"), ()),
)
PROFILE_SIGNALS = (
    "strategy", "governance", "leadership", "system", "systems", "risk", "architecture", "executive",
    "organizational", "operational", "analysis", "synthesis",
)
# fixed values: class, signals needed, results, candidates, threshold, characters
PROFILES = (
    ("abstract", 4, 10, 20, 0.18, 16000),
    ("analytical", 2, 8, 16, 0.20, 14000),
    ("direct", 0, 6, 8, 0.22, 10000),
)
MAX_MATCH_COUNT = 20
EVIDENCE_WORDS = (
    "compare", "across", "uploaded", "documents", "materials", "artifacts", "summarize", "analyze", "assessment",
    "rank", "evaluate", "identify", "review", "synthesize", "analysis",
)
SYNTHESIS_WORDS = (
    "brainstorm", "rewrite", "refine", "polish", "draft", "improve", "generate", "ideas", "proposal", "communication",
)
EXTERNAL_EVIDENCE = (
    "resume", "candidate", "uploaded file", "uploaded document", "analyze this document", "summarize this resume",
    "compare candidates", "compare resumes",
)
INTENT_NOTES = {
    "question": "Clarify the topic and provide a direct explanation.",
    "instruction": "Provide actionable, step-by-step guidance.",
    "summary": "Be concise and highlight essential points.",
    "analysis": "Break down concepts logically and examine structure.",
}
DEFAULT_NOTE = "General intent — provide a high-quality, aligned response."
EVIDENCE_NOTE = "Use provided evidence to enhance accuracy and grounding."
BUCKETS = (
    (
        "strategic",
        2,
        4,
        (
            "strategy", "roadmap", "initiative", "objective", "vision", "modernization", "future-state",
            "transformation", "scalability",
        ),
    ),
    (
        "governance",
        2,
        4,
        ("governance", "policy", "compliance", "audit", "leadership", "oversight", "risk", "controls"),
    ),
    (
        "operational",
        3,
        5,
        ("workflow", "incident", "integration", "implementation", "operations", "monitoring", "support"),
    ),
    (
        "ecosystem",
        2,
        4,
        ("ecosystem", "stakeholder", "dependency", "coordination", "cross-functional", "continuity"),
    ),
    ("contextual", 0, 4, ()),
)
MAX_MESSAGE_CHARS = 10000
NO_DOCUMENTS = "No matching documents found in the system."


def _first_rule(text: Column, rules: tuple, default: str) -> Column:
    case = None
    for name, anywhere, at_start in rules:
        hit = rx.contains_any(text, anywhere)
        for word in at_start:
            hit = hit | F.startswith(text, F.lit(word))
        case = F.when(hit, F.lit(name)) if case is None else case.when(hit, F.lit(name))
    return case.otherwise(F.lit(default))


def _is_literal(text: Column) -> Column:
    hit = F.lit(False)
    for phrase in LITERAL_PHRASES:
        hit = hit | F.startswith(text, F.lit(phrase))
    return hit


def decode_intent(c: Column) -> Column:
    """Struct (type, maturity); words are looked for as parts of words too."""
    text = rx.trim(F.lower(rx.text_or_empty(c)))
    return rx.let(
        text,
        lambda t: F.struct(
            F.when(_is_literal(t), F.lit("literal")).otherwise(_first_rule(t, TYPE_RULES, "general")).alias("type"),
            F.when(_is_literal(t), F.lit("locked"))
            .otherwise(_first_rule(t, MATURITY_RULES, "general"))
            .alias("maturity"),
        ),
    )


def simple_intent(c: Column) -> Column:
    return _first_rule(F.lower(rx.text_or_empty(c)), SIMPLE_RULES, "general")


def query_profile(c: Column) -> Column:
    """Struct (type, top_k, match_count, threshold, budget) by the number of signal words present."""
    found = rx.count_present(F.lower(rx.text_or_empty(c)), PROFILE_SIGNALS)

    def profile(name, _least, top_k, match_count, threshold, budget):
        return F.struct(
            F.lit(name).alias("type"),
            F.lit(top_k).alias("top_k"),
            F.lit(match_count).alias("match_count"),
            F.lit(float(threshold)).alias("threshold"),
            F.lit(budget).alias("budget"),
        )

    abstract, analytical, direct = PROFILES
    return (
        F.when(found >= abstract[1], profile(*abstract))
        .when(found >= analytical[1], profile(*analytical))
        .otherwise(profile(*direct))
    )


def retrieval_priority(message: Column, intent: Column, has_private: Column) -> Column:
    """NONE, LOW, MEDIUM or HIGH. intent is a class name; NULL reproduces callers that pass no usable class."""
    low = F.lower(rx.text_or_empty(message))
    evidence = rx.contains_any(low, EVIDENCE_WORDS)
    synthesis = rx.contains_any(low, SYNTHESIS_WORDS)
    return (
        F.when(has_private & evidence, "LOW")
        .when(has_private, "NONE")
        .when(evidence & ~synthesis, "HIGH")
        .when(F.coalesce(intent.isin("analysis", "lookup", "question"), F.lit(False)), "MEDIUM")
        .otherwise("LOW")
    )


def simple_case(c: Column, identity_answer: str) -> Column:
    """A fixed answer for the identity question, addresses and very short messages, else NULL."""
    message = rx.text_or_empty(c)
    low = rx.trim(F.lower(message))
    return (
        F.when(low.isin("who are you", "who are you?"), F.lit(identity_answer))
        .when(LEAK_EMAIL.occurs(message), F.lit("Email detected. No context."))
        .when(F.length(low) <= 10, F.lit("No subject."))
    )


def synthesis_gate(message: Column, context: Column) -> Column:
    """NULL when an answer can be written from context or message, else the fixed answer."""
    text = rx.text_or_empty(message)
    eligible = (rx.trim(rx.text_or_empty(context)) != "") | (
        (F.length(rx.trim(text)) >= 120) & ~rx.contains_any(F.lower(text), EXTERNAL_EVIDENCE)
    )
    return F.when(~eligible, F.lit(NO_DOCUMENTS))


def inference_notes(intent: Column, evidence_count: Column) -> Column:
    note = F.lit(DEFAULT_NOTE)
    for name, text in INTENT_NOTES.items():
        note = F.when(intent == name, F.lit(text)).otherwise(note)
    with_evidence = F.array(note, F.lit(EVIDENCE_NOTE))
    return F.when(evidence_count > 0, with_evidence).otherwise(F.array(note))


def abstraction_buckets(c: Column) -> Column:
    """Names of all buckets whose signals occur often enough, else the contextual one."""
    low = F.lower(rx.text_or_empty(c))
    named = [
        F.when(rx.count_present(low, signals) >= least, F.lit(name)) for name, least, _, signals in BUCKETS if signals
    ]
    hits = F.filter(F.array(*named), lambda b: b.isNotNull())
    return rx.let(hits, lambda h: F.when(F.size(h) > 0, h).otherwise(F.array(F.lit("contextual"))))


def request_status(message: Column) -> Column:
    text = rx.text_or_empty(message)
    return (
        F.when(rx.trim(text) == "", "Message required")
        .when(F.length(text) > MAX_MESSAGE_CHARS, "Input too large")
        .otherwise("ok")
    )
