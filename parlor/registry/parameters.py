"""Control values of the registered queries: rules and terms that occur in the driver tables."""

from __future__ import annotations

from parlor.functions.rules import Rule, TermRule

HANDLES = ["mail7"]
BOILERPLATE = r"(^|[^\p{L}\p{N}_])(nicht|les|los|thing)($|[^\p{L}\p{N}_])"


def words(*names: str) -> str:
    """Whole-word pattern with explicit Unicode boundaries."""
    return r"(^|[^\p{L}\p{N}_])(" + "|".join(names) + r")($|[^\p{L}\p{N}_])"


MESSAGE_RULES = [
    Rule("contact_data", r"[a-z0-9._]+@[a-z0-9.]+\.com", "An e-mail address"),
    Rule("license", r"licen[sc]e|copyright", "A license line"),
    Rule("negation", words("nicht", "pas", "kein"), "A negated sentence"),
    Rule("long_number", r"[0-9]{6,}", "A long number"),
]

LANGUAGE_RULES = [
    Rule("french", words("les", "des", "est")),
    Rule("german", words("der", "die", "und")),
    Rule("spanish", words("los", "las", "el")),
    Rule("english", words("the", "and", "of")),
]
LANGUAGES = ["french", "german", "spanish", "english", "other"]
OTHER = "other"
ESCALATE = words("nicht", "that", "los")
TEMPLATES = {
    "french": "Sorry about that, please send us your confirmation code by DM.",
    "german": "Glad to help, a dollar amount needs an agent.",
    "spanish": "We understand.",
}
DEFAULT_REPLY = "Thanks for reaching out, please DM your confirmation number so we can help."

TERMS = {
    "french": ["eaux", "mente", "queai"],
    "german": ["ung", "keit", "nicht"],
    "spanish": ["los", "ñ", "ción"],
    "english": ["thing", "tion", "sue"],
}

LABEL_TERMS = [
    TermRule("legal", ("licens", "copyright", "sue")),
    TermRule("contact", ("@", "http")),
    TermRule("money", ("nung", "keit"), "german"),
]
QUOTAS = {"french": 12, "german": 9, "spanish": 20, "english": 40, "other": 5}
SKETCHES = {"french": "Must answer in French", "german": "Must answer in German"}
DEFAULT_SKETCH = "Must ask for details"
LANG_QUOTAS = {"en": 50, "fr": 40, "de": 30, "es": 500}

VECTOR_KEYWORDS = {
    "0": ["ation", "ung"], "1": ["mente"], "2": ["nicht", "sue"], "3": ["eaux"], "4": ["thing"],
    "5": ["los"], "6": ["que"], "7": ["ß"], "8": ["tion"], "9": ["ñ", "der"],
}
VECTOR_CLASSES = [str(i) for i in range(10)]
VECTOR_CATCH_ALL = "9"
SCORE_THRESHOLD = 0.20
MIN_SIMILARITY = 0.36
MIN_CATCH_ALL_SIMILARITY = 0.40
REFUND_CLASS = "8"
REFUND_PATTERN = words("the", "and")

AGENT_CLASSES = ["english", "french", "german", "spanish"]

MODEL = "offline"
SYSTEM_TEXT = "Answer with one class name."
RUBRIC_CONTACT = ["nicht", "thing"]
RUBRIC_EMPATHY = ["les", "hand", "und"]
RUBRIC_MONEY = "tion"
