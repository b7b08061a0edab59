"""Default control tables (rules, terms, thresholds, class names).

Every operator takes these as parameters; other brands and domains pass their own.
"""

from parlor.functions.rules import Rule, TermRule

# Class taxonomy, in order; the last one is the catch-all.
CLASSES = [
    "flight_delay_cancellation",
    "baggage_issue",
    "rebooking_change_request",
    "refund_compensation_request",
    "aadvantage_miles_issue",
    "checkin_boarding_issue",
    "general_complaint_service_quality",
    "booking_payment_issue",
    "other_unclear",
]
CATCH_ALL = "other_unclear"
REFUND_CLASS = "refund_compensation_request"

# Keywords per class (substrings of the lowered text).
KEYWORDS = {
    "flight_delay_cancellation": ["delay", "delayed", "cancel", "cancelled", "cancellation", "tarmac", "late", "stuck", "missed connection", "flight status"],
    "baggage_issue": ["bag", "bags", "baggage", "luggage", "suitcase", "lost bag", "damaged bag", "carousel", "checked bag"],
    "rebooking_change_request": ["rebook", "rebooked", "change flight", "reschedule", "switch flight", "standby", "earlier flight", "later flight"],
    "refund_compensation_request": ["refund", "money back", "reimbursement", "compensation", "voucher", "expense", "hotel reimbursement", "meal voucher"],
    "aadvantage_miles_issue": ["aadvantage", "miles", "frequent flyer", "loyalty", "points", "status", "upgrade miles", "award travel"],
    "checkin_boarding_issue": ["check in", "checkin", "boarding", "boarding pass", "group", "seat assignment", "gate agent", "mobile check in"],
    "general_complaint_service_quality": ["rude", "worst airline", "horrible service", "attitude", "terrible", "unacceptable", "disrespect", "crew", "dirty"],
    "booking_payment_issue": ["credit card", "declined", "payment", "charged twice", "double charged", "billing error", "book ticket", "purchase error"],
    "other_unclear": ["thank you", "kudos", "great flight", "wings", "pilot", "weather", "hola", "avion"],
}

# Replies that only move the customer to a private channel.
BOILERPLATE_PATTERN = (
    r"(please\s+(dm|send\s+(us\s+)?a?\s*dm|direct\s+message)|dm\s+(us\s+)?your\s+(record\s+locator|confirmation|booking\s+reference)|send\s+us\s+a\s+direct\s+message|follow\s+and\s+dm|reach\s+out\s+via\s+dm)"
)

# Codes and patterns of the hard escalation rules, in order. The descriptions and the reply are free text.
HARD_RULES = [
    Rule(
        "hard_rule_legal_threat",
        r"\b(lawyer|attorney|sue\b|suing|lawsuit|legal\s+action|court|litigation|small\s+claims)\b",
        "Mentions lawyers, courts or a lawsuit",
    ),
    Rule(
        "hard_rule_dot_regulatory",
        r"\b(dot\s+complaint|department\s+of\s+transportation|faa\s+complaint|federal\s+aviation|regulatory\s+complaint)\b",
        "Complaint to an aviation authority",
    ),
    Rule(
        "hard_rule_safety_medical",
        r"\b(medical\s+emergency|heart\s+attack|stroke|paramedic|ambulance|passed\s+out|unconscious|bomb|weapon|gun|hijack|terrorist|assault\w*|police\s+involved|physical\s+violence|injured\b|injury|spilled\s+hot|burned\s+by|scalded|intentionally\s+hurt)\b",
        "Danger, injury or a medical case",
    ),
    Rule(
        "hard_rule_unaccompanied_minor",
        r"\b(unaccompanied\s+minor|umnr)\b|\b(child|minor|kid|daughter|son|[0-9]{1,2}\s*[- ]?year\s*[- ]?old)\b.{0,30}\b(traveling\s+alone|flying\s+alone|alone|by\s+(himself|herself|themselves)|without\s+(me|parent|adult|chaperone)|stranded)\b",
        "A minor on their own",
    ),
    Rule(
        "hard_rule_abusive_threat",
        r"\b(kill\s+yourself|go\s+die|burn\s+in\s+hell|punch\s+you|fuck\s+you\s+all)\b",
        "Abuse or a threat",
    ),
    Rule(
        "hard_rule_dollar_amount_demanded",
        r"(\$\s*[0-9]+|[0-9]+\s*(dollars|usd))\b",
        "Names a sum of money",
    ),
    Rule(
        "hard_rule_adversarial_prompt_injection",
        r"\b(ignore\s+(all\s+)?previous\s+instructions|disregard\s+(all\s+)?prior\s+instructions|system\s+prompt\s+override|developer\s+mode)\b",
        "Tries to override the instructions",
    ),
]
HARD_RULE_REPLY = "A member of our team has to look at this one and will get back to you."
REFUND_PATTERN = r"\b(refund|compensation|pay\s+me|reimburse)\b"

# Keyword baseline, in order.
CLASS_RULES = [
    Rule("flight_delay_cancellation", r"\b(delay|delayed|cancel|cancelled|cancellation|tarmac|late|stuck)\b"),
    Rule("baggage_issue", r"\b(bag|bags|baggage|luggage|suitcase|carousel)\b"),
    Rule("rebooking_change_request", r"\b(rebook|rebooked|change\s+flight|reschedule|switch\s+flight|standby)\b"),
    Rule("refund_compensation_request", r"\b(refund|money\s+back|reimbursement|compensation|voucher)\b"),
    Rule("aadvantage_miles_issue", r"\b(aadvantage|miles|frequent\s+flyer|loyalty|points)\b"),
    Rule("checkin_boarding_issue", r"\b(check\s*in|boarding|boarding\s+pass|gate|seat\s+assignment)\b"),
    Rule("booking_payment_issue", r"\b(credit\s+card|payment|charged|declined|double\s+charged)\b"),
    Rule("general_complaint_service_quality", r"\b(rude|horrible|terrible|worst\s+airline|attitude|disrespect)\b"),
]
ESCALATE_PATTERN = r"\b(lawyer|refund|compensation)\b"

# Label ladder of the evaluation set, in order (substrings).
LABEL_TERMS = [
    TermRule("legal_threat", ("lawyer", "attorney", "sue", "lawsuit", "court")),
    TermRule("regulatory_complaint", ("dot complaint", "faa complaint", "federal")),
    TermRule("medical_emergency", ("medical emergency", "ambulance", "paramedic", "heart attack")),
    TermRule("unaccompanied_minor", ("minor traveling alone", "unaccompanied minor", "child alone")),
    TermRule(
        "monetary_refund_agent_authorized",
        ("$", "dollar", "usd", "compensation", "refund"),
        "refund_compensation_request",
    ),
]

# Rows drawn per class for the evaluation set.
QUOTAS = {
    "flight_delay_cancellation": 22,
    "baggage_issue": 23,
    "rebooking_change_request": 20,
    "refund_compensation_request": 19,
    "aadvantage_miles_issue": 18,
    "checkin_boarding_issue": 18,
    "general_complaint_service_quality": 19,
    "booking_payment_issue": 18,
    "other_unclear": 19,
}

# Reply rubric.
GENERIC_REPLY = "Thanks for reaching out, please DM your confirmation number so we can help."
RUBRIC_MONEY_TERM = "dollar"
RUBRIC_CONTACT_TERMS = ["dm", "record locator", "confirmation"]
RUBRIC_EMPATHY_TERMS = ["sorry", "apologize", "understand", "glad", "happy to help"]
