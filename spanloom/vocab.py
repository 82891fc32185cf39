"""Fixed vocabularies and parameters."""

from __future__ import annotations

# The label taxonomy, in id order after NONE = 0.
LABELS = ["PERSON", "ORG", "ADDRESS", "EMAIL", "PHONE", "USERNAME", "PASSWORD", "IP_ADDRESS", "IBAN", "CREDIT_CARD", "ID_NUMBER", "ACCOUNT_NUMBER", "OTHER"]
TRAINING_LABELS = ["NONE", *LABELS]

# Other names of labels.
ALIASES = {
    "PHONE_NUMBER": "PHONE",
    "TELEPHONE": "PHONE",
    "ORGANIZATION": "ORG",
    "IP": "IP_ADDRESS",
    "IPADDRESS": "IP_ADDRESS",
    "DATE_TIME": "OTHER",
    "LOCATION": "OTHER",
    "CITY": "OTHER",
    "COUNTRY": "OTHER",
    "STATE": "OTHER",
    "ZIPCODE": "ADDRESS",
    "ZIP_CODE": "ADDRESS",
    "POSTAL_CODE": "ADDRESS",
    "FIRST_NAME": "PERSON",
    "LAST_NAME": "PERSON",
    "NAME": "PERSON",
}

# What a category says about sensitivity.
SENSITIVITY = {"REAL_PII": "REDACT", "PII_LOOKALIKE": "KEEP"}

# Patterns of the labels that text alone can show, in a dialect that Java and RE2 share.
PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "PHONE": r"\+?\d[\d\-\s().]{6,}\d",
    "IP_ADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "IBAN": r"\b[A-Z]{2}\d{2}[A-Z0-9 ]{10,34}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]*?){13,19}\b",
}
#: What every match of a pattern holds: texts without it aren't searched.
NEEDED = {"EMAIL": "@", "PHONE": r"\d[\d\-\s().]{6}", "IP_ADDRESS": r"\d\.\d", "IBAN": r"[A-Z]{2}\d{2}", "CREDIT_CARD": r"\d"}
WHOLE_EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
WHOLE_IP = r"^(?:\d{1,3}\.){3}\d{1,3}$"

#: Scores of pattern matches, our own: which label wins where matches overlap.
PATTERN_SCORES = {"EMAIL": 0.95, "IP_ADDRESS": 0.90, "IBAN": 0.85, "CREDIT_CARD": 0.80, "PHONE": 0.60}

#: White space as Python's str.isspace has it.
SPACE = r"[\t-\r\x1c-\x1f \x85\p{Z}]"
#: A token: a run of letters, digits and underscores, or another visible character.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"

# Bounds of an annotated example.
ITEMS = (10, 40)
LEAST = {"NON_PII": 3, "PII_LOOKALIKE": 1, "REAL_PII": 2}
RATIOS = {"NON_PII": (0.20, 0.70), "PII_LOOKALIKE": (0.10, 0.40), "REAL_PII": (0.10, 0.50)}

# US dollars for a million tokens of input, cached input (None: as input) and output.
PRICES = {
    "gpt-5.2": (1.75, 0.175, 14.00),
    "gpt-5.1": (1.25, 0.125, 10.00),
    "gpt-5": (1.25, 0.125, 10.00),
    "gpt-5-mini": (0.25, 0.025, 2.00),
    "gpt-5-nano": (0.05, 0.005, 0.40),
    "gpt-5.3-chat-latest": (1.75, 0.175, 14.00),
    "gpt-5.2-chat-latest": (1.75, 0.175, 14.00),
    "gpt-5.1-chat-latest": (1.25, 0.125, 10.00),
    "gpt-5-chat-latest": (1.25, 0.125, 10.00),
    "gpt-5.3-codex": (1.75, 0.175, 14.00),
    "gpt-5.2-codex": (1.75, 0.175, 14.00),
    "gpt-5.1-codex-max": (1.25, 0.125, 10.00),
    "gpt-5.1-codex": (1.25, 0.125, 10.00),
    "gpt-5-codex": (1.25, 0.125, 10.00),
    "gpt-5.2-pro": (21.00, None, 168.00),
    "gpt-5-pro": (15.00, None, 120.00),
    "gpt-4.1": (2.00, 0.50, 8.00),
    "gpt-4.1-mini": (0.40, 0.10, 1.60),
    "gpt-4.1-nano": (0.10, 0.025, 0.40),
    "gpt-4o": (2.50, 1.25, 10.00),
    "gpt-4o-2024-05-13": (5.00, None, 15.00),
    "gpt-4o-mini": (0.15, 0.075, 0.60),
    "gpt-realtime": (4.00, 0.40, 16.00),
    "gpt-realtime-1.5": (4.00, 0.40, 16.00),
    "gpt-realtime-mini": (0.60, 0.06, 2.40),
    "gpt-4o-realtime-preview": (5.00, 2.50, 20.00),
    "gpt-4o-mini-realtime-preview": (0.60, 0.30, 2.40),
}
# Models with other prices above a number of input tokens.
TIER_TOKENS = 272_000
TIERED_PRICES = {"gpt-5.4": ((2.50, 0.25, 15.00), (5.00, 0.50, 22.50)), "gpt-5.4-pro": ((30.00, None, 180.00), (60.00, None, 270.00))}
DEFAULT_MODEL = "gpt-5-mini"
