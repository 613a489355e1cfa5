"""Words and weights that results depend on. Lists are in natural order."""

from __future__ import annotations

# Words of field names by meaning, in Latin letters (Cyrillic names are transliterated first).
# Where a word stands under two meanings, the later one counts.
SYNONYMS: dict[str, list[str]] = {
    "date": ["date", "day", "data"],
    "created": ["create", "created", "creation", "sozdan", "sozdaniya"],
    "updated": ["update", "updated", "lastupdate", "obnovlen", "obnovleniya", "last", "poslednego", "posledniy", "poslednyaya"],
    "id": ["id", "identifier", "code", "identyfikator", "nomer", "kod", "identifikator"],
    "amount": ["amount", "sum", "total", "summa", "itogo"],
    "revenue": ["revenue", "income", "vyruchka", "dohod", "vyruchki", "vyruchke"],
    "name": ["name", "title", "fullname", "nazvanie", "imya", "fio"],
    "description": ["description", "descr", "details", "comment", "opisanie", "kommentariy", "naimenovanie"],
    "product": ["product", "item", "sku", "tovar", "produkt", "produktov"],
    "quantity": ["quantity", "qty", "count", "kolichestvo"],
    "organization": ["organization", "org", "company", "organizaciya", "kompaniya", "organizatsiya"],
    "creator": ["creator", "author", "owner", "sozdatel", "avtor", "sozdal"],
    "responsible": ["responsible", "manager", "owner", "assignee", "menedzher", "otvetstvennyy", "person"],
    "deal": ["deal", "opportunity", "sdelka"],
    "source": ["source", "origin", "channel", "istochnik", "kanal", "kanalprodazh"],
    "partner": ["partner", "vendor", "supplier", "postavshik", "vendorname"],
    "license": ["license", "licence", "licenziya", "subscription", "litsenziy"],
    "gross": ["gross", "vatincluded", "grossamount"],
    "net": ["net", "without", "vatexcluded", "netamount"],
    "customer": ["customer", "client", "buyer", "klient", "klienta", "zakazchik", "zakazchika"],
    "boolean": ["boolean", "bool", "flag", "yes", "no", "lid"],
    "unit": ["unit", "measure", "uom", "edinitsa", "izmereniya"],
    "plan": ["plan", "planned", "planovaya", "planovyy", "planovoe", "planovuyu"],
    "act": ["act", "acts", "akt", "akta", "aktu"],
    "reason": ["reason", "cause", "prichina", "prichine"],
    "close": ["close", "closed", "closing", "zakryt", "zakryta", "zakrytiya"],
    "stage": ["stage", "stadiya", "stadiyu"],
    "transition": ["transition", "perehod", "perehoda"],
    "time": ["time", "vremya"],
    "delivery": ["delivery", "postavka", "postavki"],
    "direct": ["direct", "pryamaya", "pryamoy"],
    "distributor": ["distributor", "distribyutor"],
    "service": ["service", "uslug", "uslugi"],
    "final": ["final", "itogovaya", "itogovyy", "itogovoe"],
    "forecast": ["forecast", "prognoz"],
    "marketing": ["marketing", "marketingovoe"],
    "event": ["event", "meropriyatie"],
    "site": ["site", "sayta", "sayt"],
    "lead": ["lead", "lid"],
    "supply": ["supply", "postavka"],
    "type": ["type", "tip"],
    "vat": ["vat", "nds"],
}
CANONICAL: dict[str, str] = {word: meaning for meaning, words in SYNONYMS.items() for word in [*words, meaning]}

# Words that carry no meaning in a field name.
STOPWORDS = ["of", "by", "with", "na", "po", "s", "param", "input", "items", "rows", "data"]

# Transliteration.
LATIN: dict[str, str] = {
    "а": "a",
    "б": "b",
    "в": "v",
    "г": "g",
    "д": "d",
    "е": "e",
    "ё": "e",
    "ж": "zh",
    "з": "z",
    "и": "i",
    "й": "y",
    "к": "k",
    "л": "l",
    "м": "m",
    "н": "n",
    "о": "o",
    "п": "p",
    "р": "r",
    "с": "s",
    "т": "t",
    "у": "u",
    "ф": "f",
    "х": "h",
    "ц": "ts",
    "ч": "ch",
    "ш": "sh",
    "щ": "sch",
    "ъ": "",
    "ы": "y",
    "ь": "",
    "э": "e",
    "ю": "yu",
    "я": "ya",
}
CYRILLIC_MANY = {letter: latin for letter, latin in LATIN.items() if len(latin) > 1}
CYRILLIC_ONE = ("".join(letter for letter, latin in LATIN.items() if len(latin) == 1), "".join(latin for latin in LATIN.values() if len(latin) == 1))
CYRILLIC_NONE = "".join(letter for letter, latin in LATIN.items() if not latin)

# The role of a meaning.
ROLES = {
    "id": "identifier",
    "name": "label",
    "description": "description",
    "date": "timestamp",
    "created": "timestamp",
    "updated": "timestamp",
    "amount": "numeric_value",
    "revenue": "numeric_value",
    "quantity": "numeric_value",
    "boolean": "flag",
    "unit": "unit",
}
# Meanings that name a kind of thing, not an entity of their own.
ENTITY_STOPWORDS = ["deal", "customer", "organization", "product", "creator", "responsible", "source", "partner", "license"]

# Meanings that count as domain tags.
DOMAIN_TAGS = ["deal", "customer", "organization", "product", "revenue", "amount", "quantity", "name", "description", "creator", "responsible", "source", "partner", "license", "gross", "net", "id", "date", "created", "updated", "unit"]
# Meanings that carry a match by pattern.
PATTERN_WORDS = [*DOMAIN_TAGS, "plan", "act", "reason", "close", "stage", "transition", "time", "delivery", "direct", "distributor", "service", "final", "forecast", "marketing", "event", "site", "lead", "supply", "type", "vat"]
# Meanings compared as domains when a candidate is scored, and those whose agreement aligns two names.
SCORED_DOMAINS = ["deal", "customer", "organization", "product", "revenue", "amount", "quantity", "name", "description", "creator", "responsible", "id", "date", "created", "updated"]
ALIGNED = ["deal", "customer", "date", "id", "amount", "revenue", "name", "description", "product", "quantity"]

# Pairs of meanings that contradict each other, for scoring a candidate.
CONFLICTS: list[tuple[str, str, float]] = [
    ("created", "updated", 1.0),
    ("id", "date", 0.95),
    ("amount", "revenue", 0.72),
    ("name", "description", 0.65),
    ("customer", "organization", 0.7),
    ("organization", "partner", 0.62),
    ("customer", "product", 0.8),
    ("organization", "product", 0.75),
    ("creator", "responsible", 0.55),
    ("creator", "source", 0.78),
    ("license", "product", 0.66),
    ("gross", "net", 0.92),
    ("quantity", "amount", 0.4),
]
# Pairs whose one side in the source and other side in the target make a pattern unstable.
PATTERN_CONFLICTS: list[tuple[str, str, float]] = [
    ("created", "updated", 1.0),
    ("id", "date", 0.95),
    ("amount", "revenue", 0.72),
    ("name", "description", 0.65),
    ("organization", "customer", 0.7),
    ("organization", "partner", 0.62),
    ("creator", "responsible", 0.55),
    ("gross", "net", 0.92),
]
# Tokens that mark a label as sensitive.
SENSITIVE = ["client", "customer", "project", "internal", "account", "email", "phone", "url"]

# Thresholds of promotion to a shared pattern.
MIN_SUPPORT, MIN_USERS, MIN_STABILITY = 3, 2, 0.75
MAX_DRIFT, MIN_ACCEPTANCE, MAX_CONFLICT = 0.25, 0.8, 0.15
MAX_SENSITIVITY, MIN_GENERALITY, MIN_CONFIDENCE = 0.6, 0.5, 0.55

# Words for truth in a transform, in inference and in sample typing.
TRUE_WORDS = ["1", "true", "yes", "да"]
INFERRED_TRUE, INFERRED_FALSE = ["true", "1", "yes", "y", "да"], ["false", "0", "no", "n", "нет"]
SAMPLE_BOOLEANS = ["true", "false", "да", "нет", "yes", "no"]

# Words told apart although they share a meaning.
IDENTIFIER_WORDS = ["identifier", "identifikator", "identyfikator"]
COMMENT_WORDS = ["comment", "kommentariy"]
REASON_WORDS = ["reason", "prichina", "prichine"]
DESCRIPTION_WORDS = ["opisanie", "description", "descr", "comment", "kommentariy"]

# Rules for targets whose words matter, in order. Each has a reason, a band, and what target and source must hold: words (as
# written) or meanings, all or any of them, or none. "deal": where the target means a deal the source must, too.
ALIAS_RULES: list[dict] = [
    {"reason": "alias_sensitive_identifier", "band": "high", "target_words": ["identifier"], "source_any": IDENTIFIER_WORDS, "deal": True},
    {"reason": "alias_sensitive_id", "band": "high", "target_words": ["id"], "target_without": ["identifier"], "source_any": ["id"], "source_without": IDENTIFIER_WORDS, "deal": True},
    {"reason": "alias_sensitive_name", "band": "high", "target_means": ["name"], "source_any": ["naimenovanie"]},
    {"reason": "alias_sensitive_name", "band": "high", "target_means": ["name"], "source_means": ["name"], "source_not": ["description"], "same": True},
    {"reason": "alias_sensitive_description", "band": "high", "target_means": ["description"], "source_any": DESCRIPTION_WORDS},
    {"reason": "alias_sensitive_description_fallback", "band": "medium", "target_means": ["description"], "source_any": ["naimenovanie"]},
    {"reason": "alias_sensitive_description_fallback", "band": "medium", "target_means": ["description"], "source_means": ["description"], "same": True},
    {"reason": "alias_sensitive_invoice_vat", "band": "high", "target_words": ["invoice", "amount", "vat"], "source_means": ["amount", "act", "vat"]},
    {"reason": "alias_sensitive_invoice", "band": "high", "target_words": ["invoice", "amount"], "target_without": ["vat"], "source_means": ["amount", "act"], "source_not": ["vat"]},
    {"reason": "alias_sensitive_final_service_revenue_vat", "band": "high", "target_means": ["final", "service", "amount", "revenue", "vat"], "source_means": ["deal", "final", "service", "amount", "revenue", "vat"]},
    {"reason": "alias_sensitive_final_service_vat", "band": "high", "target_means": ["final", "service", "amount", "vat"], "target_not": ["revenue"], "source_means": ["deal", "final", "service", "amount", "vat"], "source_not": ["revenue"]},
    {"reason": "alias_sensitive_final_service", "band": "high", "target_means": ["final", "service", "amount"], "target_not": ["vat", "revenue"], "source_means": ["deal", "final", "service", "amount"], "source_not": ["vat", "revenue"]},
    {"reason": "alias_sensitive_site_lead", "band": "high", "target_means": ["site", "lead"], "source_means": ["deal", "site", "lead"]},
    {"reason": "alias_sensitive_direct_supply", "band": "high", "target_means": ["direct", "supply"], "source_means": ["deal", "direct", "supply"]},
    {"reason": "alias_sensitive_stage_final", "band": "medium", "target_means": ["deal", "stage", "final"], "source_means": ["deal", "stage"]},
    {"reason": "alias_sensitive_reason_comment", "band": "high", "target_words": ["comment", "reason"], "source_any": COMMENT_WORDS, "source_any_too": REASON_WORDS},
    {"reason": "alias_sensitive_reason", "band": "high", "target_words": ["reason"], "target_without": ["comment"], "source_any": REASON_WORDS, "source_without": COMMENT_WORDS},
]
