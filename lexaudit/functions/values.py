"""Fixed values of the audit vocabulary and formats."""

# Document types, first match wins, matched in any case anywhere in the text.
DOCUMENT_TYPES = (
    ("privacy policy", "privacy_policy"),
    ("terms (of use|of service)", "terms_of_service"),
    ("agreement", "agreement"),
    ("proposal", "proposal"),
    ("contract", "contract"),
    ("report", "report"),
    ("policy", "policy"),
)

# Words of the two metadata lists.
DATA_MENTIONS = ("personal data", "information", "data", "email", "address", "name", "phone", "user", "customer", "profile", "account", "location", "tracking")
COMPLIANCE_WORDS = ("consent", "opt-in", "opt-out", "privacy", "compliance", "regulation", "rights", "retain", "delete", "access", "security", "cookie")

# The eight content indicators.
CONTENT_INDICATORS = {
    "has_personal_data": ("personal data", "email", "name", "address", "phone", "profile"),
    "has_data_collection": ("collect", "gather", "obtain", "capture", "record"),
    "has_data_sharing": ("share", "transfer", "disclose", "send", "provide", "third party"),
    "has_retention": ("retain", "store", "keep", "save", "archive", "delete", "period"),
    "has_consent": ("consent", "agree", "accept", "approve", "opt-in", "opt-out"),
    "has_rights": ("right", "access", "rectification", "erasure", "restriction", "portability", "object"),
    "has_automated": ("automated", "automatic", "algorithm", "profiling", "AI", "machine learning"),
    "has_sensitive": ("sensitive", "genetic", "biometric", "health", "race", "political", "religion", "union", "orientation"),
}

# Term lists used when a framework has none of its own.
DEFAULT_DATA_TERMS = ("data", "information", "record", "file", "database", "collect", "store", "process", "retain", "share", "user", "customer", "individual", "person", "entity", "tracking", "monitoring", "surveillance")
DEFAULT_REGULATORY_TERMS = ("compliance", "regulation", "legal", "lawful", "authorize", "rights", "responsibilities", "obligations", "requirements", "security", "protection", "safeguard", "confidential", "notice", "notification", "transparency", "disclosure", "access", "control", "restrict", "limit", "prohibit", "consent", "approval", "authorization", "permit")

# Concepts tagged in regulation articles.
CONCEPTS = (
    "data", "information", "record", "database", "file",
    "right", "obligation", "responsibility", "duty", "requirement",
    "process", "collect", "store", "transfer", "share", "disclose",
    "access", "control", "manage", "restrict", "limit",
    "security", "protect", "safeguard", "secure", "confidential",
    "compliance", "legal", "lawful", "authorize", "permit",
    "notice", "notification", "inform", "transparency",
    "individual", "person", "entity", "organization", "controller",
    "period", "duration", "retention", "storage", "delete",
    "consent", "agree", "approve",
)

# Words that deduplication ignores.
STOPWORDS = ("the", "a", "an", "is", "are", "will", "shall", "should", "may", "might", "can", "could", "this", "that", "these", "those", "with", "from", "have", "does", "would", "about", "which")

# Phrases that mark a citation as regulation text.
REGULATION_PHRASES = ("the controller shall", "data subject", "personal data shall", "where personal data", "the data subject shall", "processing shall be", "article", "paragraph", "regulation")

# Kinds of references to a regulation.
REFERENCE_KINDS = ("Article", "Section", "Rule", "Standard", "Requirement", "Regulation", "Part", "Chapter")
REFERENCE_NUMBER = r"\d+(?:\.\d+)?(?:\(\d+\))?(?:\([a-z]\))?"

# Section headers (numbered; capitals; title with a colon), with the line ends they take.
HEADER = r"(^|\n)(?:(\d+(?:\.\d+)*\.\s+[^\n]+)|([A-Z][A-Z\s]{2,}[A-Z])|([A-Z][a-zA-Z\s]+:))(\n|$)"

# First lines of regulation articles.
ARTICLE_STARTS = (
    r"(Article|Section|Rule|Standard|Requirement|Principle|Regulation|Part|Chapter)\s+\S+",
    r"\d+\.\s*[A-Z]",
    r"[A-Z][A-Z\s]+[A-Z]$",
    r"\d+\.\d+\s+",
)

# Chunk size and overlap by document bytes, thresholds of the router, and limits.
CHUNK_TIERS = ((10_000, 10_000, 0), (50_000, 5_000, 500), (200_000, 2_500, 250))
DEFAULT_CHUNK_SIZE, DEFAULT_CHUNK_OVERLAP = 500, 100
SHORT_CHUNK, LONG_CHUNK, MIN_SCORE = 100, 1_500, 3
CONTEXT_CHARS, DEDUP_CHARS, PREVIEW_CHARS = 50, 40, 100
TOP_REGULATIONS, TOP_VIOLATIONS, RETRIEVED, RETRIEVED_BATCH = 5, 5, 5, 3

# Texts of findings and reports.
UNKNOWN_REGULATION, UNKNOWN_ARTICLE, NO_QUOTE = "Unknown Regulation", "Unknown Article", "No specific quote provided."
DEFAULT_CONFIDENCE = "Medium"

# The model catalogue (key, name, batch size, context window, temperature, description).
MODELS = (
    ("small", "llama3:8b", 4, 4096, 0.1, "Fast model suitable for most analyses"),
    ("medium", "llama3:70b-instruct-q4_0", 2, 8192, 0.1, "Balanced model with improved accuracy"),
    ("large", "llama3:70b-instruct", 1, 8192, 0.1, "High-accuracy model (requires 32GB+ RAM)"),
)
DEFAULT_MODEL = "small"
FRAMEWORK_FILES = ("articles.txt", "common_patterns.txt", "context.txt", "handler.py", "prompts.json")

# The fields of answers in JSON.
JSON_ISSUES, JSON_TAGS, JSON_FIELDS = "issues", "topic_tags", ("issue", "regulation", "confidence", "explanation", "citation")
CONTRADICTION_FIELDS, CONTRADICTION = ("issue", "section", "confidence", "explanation", "finding_type"), "contradiction"
CONFIDENCES = ("High", "Medium", "Low")

#: Words by which a statement denies something.
DENIALS = ("no", "not", "never", "none", "nobody", "nothing", "without", "cannot", "lacks", "missing", "fails")

#: Noncharacters that mark places in texts; in a text itself they become the replacement character.
MARKS, UNMARKED = "\ufdd0\ufdd1", "\ufffd\ufffd"

# The headings of a judge's answers, what it writes when there is nothing, how an item that has no reason is dismissed, and the fields of an item.
ANSWER_KINDS = {"issue": ("ISSUES", "compliance issues", "no issues", "This violates"), "point": ("POINTS", "compliance points", "no points", "This supports")}
ANSWER_BLOCK = r"(?Uis)COMPLIANCE\s+@HEADING:?\s*\n(.*?)@END"
ANSWER_NOTHING = "NO COMPLIANCE @HEADING DETECTED"
ANSWER_FIELDS = r"(?is)@NAME\s*\d+:\s*(.+?)\s*\nArticle:\s*(.+?)\s*\nConfidence:\s*(High|Medium|Low)\s*\nExplanation:\s*(.+?)\s*\n(?:Citation:\s*(?:\"(.+?)\"|(.+?)))?(?:\n\n|\n@NAME|\z)"

# Labels of the blocks of a request.
VIOLATIONS_TITLE, PATTERNS_LINE = "PRE-SCAN DETECTED POTENTIAL VIOLATIONS:\n", "VIOLATION PATTERNS: %d patterns available"
VIOLATION_LINES = ("%d. Potential '%s' pattern detected\n", "   Description: %s\n", "   Indicator: '%s'\n   Context: \"...%s...\"\n", "   Related articles: %s\n")
REGULATION_LABELS = (" CONTEXT:\n", "\nRELATED CONCEPTS: ")
