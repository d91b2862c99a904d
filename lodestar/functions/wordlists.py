"""Word lists, labels and patterns that results depend on."""

# --- fixed values: sector terms --------------------------------------------------------
SECTOR_STOPWORDS = frozenset((
    "scheme", "schemes", "service", "services", "sector", "related", "for", "the", "and", "business", "company",
    "client",
))
SECTOR_WILDCARDS = ("all", "all india", "all industries", "all sectors", "any", "any industry")

# --- fixed values: keyword matching -----------------------------------------------------
MATCH_STOPWORDS = frozenset((
    "related", "relating", "for", "the", "a", "an", "to", "of", "and", "or", "client", "company", "business",
    "scheme", "schemes", "service", "services", "looking", "need", "needs",
))
STATE_WILDCARDS = ("all india", "pan india", "all states", "any state", "india", "nationwide")
GENERIC_WILDCARDS = (
    "all",
    "any",
    "all businesses",
    "all business types",
    "all stages",
    "all sectors",
    "all industries",
    "all founders",
    "all categories",
)

# --- fixed values: typeahead aliases ----------------------------------------------------
TYPEAHEAD_PHRASE_ALIASES = (
    ("artificial intelligence", "ai"),
    ("internet of things", "iot"),
    ("fin tech", "fintech"),
    ("financial technology", "fintech"),
    ("women led", "woman led"),
    ("female led", "woman led"),
    ("female entrepreneur", "woman entrepreneur"),
    ("female entrepreneurs", "woman entrepreneur"),
)
TYPEAHEAD_WORD_ALIASES = {
    "women": "woman",
    "womens": "woman",
    "female": "woman",
    "mahila": "woman",
    "mahilaon": "woman",
    "females": "woman",
    "entrepreneurs": "entrepreneur",
    "startups": "startup",
    "schemes": "scheme",
    "grants": "grant",
    "loans": "loan",
    "founders": "founder",
    "companies": "company",
    "businesses": "business",
    "industries": "industry",
    "technologies": "technology",
    "agricultural": "agriculture",
}

# --- fixed values: catalogue enums and labels ---------------------------------------------
VISIBLE_STATUSES = ("APPROVED", "PUBLISHED", "EXPIRING")
PUBLIC_STATUSES = ("APPROVED", "PUBLISHED")
ADMIN_STATUSES = ("DRAFT", "UNDER_REVIEW", "APPROVED", "PUBLISHED", "EXPIRING")
ADMIN_ROLES = ("SUPER_ADMIN", "ADMIN", "IT_ADMIN", "DATA_ADMIN", "SECURITY_ADMIN")
KIND_LABELS = {
    "REGISTRATION": "Registration",
    "COMPLIANCE": "Compliance",
    "CERTIFICATION": "Certification",
    "GOVT_SCHEME": "Government Scheme",
    "GRANT": "Grant",
    "LOAN": "Loan",
    "DEBT": "Debt Funding",
    "EQUITY": "Equity Funding",
    "VC": "VC Funding",
    "SUBSIDY": "Subsidy",
    "LEGAL": "Legal Service",
    "DIGITAL": "Digital Service",
    "CONSULTING": "Consulting",
    "OTHER": "Other",
}
DEADLINE_LABELS = {
    "UNKNOWN": "Unknown",
    "DATED": "Specific Date",
    "ROLLING": "Rolling",
    "ONGOING": "Ongoing",
    "OPEN": "Open",
    "CLOSED": "Closed",
    "NO_DEADLINE": "No Deadline",
    "OTHER": "Other",
}
PRIORITY_RANK = {"CRITICAL": 4, "HIGH": 3, "NORMAL": 2, "LOW": 1}
SOURCE_PRIORITY = {"APPLICATION": 0, "OFFICIAL_PORTAL": 1, "REFERENCE": 2, "FLYER": 3, "OTHER": 4}
SOURCE_LABELS = {
    "APPLICATION": "Apply / Open Portal",
    "OFFICIAL_PORTAL": "Official Scheme Page",
    "REFERENCE": "Reference",
    "FLYER": "Guidelines / Flyer",
    "OTHER": "External Link",
}

# --- fixed values: activity groups ---------------------------------------------------------
ACTION_GROUPS = {
    "SERVICE_VIEW": "views",
    "SERVICE_SAVE": "saved",
    "SERVICE_UNSAVE": "saved",
    "COLLECTION_CREATE": "saved",
    "COLLECTION_RENAME": "saved",
    "COLLECTION_DELETE": "saved",
    "COLLECTION_ADD_SERVICE": "saved",
    "COLLECTION_REMOVE_SERVICE": "saved",
    "SERVICE_FLYER_PREVIEW": "flyer",
    "SERVICE_FLYER_DOWNLOAD": "flyer",
    "EXTERNAL_LINK_OPEN": "external",
    "LOGIN": "sessions",
    "LOGOUT": "sessions",
}
EVENT_GROUPS = {"SEARCH": "search", "CLIENT_MATCH": "client", "FILTER": "filters"}
OVERVIEW_GROUPS = {
    "search": "discover",
    "filters": "discover",
    "views": "research",
    "flyer": "research",
    "external": "research",
    "client": "client",
    "saved": "saved",
    "sessions": "system",
    "other": "system",
}
FEATURE_LABELS = {
    "SEARCH": "Toolkit Search",
    "FILTER": "Toolkit Filters",
    "CLIENT_MATCH": "Client Matcher",
    "SUGGESTION_CLICK": "Search Suggestions",
}
SECURITY_ACTIONS = ("LOGIN_FAILED", "LOGIN_BLOCKED", "PERMISSION_DENIED")

# --- fixed values: key typing of imported knowledge ------------------------------------------
BLOCKED_KEY_PARTS = (
    "vendor",
    "bdm",
    "deduction",
    "internal",
    "escalation",
    "commercial",
    "commission",
    "margin",
    "employee",
    "password",
)
#: in matching order
KEY_SECTION_MARKERS = (
    ("DOCUMENTS", ("document", "documents", "required documents", "documentation", "checklist")),
    ("ELIGIBILITY", ("eligibility", "eligible", "eligibility criteria", "who can apply", "applicant eligibility", "criteria")),
    ("PROCESS", ("process", "procedure", "steps", "how to apply", "application process", "application procedure")),
    ("TIMELINE", ("timeline", "deadline", "last date", "closing date", "application date", "duration", "tenure")),
    ("FUNDING", ("funding", "finance", "financial assistance", "loan amount", "grant amount", "subsidy", "fund")),
    ("BENEFITS", ("benefit", "benefits", "advantage", "assistance", "support offered")),
    ("SCOPE", ("scope", "applicable", "applicable for", "sector", "industry", "industries")),
    ("OVERVIEW", ("overview", "description", "about", "scheme details", "details")),
    ("NOTES", ("note", "notes", "important", "remark", "remarks")),
)
DISQUALIFIER_MARKERS = ("not eligible", "ineligible", "cannot apply", "shall not", "not allowed")
REQUIRED_MARKERS = (
    "must ",
    "required",
    "shall ",
    "has to ",
    "need to ",
    "needs to ",
    "at least ",
    "not more than ",
    "minimum ",
    "maximum ",
    "only eligible",
)
MANDATORY_DOCUMENT_MARKERS = (
    "required document",
    "documents required",
    "mandatory document",
    "documents mandatory",
    "must submit",
    "shall submit",
    "required to submit",
    "documents needed",
)
TURNOVER_UNITS = {"RUPEES": 1, "LAKH": 100_000, "CRORE": 10_000_000}
