"""Fixed values of workbook ingestion: header aliases, section and category markers."""

# --- fixed values: header wording of each field, in matching order --------------------------
HEADER_ALIASES = {
    "scheme_name": ("scheme", "scheme name", "service", "service name", "program", "programme"),
    "benefits": ("benefit", "benefits", "assistance", "support"),
    "eligibility": ("eligibility", "eligible", "eligibility criteria"),
    "deadline": ("deadline", "last date", "application deadline", "closing date"),
    "focus_sectors": ("sector", "sectors", "industry", "industries"),
    "funding_organisation": ("funding organisation", "funding organization", "organisation", "organization"),
    "scheme_type": ("scheme type",),
    "applicable_for": ("applicable for", "who can apply"),
    "portal_link": ("portal link", "application link", "apply link", "website", "url"),
    "flyer": ("flyer", "brochure"),
    "additional_info": ("additional info", "additional information", "reference"),
    "government_charge": ("government fee", "government fees", "govt fee", "govt fees"),
    "minimum_charge": ("minimum charge", "minimum charges", "consultancy fee", "our fee"),
    "vendor_cost": ("vendor cost", "vendor costs", "govt fees vendor cost"),
    "bdm_deduction": ("bdm deduction", "bdm deductions"),
    "commercial_remark": ("remark", "remarks"),
}
#: an alias of at least this length also matches inside a longer header
CONTAINED_ALIAS = 7
COMMERCIAL_FIELDS = ("vendor_cost", "bdm_deduction", "minimum_charge", "government_charge", "commercial_remark")
HEADER_LABELS = (
    "scheme",
    "scheme name",
    "service",
    "services",
    "service name",
    "program",
    "programme",
    "program name",
    "programme name",
    "title",
)

# --- fixed values: section markers, in matching order ----------------------------------------
SECTION_MARKERS = (
    ("ELIGIBILITY", ("eligibility", "eligible", "minimum requirement", "who can apply")),
    ("DOCUMENTS", ("documents required", "required documents", "checklist")),
    ("PROCESS", ("how to", "process", "steps to", "procedure", "incorporate")),
    ("BENEFITS", ("benefit", "advantages")),
    ("FUNDING", ("funding", "fund scheme", "financial assistance")),
    ("TIMELINE", ("timeline", "working days", "processing time")),
    ("SCOPE", ("scope of work", "descriptive scope")),
    ("COMMERCIAL", ("commercial", "amount to be charge", "charges", "consultancy fee")),
    ("NOTES", ("please note", "note:")),
)
PLAIN_HEADINGS = ("benefits", "commercials", "timeline")

# --- fixed values: category, kind and markers, in matching order -----------------------------
CATEGORY_MARKERS = (
    ("startup-and-msme-recognition", "REGISTRATION", ("startup india", "dpiit recognition", "start-up india")),
    (
        "company-incorporation",
        "REGISTRATION",
        ("private limited", "pvt ltd", "llp incorporation", "llp registration", "company incorporation", "opc"),
    ),
    ("gst-and-tax-compliance", "COMPLIANCE", ("gst", "income tax", "80-iac", "80iac", "tax exemption")),
    ("government-grants", "GRANT", ("grant",)),
    ("credit-and-guarantee-schemes", "GOVT_SCHEME", ("credit guarantee", "loan scheme")),
    ("funding-programs", "GOVT_SCHEME", ("seed fund", "funding program", "funding programme")),
    ("equity-funding", "EQUITY", ("equity", "venture fund", "vc fund", "angel fund")),
    ("debt-funding", "DEBT", ("debt funding",)),
    ("licenses", "REGISTRATION", ("license", "licence")),
    ("certifications", "CERTIFICATION", ("certificate", "certification", "iso", "zed", "nsic")),
    ("trademark-and-intellectual-property", "LEGAL", ("trademark", "patent", "ipr")),
    ("website-development", "DIGITAL", ("website", "web development")),
    ("digital-marketing", "DIGITAL", ("digital marketing",)),
    ("seo", "DIGITAL", ("seo", "search engine optimization")),
    ("social-media", "DIGITAL", ("social media",)),
)
FALLBACK_CATEGORY = "other-business-services"
MARKED_CONFIDENCE, FALLBACK_CONFIDENCE = 0.85, 0.35

# --- fixed values: sheet kind signals ----------------------------------------------------------
COMMUNICATION_SIGNALS = ("subject", "dear ", "regards", "thank you", "email", "mail", "attached")
KNOWLEDGE_SIGNALS = (
    "eligibility",
    "eligibility criteria",
    "documents required",
    "required documents",
    "scope of work",
    "benefits",
    "objectives",
    "timeline",
    "how to",
    "minimum requirements",
    "financial assistance",
    "incorporation",
    "registration process",
)

# --- fixed values: content markers, two points each ---------------------------------------------
FINANCIAL_MARKERS = (
    "₹",
    "inr",
    "rs.",
    "rs ",
    "lakh",
    "crore",
    "grant",
    "grant-in-aid",
    "subsidy",
    "equity",
    "revenue share",
    "financial support",
    "funding support",
    "support up to",
)
ELIGIBILITY_MARKERS = (
    "eligible",
    "eligibility",
    "applicant",
    "registered",
    "incorporated",
    "pvt",
    "private limited",
    "llp",
    "partnership",
    "proprietorship",
    "individual",
    "citizen",
    "must have",
    "should not",
    "should be",
    "company should",
    "startup should",
    "start up should",
    "years in existence",
    "program is open",
    "programme is open",
    "for profit",
    "non profit",
    "nonprofit",
    "fcra",
    "license",
    "licence",
    "compulsory",
)
SECTOR_MARKERS = (
    "agriculture",
    "agritech",
    "agri tech",
    "healthcare",
    "health tech",
    "medtech",
    "manufacturing",
    "energy",
    "iot",
    "cleantech",
    "clean tech",
    "fintech",
    "edtech",
    "ed tech",
    "saas",
    "education",
    "environment",
    "livelihood",
    "dairy",
    "food tech",
    "food technology",
    "electronics",
    "electrical",
    "mechanical",
    "toys",
    "technology",
    "social impact",
    "transportation",
    "infrastructure",
    "ev",
    "deep tech",
    "green energy",
)

# --- fixed values: titles inside narrative sheets ------------------------------------------------
TITLE_MARKERS = (
    "registration",
    "scheme",
    "startup",
    "start up",
    "seed fund",
    "tax exemption",
    "80 iac",
    "80iac",
    "certificate",
    "certification",
    "incorporation",
    "licence",
    "license",
    "loan",
    "grant",
    "subsidy",
    "funding",
)
NOT_TITLES = ("dear all", "please note", "benefits", "eligibility", "documents required", "scope of work", "commercials")
TITLE_EDGE = r"^[ :\-•▪◼️]+|[ :\-•▪◼️]+$"
