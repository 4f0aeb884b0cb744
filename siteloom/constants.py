"""Fixed values. Results depend on every entry, so they are stated plainly here
and used nowhere else by copy; order matters where a comment says so."""

# --- page texts ---------------------------------------------------------------
THIN_TEXT_CHARS = 200
EMPTY_SHELL_CHARS = 60
SPA_ROOT_IDS = ["root", "app", "__next", "__nuxt", "gatsby-focus-wrapper"]

# --- URLs ---------------------------------------------------------------------
NON_HTML_EXTENSIONS = [
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico",
    ".zip", ".rar", ".7z", ".tar", ".gz",
    ".mp4", ".mp3", ".avi", ".mov", ".wav",
    ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".css", ".js", ".json", ".xml", ".rss", ".woff", ".woff2", ".ttf", ".eot",
]
SKIP_PATH_KEYWORDS = [
    "login", "signin", "sign-in", "signup", "sign-up", "register",
    "cart", "checkout", "wishlist", "account", "logout",
    "search", "print", "share", "feed", "wp-json", "wp-admin",
    "tag/", "tags/", "category/", "author/", "page/",
    "privacy", "terms", "cookie", "cookies", "sitemap",
]
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "gclid", "fbclid", "msclkid", "ref", "source", "sessionid", "sid",
]
THIRD_PARTY_PATH_HINTS = [
    "/business/", "/listing/", "/vendor/", "/supplier/",
    "/member/", "/seller/", "/profile/", "/biz/",
]
THIRD_PARTY_SLUG_CHARS = 15

# --- page categories (first match in this order wins) ---------------------------
CATEGORY_KEYWORDS = [
    ("contact", ["contact", "get-in-touch", "reach-us", "enquiry", "enquire"]),
    ("about", ["about", "who-we-are", "our-story", "company", "overview", "profile"]),
    ("blog_news", ["blog", "news", "press", "media", "insight", "article"]),
    ("products", ["product", "portfolio", "catalog", "catalogue"]),
    ("services", ["service"]),
    ("solutions", ["solution"]),
    ("industries", ["industr", "sector", "verticals", "markets"]),
    ("projects", ["project", "case-stud", "portfolio", "work"]),
    ("locations", ["location", "branch", "office", "presence", "global-network"]),
    ("careers", ["career", "jobs", "join-us", "hiring"]),
]
INDUSTRY_PATH_PATTERN = r"/industr(?:y|ies)(?:/|$)"
PRIORITY_CATEGORIES = [
    "home", "about", "products", "services", "solutions",
    "industries", "projects", "locations", "contact",
]
BUCKET_TYPES = ["products", "services", "solutions", "industries"]
CONTACT_TRUSTED_TYPES = ["home", "about", "contact", "locations"]
NAME_RANKS = {"home": 0, "about": 1, "contact": 2}
DESCRIPTION_RANKS = {"about": 0, "home": 1, "contact": 2}
OTHER_RANK = 5
HQ_PAGE_TYPES = ["contact", "about", "home"]

SOCIAL_DOMAINS = [
    ("linkedin.com", "linkedin"),
    ("twitter.com", "twitter"),
    ("x.com", "twitter"),
    ("facebook.com", "facebook"),
    ("instagram.com", "instagram"),
    ("youtube.com", "youtube"),
    ("github.com", "github"),
]

# --- contact details ------------------------------------------------------------
EMAIL_PATTERN = r"[a-zA-Z0-9][a-zA-Z0-9._%+\-]*@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE_PATTERN = r"(?<!\d)(\+?\d{1,3}[\s.-]?)?(\(?\d{2,4}\)?[\s.-]?){2,4}\d{3,4}(?!\d)"
IMAGE_SUFFIX_PATTERN = r"\.(png|jpe?g|gif|svg|webp)$"
PLACEHOLDER_DOMAINS = [
    "example.com", "example.org", "example.net", "domain.com",
    "yourcompany.com", "company.com", "yourdomain.com", "email.com",
    "sentry.io", "wixpress.com", "test.com",
]
PLACEHOLDER_LOCALS = ["you", "your", "user", "someone", "test", "sample", "name", "email"]
PHONE_DIGITS = (7, 15)

# --- names, addresses -------------------------------------------------------------
GENERIC_TITLE_WORDS = [
    "home", "homepage", "home page", "welcome", "official website",
    "official site", "contact us", "about us", "about", "products",
    "services", "solutions", "docs", "documentation", "overview",
    "index", "getting started", "loading", "loading...", "please wait",
    "untitled", "untitled document",
]
TITLE_SEPARATOR_PATTERN = "\\s*[|\\-–:]\\s*"
HQ_OFFICE_KEYWORDS = [
    "registered office", "regd. office", "regd office", "regd. address",
    "head office", "corporate office", "headquarters", "registered address",
    "principal place of business",
]
OTHER_OFFICE_KEYWORDS = [
    "branch office", "branch address", "regional office", "other office",
    "office address", "additional office", "satellite office",
]
ADDRESS_CLASS_HINTS = ["address", "location", "office"]
ADDRESS_ID_HINTS = ["address", "office"]
ADDRESS_ITEMTYPE_HINT = "PostalAddress"

# --- chrome ----------------------------------------------------------------------
CHROME_TAGS = ["nav", "header", "footer", "form", "select", "option", "label"]
CHROME_CLASS_HINTS = ["nav", "footer", "cookie"]
CHROME_ID_HINTS = ["nav", "footer"]

# --- item noise ---------------------------------------------------------------------
BOILERPLATE_HEADINGS = [
    "navigation menu", "site-wide links", "additional resources",
    "frequently asked questions", "the developer newsletter", "platform",
    "ecosystem", "support", "company", "get started today", "table of contents",
    "about us", "description", "vision", "mission", "our vision", "our mission",
    "why choose us", "company details", "company profile", "company overview",
    "overview", "trade information", "company factsheet", "additional information",
    "contact us", "send inquiry", "enquire now", "get best price", "get latest price",
    "request a quote", "business type", "faq", "faqs", "testimonials", "reviews",
    "related products", "similar products", "recommended products",
    "recently viewed", "you may also like", "video", "images", "gallery",
    "documentation", "contact", "pricing", "plans & pricing", "see plans & pricing",
    "manufacturer", "trader", "exporter", "importer", "wholesaler",
    "retailer", "distributor", "dealer", "service provider", "supplier",
    "services", "products", "solutions", "industries", "categories",
]
GENERIC_HEADING_PREFIXES = [
    "explore by", "browse by", "shop by", "view all", "see all",
    "more about", "read more", "learn more", "find more", "share on",
    "location ", "located in", "available from", "established since",
    "established in", "established ", "read the",
]
ID_LABEL_KEYWORDS = [
    "gst", "gstin", "pan number", "pan card", "cin number", "tan number",
    "iec code", "udyam", "msme", "vat number", "tin number",
    "registration number", "license number", "annual turnover",
    "nature of business", "legal status of firm", "year of establishment",
    "number of employees",
]
ENTITY_NAME_SUFFIXES = [
    "pvt ltd", "pvt. ltd.", "pvt. ltd", "private limited", "limited",
    " ltd.", " ltd", "llp", "llc", "inc.", " inc", "incorporated",
    "corporation", "corp.", " corp", "industries", "industry",
    "enterprises", "enterprise", "& sons", "and sons", "trading co",
    "trading company", "group of companies", "& co", "and co",
    "brothers", "associates",
]
INDUSTRY_SUFFIXES = ["industries", "industry"]
LISTING_NOISE_PHRASES = [
    "ask for quote", "ask for price", "get best price", "get latest price",
    "get quote", "request a quote", "request quote", "send inquiry",
    "send enquiry", "enquire now", "contact supplier", "contact seller",
    "contact us", "contact sales", "talk to sales", "view details",
    "view profile", "view more", "know more", "read more", "call now",
    "request callback", "book now", "add to cart", "buy now", "in stock",
    "out of stock", "moq", "min order", "minimum order quantity",
    "verified", "gst verified", "trustseal verified", "verified business",
    "verified supplier", "star supplier", "premium member", "trusted seller",
    "start a free trial", "start your free trial", "start free trial",
    "try for free", "try it free", "sign up free", "sign up now",
    "get started", "get started free", "book a demo", "schedule a demo",
    "request a demo", "watch demo", "watch a demo", "learn more",
    "explore more", "see how it works", "years old", "years experience",
]
DATE_PATTERN = (
    r"(?i)^((established\s*(in)?\s*)?\d{4}"
    r"|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
    r"|(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{4})$"
)
LOCATION_PATTERN = r"^[A-Z][a-zA-Z.]+(?:\s[A-Z][a-zA-Z.]+)?,\s*[A-Z][a-zA-Z]+$"
RATING_PATTERN = r"(?i)^\d(\.\d)?\s*(/|out of)\s*5\b"
METRIC_PATTERN = r"(?i)^\d[\d,.]*\s*(%|k\+|m\+|x\b)"
NUMERIC_PATTERN = r"^[\d,.\s]+$"
RANGE_TOKEN_PATTERN = r"^\d{1,4}-\d{1,4}$"
MAX_ITEM_WORDS = 9
MAX_PUNCTUATED_WORDS = 5
ACTION_LEAD_WORDS = [
    "increase", "improve", "reduce", "streamline", "transform", "discover",
    "implement", "empower", "provide", "modernize", "stay", "unlock",
    "explore", "achieve", "drive", "simplify", "accelerate", "enable",
    "maximize", "minimize", "optimize", "scale", "power", "build",
    "create", "deliver", "ensure", "boost", "let", "tap", "find", "start",
    "get", "turn", "eliminate", "clear", "secure", "ship",
    "refactoring", "understanding", "generating", "enhancing", "supporting",
    "automating", "migrating", "maintaining", "improving",
]
TAXONOMY_HREF_HINTS = [
    "categor", "industr", "sector", "solution", "/service", "tag=", "filter",
]
CARD_GROUP_MIN = 3
ITEM_LENGTH = (2, 100)
HEADING_LENGTH = (2, 80)
ADDRESS_LENGTH = (11, 299)
