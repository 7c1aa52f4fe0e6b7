"""Fixed values that results depend on: tolerances, thresholds, word lists, patterns."""

# Sizes and the core rules.
SQFT_PER_ACRE = 43560.0
NOT_FOUND = "—"
SCHEMA_VERSION = 1

# Same-sale and verification tolerances.
SAME_PRICE_TOLERANCE = 0.005
SAME_SIZE_TOLERANCE = 0.05
CLAIM_PRICE_TOLERANCE = 0.005
DATE_TOLERANCE_DAYS = 3
LOOSE_DATE_TOLERANCE_DAYS = 21

# Valuation, bands, ladder, guidance.
MIN_BRACKET = 5
MIN_BAND = 3
MAX_BANDS = 5
LADDER_WIDTHS = [0.10, 0.15, 0.25, 0.40, 0.60, 1.00]
LADDER_SAME_WIDTH = 0.005
LADDER_THIN = 3
SEARCH_BAND = 50_000
UNDERCUT = 1_000
ANCHOR_PREMIUM = 0.055
FLOOR_DISCOUNT = 0.05

# Agent flags.
SHORTLIST_MIN_CLOSINGS = 2
SHORTLIST_MIN_RATIO = 1.00
CAUTION_MAX_RATIO = 0.95

# Quadrants.
BORDERLINE_DEGREES = 0.0002
QUADRANTS = ["NE", "NW", "SE", "SW"]
EAST = "East of divider"
WEST = "West of divider"

# Pages.
PAGE_TTL_SECONDS = 6 * 60 * 60
BLOCK_PAGE_HEAD = 4000
FOCUS_MAX_CHARS = 14_000
FOCUS_HEAD = 1_500
FOCUS_WINDOW = 900
MAX_DIMENSION_CHARS = 100
GEOCODE_MIN_SCORE = 85.0

# Usage accounting.
CACHE_READ_FACTOR = 0.1
CACHE_WRITE_FACTOR = 1.25

# Street types and directionals that an address key canonicalises.
STREET_TYPES = {
    "street": "st", "st": "st",
    "avenue": "ave", "av": "ave", "ave": "ave",
    "road": "rd", "rd": "rd",
    "drive": "dr", "dr": "dr",
    "boulevard": "blvd", "blvd": "blvd",
    "lane": "ln", "ln": "ln",
    "court": "ct", "ct": "ct",
    "place": "pl", "pl": "pl",
    "terrace": "ter", "ter": "ter",
    "way": "way",
    "circle": "cir", "cir": "cir",
    "trail": "trl", "trl": "trl",
    "canyon": "canyon", "cyn": "canyon",
}
DIRECTIONS = {
    "north": "n", "n": "n",
    "south": "s", "s": "s",
    "east": "e", "e": "e",
    "west": "w", "w": "w",
    "northeast": "ne", "ne": "ne",
    "northwest": "nw", "nw": "nw",
    "southeast": "se", "se": "se",
    "southwest": "sw", "sw": "sw",
}
UNIT_PATTERN = r"(?:\b(?:apt|apartment|unit|ste|suite)\b\.?|#)\s*([\w-]+)"

# Street types that a geocode comparison ignores.
GEOCODE_STREET_TYPES = [
    "st", "ave", "rd", "dr", "blvd", "ln", "ct", "pl", "ter", "way", "cir",
    "trl", "canyon", "pkwy", "hwy", "sq", "loop", "row", "walk", "path",
]
GEOCODE_DIRECTIONS = ["n", "s", "e", "w", "ne", "nw", "se", "sw"]

# Filler names that stand for no real party.
PLACEHOLDER_NAMES = [
    "out of area", "out of area out of area", "outofarea",
    "non member", "nonmember", "non-member", "non member non member",
    "public record", "not available", "unavailable", "unknown",
    "none", "n/a", "na", "tbd", "agent", "listing agent", "seller",
    "buyer", "owner", "no agent", "not applicable", "withheld",
    ".", "-", "--", "—",
]

# Brokerage families and the glob patterns that select them, in priority order.
BROKERAGE_FAMILIES = [
    ("Berkshire Hathaway HomeServices", ["Berkshire*", "BHHS*"]),
    ("Keller Williams", ["Keller Williams*", "KW *", "KW*"]),
    ("eXp Realty", ["eXp*", "EXP *"]),
    ("Sotheby's International Realty", ["*Sotheby*"]),
    ("Coldwell Banker", ["Coldwell Banker*"]),
    ("Compass", ["Compass*"]),
    ("RE/MAX", ["RE/MAX*", "REMAX*"]),
    ("The Agency", ["The Agency*"]),
]

# Phrases that mark a challenge or refusal page.
BLOCK_SIGNALS = [
    "verify you are a human",
    "verifying you are human",
    "are you a robot",
    "captcha",
    "unusual traffic",
    "access denied",
    "request blocked",
    "enable javascript and cookies to continue",
    "checking your browser",
    "cf-browser-verification",
    "pardon our interruption",
]

# Terms that sit beside the facts of a property page.
FOCUS_TERMS = [
    "listed by", "listing courtesy", "courtesy of", "presented by", "bought with",
    "sold by", "buyer's agent", "buyers agent", "listing agent", "listing provided",
    "dre #", "dre#", "lic #", "license #", "brokerage",
    "price history", "sold on", "sold for", "last sold", "closed on",
    "list price", "listed on", "price change", "price reduced", "relisted",
    "lot size", "lot area", "square foot", "square feet", "sq ft", "sqft", "acres",
    "mls #", "mls#", "listing id",
]

# HTML elements whose content is dropped, and those that end a line.
HTML_DROPPED = ["script", "style", "noscript", "svg", "canvas", "template", "iframe"]
HTML_BREAKING = [
    "p", "div", "br", "li", "tr", "td", "th", "section", "article", "header",
    "footer", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "dl",
    "dd", "dt", "figure", "figcaption", "main", "nav", "aside", "form",
]
HTML_DATA_TYPES = ["application/ld+json", "application/json"]

# Text patterns of the field transforms.
MONEY_PATTERN = r"[-+]?[\d,]*\.?\d+"
TAG_DATE_PATTERN = r"^[A-Za-z]{3,9}\.?\s+\d{1,2},\s*\d{4}$"
DIMENSION_PATTERN = r"(?<![\d,.])([\d,.]++)\s*+(acre|acres|ac|sq\s*ft|sqft|square feet)"
LICENCE_PATTERN = r"\b(?:DRE|BRE|CalBRE|Lic(?:ense)?)\b"
