"""The text patterns and word lists that define the extraction results.

The patterns are in Java's dialect. The flags make it agree with Python's `re` on
text: `i` ignore case, `m` `^`/`$` at every line, `d` only `\\n` ends a line,
`U` Unicode classes. Digits are ASCII only.
"""

# --- fixed values -----------------------------------------------------------

IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"]
PDF_EXTENSIONS = [".pdf"]

DATE_YEAR_FIRST = r"\b([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})\b"
DATE_YEAR_LAST = r"\b([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{2,4})\b"
DATE_MONTH_NAME = r"\b([A-Za-z]{3,9})\s+([0-9]{1,2}),\s*([0-9]{4})\b"

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

AMOUNT_PATTERNS = [
    r"(?:total|amount|balance|due|pay|grand\s*total|sum)\s*[:\-=]?\s*\$?\s*([0-9]{1,3}(?:[,\s][0-9]{3})*(?:\.[0-9]{2})?)",
    r"(?:total|amount|balance|due|pay)\s*\$?\s*([0-9]{1,3}(?:[,\s][0-9]{3})*(?:\.[0-9]{2})?)",
    r"\$\s*([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2}))",
    r"USD\s*\$?\s*([0-9]{1,3}(?:[,\s][0-9]{3})*(?:\.[0-9]{2})?)",
    r"\s([0-9]{1,3}(?:[,\s][0-9]{3})*\.[0-9]{2})\s*$",
    r"\b([0-9]{1,3}(?:,[0-9]{3})+\.[0-9]{2})\b",
    r"\b([0-9]{2,3}\.[0-9]{2})\b",
]

# Lines that never name a vendor.
SKIP_LINE_PATTERNS = [
    r"^(customer|cardholder|card\s*holder|member|account|name)[\s:]*",
    r"^(thank\s*you|thanks|receipt|invoice|bill|order|ticket)",
    r"^(date|time|server|cashier|clerk|sold\s*to|ship\s*to)",
    r"^\*+\s*$",
    r"^-+\s*$",
    r"^=+\s*$",
    r"^[0-9\s\-\./]+$",
    r"^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}",
    r"^(visa|mastercard|amex|discover|debit|credit)",
]

# What Python's str.splitlines splits on, and what str.strip removes.
LINE_BREAKS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
LINE_BREAK_CLASS = r"[\n-\r\x1c-\x1e\x85\u2028\u2029]"
BLANKS = (
    "\t\x1f \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u202f\u205f\u3000"
)

# Characters str.isdigit accepts besides decimal digits (Basic Multilingual Plane).
DIGIT_SIGNS = "²³¹፩-፱᧚⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"

# Score of a line as vendor name: less for each line further down, more for capitals
# and for the length of a name, less for long lines and many spaces.
TOP_SCORE, LINE_PENALTY = 100, 3
CAPITALS_LENGTHS, CAPITALS_BONUS = (3, 40), 50
NAME_LENGTHS, NAME_BONUS = (5, 30), 20
LONG_LINE, LONG_PENALTY = 50, 30
MANY_SPACES, SPACES_PENALTY = 2, 15
VENDOR_LENGTHS, TOO_MANY_SPACES = (3, 80), 5

# Labels of where a value came from.
NO_MODEL, MANUAL_HINT, FALLBACK, MODEL_LABEL = "LLM disabled", "Manual hint", "Regex fallback", "LLM (confidence: "

# Characters of a name that a list shows.
SHOWN_VENDOR, SHOWN_CATEGORY = 28, 18

VENDOR_LINES = 20
LAST_RESORT_LINES = 5
AMOUNT_CANDIDATES = 5
PROMPT_CHARS = 2000
CONFIDENCE_FLOOR = 0.3
DEFAULT_CONFIDENCE = 0.5

FIRST_PAGE_ROWS = 47
NEXT_PAGE_ROWS = 50
# --- end of fixed values ----------------------------------------------------
