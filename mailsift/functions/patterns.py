"""Fixed values shared by the cleaning, HTML and audit expressions.

Every pattern here is written once and used verbatim by the Spark expressions and by the
DuckDB oracle SQL: both engines parse ``\\t``, ``\\xHH``, ``\\x{HHHH}``, ``\\p{L}`` and
``\\z`` inside the pattern, so one string serves both.
"""

# ---------------------------------------------------------------------------------------
# FIXED VALUES — must equal the behaviour being matched (Python ``re`` on ``str``).
# ---------------------------------------------------------------------------------------

# The code points Python treats as whitespace for ``\s`` and ``str.strip()``:
# TAB LF VT FF CR, FS GS RS US, SPACE, NEL, NBSP, OGHAM SPACE MARK, EN QUAD .. HAIR SPACE,
# LINE SEPARATOR, PARAGRAPH SEPARATOR, NARROW NBSP, MEDIUM MATHEMATICAL SPACE,
# IDEOGRAPHIC SPACE.
WS_CODEPOINTS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WS_CLASS_BODY = "".join("\\x{%X}" % c for c in WS_CODEPOINTS)
WS = "[" + WS_CLASS_BODY + "]"
NOT_WS = "[^" + WS_CLASS_BODY + "]"
# the same set as literal characters, for trim(chars)
WS_CHARS = "".join(chr(c) for c in WS_CODEPOINTS)

# Python ``\w`` on ``str``: letters, numbers, underscore.
WORD_CLASS_BODY = r"\p{L}\p{N}_"
WORD = "[" + WORD_CLASS_BODY + "]"

# Cleaning patterns (masked profile B unless noted).
URL_PATTERN = "https?://" + NOT_WS + "+"
EMAIL_PATTERN = "[" + WORD_CLASS_BODY + r".-]+@[" + WORD_CLASS_BODY + r".-]+\." + WORD + "+"
# The same matches for Java: no ``@`` is in the class, so only a run's start (or the last match's end) is tried, once.
EMAIL_FROM_START = (r"(?:\G|(?<![" + WORD_CLASS_BODY + r".-]))[" + WORD_CLASS_BODY + r".-]++@["
                    + WORD_CLASS_BODY + r".-]+\." + WORD + "+")
BLANKS_PATTERN = r"[ \t]+"
BLANK_LINES_PATTERN = r"\n" + WS + r"*\n" + WS + r"*\n+"
ALL_WS_PATTERN = WS + "+"
# What of these runs is not one space already: the same result without writing every space anew.
BLANKS_TO_CHANGE = r"\t[ \t]*| [ \t]+"
_WS_RANGES = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ALL_WS_TO_CHANGE = (r"[\x{9}-\x{D}\x{1C}-\x{1F}" + _WS_RANGES + r"[\x{9}-\x{D}\x{1C}-\x{20}" + _WS_RANGES
                    + r"*| [\x{9}-\x{D}\x{1C}-\x{20}" + _WS_RANGES + "+")
CONTROL_PATTERN = r"[\x00-\x09\x0B\x0C\x0E-\x1F\x7F-\x9F]"
URL_MARK = "[URL]"
EMAIL_MARK = "[EMAIL]"
ENCODED_MARK = "[ENCODED]"
LONG_WORD_MIN = 50

# Length limits: profile A whole text; profile B subject / body.
COMPACT_MAX_CHARS = 5000
MASKED_SUBJECT_MAX_CHARS = 200
MASKED_BODY_MAX_CHARS = 2000
COMPACT_MIN_BODY = 10      # raw body, before cleaning
MASKED_MIN_BODY = 30       # cleaned body
MIN_TEXT_LENGTH = 50       # composed text
SUBSTANTIAL_PART = 20      # a MIME part counts when len(strip(text)) > 20

SUBJECT_PREFIX = "Subject: "
PREVIEW_CHARS = 500

# HTML tag sets per profile.
COMPACT_SKIP_TAGS = ("script", "style", "head", "meta", "link")
MASKED_SKIP_TAGS = ("script", "style", "head", "meta", "link", "noscript")
COMPACT_BLOCK_TAGS = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6")
MASKED_BLOCK_TAGS = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th")

# The HTML5 named character references: taken from the standard library's table (a rule, not a
# transcription): names with ';' plus the legacy names that also decode without it.
def _html5_table() -> dict:
    from html.entities import html5
    return dict(html5)


HTML5_ENTITIES = _html5_table()
# legacy names (no ';'), longest first so that a regex alternation takes the longest prefix
HTML5_LEGACY = tuple(sorted((k for k in HTML5_ENTITIES if not k.endswith(";")), key=lambda k: (-len(k), k)))
# a named reference: up to 32 characters other than TAB LF FF SPACE < & # ;, then an optional ';'
NAMED_REF_PATTERN = r"^([^\t\n\f <&#;]{1,32};?)"

# Numeric character references 0x80–0x9F are read as windows-1252 (HTML rule); the code points
# they map to, in order 0x80, 0x81, …, 0x9F.
CP1252_C1 = (
    0x20AC, 0x0081, 0x201A, 0x0192, 0x201E, 0x2026, 0x2020, 0x2021,
    0x02C6, 0x2030, 0x0160, 0x2039, 0x0152, 0x008D, 0x017D, 0x008F,
    0x0090, 0x2018, 0x2019, 0x201C, 0x201D, 0x2022, 0x2013, 0x2014,
    0x02DC, 0x2122, 0x0161, 0x203A, 0x0153, 0x009D, 0x017E, 0x0178,
)

# Quoted-printable residue repair (profile B, on the unescaped HTML).
QP_SOFT_BREAK = r"=\r?\n"
QP_EQUALS = "=3D"
QP_SPACE = "=20"

# Class names.
LABEL_NAMES = ((0, "legitimate"), (1, "phishing"))

# Tokens never ranked by the explanation step.
SPECIAL_TOKENS = ("[CLS]", "[SEP]", "[PAD]", "[UNK]", "[MASK]")

# Word tokens: runs of letters.
TOKEN_PATTERN = r"\p{L}+"
MAX_TOKENS = 256
TOP_K = 5

# Seeds / salts for hash orders: one salt per stage so that stages are independent.
SEED = 42
