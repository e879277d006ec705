"""SQL spellings of the text / HTML expressions for the DuckDB oracle.

The oracle is a second, independent formulation of each query; it shares only the fixed
patterns of :mod:`mailsift.functions.patterns` with the Spark side. DuckDB string literals do
not process backslashes, so every pattern is passed to the regex engine exactly as written.
"""

from __future__ import annotations

from ..functions import patterns as P


def lit(s: str) -> str:
    """A SQL string literal; characters outside printable ASCII are spelled with chr()."""
    parts, buf = [], []
    for ch in s:
        if 32 <= ord(ch) < 127:
            buf.append("''" if ch == "'" else ch)
        else:
            if buf:
                parts.append("'" + "".join(buf) + "'")
                buf = []
            parts.append(f"chr({ord(ch)})")
    if buf or not parts:
        parts.append("'" + "".join(buf) + "'")
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def rr(x: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(repl)}, 'g')"


def strip(x: str) -> str:
    return f"trim({x}, {lit(P.WS_CHARS)})"


def mask_urls(x: str) -> str:
    return rr(x, P.URL_PATTERN, P.URL_MARK)


def mask_emails(x: str) -> str:
    return rr(x, P.EMAIL_PATTERN, P.EMAIL_MARK)


def collapse_blanks(x: str) -> str:
    return rr(x, P.BLANKS_PATTERN, " ")


def collapse_blank_lines(x: str) -> str:
    return rr(x, P.BLANK_LINES_PATTERN, "\n\n")


def collapse_whitespace(x: str) -> str:
    return rr(x, P.ALL_WS_PATTERN, " ")


def strip_controls(x: str) -> str:
    return rr(x, P.CONTROL_PATTERN, "")


def mask_long_words(x: str, n: int = P.LONG_WORD_MIN) -> str:
    return rr(x, f"{P.WORD}{{{int(n)},}}", P.ENCODED_MARK)


def truncate(x: str, n: int) -> str:
    return f"substring({x}, 1, {int(n)})"


def clean_masked(x: str, max_length: int = P.MASKED_BODY_MAX_CHARS, long_word_min: int = P.LONG_WORD_MIN) -> str:
    y = f"coalesce({x}, '')"
    y = mask_urls(y)
    y = mask_emails(y)
    y = collapse_blanks(y)
    y = collapse_blank_lines(y)
    y = strip_controls(y)
    y = mask_long_words(y, long_word_min)
    y = truncate(y, max_length)
    return strip(y)


def clean_compact(x: str, max_length: int = P.COMPACT_MAX_CHARS) -> str:
    y = collapse_whitespace(x)
    y = strip_controls(y)
    y = truncate(y, max_length)
    return strip(y)


def fingerprint(x: str) -> str:
    return f"md5({strip(rr(f'lower({x})', P.ALL_WS_PATTERN, ' '))})"


def compose(subject: str, body: str) -> str:
    return (f"CASE WHEN coalesce({subject}, '') <> '' THEN {lit(P.SUBJECT_PREFIX)} || {subject} || "
            f"{lit(chr(10) * 2)} || {body} ELSE {body} END")


def hash_key(salt: str, id_expr: str) -> str:
    return f"md5({lit(salt)} || CAST({id_expr} AS VARCHAR))"


def _charref(n: str) -> str:
    c1 = "[" + ", ".join(f"chr({cp})" for cp in P.CP1252_C1) + "]"
    invalid = (f"(({n} BETWEEN 1 AND 8) OR {n} = 11 OR ({n} BETWEEN 14 AND 31) OR {n} = 127 "
               f"OR ({n} BETWEEN 64976 AND 65007) OR {n} % 65536 >= 65534)")
    return (f"CASE WHEN {n} = 0 OR ({n} BETWEEN 55296 AND 57343) OR {n} > 1114111 THEN chr(65533) "
            f"WHEN {n} = 13 THEN chr(13) WHEN {n} BETWEEN 128 AND 159 THEN {c1}[{n} - 127] "
            f"WHEN {invalid} THEN '' ELSE chr(CAST({n} AS INTEGER)) END")


def _numeric(q: str) -> str:
    """SQL for the piece after ``&#`` (``q``)."""
    dec = f"regexp_extract({q}, '^([0-9]+)', 1)"
    hx = f"regexp_extract({q}, '^[xX]([0-9a-fA-F]+)', 1)"
    dec_v, hx_v = f"ltrim({dec}, '0')", f"ltrim({hx}, '0')"
    n = (f"(CASE WHEN {dec} <> '' THEN (CASE WHEN length({dec_v}) > 7 THEN 1114112 "
         f"ELSE coalesce(TRY_CAST({dec_v} AS BIGINT), 0) END) "
         f"ELSE (CASE WHEN length({hx_v}) > 6 THEN 1114112 "
         f"ELSE coalesce(TRY_CAST(('0x' || CASE WHEN {hx_v} = '' THEN '0' ELSE {hx_v} END) AS BIGINT), 0) END) END)")
    rest0 = f"(CASE WHEN {dec} <> '' THEN substring({q}, length({dec}) + 1) ELSE substring({q}, length({hx}) + 2) END)"
    rest = f"(CASE WHEN starts_with({rest0}, ';') THEN substring({rest0}, 2) ELSE {rest0} END)"
    return f"(CASE WHEN {dec} = '' AND {hx} = '' THEN '&#' || {q} ELSE ({_charref(n)}) || {rest} END)"


def _named(p: str, m: str) -> str:
    s_ = f"regexp_extract({p}, {lit(P.NAMED_REF_PATTERN)}, 1)"
    leg = f"regexp_extract({p}, {lit('^(' + '|'.join(P.HTML5_LEGACY) + ')')}, 1)"
    full = f"map_extract_value({m}, {s_})"
    return (f"(CASE WHEN {s_} <> '' AND {full} IS NOT NULL THEN {full} || substring({p}, length({s_}) + 1) "
            f"WHEN {leg} <> '' THEN map_extract_value({m}, {leg}) || substring({p}, length({leg}) + 1) "
            f"ELSE '&' || {p} END)")


def unescape(x: str) -> str:
    """Single left-to-right pass over every character reference (HTML5 table + numeric)."""
    import json
    table = json.dumps(P.HTML5_ENTITIES).replace("'", "''")
    m_lit = f"json_transform('{table}', '\"MAP(VARCHAR, VARCHAR)\"')"
    piece = f"CASE WHEN i = 1 THEN p WHEN starts_with(p, '#') THEN {_numeric('substring(p, 2)')} ELSE {_named('p', 'm')} END"
    return (f"list_transform([{m_lit}], lambda m: array_to_string(list_transform(string_split({x}, '&'), "
            f"lambda p, i: {piece}), ''))[1]")


def _alt(tags) -> str:
    return "|".join(tags)


def html_to_text(x: str, profile: str = "masked") -> str:
    skip = P.MASKED_SKIP_TAGS if profile == "masked" else P.COMPACT_SKIP_TAGS
    block = P.MASKED_BLOCK_TAGS if profile == "masked" else P.COMPACT_BLOCK_TAGS
    k, b = _alt(skip), _alt(block)
    y = unescape(x)
    if profile == "masked":
        y = rr(y, P.QP_SOFT_BREAK, "")
        y = f"replace({y}, {lit(P.QP_EQUALS)}, '=')"
        y = f"replace({y}, {lit(P.QP_SPACE)}, ' ')"
    y = rr(y, r"(?s)<!--.*?-->", "")
    y = rr(y, rf"(?i)<(?:{k})(?:{P.WS}[^>]*)?/>", "")
    y = rr(y, rf"(?is)<(?:{k})(?:{P.WS}[^>]*)?>.*?(?:</(?:{k}){P.WS}*>|\z)", "")
    y = rr(y, rf"(?i)</(?:{b}){P.WS}*>|<(?:{b})(?:{P.WS}[^>]*)?/>", "\n")
    y = rr(y, r"<[^>]+>", "")
    y = unescape(y)
    if profile != "masked":
        y = strip(collapse_whitespace(y))
    return y


def html_fallback(x: str) -> str:
    return unescape(rr(x, r"<[^>]+>", " "))
