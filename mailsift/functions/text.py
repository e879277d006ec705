"""Text scalar operators (T1–T15) as native Spark ``Column`` expressions.

All of them stay inside whole-stage code generation: ``regexp_replace`` compiles a literal
pattern once per task, ``substring``/``btrim``/``md5`` are plain expressions. Two profiles
exist: ``masked`` (markers for URLs, addresses and encoded words; paragraphs kept) and
``compact`` (all whitespace collapsed, no masking).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

ColumnOrName = Column | str

MASKED = "masked"
COMPACT = "compact"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mask_urls(c: ColumnOrName) -> Column:
    """``http(s)://`` up to the next whitespace becomes ``[URL]``."""
    return F.regexp_replace(_col(c), P.URL_PATTERN, P.URL_MARK)


def mask_emails(c: ColumnOrName) -> Column:
    """E-mail addresses become ``[EMAIL]`` (run after T1)."""
    return F.regexp_replace(_col(c), P.EMAIL_FROM_START, P.EMAIL_MARK)


def collapse_blanks(c: ColumnOrName) -> Column:
    """Runs of spaces / tabs become one space."""
    return F.regexp_replace(_col(c), P.BLANKS_TO_CHANGE, " ")


def collapse_blank_lines(c: ColumnOrName) -> Column:
    """T4: three or more line breaks (with whitespace between) become two."""
    return F.regexp_replace(_col(c), P.BLANK_LINES_PATTERN, "\n\n")


def collapse_whitespace(c: ColumnOrName) -> Column:
    """T5: every whitespace run becomes one space (paragraphs are lost)."""
    return F.regexp_replace(_col(c), P.ALL_WS_TO_CHANGE, " ")


def strip_controls(c: ColumnOrName) -> Column:
    """C0/C1 control characters except LF and CR are removed (TAB is removed)."""
    return F.regexp_replace(_col(c), P.CONTROL_PATTERN, "")


_SMART_QUOTES = "“”‘’"
_PLAIN_QUOTES = "\"\"''"


def normalise_quotes(c: ColumnOrName, typographic: bool = False) -> Column:
    """Quote normalisation.

    The behaviour being matched replaces ASCII quotes by themselves, i.e. leaves text
    unchanged, so the default is the identity. ``typographic=True`` maps curly quotes to
    ASCII ones (the evident intent).
    """
    c = _col(c)
    return F.translate(c, _SMART_QUOTES, _PLAIN_QUOTES) if typographic else c


def mask_long_words(c: ColumnOrName, min_len: int = P.LONG_WORD_MIN) -> Column:
    """A run of at least ``min_len`` word characters becomes ``[ENCODED]``.

    A greedy run of word characters always starts and ends on a word boundary, so the
    boundary assertions of ``\\b\\w{n,}\\b`` are implied.
    """
    # (a run starts where no word character stands before, so no other place of a word is tried)
    return F.regexp_replace(_col(c), f"(?<!{P.WORD}){P.WORD}{{{int(min_len)},}}", P.ENCODED_MARK)


def truncate(c: ColumnOrName, n: int) -> Column:
    """The first ``n`` code points."""
    return F.substring(_col(c), 1, int(n))


def strip(c: ColumnOrName) -> Column:
    """Remove leading / trailing Unicode whitespace (``trim`` only strips spaces)."""
    return F.btrim(_col(c), F.lit(P.WS_CHARS))


def clean_masked(c: ColumnOrName, max_length: int = P.MASKED_BODY_MAX_CHARS,
                 long_word_min: int = P.LONG_WORD_MIN) -> Column:
    """T11, profile ``masked``: null → ''; T1 T2 T3 T4 T6 T7 T8 T9 T10 in this order."""
    x = F.coalesce(_col(c), F.lit(""))
    x = mask_urls(x)
    x = mask_emails(x)
    x = collapse_blanks(x)
    x = collapse_blank_lines(x)
    x = strip_controls(x)
    x = normalise_quotes(x)
    x = mask_long_words(x, long_word_min)
    x = truncate(x, max_length)
    return strip(x)


def clean_compact(c: ColumnOrName, max_length: int = P.COMPACT_MAX_CHARS) -> Column:
    """T11, profile ``compact``: T5 T6 T7 T9 T10."""
    x = collapse_whitespace(_col(c))
    x = strip_controls(x)
    x = normalise_quotes(x)
    x = truncate(x, max_length)
    return strip(x)


def clean_text(c: ColumnOrName, profile: str = MASKED, **kw) -> Column:
    if profile == MASKED:
        return clean_masked(c, **kw)
    if profile == COMPACT:
        return clean_compact(c, **kw)
    raise ValueError(f"unknown profile {profile!r}")


def fingerprint(c: ColumnOrName) -> Column:
    """md5 hex of the lower-cased, stripped, whitespace-collapsed text."""
    return F.md5(strip(collapse_whitespace(F.lower(_col(c)))))


def compose(subject: ColumnOrName, body: ColumnOrName) -> Column:
    """M8: ``Subject: {s}\\n\\n{body}`` when the subject is non-empty, else the body."""
    s, b = _col(subject), _col(body)
    return F.when(F.coalesce(s, F.lit("")) != "", F.concat(F.lit(P.SUBJECT_PREFIX), s, F.lit("\n\n"), b)) \
        .otherwise(b)


def fill_template(template: ColumnOrName, values: list[tuple[str, Column]], passes: int = 2) -> Column:
    """Ordered placeholder replacement. Each pass replaces every ``{key}`` in the
    given order; a second pass resolves placeholders brought in by an earlier value
    (a subject or body template inside the message template)."""
    x = _col(template)
    for _ in range(passes):
        for key, val in values:
            x = F.replace(x, F.lit("{" + key + "}"), val)
    return x


def preview(c: ColumnOrName, n: int = P.PREVIEW_CHARS) -> Column:
    """First ``n`` characters followed by ``...``."""
    return F.concat(F.substring(_col(c), 1, int(n)), F.lit("..."))


def contains_ci(c: ColumnOrName, keyword: str) -> Column:
    """Case-insensitive substring test (lower-cased text contains the keyword)."""
    return F.contains(F.lower(_col(c)), F.lit(keyword.lower()))


def contains_any_ci(c: ColumnOrName, keywords) -> Column:
    """Any of several keywords, case-insensitive (one lower() per row)."""
    low = F.lower(_col(c))
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(low, F.lit(k.lower()))
    return out
