"""HTML → text (H1–H4) as one chain of native ``replace``/``regexp_replace`` expressions.

The rules reproduced are those of a streaming HTML reader with one *skip* flag:

* character references are decoded before any markup is looked at (so ``&lt;b&gt;``
  turns into a tag and disappears) and once more on the text that survives;
* a start tag of the skip set turns the flag on and the *next* end tag of the set turns
  it off — one flag, not a depth counter; a self-closed skip tag skips nothing;
* the end tag (or self-closed form) of a block element emits ``\\n``; a bare ``<br>``
  emits nothing;
* all other markup, comments and declarations vanish.

No UDF: every step is a JVM expression inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import ColumnOrName, _col, collapse_whitespace, strip

MASKED = "masked"
COMPACT = "compact"


def _char_of(n: Column) -> Column:
    """The character of code point ``n`` (UTF-16 code units decoded natively)."""
    bmp = F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE")
    m = n - F.lit(0x10000)
    pair = F.decode(F.unhex(F.concat(F.hex(F.lit(0xD800) + F.floor(m / 1024)),
                                     F.hex(F.lit(0xDC00) + m % 1024))), "UTF-16BE")
    return F.when(n < 0x10000, bmp).otherwise(pair)


def _charref(n: Column) -> Column:
    """A numeric reference resolved with the HTML rules: NUL, surrogates and values beyond
    U+10FFFF give U+FFFD, 0x80–0x9F are windows-1252, 13 is CR, non-characters and C0/DEL
    controls other than TAB/LF/FF vanish."""
    c1 = F.array(*[F.lit(chr(cp)) for cp in P.CP1252_C1])
    invalid = (((n >= 1) & (n <= 8)) | (n == 11) | ((n >= 14) & (n <= 31)) | (n == 127)
               | ((n >= 0xFDD0) & (n <= 0xFDEF)) | (n % 0x10000 >= 0xFFFE))
    return (F.when(n.isNull() | (n == 0) | ((n >= 0xD800) & (n <= 0xDFFF)) | (n > 0x10FFFF), F.lit("\ufffd"))
            .when(n == 13, F.lit("\r"))
            .when((n >= 0x80) & (n <= 0x9F), F.element_at(c1, (n - 0x7F).cast("int")))
            .when(invalid, F.lit(""))
            .otherwise(_char_of(n)))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body`` (a lambda binding)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numeric(p: Column) -> Column:
    """The piece after ``&#``: ``NNN`` / ``xHHH`` (semicolon optional) → character + rest."""
    caps = F.struct(F.regexp_extract(p, r"^([0-9]+)", 1).alias("d"),
                    F.regexp_extract(p, r"^[xX]([0-9a-fA-F]+)", 1).alias("h"))

    def resolve(t: Column) -> Column:
        dec, hx = t["d"], t["h"]
        dec_v, hx_v = F.ltrim(dec, F.lit("0")), F.ltrim(hx, F.lit("0"))
        n = (F.when(dec != "", F.when(F.length(dec_v) > 7, F.lit(0x110000))
                    .otherwise(F.coalesce(dec_v.try_cast("bigint"), F.lit(0))))
             .otherwise(F.when(F.length(hx_v) > 6, F.lit(0x110000))
                        .otherwise(F.coalesce(F.conv(F.when(hx_v == "", F.lit("0")).otherwise(hx_v), 16, 10)
                                              .try_cast("bigint"), F.lit(0)))))
        rest = F.when(dec != "", F.substring(p, F.length(dec) + 1, 1 << 30)) \
            .otherwise(F.substring(p, F.length(hx) + 2, 1 << 30))
        rest = F.regexp_replace(rest, "^;", "")
        return F.when((dec == "") & (hx == ""), F.concat(F.lit("&#"), p)) \
            .otherwise(F.concat(_let(n, _charref), rest))
    return _let(caps, resolve)


def _entity_map() -> Column:
    """The HTML5 name → text table as one constant map (a folded literal)."""
    import json
    return F.from_json(F.lit(json.dumps(P.HTML5_ENTITIES)), "map<string,string>")


def _named(p: Column, table: Column) -> Column:
    """The piece after ``&`` for a named reference: an exact name (with or without ';'), else
    the longest legacy name that prefixes it, else the ``&`` stays."""
    legacy_re = "^(" + "|".join(P.HTML5_LEGACY) + ")"
    caps = F.struct(F.regexp_extract(p, P.NAMED_REF_PATTERN, 1).alias("s"),
                    F.regexp_extract(p, legacy_re, 1).alias("l"))

    def resolve(t: Column) -> Column:
        s, leg = t["s"], t["l"]
        full = F.try_element_at(table, s)
        short = F.try_element_at(table, leg)
        return (F.when((s != "") & full.isNotNull(), F.concat(full, F.substring(p, F.length(s) + 1, 1 << 30)))
                .when(leg != "", F.concat(short, F.substring(p, F.length(leg) + 1, 1 << 30)))
                .otherwise(F.concat(F.lit("&"), p)))
    return _let(caps, resolve)


def unescape(c: ColumnOrName) -> Column:
    """H2: every character reference decoded in one left-to-right pass, with the HTML rules —
    named (HTML5 table, legacy names without ';' by longest prefix) and numeric — so nothing is
    decoded twice (``&amp;lt;`` → ``&lt;``). Native: split on ``&`` + ``transform``; each value
    is bound once through a lambda."""
    def piece(p: Column, table: Column) -> Column:
        return F.when(p.startswith("#"), _numeric(F.substring(p, 2, 1 << 30))).otherwise(_named(p, table))

    def decode(bound: Column) -> Column:
        parts, table = bound["parts"], bound["table"]
        tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: piece(p, table))
        return F.concat(F.element_at(parts, 1), F.array_join(tail, ""))

    def guarded(text: Column) -> Column:
        # the table is bound beside the pieces: a plan has it once for each call, not for each look-up
        return F.when(text.contains("&"), _let(F.struct(F.split(text, "&").alias("parts"), _entity_map().alias("table")),
                                               decode)).otherwise(text)

    return _let(_col(c), guarded)


def qp_repair(c: ColumnOrName) -> Column:
    """H3: repair quoted-printable residue: soft breaks, ``=3D`` and ``=20``."""
    x = F.regexp_replace(_col(c), P.QP_SOFT_BREAK, "")
    x = F.replace(x, F.lit(P.QP_EQUALS), F.lit("="))
    return F.replace(x, F.lit(P.QP_SPACE), F.lit(" "))


def _tags(profile: str):
    if profile == MASKED:
        return P.MASKED_SKIP_TAGS, P.MASKED_BLOCK_TAGS
    if profile == COMPACT:
        return P.COMPACT_SKIP_TAGS, P.COMPACT_BLOCK_TAGS
    raise ValueError(f"unknown profile {profile!r}")


def strip_markup(c: ColumnOrName, profile: str = MASKED) -> Column:
    """Markup removal on already-unescaped HTML (steps 2–6 of H1)."""
    skip, block = _tags(profile)
    k, b = "|".join(skip), "|".join(block)
    x = F.regexp_replace(_col(c), r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(x, rf"(?i)<(?:{k})(?:{P.WS}[^>]*)?/>", "")
    x = F.regexp_replace(x, rf"(?is)<(?:{k})(?:{P.WS}[^>]*)?>.*?(?:</(?:{k}){P.WS}*>|\z)", "")
    x = F.regexp_replace(x, rf"(?i)</(?:{b}){P.WS}*>|<(?:{b})(?:{P.WS}[^>]*)?/>", "\n")
    return F.regexp_replace(x, r"<[^>]+>", "")


def markup_removed(c: ColumnOrName, profile: str = MASKED) -> Column:
    """First half of H1: unescape (→ QP repair) → markup removal."""
    x = unescape(c)
    if profile == MASKED:
        x = qp_repair(x)
    return strip_markup(x, profile)


def finish_text(c: ColumnOrName, profile: str = MASKED) -> Column:
    """Second half of H1: the text is unescaped again; ``compact`` also collapses whitespace."""
    x = unescape(c)
    if profile == COMPACT:
        x = strip(collapse_whitespace(x))
    return x


def html_to_text(c: ColumnOrName, profile: str = MASKED) -> Column:
    """H1. ``masked``: unescape → QP repair → markup → unescape, whitespace kept.
    ``compact``: unescape → markup → unescape → whitespace collapsed and stripped.
    On a DataFrame prefer :func:`mailsift.operators.compute.with_html_text`, which stores the
    middle result so both halves stay in generated code."""
    return finish_text(markup_removed(c, profile), profile)


def strip_tags_fallback(c: ColumnOrName) -> Column:
    """H4: the fallback path — every tag becomes a space, then unescape."""
    return unescape(F.regexp_replace(_col(c), r"<[^>]+>", " "))
