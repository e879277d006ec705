"""Golden cases for the cleaning, fingerprint and HTML expressions (FIXTURES.md §4–§5)."""

from conftest import one_col

from mailsift.functions import html as H
from mailsift.functions import text as T

A50 = "a" * 50
A49 = "a" * 49


def test_clean_masked_golden(spark):
    cases = [
        ("go http://a.b/c?d=1, now", "go [URL] now"),
        ("http://u@h.com/x mail me.too@x-y.co.uk.", "[URL] mail [EMAIL]."),
        ("Mail: A@B.co, x@y", "Mail: [EMAIL], x@y"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("a\n \n\t\n b", "a\n\n b"),
        ("c\r\n\r\n\r\nd", "c\r\n\nd"),
        ("x\x00\x07y\x85z\xa0w", "xyz\xa0w"),
        ('"q" “c” ’', '"q" “c” ’'),
        (A50 + "\n\n" + A49, "[ENCODED]\n\n" + A49),
        (None, ""),
    ]
    got = one_col(spark, [c[0] for c in cases], T.clean_masked)
    assert got == [c[1] for c in cases]


def test_clean_compact_golden(spark):
    cases = [
        ("go http://a.b/c?d=1, now", "go http://a.b/c?d=1, now"),
        ("a\n\n\n\nb", "a b"),
        ("a\n \n\t\n b", "a b"),
        ("c\r\n\r\n\r\nd", "c d"),
        ("x\x00\x07y\x85z\xa0w", "xy z w"),
        (A50 + "\n\n" + A49, A50 + " " + A49),
    ]
    got = one_col(spark, [c[0] for c in cases], T.clean_compact)
    assert got == [c[1] for c in cases]


def test_truncate_counts_code_points(spark):
    got = one_col(spark, ["ñ" * 10 + "x", "  padded  "], lambda c: T.strip(T.truncate(c, 5)))
    assert got == ["ñ" * 5, "pad"]


def test_fingerprint_golden(spark):
    got = one_col(spark, ["  Hola \n MUNDO ", "hola mundo"], T.fingerprint)
    assert got == ["0ad066a5d29f3f2a2a1c7c17dd082a79"] * 2


def test_html_masked_golden(spark):
    cases = [
        ("a<br>b", "ab"),
        ("a<br/>b", "a\nb"),
        ("a<td>b</td>c", "ab\nc"),
        ("<noscript>n</noscript>m", "m"),
        ("<head><style>s</style>leak</head>z", "leakz"),
        ("x<meta/>kept", "xkept"),
        ("1 &lt;b&gt; 2", "1  2"),
        ("&amp;amp;lt;", "&lt;"),
        ("tail a & b", "tail a & b"),
        ("<p>Hello <b>world</b>, html part here</p>", "Hello world, html part here\n"),
        ('<a href=3D"x">go=20now</a> a=\r\nb', "go now ab"),
    ]
    got = one_col(spark, [c[0] for c in cases], lambda c: H.html_to_text(c, H.MASKED))
    assert got == [c[1] for c in cases]


def test_html_compact_golden(spark):
    cases = [
        ("a<td>b</td>c", "abc"),
        ("<noscript>n</noscript>m", "nm"),
        ('<a href=3D"x">go=20now</a> a=\r\nb', "go=20now a= b"),
        ("<p>Hello <b>world</b>, html part here</p>", "Hello world, html part here"),
    ]
    got = one_col(spark, [c[0] for c in cases], lambda c: H.html_to_text(c, H.COMPACT))
    assert got == [c[1] for c in cases]


def test_html_fallback(spark):
    assert one_col(spark, ["<b>x</b>&amp;y"], H.strip_tags_fallback) == [" x &y"]


def test_cleaning_is_idempotent_on_the_corpus(spark):
    from pyspark.sql import functions as F
    from mailsift.plans.fixtures import injected_text
    from mailsift.sources.tables import documents
    d = documents(spark, "/root/testdata/sf0.01", "doc_id", "text").select("doc_id", injected_text().alias("t"))
    # masked: idempotent. compact is not, by the order of its rules: whitespace is collapsed
    # before control characters are removed, so "a \x07 b" → "a  b" on the first pass
    once = d.select("doc_id", T.clean_masked("t").alias("a"))
    twice = once.select("doc_id", "a", T.clean_masked("a").alias("b"))
    assert twice.where(F.col("a") != F.col("b")).count() == 0
    assert one_col(spark, ["a \x07 b"], T.clean_compact) == ["a  b"]


def test_numeric_references_follow_html_rules(spark):
    import html as std_html
    cases = ["&#0;", "&#13;", "&#127;", "&#11;", "&#128;", "&#129;", "&#150;", "&#55296;", "&#1114112;",
             "&#65534;", "&#64976;", "&#39", "&#x27", "&#X41;", "&#65;x", "&#0065;", "&#8217;", "&#128512;",
             "&#99999999999;", "&#x;", "&#;", "a&#&#39;b", "&#38;lt;", "&amp;#39;", "&#x110000;", "&#9;",
             "&#10;", "&#31;", "&#32;", "&#xD7FF;", "&#xFFFD;", "x &#233;t&#xE9; &#x1F600;!", "no refs",
             "&#0000000065;", "&#x00041;"]
    got = one_col(spark, cases, H.unescape)
    assert got == [std_html.unescape(c) for c in cases]


def test_staged_html_equals_inline(spark):
    from pyspark.sql import functions as F
    from mailsift.operators.compute import with_html_text
    from mailsift.sources.tables import pages
    p = pages(spark, "/root/testdata/sf0.001", "page_id", "html")
    for profile in (H.MASKED, H.COMPACT):
        staged = with_html_text(p, "html", "a", profile)
        both = staged.withColumn("b", H.html_to_text("html", profile))
        assert both.where(F.col("a") != F.col("b")).count() == 0


def test_references_equal_stdlib_on_random_mixes(spark):
    """Named (full HTML5 table, legacy prefixes) and numeric references in one pass."""
    import html as std_html
    import random
    from mailsift.functions import patterns as P
    rnd = random.Random(11)
    names = list(P.HTML5_ENTITIES)
    cases = ["&ampx;", "&amp-x;", "&notit;", "&AMP;", "&lt", "&copy2019", "&foo;", "& x", "&;",
             "&amp;amp;", "&nbsp&nbsp;", "&hearts;", "&xx;y", "&&&", "&#", "&#x"]
    for _ in range(500):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            r = rnd.random()
            if r < 0.5:
                parts.append("&" + rnd.choice(names) + rnd.choice(["", "x", ";", " ", "-q", "2"]))
            elif r < 0.75:
                parts.append("&#" + str(rnd.randint(0, 130000)) + rnd.choice(["", ";", "a"]))
            else:
                parts.append(rnd.choice(["word", "&", "&#;", "<b>", " ", "é"]))
        cases.append("".join(parts))
    assert one_col(spark, cases, H.unescape) == [std_html.unescape(c) for c in cases]
