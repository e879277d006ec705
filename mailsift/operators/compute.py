"""Evaluate expensive row expressions exactly once.

Catalyst pushes a filter on a computed column below the projection that computes it by
substituting the expression into the predicate. For a regex chain over a whole e-mail that
means the chain runs twice (predicate + projection) and, worse, runs below any repartition
that was meant to spread the work. A ``Generate`` is a barrier for predicate pushdown on
its output columns, so expressions produced by ``inline(array(struct(...)))`` are computed
once, where they are written, and later filters read the stored value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, **exprs: Column) -> DataFrame:
    """``df`` plus the named columns, each evaluated once per row at this point of the plan."""
    keep = [c for c in df.columns if c not in exprs]
    packed = F.struct(*[e.alias(name) for name, e in exprs.items()])
    return df.select(*keep, F.inline(F.array(packed)))


def with_html_text(df: DataFrame, src: str, out: str, profile: str = "masked") -> DataFrame:
    """``df`` plus ``out`` = H1(``src``). The markup-free middle result is stored once, so the
    reference decoding (a lambda expression, evaluated outside generated code) reads a
    stored column instead of re-running the regex chain below it."""
    from ..functions.html import finish_text, markup_removed
    staged = with_computed(df, _h1_mid=markup_removed(src, profile))
    return staged.withColumn(out, finish_text("_h1_mid", profile)).drop("_h1_mid")
