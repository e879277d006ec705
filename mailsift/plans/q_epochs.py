"""Registered query: training in epochs over the prepared corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators.epochs import NUM_FEATURES, fit_epochs
from ..session import scratch_path
from .corpus import prepare_corpus
from .q_corpus import BALANCED_SQL
from .registry import register

EPOCHS, BATCHES, RATE, DECAY = 3, 2, 2.0, 0.01


def _epochs_sql() -> str:
    """The same training written out step by step."""
    def probability(weights: str, where: str) -> str:
        return (f"SELECT doc_id, any_value(label) AS label, 1 / (1 + exp(-sum(x * w))) AS p "
                f"FROM ft JOIN {weights} USING (idx) WHERE {where} GROUP BY doc_id")
    ctes = [BALANCED_SQL + f""",
tok AS (SELECT doc_id, label, part, CAST(('0x' || substring(md5(token), 1, 8)) AS BIGINT) % {NUM_FEATURES} AS idx FROM
  (SELECT doc_id, label, part, unnest(regexp_extract_all(lower(email_text), '{P.TOKEN_PATTERN}')[1:{P.MAX_TOKENS}]) AS token FROM corpus) u),
tf AS (SELECT doc_id, label, part, idx, CAST(count(*) AS DOUBLE) AS tf FROM tok GROUP BY ALL),
ft AS MATERIALIZED (SELECT doc_id, label, part, idx, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)) AS x FROM tf
  UNION ALL SELECT doc_id, label, part, {NUM_FEATURES}, CAST(1 AS DOUBLE) FROM corpus),
w0 AS MATERIALIZED (SELECT DISTINCT idx, CAST(0 AS DOUBLE) AS w FROM ft)"""]
    results, k = [], 0
    for e in range(1, EPOCHS + 1):
        for b in range(BATCHES):
            draw = f"CAST(('0x' || substring(md5('epoch{e}:{P.SEED}:' || doc_id || ':batch'), 1, 8)) AS BIGINT) % {BATCHES} = {b}"
            train = f"part = 'train' AND {draw}"
            ctes.append(f"""m{k} AS MATERIALIZED ({probability(f"w{k}", train)}),
g{k} AS (SELECT idx, sum((p - m{k}.label) * x) / (SELECT count(*) FROM m{k}) AS g FROM ft JOIN m{k} USING (doc_id) GROUP BY idx),
w{k + 1} AS MATERIALIZED (SELECT w{k}.idx, w - {RATE} * (coalesce(g, 0) + CASE WHEN w{k}.idx < {NUM_FEATURES} THEN {DECAY} * w ELSE 0 END) AS w
  FROM w{k} LEFT JOIN g{k} USING (idx))""")
            k += 1
        ctes.append(f"""t{e} AS ({probability(f"w{k}", "part = 'train'")}),
v{e} AS ({probability(f"w{k}", "part = 'val'")})""")
        loss = "avg(-ln(CASE WHEN label = 1 THEN p ELSE 1 - p END))"
        results.append(f"""SELECT CAST({e} AS BIGINT) AS epoch, (SELECT round({loss}, 6) FROM t{e}) AS train_loss, round({loss}, 6) AS val_loss,
  round(coalesce(count(*) FILTER (WHERE label = 1 AND p > 0.5) / nullif(count(*) FILTER (WHERE label = 1), 0), 0.0), 6) AS recall,
  round(count(*) FILTER (WHERE (label = 1) = (p > 0.5)) / count(*), 6) AS accuracy FROM v{e}""")
    return ",\n".join(ctes) + f""",
h AS ({" UNION ALL ".join(results)})
SELECT *, epoch = (SELECT epoch FROM h ORDER BY recall DESC, epoch LIMIT 1) AS best FROM h"""


@register("fit_epochs", _epochs_sql())
def fit_epochs_q(spark, base):
    """Three epochs of two steps each; loss and validation metrics per epoch, the best by recall."""
    corpus = prepare_corpus(spark, base, materialized=True)
    train, val = corpus.where(F.col("part") == "train"), corpus.where(F.col("part") == "val")
    size = -(-train.count() // BATCHES)
    fit = fit_epochs(train, val, scratch_path(spark, "epochs"), EPOCHS, size, RATE, DECAY)
    out = fit.table(spark)
    return out.select("epoch", *[F.round(c, 6).alias(c) for c in ("train_loss", "val_loss", "recall", "accuracy")], "best")
