"""All registered queries (importing the modules fills the registry)."""

from __future__ import annotations

from . import (q_corpus, q_dataset, q_epochs, q_io, q_mime, q_mllib, q_model, q_rules, q_score, q_stream,  # noqa: F401
               q_synth, q_text)
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
