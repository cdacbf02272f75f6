"""The corpus pipeline: language, lines, near duplicates, contamination, mixing."""

from __future__ import annotations

from beltline.llm import stages
from beltline.llm.frames import stored, table

STAGES = [
    ("language", stages.language),
    ("lines", stages.lines),
    ("near_duplicates", stages.near_duplicates),
    ("uncontaminated", stages.uncontaminated),
    ("mixture", stages.mixture),
]
ORACLE_SQL = None  # trained models and sketches have no SQL; tests/llm holds each stage against brute force


def run(spark, sf_dir: str):
    """All stages in order over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
