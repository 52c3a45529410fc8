"""The reranker as a table: features and final scores of candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from ..operators import judging

FEATURES = ["coverage", "subject", "entity", "phrase", "language", "definition", "relation", "title", "negation"]


def reranked(candidates: DataFrame, top_k: int = 8) -> DataFrame:
    """(query_id, chunk_ord, rank, final_score, features…) of candidates as plans.answer.candidates gives them."""
    schema = "query_id long, chunk_ord long, rank int, final_score double, " + ", ".join(f"{f} double" for f in FEATURES)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = judging.Asked(pdf["query"].iloc[0])
        rows = [judging.Candidate(int(r.chunk_ord), r.doc_id, r.title or "", r.text or "", r.parent_text or "", r.language, r.strategy, r.dense_score, r.bm25_score, r.rrf_score) for r in pdf.sort_values("place").itertuples()]
        ranked = judging.rerank(asked, rows, top_k)
        names = ["query_id", "chunk_ord", "rank", "final_score", *FEATURES]
        return pd.DataFrame([(int(pdf["query_id"].iloc[0]), c.chunk_ord, i + 1, round(c.final, 6), *(float(c.features[f]) for f in FEATURES)) for i, c in enumerate(ranked)], columns=names)

    return candidates.groupBy("query_id").applyInPandas(run, schema)
