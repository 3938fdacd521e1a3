"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from shoebox.llm import byte_bpe, decontaminate, lattice_lm, line_dedup, media, quality, secrets, simhash, substring_dedup, toxicity


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_quality": quality.op2_quality,
        "op3_simhash": simhash.op3_simhash,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_media_columns": media.op6_media_columns,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_lattice_lm": lattice_lm.op8_lattice_lm,
        "op9_byte_bpe": byte_bpe.op9_byte_bpe,
        "op10_secret_scan": secrets.op10_secret_scan,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op4_substring_dedup": substring_dedup.SQL}
