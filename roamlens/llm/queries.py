"""The registered queries of this package."""

from __future__ import annotations

from roamlens.llm import benchmark, credentials, golay, infill, lines, minhash, mixing, pii, quality, subwords, suffix, voters, whitening

QUERIES = {
    "op1_robust_outliers": quality.query,
    "op2_subword_quality": subwords.query,
    "op3_fuzzy_lines": lines.query,
    "op4_column_wise_bwt": suffix.query,
    "op5_minhash_bayes": minhash.query,
    "op6_linked_credentials": credentials.query,
    "op7_pivotal_mixing": mixing.query,
    "op8_pii_surrogates": pii.query,
    "op9_weak_supervision": voters.query,
    "op10_pigeonhole_decontamination": benchmark.query,
    "op11_rotated_infill": infill.query,
    "op12_chebyshev_whitening": whitening.query,
    "op13_golay_simhash": golay.query,
}
ORACLES: dict[str, str] = {"op11_rotated_infill": infill.SQL}
