"""The subpackage's registered queries; oracles where SQL can express one."""

from __future__ import annotations

from . import chat, decontaminate, langmodel, licenses, media, packing, pii, quality, simhash, warc

QUERIES = {
    "op10_pii_surrogates": pii.query,
    "op1_media_columns": media.query,
    "op2_simhash_near_dedup": simhash.query,
    "op3_quality_classifier": quality.query,
    "op4_license_scans": licenses.query,
    "op5_benchmark_decontamination": decontaminate.query,
    "op6_chat_formatting": chat.query,
    "op7_warc": warc.query,
    "op8_lm_scoring": langmodel.query,
    "op9_best_fit_packing": packing.query,
}
ORACLES: dict[str, str] = {
    "op5_benchmark_decontamination": decontaminate.ORACLE,
    "op6_chat_formatting": chat.ORACLE,
    "op7_warc": warc.ORACLE,
}
