"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from . import chat_format, edit_match, heap_lloyd, language_id, merge_pieces, odd_sketch, packing, quality_rules, radix_mining, token_files, toxicity, unigram, warc


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_warc": warc.op1_warc,
        "op2_token_counts": unigram.op2_token_counts,
        "op3_near_duplicates": odd_sketch.op3_near_duplicates,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_language_id": language_id.op5_language_id,
        "op6_chat_format": chat_format.op6_chat_format,
        "op7_token_files": token_files.op7_token_files,
        "op8_decontamination": edit_match.op8_decontamination,
        "op9_packing": packing.op9_packing,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_heap_lloyd": heap_lloyd.op11_heap_lloyd,
        "op12_merge_pieces": merge_pieces.op12_merge_pieces,
        "op13_radix_mining": radix_mining.op13_radix_mining,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.ORACLE, "op6_chat_format": chat_format.ORACLE, "op11_heap_lloyd": heap_lloyd.ORACLE, "op13_radix_mining": radix_mining.ORACLE}
