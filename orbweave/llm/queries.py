"""The numbered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orbweave.llm import bilinear_lm, cube_mix, curve_ann, lang_masks, ngram_join, pair_index_bpe, scaled_sketch, suffix_dedup, target_resampling, token_alignment, token_fertility, toxic_cnn, warc_split

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op10_warc_split": warc_split.query,
    "op9_cube_mix": cube_mix.query,
    "op3_scaled_sketch": scaled_sketch.query,
    "op6_lang_masks": lang_masks.query,
    "op7_toxic_cnn": toxic_cnn.query,
    "op4_ngram_join": ngram_join.query,
    "op5_suffix_dedup": suffix_dedup.query,
    "op2_bilinear_lm": bilinear_lm.query,
    "op1_curve_ann": curve_ann.query,
    "op8_pair_index_bpe": pair_index_bpe.query,
    "op11_token_alignment": token_alignment.query,
    "op12_target_resampling": target_resampling.query,
    "op13_token_fertility": token_fertility.query,
}

ORACLES: dict[str, str] = {
    "op10_warc_split": warc_split.SQL,
    "op4_ngram_join": ngram_join.SQL,
    "op5_suffix_dedup": suffix_dedup.SQL,
    "op12_target_resampling": target_resampling.SQL,
}
