"""The registered queries of this package, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from . import chat, fim, html_main, jaccard_join, langid, media, mixing, order_minhash, packing, pii, secrets_scan, spelling, window_dedup
from .base import table


def op1_order_minhash(spark, sf_dir):
    return order_minhash.fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_mixing(spark, sf_dir):
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op3_html_main_text(spark, sf_dir):
    return html_main.extract(table(spark, sf_dir, "pages"))


def op4_chat_formatting(spark, sf_dir):
    return chat.render_conversations(table(spark, sf_dir, "conversations"))


def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op7_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_secret_scan(spark, sf_dir):
    return secrets_scan.scan(table(spark, sf_dir, "documents"))


def op9_pii(spark, sf_dir):
    return pii.scan(table(spark, sf_dir, "documents"))


def op10_media(spark, sf_dir):
    return media.features(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark, sf_dir):
    return fim.digests(fim.transform(table(spark, sf_dir, "documents")))


def op12_substring_dedup(spark, sf_dir):
    return window_dedup.digests(window_dedup.without_repeats(table(spark, sf_dir, "documents")))


def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(spelling.counted_words(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_order_minhash, op2_mixing, op3_html_main_text, op4_chat_formatting, op5_jaccard_join, op6_language_id, op7_packing, op8_secret_scan, op9_pii, op10_media,
        op11_fill_in_middle, op12_substring_dedup, op13_spelling_variants,
    )
}
ORACLES = {
    "op2_mixing": mixing.ORACLE, "op4_chat_formatting": chat.ORACLE, "op5_jaccard_join": jaccard_join.ORACLE, "op11_fill_in_middle": fim.ORACLE,
    "op12_substring_dedup": window_dedup.ORACLE, "op13_spelling_variants": spelling.ORACLE,
}
