from collections import Counter

import corpus_pipeline as c
from noteloom.llm import base, langid, mixing, secrets_scan

from .conftest import DIR, needs_tables
from .test_jaccard import brute as components
from .test_python_operators import check_packing, plain_ids


def test_stages():
    assert [n for n, _ in c.STAGES] == ["language_id", "near_copies", "secrets", "mix", "pack"]


@needs_tables
def test_each_stage_on_its_input(spark):
    docs = base.table(spark, DIR, "documents")
    kept = base.keep(c.identify_language(spark, docs, DIR), "one")
    assert kept.columns == c.COLUMNS
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in kept.collect()} >= {k for k, t in texts.items() if t and len(t) > 200}

    single = base.keep(c.drop_near_copies(spark, kept, DIR), "two")
    want = {k for k, _, comp in components([(r["doc_id"], r["text"]) for r in kept.collect()]) if k == comp}
    assert {r["doc_id"] for r in single.collect()} == want and single.count() == len(want)

    clean = base.keep(c.redact_secrets(spark, single, DIR), "three")
    assert clean.columns == c.COLUMNS and clean.count() == single.count()
    assert secrets_scan.scan(clean).where("n_assign + n_access + n_hex + n_entropy > 0").count() == 0
    before = {r["doc_id"]: r for r in single.collect()}
    for r in clean.collect():
        assert r == before[r["doc_id"]] or "[REDACTED]" in r["text"] and r["n_chars"] == len(r["text"])

    mixed = base.keep(c.mix_sources(spark, clean, DIR), "four")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_documents(clean).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == +Counter(copies)

    one = mixed.coalesce(1)
    check_packing(one, c.pack_sequences(spark, one, DIR).collect())


def test_odd_rows_pass_through(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in c.STAGES:
            docs = base.keep(stage(spark, docs, DIR), "stage")
        assert docs.count() >= 0


@needs_tables
def test_run_against_brute_force(spark):
    """The whole run: languages by single predictions, components by all pairs, the mix by its SQL, plain tokenizer ids."""
    import duckdb

    docs = base.table(spark, DIR, "documents")
    model, letters = langid.fit(docs), langid.letter_table()
    said = {(r["doc_id"], r["text"]): model.predict(r["text"], letters) for r in docs.collect()}
    kept = [k for k, (lang, _, coverage) in said.items() if lang != "und" and coverage >= c.LEAST_COVERAGE]
    single = {k for k, _, comp in components(kept) if k == comp}
    clean = secrets_scan.redact(docs.where(docs.doc_id.isin(list(single)))).toPandas()
    con = duckdb.connect()
    con.register("documents", clean)
    copies = {k: n for k, n in con.sql(f"SELECT doc_id, copies FROM ({mixing.ORACLE})").fetchall() if n}
    tokens = {r.doc_id: len(plain_ids(r.text)) for r in clean.itertuples()}
    got = c.run(spark, DIR).collect()
    assert {r["doc_id"] for r in got} == set(copies) and all(r["doc_tokens"] == tokens[r["doc_id"]] for r in got)
    placed = Counter()
    for r in got:
        placed[r["doc_id"]] += r["length"]
    assert placed == Counter({k: n * tokens[k] for k, n in copies.items()})
