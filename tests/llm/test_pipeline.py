"""The pipeline's stages against brute force, and the queries' registration."""

import hashlib
import random

import numpy as np

import corpus_pipeline
from tests.conftest import TINY
from tests.llm.test_operators import jaccard_classes, removed
from tidemill.llm import registry
from tidemill.llm.common import stored


def test_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    start = spark.read.parquet(f"{TINY}/documents.parquet")
    docs, kept = start, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, TINY), name)
        kept.append(docs)
        if name != "bpe_encode":
            assert docs.columns == start.columns
    language, distinct, cut, mixed, encoded = kept
    assert language.count() == start.filter("text rlike '[A-Za-z]'").count()
    rows = [(r.doc_id, r.text) for r in language.collect()]
    classes = jaccard_classes(rows)
    assert sorted(r.doc_id for r in distinct.collect()) == sorted(i for i, (c, _) in classes.items() if i == c)
    want = {i: sha for i, _, n, _, sha in removed([(r.doc_id, r.text) for r in distinct.collect()])}
    for r in cut.collect():
        whole = hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id]
        assert whole or not r.text.isascii() or "�" not in r.text
    seen = {r.doc_id for r in mixed.collect()}
    assert seen == {r.doc_id for r in cut.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_id = {r.doc_id: r.text for r in mixed.collect()}
    for r in encoded.collect():
        ids = library.encode(by_id[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert encoded.count() == mixed.count()


def test_stages_on_odd_tables(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns with the names that the stages use inside."""
    rng = random.Random(3)
    prose = [" ".join(rng.choice(["der", "the", "cat", "dog", "house", "haus", "und", "and", "of", "river"]) + str(rng.randint(0, 50)) for _ in range(rng.randint(5, 120))) for _ in range(60)]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t), i, "x", "y") for i, t in enumerate(prose)]
    rows += [rows[0], rows[1], (2, prose[5] + " more", None, None, None, None, None, None), (None, prose[7], "en", "s0", 1, 1, "x", "y"), (100, None, "en", "s0", None, 1, "x", "y"), (101, "", None, None, 0, 1, "x", "y"), (102, "123 ...", "en", None, 0, 1, "x", "y"), (103, "w " * 30000, "en", "s1", 60000, 1, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rep int, ids string, _row string").repartition(3)
    found = docs
    for name, stage in corpus_pipeline.STAGES:
        before, found = found, stored(stage(spark, found, ""), name)
        if name != "bpe_encode":
            assert found.columns == docs.columns and found.schema == docs.schema
            assert found.count() > 50
        if name == "language_id":
            # rejected: no text, no letter
            assert before.count() - found.count() == 3
    assert found.columns == [*docs.columns, "bpe_ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert found.filter("size(bpe_ids) <> n_tokens").count() == 0
    nothing = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        nothing = stored(stage(spark, nothing, ""), name)
        assert nothing.count() == 0


def test_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
