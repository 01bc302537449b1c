import corpus_pipeline
from tests.llm.test_operators import near_by_force, repeats_by_force, sample
from tierview.llm import language


def test_stages(spark):
    df, rows = sample(spark)
    docs = df.select("doc_id", "text", "lang", "source", "n_chars")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_dedup", "suffix_dedup", "pack"]
    lettered = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= {r[0] for r in lettered}
    deduped = corpus_pipeline.minhash_dedup(spark, docs, "")
    components, _ = near_by_force(rows)
    ids = [r["doc_id"] for r in deduped.collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted(i for i, c in components.items() if i == c and i is not None) and deduped.columns == docs.columns
    stripped = corpus_pipeline.suffix_dedup(spark, docs, "").collect()
    want = [(i, len(raw.decode(errors="ignore"))) for i, _, _, raw in repeats_by_force(rows)]
    assert sorted(((r["doc_id"], r["n_chars"]) for r in stripped), key=str) == sorted(want, key=str)
    assert corpus_pipeline.pack(spark, docs, "").count() >= len(rows)


def test_empty(spark):
    docs = sample(spark, empty=True)[0].select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_rows_that_share_an_id(spark):
    """One row of a repeated id stays, the first by text; exact repeats too."""
    rows = [(1, "b c", "en", "s", 3), (1, "a b", "en", "s", 3), (2, "x y", "en", "s", 3), (2, "x y", "en", "s", 3), (3, "z", None, None, None), (None, "x y", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.minhash_dedup(spark, docs, "").collect()), key=str)
    assert kept == [(1, "a b"), (2, "x y"), (3, "z"), (None, "x y")]


def test_replacement_characters_stay(spark):
    """A removed passage that ends inside a character takes all of it; a genuine U+FFFD elsewhere stays."""
    shared = "x" * 60
    rows = [(1, shared + "é", "en", "s", 61), (2, "\ufffd kept \ufffd" + shared + "è end", "en", "s", 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    assert got == {1: (shared + "é", 61), 2: ("\ufffd kept \ufffd end", 12)}


def test_no_language_labelled(spark):
    texts = ["clean text", "¿? 12 _", "½", "中", "٣", "①", "", None]
    docs = spark.createDataFrame([(i, t, None, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["text"] for r in kept.collect()) == sorted(t for t in texts if t and language.has_letter(t)) == ["clean text", "中"]
