"""The pipeline's stages, each against what it must do to its input."""

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import op01_decontaminate, op02_pii, op05_simhash, op09_toxicity


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "encoding"]
    kept = [docs]
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, kept[-1], sf)
        out.write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
        if name != "encoding":
            assert kept[-1].columns == names
    ids = [{r[0] for r in k.select("doc_id").collect()} for k in kept]
    model = op09_toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rated = {r["doc_id"]: r["toxicity"] for r in op09_toxicity.scored(docs.select("doc_id", "text"), model).collect()}
    assert ids[1] == {i for i, s in rated.items() if s < 0.5}
    same = {r["doc_id"]: r["component_id"] for r in op05_simhash.classes(kept[1]).collect()}
    assert ids[2] == {i for i, c in same.items() if i == c}
    leaks = {r["doc_id"] for r in op01_decontaminate.leaks(kept[2], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids[3] == ids[2] - leaks
    assert ids[4] == ids[3] == ids[5] and op02_pii.annotate(kept[4]).filter(F.size("pii_spans") > 0).count() == 0
    assert kept[4].filter("n_chars <> length(text)").count() == 0
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in kept[4].collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in kept[5].collect()} == {i: sp.encode(t) for i, t in texts.items()}


def test_stages_edges(spark, sf):
    """Nulls in every column, empty and long texts, repeated rows, clashing columns, empty tables: what each stage says it does."""
    long = "many words of a long text that goes on and on " * 20000
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows = [
        (1, "the first of the texts that are here", "en", "a", 36, 7), (1, "the first of the texts that are here", "en", "a", 36, 7), (2, "the first of the texts that are here", "en", None, None, 8),
        (3, None, None, None, None, None), (4, "", "", "", 0, 0), (None, "a text that has no id of its own", "en", "b", 1, 1), (None, None, None, None, None, None),
        (5, long, "en", "c", len(long), 2), (6, f"what was before {item} and what came after", "en", "c", 1, 3), (7, "write to a@b.org or call +49 170 1234567", "en", "c", 1, 4),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `__text` long")
    stages = dict(corpus_pipeline.STAGES)
    key = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), sf).count() == 0, name
        if name != "encoding":
            assert f(spark, docs, sf).columns == docs.columns
    kept = stages["toxicity"](spark, docs, sf)
    assert key(kept) == key(docs)
    one = key(stages["near_duplicates"](spark, docs, sf))
    assert one == key(docs.filter("doc_id IN (3, 5, 6, 7) OR doc_id IS NULL AND text IS NOT NULL").unionByName(docs.filter("doc_id = 1").limit(1)))
    clean = key(stages["decontamination"](spark, docs, sf))
    assert clean == key(docs.filter("doc_id IS NULL OR doc_id <> 6"))
    masked = {r["doc_id"]: (r["text"], r["n_chars"], r["__text"]) for r in stages["personal_data"](spark, docs.filter("doc_id IS NOT NULL"), sf).collect()}
    assert masked[7] == ("write to [EMAIL] or call [PHONE]", 32, 4) and masked[3] == ("", 0, None) and masked[5] == (long, len(long), 2)
    ids = sorted(((r["doc_id"], len(r["ids"])) for r in stages["encoding"](spark, docs, sf).collect()), key=str)
    assert len(ids) == len(rows) and (3, 0) in ids and (None, 0) in ids
