"""The pipeline's stages, each on what the one before kept, against plain versions of the same decisions."""

import corpus_pipeline
from tallyloom.llm import pii, toxicity

from test_operators import plain_components, plain_fingerprint, plain_hits, plain_spans

SMALL = "/root/testdata/sf0.001"


def plain_redacted(text):
    out, at = "", 0
    spans = sorted((int(a), ["email", "ip", "card", "phone"].index(k), int(b), k) for k, a, b in (s.split(":") for s in plain_spans(text)))
    for a, _, b, kind in spans:
        if a >= at:
            out += text[at:a] + f"<{kind}>"
        at = max(at, b)
    return out + text[at:]


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")

    def not_toxic(rows, docs):
        kept = {r["doc_id"] for r in toxicity.classify(docs, labels).where("predicted = 0").collect()}
        return {i: t for i, t in rows.items() if i in kept}

    def one_of_each(rows, _):
        roots = plain_components({i: plain_fingerprint(t) for i, t in rows.items()})
        return {i: rows[i] for i in set(roots.values())}

    def clean(rows, _):
        hits = plain_hits(rows.items(), benchmark)
        return {i: t for i, t in rows.items() if not hits[i][4]}

    def redacted(rows, _):
        return {i: t and plain_redacted(t) for i, t in rows.items()}

    columns = docs.columns
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (not_toxic, one_of_each, clean, redacted)):
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        want = plain(rows, docs)
        docs = stage(spark, docs, SMALL).checkpoint()
        assert docs.columns == columns, name
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == want, name
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["text"] is not None)
    assert docs.groupBy("doc_id").count().where("count > 1").count() == 0
    assert pii.find(docs).where("spans <> ''").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
