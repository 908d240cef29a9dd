"""The pipeline's stages one after another against what each should keep."""

import corpus_pipeline
from quarry.llm.common import Scratch
from tests.llm.test_dedup import brute
from tests.llm.test_models import toxic_rows

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    data, labels = toxic_rows(800)
    docs = [(k, t, "en", "s", len(t)) for k, t, *_ in data]
    clean = [d for d, v in zip(docs, (v for _, v in labels), strict=True) if not v]
    docs += [(1000 + k, d[1].upper(), "en", "s", d[4]) for k, d in enumerate(clean[:20])]  # copies: the larger id stays
    docs += [(2000 + k, d[1] + " indeed", "en", "s", d[4]) for k, d in enumerate(clean[20:60])]
    docs += [(3000, "123 ... 456", None, "s", 3), (3001, None, None, None, None)]
    folder = Scratch(spark, "pipeline-test").path
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    scratch, now, seen = Scratch(spark, "stages"), spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = scratch.write(stage(spark, now, folder), name)
        assert now.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        seen[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    toxic = {k for k, v in labels if v}
    assert {d[0] for d in docs} - toxic <= set(seen["toxicity"])
    assert len(toxic & set(seen["toxicity"])) <= 0.05 * len(toxic)
    assert set(seen["language_id"]) == set(seen["toxicity"]) - {3000, 3001}
    last = {}
    for d, t in seen["language_id"].items():
        last[t.lower()] = max(d, last.get(t.lower(), -1))
    assert set(seen["exact_dedup"]) == set(last.values())
    components = brute(list(seen["exact_dedup"].items()))
    assert set(seen["jaccard_join"]) == {c for _, c in components.values()}
    packed = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(seen["jaccard_join"])


def test_stages_on_empty_tables_and_clashing_columns(spark):
    """Every stage takes an empty table, int ids and columns with names that the operators use inside, and gives the same columns back."""
    columns = "doc_id int, text string, lang string, source string, n_chars long, _id string, _map string, digest string"
    folder = Scratch(spark, "pipeline-edge").path
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    data = [(k, f"plain words of text number {k} stand here", "en", "s", 30, "i", "m", "d") for k in range(6)]
    for rows in ([], data):
        docs = spark.createDataFrame(rows, columns)
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, folder)
            assert out.schema == docs.schema and out.count() == len(rows)
        assert corpus_pipeline.STAGES[4][1](spark, docs, folder).count() == len(rows)
