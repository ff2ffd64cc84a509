import __spark_entry__
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from geostride.llm import mixing, packing, pii

from geostride.session import materialize

from .cases import SCHEMA, empty, odd_documents, save
from .test_joins import families, plain_components
from .test_text_ops import check_packing


def documents():
    words = {"en": "the of and this that with", "fr": "le la les des une avec"}
    texts = families(seed=3, groups=10, copies=4)
    rows = []
    for k, t in texts.items():
        lang = ("en", "fr")[k % 2]
        body = None if t is None else f"{t} {' '.join(words[lang].split() * (len(t) // 8))}"
        rows.append((k, body, lang, f"src{k % 3}", len(body or ""), 0.0, 0))
    rows.append((9000, "the of and this that with mail a@b.cc or +1 (651) 555-8500 the of and", "en", "src1", 10, 0.0, 0))
    return rows


def test_stages_do_what_their_operators_decide(spark, tmp_path):
    rows = documents()
    path = save(spark.createDataFrame(rows, SCHEMA), tmp_path)
    docs = spark.read.parquet(f"{path}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    before = {r.doc_id: r for r in docs.collect()}
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, path)
        result.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        out[name] = docs
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    accepted = {r.doc_id for r in out["language_id"].collect()}
    assert {k for k, r in before.items() if not r.text} & accepted == set() and len(accepted) >= len(before) - 5
    comp = plain_components({k: before[k].text for k in accepted})
    assert {r.doc_id for r in out["near_duplicates"].collect()} == {c for _, c in comp.values()}
    for r in out["pii"].collect():
        assert r.text == before[r.doc_id].text or r.doc_id == 9000
        assert r.n_chars == before[r.doc_id].n_chars or r.n_chars == len(r.text)
    assert "[EMAIL] or [PHONE]" in out["pii"].filter("doc_id = 9000").first().text
    taken = {r.doc_id: r.reps for r in mixing.mix(out["pii"]).collect() if r.reps}
    assert {r.doc_id: r["count"] for r in out["mixing"].groupBy("doc_id").count().collect()} == taken
    check_packing(out["packing"].collect())
    assert out["packing"].filter("piece = 0").count() == sum(taken.values())


def test_run_gives_the_packed_pieces(spark, tmp_path):
    path = save(spark.createDataFrame(documents(), SCHEMA), tmp_path)
    rows = corpus_pipeline.run(spark, path).collect()
    check_packing(rows)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in __spark_entry__.queries()["pipeline"](spark, path).collect())
    assert corpus_pipeline.run(spark, empty(spark, tmp_path / "none")).count() == 0


def test_run_takes_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows and keys, very long texts, and columns of the operators' own names."""
    odd = odd_documents(spark)
    odd = odd.union(odd.filter("doc_id in (5, 17)")).union(odd.filter("doc_id in (6, 9)").withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.union(spark.createDataFrame([(17, "another text under a key that is there already", None, None, None, None, None)], SCHEMA))
    path = save(odd.selectExpr("*", "'a' as spans", "'b' as cut", "1 as key", "'c' as lang_pred", "2 as reps"), tmp_path)
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, path), f"odd-{name}")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept = docs
    rows = corpus_pipeline.run(spark, path).collect()
    check_packing(rows)
    assert sorted((r.doc_id or -1) for r in rows if r.piece == 0) == sorted((r.doc_id or -1) for r in kept.collect())


def test_redaction_keeps_clean_texts(spark):
    docs = spark.createDataFrame([(1, "clean text 12 34"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(map(tuple, pii.redact(docs).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


@pytest.mark.parametrize("n", range(1, 11))
def test_one_query_for_each_operator(n):
    assert sum(name.startswith(f"op{n}_") for name in __spark_entry__.queries()) == 1


def test_capacity_is_never_passed(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") * 37 % 900 + 1).cast("int")).alias("text"))
    assert check_packing(packing.pack(docs, capacity=256).collect(), 256) > 0
