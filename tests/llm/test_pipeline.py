import corpus_pipeline
from cases import DOCS, counted, docs, prose
from oracle import duck, same
from pyspark.sql import functions as F

from rill.llm import queries
from rill.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_act(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        out.write.mode("overwrite").saveAsTable(f"rill_{len(seen)}")
        docs = spark.table(f"rill_{len(seen)}")
        seen.append(docs.count())
    assert seen[0] < table(spark, SF, "documents").count() and seen[1] < seen[0] and seen[2] == seen[1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == seen[3]


def test_run_is_the_stages_in_a_row_and_repeats(spark):
    place = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, SF).select(place).collect())) for _ in range(2))
    assert a == b and a


def odd(spark, rows):
    """Odd rows with the columns of documents, and some that clash with the operators' own."""
    return docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") > 3, "en")).withColumn("n_chars", F.length("text").cast("long"))


def test_stages_on_odd_rows(spark):
    rows = [*DOCS, *((None, prose(i, 40), "a") for i in range(30)), *[(50, prose(50, 40), None)] * 5]
    frame = odd(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns, name
        kept = out.collect()
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept), name
        if name == "secret scans":
            assert counted(kept) == counted(frame.collect())
        if name == "near duplicates":
            texts = [" ".join((r.text or "").lower().split()) for r in kept]
            assert len(texts) == len(set(texts)) and {r.doc_id for r in kept} >= {-20, -21, 3, 4, 5}
            assert sum(r.doc_id is None and r.text is not None for r in kept) == 30  # one of them is in DOCS as well
        if name == "quality rules":
            assert all(len(r.text.split()) >= 10 for r in kept) and sum(r.doc_id is None for r in kept) >= 25
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
    assert packed.where("piece = 0").count() == len(rows)


def test_stages_on_no_rows(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd(spark, []), SF).count() == 0, name


def test_queries_with_sql_match_it(spark):
    for name, sql in queries.ORACLES.items():
        same(queries.QUERIES[name](spark, SF), sql, duck(SF))
