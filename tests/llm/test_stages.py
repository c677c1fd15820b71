"""Every stage of the pipeline on odd, empty and clashing tables."""

import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, ODD

import corpus_pipeline as pipe

LONG = " ".join(f"word{i}" for i in range(400))
#: Names that operators use inside, in both cases.
CLASHES = ["fp", "_row", "row", "set", "Size", "target", "copies", "source_size", "kept", "REJECTED_BY", "spans", "ident", "n", "counts", "__carried_0", "piece"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [*ODD, (30, LONG, "en", "a", 1), (31, LONG, "en", "a", 1), (32, LONG + " ann@mail.example.org", None, None, None), (None, LONG.replace("word7", "other"), "en", "b", 3)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name, stage", pipe.STAGES)
def test_empty_tables(spark, table, name, stage):
    out = stage(spark, table.limit(0), "")
    assert out.count() == 0 and (name == pipe.STAGES[-1][0] or out.columns == table.columns)


@pytest.mark.parametrize("name, stage", pipe.STAGES)
def test_columns_that_clash_stay(spark, table, name, stage):
    wide = table
    for i, c in enumerate(CLASHES):
        wide = wide.withColumn(c, F.concat(F.lit(f"mine {i} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    narrow, out = stage(spark, table, ""), stage(spark, wide, "")
    if name == pipe.STAGES[-1][0]:
        assert set(CLASHES) <= set(out.columns)
    else:
        assert out.columns == wide.columns
    got = out.collect()
    assert all(r[c] == f"mine {i} {r.doc_id if r.doc_id is not None else 'null'}" for r in got for i, c in enumerate(CLASHES))
    assert sorted(map(repr, out.select(*narrow.columns).collect())) == sorted(map(repr, narrow.collect())) and len(got) > 0


def test_what_each_stage_makes_of_odd_rows(spark, table):
    by = dict(pipe.STAGES)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=lambda i: (i is None, i))
    assert ids(by["quality rules"](spark, table, "")) == [30, 31, 32, None]
    assert ids(by["SimHash near-dedup"](spark, table, "")) == [1, 4, 5, 6, 8, 9, 30]
    masked = {r.doc_id: r for r in by["PII"](spark, table, "").collect() if r.doc_id != 6}
    assert masked[1].text is None and masked[1].n_chars is None and masked[32].text == LONG + " <EMAIL>" and masked[32].n_chars == len(masked[32].text) and masked[4].text == ODD[3][1]
    mixed = by["mixing"](spark, table, "").collect()
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in table.collect()} and mixed
    coded = {r.doc_id: r for r in by["byte-level BPE"](spark, table, "").collect() if r.doc_id != 6}
    assert "text" not in by["byte-level BPE"](spark, table, "").columns and coded[1].n_tokens == 0 and bytes(coded[1].ids) == b"" and coded[30].n_tokens > 400
