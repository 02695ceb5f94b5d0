import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from panelweave.llm import queries
from panelweave.llm.common import stage

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = [n.split("_")[0] for n in queries.QUERIES if n.startswith("op")]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 14))
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(queries.ORACLE) <= set(__spark_entry__.oracle_sql())


def test_stages_keep_the_columns_and_drop_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, seen = docs.columns, docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = stage(step(spark, seen, SF), "test")
        assert after.columns == columns, name
        assert after.join(seen.select("doc_id"), "doc_id", "left_anti").count() == 0
        assert after.count() == after.select("doc_id").distinct().count()
        seen = after
    good = labels.filter("quality = 1 and toxic = 0").join(docs, "doc_id")
    import brute

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    unique = {i for i, (_, c) in brute.near(rows).items() if i == c} & {i for i, v in brute.exact(rows).items() if v[2]}
    clean = {r["doc_id"] for r in good.select("doc_id").collect()} & unique
    left = {r["doc_id"] for r in seen.select("doc_id").collect()}
    assert len(clean - left) <= 0.1 * len(clean)
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == left


@pytest.mark.parametrize("name", sorted(n for n in queries.ORACLE))
def test_queries_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    ours = queries.QUERIES[name](spark, SF)
    theirs = con.sql(queries.ORACLE[name])
    names = sorted(ours.columns)
    assert sorted(theirs.columns) == names
    mine = sorted(tuple(r) for r in ours.select(*names).collect())
    assert mine == sorted(tuple(r) for r in theirs.select(*names).fetchall())


def test_pipeline_stages_on_an_empty_table(spark):
    nothing = spark.read.parquet(f"{SF}/documents.parquet").filter(F.lit(False))
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, nothing, SF).count() == 0, name


def test_stages_judge_rows_and_not_ids(spark):
    """Rows without id, and rows of one id with different texts, go or stay by their own text; repeats leave one row."""
    from panelweave.llm import exact_dedup, mixing, near_dedup

    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(None, "a", "x"), (3, "a", "x"), (3, "a", "y"), (None, "unique", "x"), (None, "twice", "x"), (None, "twice", "x"), (3, "other", "x"),
                                  (3, "a ", "x"), (4, "other", "x"), (5, None, "x"), (5, " ", "x")], schema)
    for limits in ({}, {"capacity": 1, "slot_bits": 1}):
        left = exact_dedup.drop_exact_duplicates(docs, **limits)
        assert left.columns == docs.columns
        assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == [("3", "a "), ("3", "other"), ("5", " "), ("None", "twice"), ("None", "unique")]

    first, second, third = (" ".join(f"{c}{k}" for k in range(60)) for c in "pqr")
    docs = spark.createDataFrame([(3, first, "x"), (5, first + " more", "x"), (5, second, "x"), (None, second + " more", "x"), (None, third, "x")], schema)
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == [("3", first), ("5", second), ("None", third)]

    low, high = [f"ALPHA!! BETA!! GAMMA!! {k}!!" for k in range(40)], [f"alpha beta gamma delta {k}" for k in range(40)]
    rows = [(i, t, "x") for i, t in enumerate(high + low)]
    domains = mixing.fit_domains(spark.createDataFrame(rows, schema), spark.createDataFrame([(i, "high" if i < 40 else "low") for i in range(80)], "doc_id long, domain string"))
    docs = spark.createDataFrame([(None if k % 2 else 7, t, "x") for k, t in enumerate(high + low)], schema)
    mixed = mixing.mixed_rows(docs, domains, {"high": 1.0, "low": 1.0}, anchor="high", most=1.0)
    assert mixed.columns == docs.columns and {r["text"] for r in mixed.collect()} >= set(high)
    half = mixing.mixed_rows(docs, domains, {"high": 0.67, "low": 0.33}, anchor="high", most=1.0)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in half.collect())
    assert set(high) <= {t for _, t in kept} and all(0 < sum(i == n and "ALPHA" in t for i, t in kept) < 20 for n in ("7", "None"))


def test_arrow_batches_are_bounded(spark):
    """The stages with Arrow functions send texts in batches of bounded bytes, not of 10,000 rows."""
    from collections.abc import Iterator

    import pyarrow as pa

    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    @F.arrow_udf("long")
    def bytes_at_once(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([batch.nbytes] * len(batch), pa.int64())

    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 300).alias("text"))
    for k, step in ((0, corpus_pipeline.reject_toxic), (2, corpus_pipeline.reject_near_copies), (4, corpus_pipeline.pack_sequences)):
        spark.conf.unset(name)
        step(spark, docs, SF)
        largest = docs.select(bytes_at_once("text").alias("n")).agg(F.max("n")).first()[0]
        assert largest < 3 << 20, corpus_pipeline.STAGES[k][0]
    spark.conf.set(name, "1m")
    corpus_pipeline.pack_sequences(spark, docs, SF)
    assert spark.conf.get(name) == "1m"
    spark.conf.unset(name)


def test_places_are_planned_without_python_rows(spark, monkeypatch):
    """The table of places goes to Spark as Arrow: a list of rows would need Python processes of their own on every executor."""
    import pyarrow as pa
    from pyspark.sql import SparkSession

    from panelweave.llm import packing

    given, create = [], SparkSession.createDataFrame
    pieces = spark.createDataFrame([(i, 0, 1 + i % 7) for i in range(50)], "doc_id long, piece int, length long")
    monkeypatch.setattr(SparkSession, "createDataFrame", lambda self, data, *a, **b: given.append(type(data)) or create(self, data, *a, **b))
    packed = packing.pack_pieces(pieces, 10)
    assert given == [pa.Table] and packed.count() == 50
    assert packing.pack_pieces(pieces.limit(0), 10).count() == 0


def test_a_step_of_the_mix_needs_no_code_of_its_own(spark, capsys):
    """The numbers of a step are data of the plan, so that the code of one step serves all others."""
    from panelweave.llm import mixing

    rows = spark.createDataFrame([(0.25, 0.75), (1.0, 0.0)], "a double, b double")
    found = rows.select(mixing.pulled([F.col("a"), F.col("b")], [0.123456789, -2.5]).alias("slope"))
    assert [r["slope"] for r in found.collect()] == [0.0 + 0.25 * 0.123456789 + 0.75 * -2.5, 0.0 + 0.123456789 + 0.0 * -2.5]
    found.agg(F.min("slope")).explain("codegen")
    assert "0.123456789D" not in capsys.readouterr().out
