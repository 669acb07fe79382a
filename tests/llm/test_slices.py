import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import append_columns, slices

texts = st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=40)


@given(st.lists(texts, max_size=3), st.integers(1, 9), st.integers(1, 60))
def test_slices_are_the_batches_in_small_pieces(batches, most_rows, most_bytes):
    made = [pa.RecordBatch.from_arrays([pa.array(range(len(b)), pa.int64()), pa.array(b, pa.string())], ["i", "t"]) for b in batches]
    out = list(slices(iter(made), 1, most_rows, most_bytes))
    assert [r for b in out for r in b.to_pylist()] == [r for b in made for r in b.to_pylist()]
    size = lambda b: [len((t or "").encode()) for t in b.column(1).to_pylist()]
    assert all(0 < b.num_rows <= most_rows and sum(size(b)[:-1]) < most_bytes for b in out)


def test_appended_columns_see_few_rows(spark):
    df = spark.range(3000).select("id", F.repeat(F.lit("x"), 2000).alias("text")).coalesce(1)
    out = append_columns(df, ["text"], [T.StructField("rows", T.LongType())], lambda t: [pa.array([len(t)] * len(t), pa.int64())])
    assert out.count() == 3000 and out.agg(F.max("rows")).first()[0] <= 525
