"""Every found query over tables that are empty, full of nulls, repeated, or carry clashing columns."""

import pytest
from pyspark.sql import functions as F

from lexiloom.llm.queries import queries

SRC = "/root/testdata/sf0.001"
TABLES = "documents chunks vectors transcript_segments transcripts keyframes citations gap_records turn_insights map_clusters chunk_limits pack_capacities".split()
SMALL = {"map_clusters", "chunk_limits", "pack_capacities"}
IDS = {"documents": "doc_id", "chunks": "chunk_id", "vectors": "vec_id", "transcript_segments": "segment_id", "transcripts": "transcript_id", "keyframes": "keyframe_id", "citations": "citation_id", "gap_records": "gap_id", "turn_insights": "turn_id"}
NAMES = [f"p{n}_found" if n not in (8, 9) else {8: "p8_ids", 9: "p9_packing"}[n] for n in range(1, 11)]


def write(spark, folder, change):
    for t in TABLES:
        df = spark.read.parquet(f"{SRC}/{t}.parquet")
        (df if t in SMALL else change(df, t)).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), lambda df, t: df.limit(0))


@pytest.fixture(scope="module")
def nulls(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("nulls"), lambda df, t: df.select(*[F.col(c) if c == IDS[t] else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns]))


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    extra = "id n unit term tf tbl grp words pos rank label kind part key a b c v s h rep cls size tokens looks score keep count text_ first last own used".split()

    def change(df, t):
        more = {c: F.lit("x") for c in extra if c not in df.columns}
        return df.withColumns(more) if t == "documents" else df.withColumns(more).union(df.withColumns(more))

    return write(spark, tmp_path_factory.mktemp("clashing"), change)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_nulls_in_every_column_are_no_cases(spark, nulls, name):
    got = queries()[name](spark, nulls)
    n = spark.read.parquet(f"{nulls}/documents.parquet").count()
    if name == "p8_ids":
        assert got.where(F.size("ids") == 0).count() == n
    elif name == "p9_packing":
        assert got.where("tokens = 0").count() == 3 * n
    else:
        assert got.count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_repeated_rows_and_clashing_columns_change_nothing(spark, clashing, name):
    f = queries()[name]
    assert rows(f(spark, clashing)) == rows(f(spark, SRC))
