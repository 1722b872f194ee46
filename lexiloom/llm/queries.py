"""The pN_ queries: (spark, folder) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from .turns import speaker_turns

    turns = speaker_turns(table(spark, d, "transcript_segments"), with_text=False)
    return turns.where("part = 0").select("media_id", "first_segment_id", "last_segment_id")


def p1_turns(spark: SparkSession, d: str) -> DataFrame:
    from .turns import speaker_turns

    return speaker_turns(table(spark, d, "transcript_segments"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from .neighbours import mutual_pairs, near_pairs

    return mutual_pairs(near_pairs(table(spark, d, "vectors"), least=0.92, k=10), k=10)


def p2_knn(spark: SparkSession, d: str) -> DataFrame:
    from .neighbours import query_neighbours

    return query_neighbours(table(spark, d, "vectors"), lambda i: i % 100 == 0)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from .distinctive import score_terms

    scores = score_terms(table(spark, d, "chunks"), min_letters=5, wide=False, min_tf=3)
    return scores.where("tf >= 3 and df <= 5").select("chunk_id", "term")


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    from .distinctive import score_terms

    return score_terms(table(spark, d, "chunks"))


def p3_keywords(spark: SparkSession, d: str) -> DataFrame:
    from .distinctive import group_keywords, score_terms

    member = table(spark, d, "vectors").select(F.col("vec_id").alias("chunk_id"), "cluster_id")
    words = group_keywords(score_terms(table(spark, d, "chunks"), min_letters=4), member, "chunk_id", "cluster_id")
    return table(spark, d, "map_clusters").select("cluster_id").join(words, "cluster_id", "left")


def _scans(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "keyframes").select(F.lit("keyframes").alias("tbl"), F.col("keyframe_id").alias("record_id"), F.col("media_id").alias("grp"), F.col("ocr_text").alias("text"))
    return frames.union(table(spark, d, "citations").select(F.lit("citations"), "citation_id", "source_name", "text"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from .scans import defects, repair_scans

    return defects(repair_scans(_scans(spark, d), with_text=False))


def p4_text(spark: SparkSession, d: str) -> DataFrame:
    from .scans import repair_scans

    return repair_scans(_scans(spark, d)).select("tbl", "record_id", "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from .grouping import group_vectors, wrong_members

    return wrong_members(group_vectors(table(spark, d, "vectors")))


def p5_points(spark: SparkSession, d: str) -> DataFrame:
    from .grouping import group_ids, group_vectors

    g = group_vectors(table(spark, d, "vectors"))
    return g.join(group_ids(g), "grp", "left").select(F.col("id").alias("vec_id"), "grp", "cluster_id", "closeness")


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    from .grouping import describe_groups, group_vectors

    return describe_groups(group_vectors(table(spark, d, "vectors")))


def _language_records(spark: SparkSession, d: str) -> DataFrame:
    gaps = table(spark, d, "gap_records").select(F.lit("gap_records").alias("tbl"), F.col("gap_id").alias("record_id"), F.lit(None).cast("string").alias("host"), F.col("lang").alias("label"), F.col("query_text").alias("text"))
    turns = table(spark, d, "turn_insights").select(F.lit("turn_insights"), "turn_id", F.col("session_id").cast("string"), "lang", F.array_join("queries", "\n"))
    texts = table(spark, d, "transcripts").select(F.lit("transcripts"), "transcript_id", "media_id", "lang", "text")
    return gaps.union(turns).union(texts).where("record_id is not null")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from .languages import found_cases, language_parts

    return found_cases(language_parts(_language_records(spark, d)))


def p6_parts(spark: SparkSession, d: str) -> DataFrame:
    from .languages import language_parts

    out = language_parts(_language_records(spark, d))
    return out.select("tbl", "record_id", "lang", "confidence", "mixed", F.explode_outer("parts").alias("p")).select("tbl", "record_id", "lang", "confidence", "mixed", F.col("p.start").alias("part_start"), F.col("p.end").alias("part_end"), F.col("p.lang").alias("part_lang"), F.col("p.confidence").alias("part_confidence"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from .splitting import split_oversized

    pieces = split_oversized(table(spark, d, "chunks"), table(spark, d, "chunk_limits"))
    found = pieces.groupBy("chunk_id").agg(F.collect_set("hard_start").alias("h"))
    hard = F.filter("h", lambda x: x >= 0)
    return found.select("chunk_id", F.explode(F.when(F.size(hard) > 0, hard).otherwise(F.array(F.lit(-1)))).alias("hard_start"))


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    from .splitting import place_in_documents, split_oversized

    pieces = split_oversized(table(spark, d, "chunks"), table(spark, d, "chunk_limits"))
    return place_in_documents(pieces, table(spark, d, "documents"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    from .encoding import encode_corpus

    return encode_corpus(table(spark, d, "documents"))


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    from .encoding import token_counts
    from .packing import pack

    caps = [(r[0], r[1]) for r in table(spark, d, "pack_capacities").select("capacity_id", "max_tokens").collect()]
    out = pack(token_counts(table(spark, d, "documents")), caps, "doc_id", "tokens")
    return out.withColumnRenamed("first_unit", "first_token").withColumnRenamed("units", "tokens")


def p9_space(spark: SparkSession, d: str) -> DataFrame:
    """(capacity_id, containers, filled): how many containers of each capacity are used, and the share of their space that is."""
    caps = table(spark, d, "pack_capacities").select("capacity_id", "max_tokens")
    each = p9_packing(spark, d).groupBy("capacity_id", "container_id").agg(F.sum("tokens").alias("used"))
    sums = each.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("used"))
    return sums.join(caps, "capacity_id").select("capacity_id", "containers", (F.col("used") / (F.col("containers") * F.col("max_tokens"))).alias("filled"))


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    from .quality import quality_statistics

    return quality_statistics(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_stats(spark, d).where("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}
