"""Each operator on odd rows and on an empty table: defined results, no crash, one row per document."""

import hashlib

import pytest
from pyspark.sql import functions as F

from assayline.llm import jaccard_join, license_scan, line_dedup, mixing, neighbours, personal_data, pieces, quality_classifier, quality_rules, suffix_dedup

EMPTY = hashlib.sha256(b"").hexdigest()


def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (7, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


RUN = {
    "line_dedup": lambda d, y: line_dedup.report(d),
    "pieces": lambda d, y: pieces.digests(d, model_path()),
    "quality_rules": lambda d, y: quality_rules.apply(d, quality_rules.train(d, y)),
    "quality_classifier": lambda d, y: quality_classifier.classify(d, y),
    "suffix_dedup": lambda d, y: suffix_dedup.report(d),
    "mixing": lambda d, y: mixing.mix(d),
    "license_scan": lambda d, y: license_scan.scan(d),
    "personal_data": lambda d, y: personal_data.report(d),
    "jaccard_join": lambda d, y: jaccard_join.components(d),
}


@pytest.mark.parametrize("name", sorted(RUN))
def test_odd_rows(name, odd, labels):
    rows = RUN[name](odd, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.select("doc_id").collect())
    by = {r.doc_id: r for r in rows}
    if name == "pieces":
        assert (by[1].n_tokens, by[1].ids_sha256, by[2].decoded_sha256) == (0, EMPTY, EMPTY)
    if name == "suffix_dedup":
        assert (by[1].n_bytes, by[1].kept_sha256, by[5].n_removed, by[6].n_removed, by[9].n_removed) == (0, EMPTY, 24000, 24000, 5000)
    if name == "jaccard_join":
        assert (by[1].n_shingles, by[6].component_id, by[2].component_id, by[None].component_id) == (0, 5, 2, None)
    if name == "quality_rules":
        assert by[1].base_failed and not by[1].kept and by[5].n_repeat_words == 3000
    if name == "license_scan":
        assert (by[1].n_words, by[1].labels, by[1].first_word) == (0, "", None)
    if name == "personal_data":
        assert (by[2].base_sha256, by[2].spans) == (EMPTY, "")
    if name == "mixing":
        assert by[1].taken == 0 and all(r.taken <= 3 * r.size for r in rows)
    if name == "line_dedup":
        assert (by[1].n_lines, by[1].n_removed, by[6].n_removed, by[5].n_removed, by[None].n_removed) == (1, 0, 1, 0, 0)


@pytest.mark.parametrize("name", sorted(RUN))
def test_empty_table(name, none, no_labels):
    assert RUN[name](none, no_labels).count() == 0


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 1.0]), (2, [1.0, 0.0])]
    got = neighbours.every_hundredth(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 2), (0, 2, 1)]
    assert neighbours.every_hundredth(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_row_keeping_forms(odd, labels):
    for out in (quality_classifier.accepted(odd, labels), line_dedup.deduplicated(odd), jaccard_join.representatives(odd), mixing.mixed_rows(odd)):
        assert out.columns == odd.columns
    assert jaccard_join.representatives(odd).where("doc_id = 6").count() == 0
    assert line_dedup.deduplicated(odd).where(F.col("doc_id") == 6).count() == 0
