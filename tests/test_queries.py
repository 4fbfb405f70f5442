"""A few registered queries against their SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [
    "E3_detect_phrases", "P1_is_bracketed_marker", "P4_is_blank_audio", "P5_classify_sound", "P6_categorize_phrase", "P7_strip_blank_markers",
    "P9_drop_unusable_phrases", "P18_build_segment", "A21_join_text", "H4_normalize_word", "H6_fuzzy_match", "J5_align_overlap",
    "E6_merge_same_speaker", "C7_infer_conversation", "C14_reapply_boosting", "C14_switch_enrollments", "J3_pool_frames", "A6_silhouette",
    "T6_phrase_windows", "T1_ordered_chunks", "T8_session_lifecycle", "S15_chunk_stream", "H16_blend_centroid", "C15_job_grid", "A18_speech_content",
    "C1_assign_speakers", "C3_cluster_unknowns", "H15_join_split_markers", "C9_hypothesis_history", "F5_history_tail", "C11_process_audio",
    "C11_process_quick", "C15_process_grid", "J4_slice_audio", "S8_export_job_document", "S12_retain_with_children", "S13_export_raw_chunks",
    "S13_export_transcript_json", "S14_session_tables", "T2_live_speech", "T3_live_pieces", "T6_word_phrases", "T8_timed_sessions", "U1_embed",
]


def canon(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return tuple(map(canon, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(canon(r[c]) for c in columns) for r in df.collect()) == Counter(tuple(canon(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_other_gates_and_rosters_change_labels(spark):
    labels = lambda name: Counter(r.display_label for r in __spark_entry__.queries()[name](spark, SF).collect())
    counts = {r.display_label: r.n for r in __spark_entry__.queries()["C14_reapply_boosting"](spark, SF).collect()}
    assert counts != dict(labels("C7_infer_conversation"))
    switched = __spark_entry__.queries()["C14_switch_enrollments"](spark, SF).collect()
    assert "S0" in labels("C7_infer_conversation") and not any(r.display_label == "S0" for r in switched)
