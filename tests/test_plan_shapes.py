"""Plans keep the shape they were built for: shuffles, pushed-down columns, no Python."""

import contextlib
import io
import re

import pytest

from sonargrid.plans import registry


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name,shuffles", [("vote_pad_merge", 1), ("merge_intervals", 1), ("subtract_intervals", 3), ("binarize_frames", 1), ("asof_join", 2)])
def test_shuffles(spark, tables, name, shuffles):
    text = plan(registry.QUERIES[name](spark, tables[0]))
    assert len(re.findall("Exchange hash", text)) <= shuffles and "SinglePartition" not in text and not re.search("Python|Pandas|Arrow", text)


def test_scans_read_only_what_they_need(spark, tables):
    text = plan(registry.QUERIES["total_duration"](spark, tables[0]))
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>", text)


def test_filters_reach_the_scan(spark, tables):
    text = plan(registry.QUERIES["points_in_intervals"](spark, tables[0]))
    assert "EqualTo(event_type,click)" in text


@pytest.mark.parametrize("name", ["token_hits", "word_speakers"])
def test_rows_that_grow_in_the_query_are_not_broadcast(spark, tables, name):
    assert "Broadcast" not in plan(registry.QUERIES[name](spark, tables[0]))


def test_windows_of_a_manifest_are_not_broadcast(spark, tables, monkeypatch):
    from sonargrid.plans import source_queries

    found, write = [], source_queries.fm.write_json_lines
    monkeypatch.setattr(source_queries.fm, "write_json_lines", lambda df, *a, **b: (found.append(plan(df)), write(df, *a, **b)))
    source_queries.embedding_manifest(spark, tables[0])
    assert found and "Broadcast" not in found[0]
