"""Registered queries against the same SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from planar import queries

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["q_grid_join", "q_radius_join", "q_pad_neighbors", "q_index_statistics", "q_mutation_fold", "q_extent", "q_geomdb_counts", "q_bounds_projection", "q_classify", "q_clusters", "q_keyword_search", "q_substring_search", "q_reference_search", "q_validate", "q_visible_tiles", "q_lru_cache", "q_char_words", "q_gerber_scan", "q_excellon_scan", "q_kicad_scan", "q_eagle_scan", "q_net_slugs"]
QUICK += ["q_near_topk", "q_hit_test", "q_click_select", "q_visible_objects", "q_validity", "q_net_trace", "q_format_detection", "q_format_inspection", "q_path_contours", "q_contour_segments", "q_technical_totals", "q_text_graphics"]
QUICK += ["q_page_words", "q_safe_index", "q_views", "q_layer_visibility", "q_add_range", "q_primitive_counts", "q_database_summary", "q_search_groups", "q_properties", "q_cross_probe", "q_cluster_metrics", "q_template_match", "q_components", "q_topology_kernel", "q_contours"]
QUICK += ["q_kernel_rectangles", "q_kernel_counters", "q_page_vectors", "q_page_lines", "q_line_inspection"]


def plain(rows):
    return sorted(repr(tuple(x + 0.0 if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL)
    columns = sorted(got.columns)
    found = duck.execute(queries.ORACLES[name])
    own = [d[0] for d in found.description]
    assert sorted(own) == columns
    want = [tuple(r[own.index(c)] for c in columns) for r in found.fetchall()]
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and set(queries.QUERIES) <= set(names)
