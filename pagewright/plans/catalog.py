"""Imports every module that registers queries."""

from pagewright.plans import blueprint_queries, coercion_queries, copy_queries, flow_queries, label_queries, page_queries, planning_queries, record_queries, sink_queries, site_queries, source_queries, store_queries, style_queries, synthesis_queries, text_queries, tree_queries, url_queries  # noqa: F401
