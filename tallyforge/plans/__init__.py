"""Named queries by area: each module has QUERIES (name to callable of session and folder) and SQL (name to text)."""

from tallyforge.plans import asof_queries, book_queries, feed_queries, function_queries, inflation_queries, parser_queries, pick_queries, refdata_queries, report_queries, score_queries, search_queries, series_queries, stream_queries, tree_queries, walk_queries

MODULES = (asof_queries, book_queries, feed_queries, function_queries, inflation_queries, parser_queries, pick_queries, refdata_queries, report_queries, score_queries, search_queries, series_queries, stream_queries, tree_queries, walk_queries)
