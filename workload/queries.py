"""Import every query module, so that the registry is complete."""

from workload import model_queries, outlier_queries, report_queries, series_queries, source_queries, tables_queries  # noqa: F401
