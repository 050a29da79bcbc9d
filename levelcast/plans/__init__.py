"""Named queries; importing the package registers them all."""

from . import bayes_queries, composite_queries, derived_queries, ensemble_queries, model_queries, projection_queries, registry, scan_queries, series_queries, source_queries, text_queries  # noqa: F401
