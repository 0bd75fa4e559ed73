"""Compositions: data preparation, model evaluation, uplift study, and the pages of the dashboard."""
