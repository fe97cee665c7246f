"""KPI queries, summary views and data-quality checks."""
