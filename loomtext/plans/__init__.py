"""Settings, pipelines and the query catalogue."""
