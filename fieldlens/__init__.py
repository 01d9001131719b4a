"""DataFrame operators for tracking tables, rerun evaluation and (in ``llm``) training data."""
