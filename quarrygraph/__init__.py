"""A PySpark engine for evidence graphs, with operators for training-data pipelines beside it."""
