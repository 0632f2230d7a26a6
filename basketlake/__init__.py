"""Daily price, store and promotion files of supermarket chains as Spark tables.

Layers: landed files -> raw rows (all text) -> typed rows -> latest-state and history tables -> quality checks.
"""
