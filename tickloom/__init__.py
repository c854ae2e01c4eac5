"""Market-data pipelines as Spark jobs: landing, tables, labels, model weights, positions and PnL."""
