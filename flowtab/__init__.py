"""Spark operators for image-flow data pipelines: pairing, ordering, noising, scoring, metrics."""
