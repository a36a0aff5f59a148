"""Spark operators for tomographic image volumes and hand measurements."""
