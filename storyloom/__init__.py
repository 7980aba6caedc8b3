"""Storyloom: a Spark-first engine for news-like text streams."""
