"""Where rows come from. Every reader is ``(spark, path or table) -> DataFrame``."""
