"""Where rows go. Writers take ``(df, target, ...)``."""
