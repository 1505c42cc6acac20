"""Files to documents, model answers to mentions, and the workspace of tables."""
