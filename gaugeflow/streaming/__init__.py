"""The same features and rules on streams."""
