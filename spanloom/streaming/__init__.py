"""The engine on streams."""
