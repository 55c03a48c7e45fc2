"""The ordered operators as streams."""
