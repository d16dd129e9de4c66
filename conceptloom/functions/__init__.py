"""Part of conceptloom."""
