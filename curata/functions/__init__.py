"""Part of curata."""
