"""Part of tierview."""
