"""Part of quireflow."""
