"""Part of typoforge."""
