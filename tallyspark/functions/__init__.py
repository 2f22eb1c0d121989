"""Part of the disclosure-verification engine."""
