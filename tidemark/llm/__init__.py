"""Operators for preparing training corpora: scoring, fingerprints, dedup, tokens, archives."""
