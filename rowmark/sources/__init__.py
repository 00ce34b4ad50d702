"""Readers, row positions, fingerprints, annotation bundles and packed bundles."""
