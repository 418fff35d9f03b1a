"""Typed readers, schema declarations, fingerprints and run bookkeeping."""
