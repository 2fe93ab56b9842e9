"""Reading corpora and writing bundles."""
