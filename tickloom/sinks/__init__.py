"""Writers: replace, partition overwrite, backfill, insert-if-absent, each published whole."""
