"""The incremental load as a stream of export files."""
