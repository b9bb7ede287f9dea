"""DataFrame operators over the catalogue."""
