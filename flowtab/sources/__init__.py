"""flowtab.sources."""
