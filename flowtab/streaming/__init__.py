"""flowtab.streaming."""
