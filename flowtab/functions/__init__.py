"""flowtab.functions."""
