"""flowtab.operators."""
