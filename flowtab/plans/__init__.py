"""flowtab.plans."""
