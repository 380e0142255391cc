"""Plans: operators composed into whole jobs (validation, registry, history, reports)."""
