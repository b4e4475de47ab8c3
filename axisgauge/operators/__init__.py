"""Jobs on measurement tables: geometry, baselines, statistics, judges, audits."""
