"""Named checks, suites of checks and the reports drawn from their findings."""
