"""DataFrame-first analytics: pipeline file reconciliation, partner onboarding
status, contribution totals and binary-outcome survey models."""
