"""Multi-step plans: staged tables and whole evaluations."""
