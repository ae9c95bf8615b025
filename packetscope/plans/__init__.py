"""Multi-step plans: numbering, splitting, reports."""
