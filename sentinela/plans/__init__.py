"""Report, prompt and audit assembly: one row per report."""
