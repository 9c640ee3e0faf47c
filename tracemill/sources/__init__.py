"""Where data comes from and goes to: traces, CSV results, metadata tables."""
