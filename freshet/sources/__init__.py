"""Where definitions and rows come from and go to as files."""
