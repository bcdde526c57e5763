"""Jobs composed of operators: what is due, in which order, rebuild, re-plan."""
