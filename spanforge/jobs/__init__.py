"""Jobs to submit to a cluster."""
