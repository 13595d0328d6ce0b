"""functions of the trace engine."""
