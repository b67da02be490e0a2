"""Sources and sinks (S1-S8) and the binding of the driver test tables."""
