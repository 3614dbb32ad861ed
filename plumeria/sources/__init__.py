"""Sources and sinks: files of models read in ranges, and containers."""
