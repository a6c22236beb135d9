"""Sources and sinks: caption files and the driver's tables, as segment tables."""
