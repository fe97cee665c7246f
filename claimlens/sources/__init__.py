"""Sources and sinks: CSV staging scan, star-schema loads, fixtures, exports."""
