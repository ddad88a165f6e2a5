"""Sources and sinks: test-data views, catalog scans, exports."""
