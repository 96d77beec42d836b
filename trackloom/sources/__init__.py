"""Sources and sinks of track data."""
