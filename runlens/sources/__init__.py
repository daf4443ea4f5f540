"""Sources and sinks of evidence: capsules, structured text, content-addressed files."""
