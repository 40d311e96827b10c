"""Sources and the row ids of their rows."""
