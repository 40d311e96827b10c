"""No streaming operators: provenance is captured for batch queries only."""
