"""Reading, annotating and composing Catalyst plans."""
