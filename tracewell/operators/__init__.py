"""Operators over blocks: traces, interventions, explanations."""
