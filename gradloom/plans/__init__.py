"""Driver-side planning: validation, lowering, initial parameters, placement and topology."""
