"""Part of earshot."""
