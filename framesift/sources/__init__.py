"""sources of framesift."""
