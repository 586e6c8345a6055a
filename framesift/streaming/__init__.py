"""streaming of framesift."""
