"""operators of framesift."""
