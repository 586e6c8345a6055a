"""functions of framesift."""
