"""plans of framesift."""
