"""fleetlens package."""
