"""Part of the lodeseek package."""
