"""Where signals and findings come from and go to."""
