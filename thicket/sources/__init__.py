"""Where notes come from and where results go."""
