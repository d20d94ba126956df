"""Plan shapes that Catalyst does not derive by itself."""
