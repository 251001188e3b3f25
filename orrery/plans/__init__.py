"""What plans share: written tables."""
