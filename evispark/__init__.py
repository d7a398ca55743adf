"""Evidence analytics as DataFrame plans."""
