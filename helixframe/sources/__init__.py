"""sources of helixframe."""
