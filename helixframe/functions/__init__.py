"""functions of helixframe."""
