"""Point-in-time reads: what was knowable at an instant."""
