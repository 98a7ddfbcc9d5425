"""Play-history analytics as DataFrame-to-DataFrame functions."""
