"""Point-in-time panels and cross-sectional factor research as DataFrame operators."""
