"""Session-funnel analytics for web shops, as PySpark DataFrame functions."""
